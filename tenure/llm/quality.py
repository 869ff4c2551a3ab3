"""Quality classifier: hashed word n-grams, logistic regression, FTRL updates.

Features of a text are its words and pairs of neighbouring words, each also
in the form of its shape (letters, capitals, digits and marks, runs collapsed),
hashed to ``2**bits`` weights and counted; the counts are scaled to length one.
A pair of equal words has a feature of its own, whatever the word.  Weights are
learnt with follow-the-regularised-leader (proximal) steps, one labelled text
at a time, on a bounded sample of labelled texts; a score is the logistic
function of one sparse dot product.

``max_rows`` (a documented bound on training, not on scoring) limits the
labelled rows that are learnt from; they are picked by a hash of the id.

Defined results for odd input: a null text is an empty one, which has no
features and gets the score of the bias alone; a document without an id is
scored and never learnt from; repeated rows are scored one by one; several
labels of one id count as the largest; null labels are ignored; without
training rows every score is 0.5; extra columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import WHITE, cut, small_batches
from tenure.llm.wordhash import U64, chunks, hash_words, mix

FOLDS = 5
THRESHOLD = 0.3


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 5; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


# --- features -------------------------------------------------------------------------------

#: Class of every byte for word shapes: capital, small letter or part of a wider character, digit; marks stay themselves.
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


def _collapse(texts: list[bytes]) -> list[bytes]:
    """Texts with every word as its shape: runs of one class become one byte."""
    buf = np.frombuffer(b"\n".join(t.translate(_SHAPE) for t in texts) + b"\n", np.uint8)
    keep = np.ones(len(buf), bool)
    keep[1:] = (buf[1:] != buf[:-1]) | np.isin(buf[1:], np.frombuffer(WHITE, np.uint8))
    ends = np.cumsum([len(t) + 1 for t in texts])
    keep[ends - 1] = True
    out, new_ends = buf[keep].tobytes(), np.cumsum(keep)[ends - 1]
    return [out[a:b - 1] for a, b in zip(np.concatenate(([0], new_ends[:-1])), new_ends)]


def _grams(texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes of the features and, for each, the text that it belongs to."""
    hashes, owners = [], []
    for salt, forms in ((U64(1), texts), (U64(2), _collapse(texts))):
        h, at = hash_words(forms)
        owner = np.repeat(np.arange(len(forms)), np.diff(at))
        with np.errstate(over="ignore"):
            hashes.append(mix(h + salt))
            owners.append(owner)
            if len(h) > 1:
                same = owner[1:] == owner[:-1]
                pair = mix(h[:-1] * U64(3) + h[1:] * U64(0x9E3779B97F4A7C15) + salt)
                if salt == 1:
                    pair = np.where(h[1:] == h[:-1], U64(0x1D8AF066), pair)
                hashes.append(pair[same])
                owners.append(owner[1:][same])
    return hashes, owners


def sparse_rows(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of every non-zero feature, ordered by text and feature; values of a text have length one."""
    hashes, owners = _grams(texts)
    key = (np.concatenate(owners).astype(U64) << U64(bits)) | (np.concatenate(hashes) >> U64(64 - bits))
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    counts = np.diff(np.append(first, len(key))).astype(float)
    key = key[first]
    owner, feature = (key >> U64(bits)).astype(np.int64), (key & U64((1 << bits) - 1)).astype(np.int64)
    norm = np.sqrt(np.bincount(owner, counts * counts, len(texts)))
    return owner, feature, counts / norm[owner]


# --- training -------------------------------------------------------------------------------

def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int, epochs: int = 3,
         alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> np.ndarray:
    """Weights after ``epochs`` passes of FTRL-proximal over (features, values) rows; the last weight is the bias."""
    n_feat = 1 << bits
    z, n = np.zeros(n_feat + 1), np.zeros(n_feat + 1)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for (feature, value), y in zip(rows, labels):
            i, x = np.append(feature, n_feat), np.append(value, 1.0)
            w = weights(i)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(n_feat + 1))


def _trainer(bits: int):
    def train(batches) -> Iterator:
        import pyarrow as pa
        rows, labels = [], []
        for batch in batches:
            texts, y = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            labels += y
            for _, run in chunks(texts):
                owner, feature, value = sparse_rows(run, bits)
                at = np.searchsorted(owner, np.arange(len(run) + 1))
                rows += [(feature[a:b].astype(np.int32), value[a:b].astype(np.float32)) for a, b in zip(at, at[1:])]
        if rows:
            w = ftrl(rows, np.array(labels, float), bits)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["feature", "weight"])
    return train


def fit(documents: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text",
        id_col: str = "doc_id", bits: int = 18, max_rows: int = 8192) -> np.ndarray:
    """Learn weights from at most ``max_rows`` labelled rows whose fold is not 0.

    Ids are picked in hash order; equal texts of an id are one row, and of the rows
    of the picked ids the first ``max_rows`` in that order are learnt from, however
    many texts an id has."""
    order = F.xxhash64(id_col)
    picked = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(F.col(id_col)) != 0))
              .groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
              .orderBy(order, id_col).limit(max_rows))
    # At most max_rows ids and rows: proven bounds for the broadcast and for the one task that learns in order.
    rows = (documents.select(id_col, F.col(text_col).cast("string").alias("_text"))
            .join(F.broadcast(cut(picked)), id_col)
            .withColumn("_key", F.xxhash64("_text")).dropDuplicates([id_col, "_key"])
            .orderBy(order, id_col, "_key").limit(max_rows)
            .repartition(1).sortWithinPartitions(order, id_col, "_text").select("_text", "_y"))
    w = np.zeros((1 << bits) + 1)
    for r in rows.transform(small_batches).mapInArrow(_trainer(bits), "feature long, weight double").collect():  # 2**bits + 1 rows at most
        w[r.feature] = r.weight
    return w


# --- scoring --------------------------------------------------------------------------------

def score_texts(texts: list[bytes], w: np.ndarray) -> np.ndarray:
    bits = (len(w) - 1).bit_length() - 1
    owner, feature, value = sparse_rows(texts, bits)
    dot = np.bincount(owner, w[feature] * value, len(texts)) + w[-1]
    return 1.0 / (1.0 + np.exp(-np.clip(dot, -35, 35)))


def score(documents: DataFrame, weights: np.ndarray, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``documents`` with the score (0 to 1) of every whole text, in one pass without a shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(weights)
    k = documents.columns.index(text_col)
    from pyspark.sql.types import DoubleType, StructType
    schema = StructType([*documents.schema.fields]).add(score_col, DoubleType())

    def run(batches) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            got = [score_texts(run, shared.value) for _, run in chunks(batch.column(k).to_pylist())]
            out = pa.array(np.concatenate(got) if got else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, score_col])
    return documents.transform(small_batches).mapInArrow(run, schema)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **fit_args) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, with weights learnt from ``labels``."""
    w = fit(documents, labels, **fit_args)
    return (score(documents.select("doc_id", F.col("text").cast("string").alias("text")), w)
            .select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
