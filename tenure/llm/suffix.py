"""Repeated passages with a sparse suffix array.

Texts are sequences of words (ASCII white space apart).  Only suffixes at
minimiser positions are kept: of every ``min_words - gram + 1`` neighbouring
word positions the one (with equals, all) whose ``gram`` next words hash
lowest.  The choice depends on content alone, and every passage of
``min_words`` words holds the ``gram`` words of a position chosen in all of
its copies, so a repeated passage meets itself in the array.

1. Positions are hashed in one pass; those whose gram occurs once go.
2. The others get their context: the words after the gram (up to
   ``min_words`` from the position) and the ``gram`` words before it.
3. These suffixes are sorted over the whole cluster by gram and following
   words, and with equal ones by the words before, read backwards.  The sort ends in document and position, so a passage that a third of
   all documents hold is spread over many tasks.  Every suffix is compared
   with its ``reach`` nearest neighbours on both sides; the first and last
   suffixes of every task are compared once more with those of the next task.
4. A pair's match is extended right and left word by word; at least
   ``min_words`` in all make a hit.  Overlapping hits of a document are merged,
   which puts long passages together from one hit per chosen position.

Groups of up to ``reach + 1`` suffixes are thus compared completely; in larger
ones each suffix meets those with which it shares the longest continuation.
The rest of those is found exactly: every passage of ``min_words`` words whose
lowest gram (the same in all its copies) is such a group's is hashed as a whole,
and those met in two ids are hits.  The grams, and then the hashes met in two
ids, go to a second and third pass over the texts as bits of a filter, so that
only passages that may count are shuffled.

Defined results for odd input: null, empty and short texts hold no passage; a
row without an id is left out; rows with equal id and text are one document; a
passage repeated only within one id is not reported; empty input gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import cut, free_name, shared_folder, small_batches
from tenure.llm.wordhash import U64, chunks, hash_words, mix

_GRAM_BASE = 0xD6E8FEB86659FD93
_GRAM_INVERSE = pow(_GRAM_BASE, -1, 1 << 64)
SPANS = "doc_id long, start_word long, end_word long, ref_doc long"


def _grams(h: np.ndarray, at: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the ``gram`` words from every word on, whether they all lie in the word's text)."""
    n = len(h)
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.concatenate(([U64(1)], np.full(max(0, n - 1), _GRAM_BASE, U64))))[:n]
        down = np.multiply.accumulate(np.concatenate(([U64(1)], np.full(max(0, n - 1), _GRAM_INVERSE, U64))))[:n]
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(h * up, dtype=U64)))
        end = np.minimum(np.arange(n) + gram, n)
        g = mix((sums[end] - sums[:n]) * down)
    last = np.repeat(at[1:], np.diff(at))
    return g, np.arange(n) + gram <= last


def _sliding(x: np.ndarray, window: int, pad, pick) -> np.ndarray:
    """pick over x[i:i + window] by doubling."""
    n, size, y = len(x), 1, x
    while size * 2 <= window:
        y = pick(y, np.concatenate((y[size:], np.full(size, pad, x.dtype)))[:n])
        size *= 2
    rest = window - size
    return pick(y, np.concatenate((y[rest:], np.full(rest, pad, x.dtype)))[:n]) if rest else y


def minimisers(h: np.ndarray, at: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(chosen word positions, hashes of their grams) of texts given as word hashes ``h`` cut at ``at``."""
    if len(h) < gram + window - 1:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    g, whole = _grams(h, at, gram)
    n, big = len(g), ~U64(0)
    g = np.where(whole, g, big)
    low = _sliding(g, window, big, np.minimum)
    inside = np.concatenate((whole[window - 1:], np.zeros(window - 1, bool)))  # the window's last position has a whole gram ...
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ends = np.minimum(np.arange(n) + window - 1, n - 1)
    inside &= text[ends] == text  # ... of the same text
    low = np.where(inside, low, 0)
    # A position is chosen if it is the lowest of some window that holds it: the highest of their lows.
    highest = _sliding(low[::-1], window, U64(0), np.maximum)[::-1]
    chosen = np.flatnonzero((highest == g) & whole)
    return chosen, g[chosen]


def _positions(gram: int, window: int):
    def run(batches) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, texts in chunks(batch.column(2).to_pylist()):
                h, at = hash_words(texts)
                pos, g = minimisers(h, at, gram, window)
                doc = np.searchsorted(at, pos, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), pa.array(ids[first + doc]), pa.array(hashes[first + doc]),
                     pa.array((pos - at[doc]).astype(np.int32))], names=["g", "doc", "version", "pos"])
    return run


_SEGMENT = 16  # a task fills 2 ** 16 bits at a time


def _fill(batches) -> Iterator:
    """(segment, its bits) of sorted bit numbers; a segment's numbers are in one task."""
    import pyarrow as pa
    now, bits = None, np.zeros(0, np.uint8)

    def segment():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([bits.tobytes()], pa.binary())], names=["segment", "bits"])
    for batch in batches:
        b = batch.column(0).to_numpy()
        for x in np.split(b, np.flatnonzero(np.diff(b >> _SEGMENT)) + 1) if len(b) else ():
            if now != int(x[0]) >> _SEGMENT:
                if now is not None:
                    yield segment()
                now, bits = int(x[0]) >> _SEGMENT, np.zeros(1 << _SEGMENT - 3, np.uint8)
            x = x & (1 << _SEGMENT) - 1
            np.bitwise_or.at(bits, x >> 3, (1 << (x & 7)).astype(np.uint8))
    if now is not None:
        yield segment()


def _filter_of(keys: DataFrame, n: int) -> np.ndarray:
    """Bits of the ``n`` hashes in the only column: eight a key, at most 128 MB.  A miss is sure, a hit is not."""
    size = min(30, max(_SEGMENT, (8 * n - 1).bit_length()))
    bits = np.zeros(1 << size - 3, np.uint8)
    at = F.col(keys.columns[0]).bitwiseAND(F.lit((1 << size) - 1).cast("long")).alias("at")
    parts = (keys.select(at).repartition(F.shiftright("at", _SEGMENT)).sortWithinPartitions("at")
             .mapInArrow(_fill, "segment long, bits binary"))
    for r in parts.toLocalIterator():
        bits[r.segment << _SEGMENT - 3:r.segment + 1 << _SEGMENT - 3] = np.frombuffer(r.bits, np.uint8)
    return bits


def _held(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = x & U64(8 * len(bits) - 1)
    return (bits[at >> U64(3)] >> (at & U64(7)).astype(np.uint8) & 1).astype(bool)


def _windows(gram: int, min_words: int, hot, repeated=None):
    """(hash, document, start) of every passage of ``min_words`` words whose lowest gram is in ``hot``, itself in ``repeated``."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, texts in chunks(batch.column(1).to_pylist()):
                h, at = hash_words(texts)
                if len(h) < min_words:
                    continue
                low = _sliding(_grams(h, at, gram)[0], min_words - gram + 1, ~U64(0), np.minimum)
                w, whole = _grams(h, at, min_words)
                start = np.flatnonzero(whole & _held(hot.value, low))
                if repeated is not None:
                    start = start[_held(repeated.value, w[start])]
                doc = np.searchsorted(at, start, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(w[start].view(np.int64)), pa.array(ids[first + doc]),
                                                  pa.array((start - at[doc]).astype(np.int32))], names=["w", "doc", "start"])
    return run


def _runs(min_words: int):
    """Hits of windows that follow each other in a document as one."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            doc, start, lo, hi = (batch.column(k).to_numpy() for k in range(4))
            if not len(doc):
                continue
            edge = np.concatenate(([0], np.flatnonzero((doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)) + 1))
            last = np.concatenate((edge[1:], [len(doc)])) - 1
            ref = np.minimum.reduceat(np.where(lo != doc, lo, hi), edge)
            yield pa.RecordBatch.from_arrays([pa.array(doc[edge]), pa.array(start[edge]), pa.array((start[last] + min_words).astype(np.int32)),
                                              pa.array(ref)], names=["doc", "start", "end", "ref"])
    return run


def _exact(rows: DataFrame, hot: DataFrame, gram: int, min_words: int) -> DataFrame | None:
    """Hits of all passages of ``min_words`` words whose lowest gram is one of ``hot``, in whatever order they stand."""
    share = rows.sparkSession.sparkContext.broadcast
    n = hot.count()
    if not n:
        return None
    texts, out = rows.select("doc", "text").transform(small_batches), "w long, doc long, start int"
    bits = share(_filter_of(hot, n))
    groups = cut(texts.mapInArrow(_windows(gram, min_words, bits), out).groupBy("w")
                 .agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo <> hi"))
    n = groups.count()
    if not n:
        return None
    found = texts.mapInArrow(_windows(gram, min_words, bits, share(_filter_of(groups.select("w"), n))), out)
    return (found.join(groups, "w").select("doc", "start", "lo", "hi").transform(small_batches)
            .mapInArrow(_runs(min_words), "doc long, start int, end int, ref long"))


SUFFIX = "g long, after binary, n_after int, before binary, n_before int, doc long, version long, pos int"


def _fixed(x: np.ndarray):
    import pyarrow as pa
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())


def _contexts(gram: int, min_words: int):
    def run(batches) -> Iterator:
        import pyarrow as pa
        more = min_words - gram
        for batch in batches:
            ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            wanted = batch.column(3).to_pylist()
            for first, texts in chunks(batch.column(2).to_pylist()):
                h, at = hash_words(texts)
                if not len(h):
                    continue
                g, _ = _grams(h, at, gram)
                count = np.array([len(wanted[first + k]) for k in range(len(texts))])
                doc = np.repeat(np.arange(len(texts)), count)
                pos = np.concatenate([np.sort(wanted[first + k]) for k in range(len(texts))]).astype(np.int64)
                p = at[doc] + pos
                short = (h >> U64(32)).astype(np.uint32)
                for a in range(0, len(p), 1 << 14):
                    s = slice(a, a + (1 << 14))
                    after = p[s, None] + gram + np.arange(more)
                    before = p[s, None] - 1 - np.arange(gram)
                    ok_a, ok_b = after < at[doc[s] + 1][:, None], before >= at[doc[s]][:, None]
                    w_a = np.where(ok_a, short[np.minimum(after, len(h) - 1)], 0).astype(np.uint32)
                    w_b = np.where(ok_b, short[np.maximum(before, 0)], 0).astype(np.uint32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g[p[s]].view(np.int64)), _fixed(w_a), pa.array(ok_a.sum(1).astype(np.int32)), _fixed(w_b),
                         pa.array(ok_b.sum(1).astype(np.int32)), pa.array(ids[first + doc[s]]), pa.array(versions[first + doc[s]]),
                         pa.array(pos[s].astype(np.int32))], names=[c.split()[0] for c in SUFFIX.split(", ")])
    return run


def _common(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows, at most what both have."""
    same = a == b
    return np.minimum(np.where(same.all(1), a.shape[1], same.argmin(1)), np.minimum(na, nb))


class Neighbours:
    """Sorted suffixes as columns, compared with their neighbours."""

    def __init__(self, gram: int, min_words: int, reach: int):
        self.gram, self.min_words, self.reach = gram, min_words, reach

    def columns(self, batch) -> list[np.ndarray]:
        import pyarrow as pa
        out = []
        for k, width in enumerate((0, self.min_words - self.gram, 0, self.gram, 0, 0, 0, 0)):
            c = batch.column(k)
            if width:
                c = c.cast(pa.binary(4 * width))
                raw = np.frombuffer(c.buffers()[1], np.uint32)
                out.append(raw[c.offset * width:(c.offset + len(c)) * width].reshape(len(c), width))
            else:
                out.append(c.to_numpy())
        return out

    def hits(self, c: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, words to the left, words to the right, id of a partner) of every suffix with a hit."""
        g, after, n_after, before, n_before, doc = c[:6]
        n = len(g)
        left, right, ref = np.full(n, -1), np.full(n, -1), np.zeros(n, np.int64)

        def compare(i, j):
            ok = (g[i] == g[j]) & (doc[i] != doc[j])
            i, j = i[ok], j[ok]
            r = self.gram + _common(after[i], after[j], n_after[i], n_after[j])
            l = _common(before[i], before[j], n_before[i], n_before[j])  # noqa: E741
            hit = l + r >= self.min_words
            i, j, l, r = i[hit], j[hit], l[hit], r[hit]  # noqa: E741
            for x, y in ((i, j), (j, i)):
                np.maximum.at(left, x, l)
                np.maximum.at(right, x, r)
                ref[x] = doc[y]
        every = np.arange(n)
        for d in range(1, min(self.reach, n - 1) + 1):
            compare(every[:-d], every[d:])
        # A text that repeats itself may fill the reach: its suffixes go on to the neighbours outside.
        edge = np.flatnonzero((doc[1:] != doc[:-1]) | (g[1:] != g[:-1])) + 1
        start = np.repeat(np.concatenate(([0], edge)), np.diff(np.concatenate(([0], edge, [n])))) if n else every
        stop = np.repeat(np.concatenate((edge, [n])), np.diff(np.concatenate(([0], edge, [n])))) if n else every
        inside = np.flatnonzero(stop - start >= self.reach)
        for d in range(self.reach):
            i = inside[stop[inside] + d < n]
            compare(i, stop[i] + d)
            i = inside[start[inside] - 1 - d >= 0]
            compare(i, start[i] - 1 - d)
        row = np.flatnonzero(left >= 0)
        return row, left[row], right[row], ref[row]


FOUND = SUFFIX + ", kind int, start int, end int, ref long"


def _compare(nb: Neighbours):
    """Hits (kind 0) of a task's sorted suffixes, and the suffixes at its ends (kind 1)."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        names = [c.split()[0] for c in FOUND.split(", ")]
        types = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]

        def hit_batch(c):
            row, left, right, ref = nb.hits(c)
            n, pos = len(row), c[7][row]
            none = [pa.nulls(n, t) for t in types[:5]]
            return pa.RecordBatch.from_arrays(
                [*none, pa.array(c[5][row]), pa.array(c[6][row]), pa.array(pos.astype(np.int32)), pa.array(np.zeros(n, np.int32)),
                 pa.array((pos - left).astype(np.int32)), pa.array((pos + right).astype(np.int32)), pa.array(ref)], names=names)

        def end_batch(c):
            n = len(c[0])
            cols = [pa.array(c[0]), _fixed(c[1]), pa.array(c[2]), _fixed(c[3]), pa.array(c[4]), pa.array(c[5]), pa.array(c[6]), pa.array(c[7])]
            return pa.RecordBatch.from_arrays([*cols, pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()),
                                               pa.nulls(n, pa.int64())], names=names)
        rest = None
        first = True
        for batch in batches:
            c = nb.columns(batch)
            if not len(c[0]):
                continue
            if first:
                yield end_batch([x[:nb.reach] for x in c])
                first = False
            if rest is not None:
                c = [np.concatenate(x) for x in zip(rest, c)]
            yield hit_batch(c)
            other = np.flatnonzero((c[5] != c[5][-1]) | (c[0] != c[0][-1]))  # a whole run of one text, and reach before it
            keep = len(c[0]) - (int(other[-1]) + 1 if len(other) else 0) + nb.reach
            rest = [x[-keep:].copy() for x in c]
        if rest is not None:
            yield end_batch([x[-nb.reach:] for x in rest])
    return run


def _merge(batches) -> Iterator:
    """One row per maximal run of overlapping or touching hits of a document."""
    import pyarrow as pa
    for batch in batches:
        rows = []
        for doc, hits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            spans: list[list] = []
            for h in sorted((x["start"], x["end"], x["ref"]) for x in hits):
                if spans and h[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], h[1])
                    spans[-1][2] = min(spans[-1][2], h[2])
                else:
                    spans.append(list(h))
            rows += [(doc, *s) for s in spans]
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start_word", "end_word", "ref_doc"])


def repeated_passages(documents: DataFrame, min_words: int = 50, gram: int = 25, reach: int = 8, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Maximal passages of at least ``min_words`` words that another id holds too.

    One row each: doc_id, first word, word after the last (counted from 0), and
    the smallest id among the partners met.
    """
    spark = documents.sparkSession
    text = F.col(text_col).cast("string")
    rows = (documents.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))
            .filter("doc IS NOT NULL AND text IS NOT NULL"))
    folder = shared_folder(spark, "suffixes")
    rows.transform(small_batches).mapInArrow(_positions(gram, min_words - gram + 1), "g long, doc long, version long, pos int").write.parquet(f"{folder}/positions")
    chosen = spark.read.parquet(f"{folder}/positions")
    twice = cut(chosen.groupBy("g").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("n"))
                .filter("lo <> hi").select("g", (F.col("n") > reach + 1).alias("hot")))
    wanted = (chosen.join(twice, "g", "left_semi").groupBy("doc", "version")
              .agg(F.collect_set("pos").alias("wanted")))  # at most a text's own positions
    texts = (rows.join(wanted, ["doc", "version"]).groupBy("doc", "version")
             .agg(F.first("text").alias("text"), F.first("wanted").alias("wanted")))
    key = ["g", "after", "before", "doc", "pos"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    suffixes = texts.transform(small_batches).mapInArrow(_contexts(gram, min_words), SUFFIX)
    nb = Neighbours(gram, min_words, reach)
    found = cut(suffixes.repartitionByRange(n, *key).sortWithinPartitions(*key).transform(small_batches).mapInArrow(_compare(nb), FOUND))
    # The ends of all tasks: at most 2 * reach rows per task, in order in one task.
    ends = (found.filter("kind = 1").select(*[c.split()[0] for c in SUFFIX.split(", ")]).distinct()
            .repartition(1).sortWithinPartitions(*key).transform(small_batches).mapInArrow(_compare(nb), FOUND).filter("kind = 0"))
    hits = found.filter("kind = 0").union(ends).select("doc", "start", "end", "ref")
    exact = _exact(rows, twice.filter("hot").select("g"), gram, min_words)
    hits = hits if exact is None else hits.union(exact)
    return (hits.groupBy("doc").agg(F.collect_list(F.struct("start", "end", "ref")).alias("hits"))
            .transform(small_batches).mapInArrow(_merge, SPANS))


def without_passages(documents: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with every repeated passage cut out of the texts that hold
    it, except the smallest id it was met in.  White space around a cut stays;
    rows without an id or passage are unchanged, and so are those whose id occurs
    with different texts: a span doesn't say which of them it counts words in."""
    import re
    word = re.compile(r"[^ \t\n\x0b\x0c\r]+")
    doc, gone = free_name(documents, "_doc"), free_name(documents, "_gone")
    cuts = (spans.filter("ref_doc < doc_id").groupBy(F.col("doc_id").alias(doc))
            .agg(F.collect_list(F.struct("start_word", "end_word")).alias(gone)))  # at most a text's own spans
    key = F.xxhash64(F.col(text_col).cast("string"))
    unclear = (documents.groupBy(F.col(id_col).cast("long").alias(doc)).agg(F.min(key).alias("low"), F.max(key).alias("high"))
               .filter("low <> high").select(doc))
    cuts = cuts.join(unclear, doc, "left_anti")
    joined = documents.join(cuts, documents[id_col].cast("long") == F.col(doc), "left").drop(doc)
    at, gone_at, names = joined.columns.index(text_col), joined.columns.index(gone), documents.columns

    def shorten(text: str, drop) -> str:
        words = [m.span() for m in word.finditer(text)]
        for s in sorted(drop, key=lambda s: -s["start_word"]):
            if s["start_word"] < len(words):
                text = text[:words[s["start_word"]][0]] + text[words[min(s["end_word"], len(words)) - 1][1]:]
        return text

    def run(batches) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            texts = [t if not d or t is None else shorten(t, d)
                     for t, d in zip(batch.column(at).to_pylist(), batch.column(gone_at).to_pylist())]
            cols = [c for k, c in enumerate(batch.columns) if k != gone_at]
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return joined.transform(small_batches).mapInArrow(run, documents.schema)
