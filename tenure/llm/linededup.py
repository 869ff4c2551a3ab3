"""Repeated lines found with levelled sorted runs of line hashes.

The store keeps every line key seen so far in exactly one sorted run, with the
number of documents of its batch that hold it and the largest of their ids.  A new
batch is aggregated by key and merge-anti-joined with the runs: first-seen keys
become a run of their own at level 0, known ones only an entry in the list of
updates.  As soon as a level has ``fanout`` runs they are compacted into one run
of the next level, so a key is rewritten about log(batches) times and a look-up
reads few runs.  Runs are bucketed by key: a join with one never moves it.  At the
end a key's count is that of its run and its updates; keys without updates,
most lines of a corpus, are not aggregated again.

A key is a line without the white space at its ends and in lower case (A-Z),
hashed to 128 bits; only keys of at least ``min_chars`` code points count.
Every key found in at least ``min_docs`` documents loses all its lines except
those in the largest id that holds it.

Defined results for odd input: a null or empty text is one empty line; a row
without an id neither counts nor loses lines; rows that share an id are one
document (each counts once, and all lose or keep the same keys); a text of
which every line goes becomes empty; extra columns pass through untouched;
empty input gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from tenure.llm.common import WHITE, cut, free_name, shared_folder, small_batches

RUN_SCHEMA = "h binary, n_docs long, max_doc long"


def key_hash(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the line's key; None if the key is too short to count."""
    from xxhash import xxh3_128_digest
    key = line.strip(WHITE).lower()
    if len(key) < min_chars or len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxh3_128_digest(key)


def line_keys(documents: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, doc): the distinct keys of every row that has an id."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            hs, docs = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {key_hash(x, min_chars) for x in text.encode().split(b"\n") if len(x) >= min_chars} - {None}
                hs += own
                docs += [doc] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.binary()), pa.array(docs, pa.int64())], names=["h", "doc"])
    rows = (documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
            .filter("doc IS NOT NULL AND text IS NOT NULL"))
    return rows.transform(small_batches).mapInArrow(run, "h binary, doc long")


class LineRuns:
    """The store: levels of sorted, bucketed runs under a shared folder, and updates of their keys."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = 3, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.folder = folder or shared_folder(spark, "lines")
        # as many buckets as a shuffle has partitions: then only a batch's side of a join is dealt
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.updates: list[str] = []
        self.written = 0

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _write(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"run_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h")
         .option("path", f"{self.folder}/run-{self.written:05d}-level{level}").saveAsTable(name))
        self.written += 1
        self.levels[level].append(name)

    def fresh(self, counted: DataFrame) -> DataFrame:
        """The rows of ``counted`` whose key no run holds (a sort-merge anti join with each run)."""
        for run in self.runs():
            counted = counted.join(run.select("h").hint("merge"), "h", "left_anti")
        return counted

    def known(self, counted: DataFrame) -> DataFrame:
        """The rows of ``counted`` whose key a run holds."""
        found = [counted.join(run.select("h").hint("merge"), "h", "left_semi") for run in self.runs()]
        return reduce(DataFrame.unionByName, found, counted.limit(0))

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (h, doc) rows; a document must not come in two batches."""
        counted = batch.distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("max_doc"))
        if self.runs():
            counted = cut(counted)
            path = f"{self.folder}/updates-{self.written:05d}"
            self.known(counted).write.parquet(path)
            self.updates.append(path)
        self._write(self.fresh(counted), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            # no key is in two runs: runs are merged without an aggregation
            self._write(reduce(DataFrame.unionByName, [self.spark.table(n) for n in full]), level + 1)
            self._drop(full)
            level += 1

    def totals(self) -> DataFrame:
        """(h, n_docs, max_doc) of every key."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], RUN_SCHEMA)
        if not self.updates:
            return reduce(DataFrame.unionByName, runs)
        more = cut(self.spark.read.schema(RUN_SCHEMA).parquet(*self.updates).groupBy("h")
                   .agg(F.sum("n_docs").alias("n_more"), F.max("max_doc").alias("max_more")))
        both = [run.join(more.hint("merge"), "h", "left") for run in runs]
        return reduce(DataFrame.unionByName, both).select(
            "h", (F.col("n_docs") + F.coalesce("n_more", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "max_more").alias("max_doc"))

    def _drop(self, names: list[str]) -> None:
        for n in names:
            self.spark.sql(f"DROP TABLE {n}")

    def close(self) -> None:
        """Forget the runs' names; their files stay in the folder."""
        self._drop([n for level in self.levels for n in level])
        self.levels = []


def _rebuild(schema: StructType, text_at: int, drop_at: int, min_chars: int):
    names = [f.name for f in schema.fields]

    def run(batches) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column(text_at).to_pylist(), batch.column(drop_at).to_pylist()):
                lines = (text or "").encode().split(b"\n")
                kept = lines
                if drop:
                    gone = set(drop)
                    kept = [x for x in lines if len(x) < min_chars or key_hash(x, min_chars) not in gone]
                texts.append(text if len(kept) == len(lines) else b"\n".join(kept).decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            cols = [c for k, c in enumerate(batch.columns) if k != drop_at]
            cols[text_at] = pa.array(texts, cols[text_at].type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=names)
    return run


def dedup_lines(documents: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3,
                id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``documents`` without the repeated lines, with two count columns (lines before, lines dropped).

    Keys are hashed once; batches go by a hash of the document id.  The rows
    of one hot key are narrow and meet only in counts (with map-side partial
    sums) and in a join whose sides both shuffle plainly, which AQE splits.
    """
    spark = documents.sparkSession
    keys = cut(line_keys(documents, min_chars, id_col, text_col)
               .withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches))))
    store = LineRuns(spark, fanout=fanout)
    for k in range(batches):
        store.add(keys.filter(F.col("batch") == k).select("h", "doc"))
    heavy = cut(store.totals().filter(F.col("n_docs") >= min_docs).select("h", "max_doc"))
    store.close()
    lost = (keys.join(heavy, "h").filter("doc <> max_doc").groupBy("doc")
            .agg(F.collect_set("h").alias("gone")))  # at most a document's own lines
    doc, gone = free_name(documents, "_doc"), free_name(documents, "_gone")
    joined = documents.join(lost.select(F.col("doc").alias(doc), F.col("gone").alias(gone)),
                            documents[id_col].cast("long") == F.col(doc), "left").drop(doc)
    text = F.col(text_col).cast("string").alias(text_col)
    joined = joined.select(*[text if c == text_col else c for c in documents.columns], gone)
    schema = StructType([f for f in joined.schema.fields if f.name != gone])
    for c in counts:
        schema = schema.add(free_name(documents, c), LongType())
    at = joined.columns
    return joined.transform(small_batches).mapInArrow(_rebuild(schema, at.index(text_col), at.index(gone), min_chars), schema)


def line_report(documents: DataFrame, **args) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row."""
    out = dedup_lines(documents.select("doc_id", "text"), **args)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: DuckDB form of ``line_report`` over ``documents``.
SQL = r"""
WITH l AS (
  SELECT row_id, doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT row_id, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
        FROM (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
heavy AS (
  SELECT k, max(doc_id) AS keep FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (
  SELECT l.*, (heavy.k IS NOT NULL AND l.doc_id IS NOT NULL AND l.doc_id <> heavy.keep) AS gone
  FROM l LEFT JOIN heavy ON l.k = heavy.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY row_id
"""
