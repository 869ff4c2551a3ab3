"""From raw documents to packed training sequences, in five stages.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the next stage's documents, the last one the packed pieces.  ``run``
writes every stage's result as Parquet to the shared checkpoint folder and
reads it back, so a lost executor repeats one stage's tasks at most.

1. quality: documents that the classifier rejects go;
2. lines: repeated lines go, the documents stay with what is left of their text;
3. near_duplicates: of every SimHash group the document with the smallest id stays;
4. decontamination: documents that hold a benchmark item go;
5. packing: the documents' tokens, one row per piece.

Null texts count as empty, rows without an id pass stages 2 and 3 unchanged,
and extra columns of the documents pass through stages 1 to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.llm import decontam, linededup, packing, quality, simhash
from tenure.llm.common import free_name, shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = quality.fit(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "score")
    scored = quality.score(docs, weights, score_col=name)
    return scored.filter(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(docs).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: No stage but the second can be put in SQL; tests/llm compares run() with a plain-Python form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
