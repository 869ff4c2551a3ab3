"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.llm import decontam, dialogue, embeddings, html, lexical, licenses, linededup, packing, pii, quality, simhash, suffix, warc
from tenure.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(spark, table(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = suffix.repeated_passages(table(spark, sf_dir, "documents"))
    return spans.withColumn("n_words", F.col("end_word") - F.col("start_word"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pii.report(documents, pii.train(documents))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.damaged_report(table(spark, sf_dir, "conversations"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.find(table(spark, sf_dir, "documents")))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_quality": op2_quality,
    "op3_suffix": op3_suffix,
    "op4_embeddings": op4_embeddings,
    "op5_simhash": op5_simhash,
    "op6_pii": op6_pii,
    "op7_packing": op7_packing,
    "op8_lines": op8_lines,
    "op9_html": op9_html,
    "op10_decontam": op10_decontam,
    "op11_dialogue": op11_dialogue,
    "op12_licenses": op12_licenses,
    "op13_lexical": op13_lexical,
}
ORACLES: dict[str, str] = {
    "op1_warc": warc.SQL,
    "op4_embeddings": embeddings.SQL,
    "op8_lines": linededup.SQL,
    "op11_dialogue": dialogue.sql(),
    "op12_licenses": licenses.sql(),
    "op13_lexical": lexical.SQL,
}
