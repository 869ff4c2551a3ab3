"""Scans: the transactions table from CSV / parquet, and frames already loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.functions.ordering import PID, global_order
from tenure.session import cut_lineage
from tenure.sources.schema import CORRUPT, RAW_CSV_SCHEMA, Coercion, canonicalize


def read_transactions_csv(spark: SparkSession, path: str, schema=RAW_CSV_SCHEMA, coercion: Coercion | None = None) -> DataFrame:
    """CSV with a header row in the raw layout (date, driver_id, amount, kind).

    An explicit schema avoids the inference pass over the whole input.
    Without a ``tx_id`` column rows are numbered in file order (files by path,
    then the row's place), whatever the input splits; ``coercion`` then counts in
    the same pass and is checked here.
    """
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]) if coercion else schema
    df = (spark.read.schema(wide).option("header", True).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    return _in_file_order(df, coercion)


def read_transactions(spark: SparkSession, path: str, fmt: str = "parquet", coercion: Coercion | None = None) -> DataFrame:
    """Transactions in canonical or raw layout from parquet / csv / json, numbered
    like :func:`read_transactions_csv` if they have no ``tx_id``."""
    if fmt == "csv":
        return read_transactions_csv(spark, path, coercion=coercion)
    return _in_file_order(spark.read.format(fmt).load(path), coercion)


def _in_file_order(df: DataFrame, coercion: Coercion | None) -> DataFrame:
    """``df``, read from files, in the canonical layout."""
    if "tx_id" in df.columns:
        return canonicalize(df, coercion)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # within the task's splits
    x = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), place.alias("_place"))
    x = canonicalize(x.withColumn("tx_id", F.lit(0).cast("long")), coercion).drop("tx_id")
    if coercion:
        x = cut_lineage(x)  # the sort samples its input first: rows would be counted twice
        coercion.check()
    out = global_order(x, ["_file", "_block", "_place"], "tx_id").drop(PID, "_file", "_block", "_place")
    return out.select("tx_id", *[c for c in out.columns if c != "tx_id"])


def load_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical transactions from a TPC-H style ``orders`` table.

    ``o_orderkey → tx_id``, ``o_custkey → driver_id``, ``o_orderdate →
    transaction_date``, ``o_totalprice → amount`` and the order status mapped
    onto the three payment kinds.  Only these four columns are read.
    """
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return canonicalize(o.select(
        F.col("o_orderkey").alias("tx_id"),
        F.col("o_custkey").alias("driver_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("transaction_date"),
        F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_orderstatus") == "F", "FIRST_PAYMENT")
         .when(F.col("o_orderstatus") == "O", "RECURRENCY")
         .when(F.col("o_orderstatus") == "P", "FIRST_PAYMENT_EXCHANGE")
         .alias("kind"),
    ))


def load_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical transactions from the ``events`` table (times of day)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return canonicalize(e.select(
        F.col("event_id").alias("tx_id"),
        F.col("user_id").alias("driver_id"),
        F.col("ts").cast("timestamp_ntz").alias("transaction_date"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("kind"),
    ))


def load_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Midnight rows (:func:`load_transactions`) and time-of-day rows
    (:func:`load_activity`, their tx_id negative) in one frame."""
    a = load_activity(spark, sf_dir).withColumn("tx_id", -F.col("tx_id") - 1)
    return load_transactions(spark, sf_dir).unionByName(a)


def load_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price / demand / revenue / segment rows from ``lineitem ⋈ part``.

    The join is left to the planner: ``part`` is broadcast only while its
    size estimate is under ``spark.sql.autoBroadcastJoinThreshold``,
    otherwise both sides are shuffled on the part key.
    """
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_retailprice", "p_brand")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("p_retailprice").alias("price"),
        F.col("l_quantity").alias("demand"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.col("p_brand").alias("segment"),
    )


def load_customer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver profile (sign-up, last activity, rides, mean ride value).

    Orders are aggregated per customer first (partial aggregation before the
    shuffle), then left-joined to ``customer`` so that customers without any
    order keep NULL profile fields.
    """
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(
        F.min("o_orderdate").cast("timestamp_ntz").alias("data_cadastro"),
        F.max("o_orderdate").cast("timestamp_ntz").alias("ultima_data_ativo"),
        F.count("o_orderkey").alias("numero_corridas"),
        F.avg("o_totalprice").alias("valor_medio_corrida"),
    )
    return c.join(o, c.c_custkey == o.o_custkey, "left").select(
        F.col("c_custkey").alias("driver_id"),
        F.col("c_acctbal").alias("acctbal"),
        "data_cadastro", "ultima_data_ativo", "valor_medio_corrida", "numero_corridas",
    )
