"""Canonical schema of the transactions frame and input checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.session import cut_lineage

# The payment kinds of the input data, in this order.
KINDS = ["FIRST_PAYMENT", "RECURRENCY", "FIRST_PAYMENT_EXCHANGE"]

# Schema of the raw CSV layout (date, driver_id, amount, kind).
RAW_CSV_SCHEMA = T.StructType([
    T.StructField("date", T.StringType(), True),
    T.StructField("driver_id", T.LongType(), True),
    T.StructField("amount", T.DoubleType(), True),
    T.StructField("kind", T.StringType(), True),
])

TRANSACTIONS_SCHEMA = T.StructType([
    T.StructField("tx_id", T.LongType(), True),
    T.StructField("driver_id", T.LongType(), True),
    T.StructField("transaction_date", T.TimestampNTZType(), True),
    T.StructField("amount", T.DoubleType(), True),
    T.StructField("kind", T.StringType(), True),
])

REQUIRED = ("driver_id", "amount")


def validate(df: DataFrame, required=REQUIRED) -> None:
    """Raise ValueError when a required column is missing (no Spark job)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"DataFrame must contain the columns {list(required)}; missing {missing}")
    if "transaction_date" not in df.columns and "date" not in df.columns:
        raise ValueError("DataFrame must contain a 'date' or 'transaction_date' column")


class Coercion:
    """What was lost on the way into the canonical layout, counted in the pass that reads the rows.

    Hand one to a reader or to :func:`canonicalize`; after the first action on
    the frame ``counts()`` has ``rows``, ``bad_dates`` (text that is no
    timestamp), ``bad_amounts`` (NaN) and ``malformed`` (lines of a CSV or JSON
    file that don't fit its schema)."""

    def __init__(self, max_share: float | None = None):
        self.max_share = max_share
        self.observation = Observation()

    def counts(self) -> dict[str, int]:
        return dict(self.observation.get)

    def check(self) -> dict[str, int]:
        """The counts; ValueError if more than ``max_share`` of the rows lost a field."""
        c = self.counts()
        lost = max(c["bad_dates"], c["bad_amounts"], c["malformed"])
        if self.max_share is not None and lost > self.max_share * c["rows"]:
            raise ValueError(f"more than {self.max_share:.2%} of {c['rows']} rows lost a field: {c}")
        return c


#: Column in which readers keep a line that doesn't fit the schema.
CORRUPT = "_corrupt_record"


def canonicalize(df: DataFrame, coercion: Coercion | None = None) -> DataFrame:
    """Bring any transactions-like frame into the canonical layout.

    * ``date`` is renamed to ``transaction_date`` and coerced to TIMESTAMP_NTZ
      (text is parsed with ``try_to_timestamp``: unparsable text becomes NULL);
    * a ``tx_id`` is added when absent (monotone in the frame's order; it is the
      tie-breaker of every order-dependent operator), and the rows are written to
      the checkpoint folder with it, for a frame computed again may number its
      rows differently;
    * NaN amounts are read as NULL (pandas treats them alike);
    * ``coercion`` counts what became NULL on the way.
    """
    validate(df)
    if "transaction_date" not in df.columns:
        df = df.withColumnRenamed("date", "transaction_date")
    dt = df.schema["transaction_date"].dataType
    if isinstance(dt, T.StringType):
        ts = F.try_to_timestamp(F.col("transaction_date")).cast(T.TimestampNTZType())
    elif isinstance(dt, T.TimestampNTZType):
        ts = F.col("transaction_date")
    else:
        ts = F.col("transaction_date").cast(T.TimestampNTZType())
    numbered = "tx_id" in df.columns
    if not numbered:
        df = df.withColumn("tx_id", F.monotonically_increasing_id())
    amount = F.col("amount").cast("double")
    kind = F.col("kind").cast("string") if "kind" in df.columns else F.lit(None).cast("string")
    extra = [c for c in df.columns if c not in {"tx_id", "driver_id", "transaction_date", "amount", "kind", CORRUPT}]
    if coercion:
        bad = F.col(CORRUPT).isNotNull() if CORRUPT in df.columns else F.lit(False)
        df = df.observe(coercion.observation, F.count(F.lit(1)).alias("rows"),
                        F.count_if(F.col("transaction_date").isNotNull() & ts.isNull()).alias("bad_dates"),
                        F.count_if(F.isnan(amount)).alias("bad_amounts"), F.count_if(bad).alias("malformed"))
    out = df.select(
        F.col("tx_id").cast("long").alias("tx_id"),
        F.col("driver_id").cast("long").alias("driver_id"),
        ts.alias("transaction_date"),
        F.when(F.isnan(amount), None).otherwise(amount).alias("amount"),
        kind.alias("kind"),
        *extra,
    )
    return out if numbered else cut_lineage(out)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Columns of 64-bit integer or double type (pandas int64/float64).

    32-bit fields (e.g. ``month()``) are left out, as pandas leaves out its
    int32 results of ``dt.month``.
    """
    keep = (T.LongType, T.DoubleType)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, keep) and f.name not in set(exclude)]
