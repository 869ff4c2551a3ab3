"""Shared building blocks of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TS, DRV, AMT, KIND, TX = "transaction_date", "driver_id", "amount", "kind", "tx_id"


def ref_date(t: DataFrame, name: str = "ref_date") -> DataFrame:
    """One-row frame: the last transaction date of the whole input."""
    return t.agg(F.max(TS).alias(name))


def with_ref(df: DataFrame, ref: DataFrame) -> DataFrame:
    """Attach a one-row frame to every row (broadcast; size is one row)."""
    return df.crossJoin(F.broadcast(ref))


def drivers(t: DataFrame) -> DataFrame:
    """Rows with a driver (pandas drops NULL keys in ``groupby``)."""
    return t.where(F.col(DRV).isNotNull())


def sum0(c) -> F.Column:
    """pandas ``sum``: 0 for an empty or all-NULL group.  Amounts are summed as
    they are; only the query layer rounds."""
    return F.coalesce(F.sum((F.col(c) if isinstance(c, str) else c).cast("double")), F.lit(0.0))


def mavg(c) -> F.Column:
    """Mean of amounts (or of sums of amounts), NULLs skipped, unrounded."""
    return F.avg((F.col(c) if isinstance(c, str) else c).cast("double"))


def per_driver_with_ref(t: DataFrame, *aggs, ref_name: str = "ref_date") -> DataFrame:
    """``groupBy(driver_id).agg(*aggs)`` for the non-NULL drivers, each row
    carrying the reference date (the last date of *all* rows).

    The reference date is a separate global ``max``: a scan of the one date
    column with a one-row partial aggregate per task and no data shuffle.
    (Deriving it from the per-driver aggregate instead does not share that
    aggregate — the optimizer prunes and re-plans the branch — and adds a
    shuffle.)
    """
    per = drivers(t).groupBy(DRV).agg(*aggs)
    return with_ref(per, ref_date(t, ref_name))


# A driver counts as heavy from this share of all rows on, so there are at
# most HEAVY_SHARE of them: a proven bound for broadcasting their ids.
HEAVY_SHARE = 200
SALTS = 64


def heavy_drivers(t: DataFrame) -> DataFrame:
    """(driver_id) of the drivers with over 1/HEAVY_SHARE of all rows; at most HEAVY_SHARE rows."""
    n = drivers(t).groupBy(DRV).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"))  # one row
    return n.crossJoin(F.broadcast(total)).where(F.col("_n") * HEAVY_SHARE > F.col("_all")).select(DRV)


def join_drivers(rows: DataFrame, per: DataFrame, heavy: DataFrame, how: str = "left") -> DataFrame:
    """``rows`` joined to the one-row-per-driver frame ``per``.

    AQE can't split a driver here: ``per`` is an aggregate and keeps its own
    partitioning.  So a heavy driver's rows get one of SALTS salts, and its row
    of ``per`` is repeated once per salt; all others have salt 0.
    """
    hot = F.broadcast(heavy.withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, DRV, "left").withColumn("_salt", salt).drop("_hot")
    right = per.join(hot, DRV, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, [DRV, "_salt"], how).drop("_salt").select(
        *rows.columns, *[c for c in per.columns if c != DRV])


def heavy_keys(rows: DataFrame, keys: list[str], share: int = HEAVY_SHARE) -> list[int]:
    """xxhash64 of the key tuples with over 1/``share`` of all rows, and perhaps of some with a little less.

    One aggregation: a frequent-items sketch of the keys' hashes, merged map side,
    of bounded size whatever the number of keys.  It follows ``50 * share`` items,
    so its counts are off by far less than 1/``share`` of the rows and no heavy
    tuple is missed.  NULL keys count as a tuple."""
    h = F.xxhash64(*keys).alias("h")
    r = rows.select(h).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {2 * share}, {50 * share})").alias("top")).first()
    return [t["item"] for t in r.top or [] if t["count"] * share * 1.1 > r.n]


def join_salted(rows: DataFrame, per: DataFrame, keys: list[str], how: str = "left", hot: list[int] | None = None) -> DataFrame:
    """``rows`` joined to ``per``, which has one row per tuple of ``keys``.
    ``hot`` are the :func:`heavy_keys`, if known from a frame that is cheaper to read.

    If ``per`` is an aggregate on the same keys it keeps its partitioning and AQE
    can't split a key.  So rows of a heavy tuple get one of SALTS salts, and its
    row of ``per`` is repeated once per salt; without one it is a plain join."""
    hot = heavy_keys(rows, keys) if hot is None else hot
    if not hot:
        return rows.join(per, keys, how)
    is_hot = F.xxhash64(*keys).isin(hot)  # at most 2 * HEAVY_SHARE numbers
    salt = F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    joined = rows.withColumn("_salt", salt).join(per.withColumn("_salt", F.explode(salts)), [*keys, "_salt"], how)
    return joined.select(*rows.columns, *[c for c in per.columns if c not in keys])
