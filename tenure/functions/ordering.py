"""Order-dependent operations without a single-task window.

A ``Window`` with an ``ORDER BY`` but no ``PARTITION BY`` (or one partitioned
by a key that may hold a third of all rows) runs in one task.  The helpers
here replace it by

1. a global sort (range partitioning: a hot key is split across partitions
   because the sort key ends in a unique tie-breaker), written once to the
   checkpoint folder,
2. per-partition row counts — one row per partition, bounded by the
   partition count — turned into offsets (as ``RDD.zipWithIndex`` does),
   giving every row its global index ``_gidx``,
3. per-partition windows, plus what the neighbouring partitions' border rows
   (lags) or the preceding partitions' totals (running sums, forward fill) add.

Every shuffle here is balanced whatever the key distribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PID, GIDX = "_pid", "_gidx"
_LOW33 = (1 << 33) - 1


def global_order(df: DataFrame, order_cols: list, idx: str = GIDX) -> DataFrame:
    """Add ``_pid`` and the 0-based global row index ``idx`` in ``order_cols`` order.

    ``order_cols`` should end in a unique column so that the order is total.
    The sorted rows are checkpointed (shared checkpoint folder) before the
    per-partition counts are taken: Spark seeds a range partitioner's
    sample with the RDD id, so two separately planned sorts of the same rows
    may cut partitions differently — both the counts and the rows must come
    from one materialised copy.  The checkpoint also cuts the lineage, so a
    lost executor recomputes from it.
    """
    from tenure.session import cut_lineage
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    s = cut_lineage(df.orderBy(*cols)
                      .withColumn(PID, F.spark_partition_id())
                      .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33))))
    # Row counts per partition, as RDD.zipWithIndex does: one small job whose
    # result has one row per partition (bounded by the partition count, not
    # by the data).  The offsets go back as a broadcast table — shipped once
    # per executor, not inside every task like a literal array would be — so
    # later reads of the rows need no shuffle and no second pass.
    counts = sorted(s.groupBy(PID).agg(F.count(F.lit(1)).alias("_n")).collect())
    offsets, acc = [], 0
    for pid, n in counts:
        offsets.append((int(pid), acc))
        acc += int(n)
    spark = df.sparkSession
    off = spark.createDataFrame(offsets or [(0, 0)], f"{PID} int, _off long")
    return (s.join(F.broadcast(off), PID)
             .withColumn(idx, F.col("_off") + F.col("_local"))
             .drop("_off", "_local"))


def shifts_ordered(df: DataFrame, cols: list[str], ks: list[int], suffixes: list[str], key: str | None = None,
                   idx: str = GIDX) -> DataFrame:
    """Values of ``cols`` ``k`` rows earlier (``k < 0``: later), for every
    ``k`` in ``ks``, as columns ``c + suffixes[i]``.

    ``df`` comes from :func:`global_order` (with ``_pid``).  Inside a partition
    the value is a window function over ``_pid``: one exchange of the rows
    however many offsets.  The few rows whose target lies in another
    partition look it up among the first and last rows of all partitions, at
    most ``2 * max(|k|)`` per partition, which are broadcast.  With ``key`` the
    other row must have the same key (a lag within groups that are contiguous
    in the order)."""
    reach = max(abs(k) for k in ks)
    fields = [*([F.col(key).alias("_key")] if key else []), *[F.col(c).alias(c) for c in cols]]
    ends = df.groupBy(PID).agg(F.min(idx).alias("_lo"), F.max(idx).alias("_hi"))
    edges = (df.join(F.broadcast(ends), PID)
             .where((F.col(idx) < F.col("_lo") + reach) | (F.col(idx) > F.col("_hi") - reach))
             .select(F.col(idx).alias("_at"), F.struct(*fields).alias("_edge")))
    w = Window.partitionBy(PID).orderBy(idx)
    names = df.columns
    for k, suf in zip(ks, suffixes):
        inside = F.lag(F.struct(*fields), k) if k >= 0 else F.lead(F.struct(*fields), -k)
        df = df.withColumn(f"_w{suf}", inside.over(w))
    out = df
    for k, suf in zip(ks, suffixes):
        other = edges.select((F.col("_at") + k).alias(f"_at{suf}"), F.col("_edge").alias(f"_e{suf}"))
        out = out.join(F.broadcast(other), (F.col(idx) == F.col(f"_at{suf}")) & F.col(f"_w{suf}").isNull(), "left")
        out = out.withColumn(f"_w{suf}", F.coalesce(f"_w{suf}", f"_e{suf}"))
    keep = [F.col(c) for c in names]
    for suf in suffixes:
        got = F.col(f"_w{suf}")
        same = got["_key"] == F.col(key) if key else F.lit(True)
        keep += [F.when(same, got[c]).alias(c + suf) for c in cols]
    return out.select(*keep)


def shift_ordered(df: DataFrame, cols: list[str], k: int, key: str | None = None,
                  suffix: str | None = None, idx: str = GIDX) -> DataFrame:
    """Value of ``cols`` ``k`` rows earlier in ``idx`` order (``lag``); see
    :func:`shifts_ordered`."""
    return shifts_ordered(df, cols, [k], [suffix or f"_lag{k}"], key=key, idx=idx)


def cumsum_ordered(df: DataFrame, cols: list[str], suffix: str = "_cum",
                   idx: str = GIDX) -> DataFrame:
    """Running (inclusive) sums of ``cols`` in ``idx`` order.

    Within a partition: a window partitioned by ``_pid``; across partitions:
    the totals of all earlier partitions (a table of one row per partition).
    """
    tot = df.groupBy(PID).agg(*[F.sum(c).alias(c + "_t") for c in cols])
    w = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    carry = tot.select(PID, *[F.coalesce(F.sum(c + "_t").over(w), F.lit(0)).alias(c + "_carry")
                              for c in cols])
    wp = Window.partitionBy(PID).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(F.broadcast(carry), PID)
    for c in cols:
        out = out.withColumn(c + suffix, F.sum(c).over(wp) + F.col(c + "_carry"))
    return out.drop(*[c + "_carry" for c in cols])


def ffill_ordered(df: DataFrame, col: str, out: str | None = None, idx: str = GIDX) -> DataFrame:
    """Forward fill of NULLs in ``idx`` order (pandas ``ffill``)."""
    out = out or col
    last = df.groupBy(PID).agg(F.max_by(col, F.when(F.col(col).isNotNull(), F.col(idx))).alias("_last"))
    w = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(PID, F.last("_last", ignorenulls=True).over(w).alias("_carry"))
    wp = Window.partitionBy(PID).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last(col, ignorenulls=True).over(wp), F.col("_carry"))
    return df.join(F.broadcast(carry), PID).withColumn(out, filled).drop("_carry")
