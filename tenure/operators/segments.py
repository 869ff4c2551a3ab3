"""Segment tables: profile, strategy (churn definition C), priority, flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.timeutil import floor_days, month_start
from tenure.operators.common import AMT, DRV, KIND, TS, drivers, mavg, ref_date, sum0, with_ref


def segment_profile(t: DataFrame, col: str = KIND) -> DataFrame:
    """total_drivers, total_revenue, avg_amount, transaction_count,
    avg_transactions and revenue_share per segment value."""
    g = (t.where(F.col(col).isNotNull()).groupBy(col)
          .agg(F.countDistinct(DRV).alias("total_drivers"), sum0(AMT).alias("total_revenue"),
               mavg(AMT).alias("avg_amount"), F.count(AMT).alias("transaction_count")))
    tot = g.agg(F.sum("total_revenue").alias("_all"))  # one row
    return (g.crossJoin(F.broadcast(tot))
             .withColumn("avg_transactions", F.try_divide(F.col("transaction_count"), F.col("total_drivers")))
             .withColumn("revenue_share", F.try_divide(F.col("total_revenue"), F.col("_all")))
             .drop("_all"))


def segment_strategy(t: DataFrame, col: str = KIND, days: int = 30) -> DataFrame:
    """Per segment: monthly_value (mean of the segment's monthly sums over its
    observed months), n_drivers, churn_rate (each driver's last row *inside*
    the segment vs the global last date, CP2), avg_value_per_driver,
    revenue_at_risk = monthly_value × churn_rate."""
    seg = t.where(F.col(col).isNotNull())
    monthly = (seg.where(F.col(TS).isNotNull()).groupBy(col, month_start(TS).alias("_m"))
                  .agg(sum0(AMT).alias("_v"))
                  .groupBy(col).agg(mavg("_v").alias("monthly_value")))
    per = drivers(seg).groupBy(col, DRV).agg(F.max(TS).alias("_last"))
    churn = (floor_days("_last", "ref_date") > days).cast("double")
    dr = (with_ref(per, ref_date(t)).groupBy(col)
          .agg(F.count(F.lit(1)).alias("n_drivers"), F.avg(churn).alias("churn_rate")))
    return (monthly.join(dr, col)
            .withColumn("avg_value_per_driver", F.try_divide(F.col("monthly_value"), F.col("n_drivers")))
            .withColumn("revenue_at_risk", F.col("monthly_value") * F.col("churn_rate"))
            .select(col, "monthly_value", "n_drivers", "churn_rate", "avg_value_per_driver", "revenue_at_risk"))


def segment_priority(t: DataFrame, col: str = KIND, days: int = 30) -> DataFrame:
    """Priority score = revenue_at_risk × churn_rate (ascending), bubble size
    n_drivers / max × 50, and each segment's share of the revenue at risk."""
    s = segment_strategy(t, col, days)
    tot = s.agg(F.max("n_drivers").alias("_mx"), F.sum("revenue_at_risk").alias("_rar"))  # one row
    return (s.crossJoin(F.broadcast(tot))
             .select(col, (F.col("revenue_at_risk") * F.col("churn_rate")).alias("score"),
                     (F.col("n_drivers") / F.col("_mx") * 50).alias("relative_size"),
                     F.try_divide(F.col("revenue_at_risk"), F.col("_rar")).alias("impact_share"))
             .orderBy("score"))
