"""Cohort retention and lifetime value, in long form.

Everything runs on the (driver, month) table — one row per driver and month
with the month's amount — so a driver with a third of all rows contributes
at most one row per month after the first (partially aggregated) shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenure.functions.timeutil import month_index, month_start
from tenure.operators.common import AMT, DRV, TS, drivers, heavy_drivers, join_drivers, mavg, sum0


def cohort_assign(t: DataFrame) -> DataFrame:
    """Every row with its driver's cohort month (month of the first
    transaction) and ``period_number`` = months since the cohort month."""
    first = drivers(t).groupBy(DRV).agg(F.min(TS).alias("_first"))
    x = join_drivers(t, first, heavy_drivers(t))
    return (x.withColumn("cohort_month", month_start("_first"))
             .withColumn("period_number", month_index(TS) - month_index("_first"))
             .drop("_first"))


def _driver_month_amounts(t: DataFrame) -> DataFrame:
    d = drivers(t).where(F.col(TS).isNotNull())
    dm = d.groupBy(DRV, month_start(TS).alias("month")).agg(sum0(AMT).alias("amount"))
    # min over (month, amount) reads the same columns as the other use of dm,
    # so both share one scan and exchange; the month decides the minimum
    first = dm.groupBy(DRV).agg(F.min(F.struct("month", "amount"))["month"].alias("cohort_month"))
    per = F.col("month")
    return (dm.join(first, DRV)
              .withColumn("period_number", (month_index(per) - month_index("cohort_month"))))


def cohort_counts(t: DataFrame) -> DataFrame:
    """(cohort_month, period_number, drivers, ltv): unique drivers and amount."""
    return (_driver_month_amounts(t).groupBy("cohort_month", "period_number")
            .agg(F.count(F.lit(1)).alias("drivers"), F.sum("amount").alias("ltv")))


def cohort_retention(t: DataFrame) -> DataFrame:
    """Unique drivers per (cohort, period) ÷ the cohort's period-0 drivers."""
    c = cohort_counts(t)
    w = Window.partitionBy("cohort_month")  # (cohort, period) cells: months² at most
    base = F.max(F.when(F.col("period_number") == 0, F.col("drivers"))).over(w)
    return c.select("cohort_month", "period_number", "drivers",
                    F.try_divide(F.col("drivers"), base).alias("retention"))


def _months(t: DataFrame) -> int:
    """Calendar months from the first to the last date: no cohort has more periods."""
    r = drivers(t).agg(month_index(F.min(TS)).alias("lo"), month_index(F.max(TS)).alias("hi")).first()
    return 0 if r.lo is None else int(r.hi - r.lo) + 1


def _wide(cells: DataFrame, value: str, periods: int) -> DataFrame:
    wide = cells.groupBy("cohort_month").pivot("period_number", list(range(periods))).agg(F.first(value))
    return wide.select("cohort_month", *[F.col(str(p)).alias(f"period_{p}") for p in range(periods)])


def cohort_retention_wide(t: DataFrame, periods: int | None = None) -> DataFrame:
    """Retention pivoted to one column per period, ``period_0`` to the last
    calendar month of the data (or the first ``periods`` of them)."""
    return _wide(cohort_retention(t), "retention", _months(t) if periods is None else periods)


def cohort_ltv_wide(t: DataFrame, periods: int | None = None) -> DataFrame:
    """LTV pivoted like :func:`cohort_retention_wide`."""
    return _wide(cohort_ltv(t), "ltv", _months(t) if periods is None else periods)


def cohort_ltv(t: DataFrame) -> DataFrame:
    """Σ amount per (cohort, period)."""
    return cohort_counts(t).select("cohort_month", "period_number", F.col("ltv").cast("double").alias("ltv"))


def cohort_ltv_cumulative(t: DataFrame) -> DataFrame:
    """Running LTV along the observed periods of each cohort."""
    w = Window.partitionBy("cohort_month").orderBy("period_number").rowsBetween(Window.unboundedPreceding, 0)
    c = cohort_counts(t)
    return c.select("cohort_month", "period_number", F.col("ltv").cast("double").alias("ltv"),
                    F.sum("ltv").over(w).cast("double").alias("cumulative_ltv"))


def cohort_period_means(t: DataFrame) -> DataFrame:
    """Per period: mean retention and mean LTV over the cohorts that have the cell."""
    r = cohort_retention(t).join(cohort_counts(t).select("cohort_month", "period_number", "ltv"),
                                 ["cohort_month", "period_number"])
    return r.groupBy("period_number").agg(F.avg("retention").alias("avg_retention"),
                                          mavg("ltv").alias("avg_ltv"))


def cohort_value_per_retained(t: DataFrame) -> DataFrame:
    """Per period: mean over cohorts of ltv[c,p] / (retention[c,p] · ltv[c,0])."""
    r = cohort_retention(t).join(cohort_ltv(t), ["cohort_month", "period_number"])
    w = Window.partitionBy("cohort_month")
    ltv0 = F.max(F.when(F.col("period_number") == 0, F.col("ltv"))).over(w)
    v = F.try_divide(F.col("ltv"), F.col("retention") * ltv0)
    return (r.select("period_number", v.alias("_v")).groupBy("period_number")
             .agg(F.avg("_v").alias("value_per_retained")))
