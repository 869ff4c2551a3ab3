"""Churn KPIs (three churn predicates, each kept separate).

CP1  ``last < ref − N days``                      (timestamp comparison)
CP2  ``floor_days(ref − last) > 30``              (whole days)
CP3  ``floor_days(ref − last) > 28``

Plans: one ``groupBy(driver_id)`` (partial aggregation, so a driver holding a
third of the rows is pre-reduced map-side), the reference date as a one-row
broadcast, then small global aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.timeutil import floor_days, minus_days, month_start
from tenure.session import few_rows
from tenure.operators.common import (AMT, DRV, KIND, TS, TX, drivers, heavy_drivers, join_drivers, mavg, per_driver_with_ref, ref_date,
                                     sum0, with_ref)


def churn_basic_metrics(t: DataFrame, window_days: int = 30) -> DataFrame:
    """total_drivers, churned_drivers (CP1), churn_rate, revenue_at_risk.

    revenue_at_risk = mean over *active* drivers of ``sum(amount)/(N/30)``
    × (number of active drivers × churn_rate).
    """
    return _basic(t, window_days).select("total_drivers", "churned_drivers", "churn_rate", "revenue_at_risk")


def _basic(t: DataFrame, window_days: int) -> DataFrame:
    """One row of KPIs from one per-driver table (with the reference date)."""
    x = (per_driver_with_ref(t, F.max(TS).alias("last"), F.min(TS).alias("first"), sum0(AMT).alias("total"))
         .withColumn("_cut", minus_days("ref_date", window_days)))
    active = F.col("last") >= F.col("_cut")
    agg = x.agg(
        F.count(F.lit(1)).alias("total_drivers"),
        F.count_if(F.col("last") < F.col("_cut")).alias("churned_drivers"),
        F.count_if(active).alias("_n_active"),
        (mavg(F.when(active, F.col("total"))) / F.lit(window_days / 30.0)).alias("_active_rev"),
        F.avg(floor_days("first", "last")).alias("avg_days_to_churn"),
    )
    rate = F.try_divide(F.col("churned_drivers"), F.col("total_drivers"))
    return agg.select(
        "total_drivers", "churned_drivers", rate.alias("churn_rate"), "avg_days_to_churn",
        (F.col("_active_rev") * (F.col("_n_active") * rate)).alias("revenue_at_risk"))


def driver_lifetimes(t: DataFrame) -> DataFrame:
    """Per driver: first, last and lifetime in whole days (all drivers)."""
    per = drivers(t).groupBy(DRV).agg(F.min(TS).alias("first_transaction"),
                                      F.max(TS).alias("last_transaction"))
    return per.withColumn("lifetime_days", floor_days("first_transaction", "last_transaction"))


def lifetime_summary(t: DataFrame) -> DataFrame:
    """avg_days_to_churn and median_days_to_churn over all drivers' lifetimes.

    Lifetimes are whole days bounded by the data's date range, so the exact
    ``percentile`` holds at most that many distinct values per task.
    """
    lt = driver_lifetimes(t)
    return lt.agg(F.avg("lifetime_days").alias("avg_days_to_churn"),
                  F.percentile("lifetime_days", 0.5).alias("median_days_to_churn"))


def churned_drivers(t: DataFrame, window_days: int = 30, subset: DataFrame | None = None) -> DataFrame:
    """Drivers with ``last < ref − N days`` (CP1).

    With ``subset`` (a frame with ``driver_id``) only those drivers' rows are
    used — all their kinds — and the reference date is *their* last date.
    """
    src = t if subset is None else t.join(subset.select(DRV).distinct(), DRV, "left_semi")
    x = per_driver_with_ref(src, F.max(TS).alias("last_transaction"))
    return (x.where(F.col("last_transaction") < minus_days("ref_date", window_days))
             .select(DRV, "last_transaction"))


def revenue_before_churn(t: DataFrame, window_days: int = 30, pre_churn_window: int = 30) -> DataFrame:
    """Mean over churned drivers of the revenue in the ``pre_churn_window``
    days up to (and including) their last transaction; 0 if nobody churned.

    The per-driver window is a join of the churned drivers' last dates back
    to their rows (a heavy driver's rows are salted), then a grouped sum
    with partial sums in every task.
    """
    ch = churned_drivers(t, window_days)
    rows = join_drivers(drivers(t).select(DRV, TS, AMT), ch, heavy_drivers(t), "inner")
    in_win = F.col(TS) >= minus_days("last_transaction", pre_churn_window)
    per = rows.groupBy(DRV).agg(sum0(F.when(in_win, F.col(AMT))).alias("rev"))
    return per.agg(F.coalesce(mavg("rev"), F.lit(0.0)).alias("avg_revenue_before_churn"))


def churn_by_segment(t: DataFrame, col: str = KIND, window_days: int = 30) -> DataFrame:
    """Churn rate per segment value (definition A).

    Segment drivers = drivers with at least one row of the segment; each is
    judged on its overall last transaction against the last date of the
    segment drivers' rows.  No per-segment loop: distinct (segment, driver)
    joined to the per-driver last date, then a per-segment max.
    """
    per = drivers(t).groupBy(DRV).agg(F.max(TS).alias("last"))
    sd = drivers(t).where(F.col(col).isNotNull()).select(col, DRV).distinct().join(per, DRV)
    seg = sd.groupBy(col).agg(F.max("last").alias("seg_ref"), F.count(DRV).alias("n_drivers"))
    churned = F.col("last") < minus_days("seg_ref", window_days)
    c = sd.join(few_rows(seg), col).groupBy(col, "n_drivers").agg(F.count_if(churned).alias("_c"))
    return c.select(col, (F.col("_c") / F.col("n_drivers")).alias("churn_rate"), "n_drivers")


def churn_seasonality(t: DataFrame, window_days: int = 30) -> DataFrame:
    """Churned drivers (CP1) per month of their last transaction."""
    ch = churned_drivers(t, window_days)
    return (ch.groupBy(month_start("last_transaction").alias("month"))
              .agg(F.count(F.lit(1)).alias("churned_drivers")))


def segment_churn_last_kind(t: DataFrame, days: int = 30) -> DataFrame:
    """Churn (CP2) per driver's *last* kind (last non-NULL kind in ``tx_id`` order).

    ``max_by`` is an ordinary aggregate (partial aggregation), so no
    per-driver window is needed.
    """
    x = per_driver_with_ref(
        t, F.max(TS).alias("last"),
        F.max_by(KIND, F.when(F.col(KIND).isNotNull(), F.col(TX))).alias("last_kind"),
    ).where(F.col("last_kind").isNotNull())
    churn = (floor_days("last", "ref_date") > days).cast("double")
    return (x.groupBy(F.col("last_kind").alias(KIND))
             .agg(F.avg(churn).alias("churn_rate"), F.count(F.lit(1)).alias("total_drivers")))


def transaction_churn_flag(t: DataFrame, window_days: int = 30, target: str = "churn") -> DataFrame:
    """Every row gets its driver's CP1 churn flag (0/1)."""
    ch = churned_drivers(t, window_days).select(DRV, F.lit(1).alias("_c"))
    return (join_drivers(t, ch, heavy_drivers(t))
             .withColumn(target, F.coalesce(F.col("_c"), F.lit(0)))
             .drop("_c"))


def kpi_summary(t: DataFrame, window_days: int = 30) -> DataFrame:
    """churn_rate, avg_days_to_churn, revenue_at_risk in one row."""
    return _basic(t, window_days).select("churn_rate", "avg_days_to_churn", "revenue_at_risk")


def advanced_metrics(t: DataFrame, window_days: int = 30) -> dict[str, DataFrame]:
    """The advanced-metrics bundle as named frames (nothing is collected)."""
    out = {
        "lifetime_summary": lifetime_summary(t),
        "revenue_before_churn": revenue_before_churn(t, window_days),
        "churn_seasonality": churn_seasonality(t, window_days),
    }
    if KIND in t.columns:
        out["churn_by_payment_type"] = churn_by_segment(t, KIND, window_days)
    return out
