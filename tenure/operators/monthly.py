"""Month-over-month churn and monthly statistics.

The set semantics of the reference ("drivers of the previous observed month that
are absent this month") come from one aggregation per driver: the sorted list of
the driver's months, at most one entry per month of the calendar whatever the
number of rows, so a hot driver is reduced map side.  Each entry knows the driver's
own previous and next month.  A driver stays from one observed month to the next if
the next one is the driver's own next, so counting (month, own next month) pairs, a
table bounded by the calendar, gives active, retained, churned and new drivers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenure.functions.timeutil import month_start
from tenure.operators.common import AMT, DRV, KIND, TS, drivers, mavg, sum0


def _month_key(key: str):
    if key == "year_month":
        return month_start(TS)
    if key == "month":
        return F.month(TS)
    raise ValueError("key must be 'year_month' or 'month'")


def driver_months(t: DataFrame, key: str = "year_month") -> DataFrame:
    """Distinct (driver_id, month)."""
    return (drivers(t).where(F.col(TS).isNotNull())
            .select(DRV, _month_key(key).alias("month")).distinct())


def driver_steps(t: DataFrame, key: str = "year_month") -> DataFrame:
    """(driver_id, month, own_prev, own_next): every month of a driver with the driver's months around it.

    The one shuffle is of the drivers' months, a set per driver and task."""
    own = (drivers(t).where(F.col(TS).isNotNull()).groupBy(DRV)
           .agg(F.array_sort(F.collect_set(_month_key(key))).alias("_months")))
    m = F.col("_months")
    steps = F.transform(m, lambda x, i: F.struct(x.alias("month"), F.get(m, i - 1).alias("own_prev"), F.get(m, i + 1).alias("own_next")))
    return own.select(DRV, F.explode(steps).alias("s")).select(DRV, "s.*")


def month_chain(steps: DataFrame) -> DataFrame:
    """(month, prev_month, next_month) over the observed months; bounded by the calendar."""
    w = Window.orderBy("month")
    return (steps.groupBy("month").agg(F.count(F.lit(1)).alias("_n"))
            .select("month", F.lag("month").over(w).alias("prev_month"), F.lead("month").over(w).alias("next_month")))


def month_flows(t: DataFrame, key: str = "year_month") -> DataFrame:
    """Per observed month: active, previous_active, retained, churned, new."""
    pairs = driver_steps(t, key).groupBy("month", "own_next").agg(F.count(F.lit(1)).alias("_n"))
    months = pairs.groupBy("month").agg(F.sum("_n").alias("active"), F.collect_list(F.struct("own_next", "_n")).alias("_to"))
    w = Window.orderBy("month")  # one row per observed month
    x = months.select("month", "active", F.lag("month").over(w).alias("prev_month"), F.lag("active").over(w).alias("_before"),
                      F.lag("_to").over(w).alias("_from"))
    stay = F.get(F.filter("_from", lambda p: p["own_next"] == F.col("month")), F.lit(0))["_n"]
    x = x.withColumn("previous_active", F.coalesce("_before", F.lit(0)).cast("long")).withColumn("retained", F.coalesce(stay, F.lit(0)).cast("long"))
    return x.select("month", "prev_month", "active", "previous_active", "retained",
                    (F.col("previous_active") - F.col("retained")).alias("churned"), (F.col("active") - F.col("retained")).alias("new"))


def monthly_churn_calendar(t: DataFrame) -> DataFrame:
    """Month-over-month churn by calendar month number (years merged).

    The previous month is the previous *observed* month number; the first
    month has churned 0, rate 0 and every driver new.
    """
    f = month_flows(t, "month")
    prev = F.col("previous_active")
    return f.select(
        "month", F.col("active").alias("active_drivers"), F.col("churned").alias("churned_drivers"),
        F.col("new").alias("new_drivers"),
        F.when(prev > 0, F.col("churned") / prev).otherwise(F.lit(0.0)).alias("churn_rate"),
        F.col("previous_active"),
        F.when(prev > 0, (F.col("active") - prev) / prev).alias("net_growth"))


def monthly_churn(t: DataFrame) -> DataFrame:
    """Month-over-month churn by year-month, from the second observed month."""
    f = month_flows(t, "year_month").where(F.col("prev_month").isNotNull())
    prev = F.col("previous_active")
    return f.select("month", prev.alias("active_prev"), F.col("active").alias("active_current"),
                    "churned", F.when(prev > 0, F.col("churned") / prev).otherwise(F.lit(0.0)).alias("churn_rate"))


def monthly_stats(t: DataFrame, key: str = "year_month") -> DataFrame:
    """Unique drivers, sum, mean and count of amounts per month."""
    return (t.where(F.col(TS).isNotNull())
             .groupBy(_month_key(key).alias("month"))
             .agg(F.countDistinct(DRV).alias("n_drivers"), sum0(AMT).alias("total_amount"),
                  mavg(AMT).alias("avg_amount"), F.count(AMT).alias("n_transactions")))


def kind_stats(t: DataFrame) -> DataFrame:
    """The same four statistics per payment kind."""
    return (t.where(F.col(KIND).isNotNull()).groupBy(KIND)
             .agg(F.countDistinct(DRV).alias("n_drivers"), sum0(AMT).alias("total_amount"),
                  mavg(AMT).alias("avg_amount"), F.count(AMT).alias("n_transactions")))


def monthly_trend(t: DataFrame) -> DataFrame:
    """Per observed year-month: drivers, revenue, churn_rate, growth_rate,
    revenue_at_risk = revenue × churn_rate (first month: rates 0)."""
    f = month_flows(t, "year_month")
    rev = t.where(F.col(TS).isNotNull()).groupBy(month_start(TS).alias("month")).agg(sum0(AMT).alias("revenue"))
    prev = F.col("previous_active")
    rate = F.when(prev > 0, F.col("churned") / prev).otherwise(F.lit(0.0))
    growth = F.when(prev > 0, (F.col("active") - prev) / prev).otherwise(F.lit(0.0))
    return (f.join(rev, "month", "left")
             .select("month", F.col("active").alias("drivers"), F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
                     rate.alias("churn_rate"), growth.alias("growth_rate"))
             .withColumn("revenue_at_risk", F.col("revenue") * F.col("churn_rate")))


def net_churn_trend(t: DataFrame) -> DataFrame:
    """Calendar-complete months (empty months count 0 drivers);
    churn_rate = 1 − cur/prev with the first month and 0/0 giving 1 and
    x/0 giving NULL."""
    base = drivers(t).where(F.col(TS).isNotNull())
    cnt = base.groupBy(month_start(TS).alias("month")).agg(F.countDistinct(DRV).alias("n_drivers"))
    rng = base.agg(F.min(month_start(TS)).alias("lo"), F.max(month_start(TS)).alias("hi"))
    cal = rng.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    w = Window.orderBy("month")  # one row per calendar month
    x = (cal.join(cnt, "month", "left")
            .select("month", F.coalesce("n_drivers", F.lit(0)).cast("long").alias("n_drivers"))
            .withColumn("_prev", F.lag("n_drivers").over(w)))
    cur, prev = F.col("n_drivers"), F.col("_prev")
    churn = (F.when(prev.isNull(), F.lit(1.0))
              .when((prev == 0) & (cur == 0), F.lit(1.0))
              .when(prev == 0, F.lit(None).cast("double"))
              .otherwise(1 - cur / prev))
    return x.select("month", "n_drivers", churn.alias("churn_rate"))


def transaction_seasonality(t: DataFrame) -> DataFrame:
    """Rows per calendar month number ÷ the largest month."""
    c = t.where(F.col(TS).isNotNull()).groupBy(F.month(TS).alias("month")).agg(
        F.count(F.lit(1)).alias("n_transactions"))
    mx = c.agg(F.max("n_transactions").alias("_mx"))
    return c.crossJoin(F.broadcast(mx)).select(
        "month", "n_transactions", (F.col("n_transactions") / F.col("_mx")).alias("seasonality"))


def month_churned_drivers(t: DataFrame) -> DataFrame:
    """(month, driver_id): drivers of the previous observed year-month that
    are absent in ``month`` (their own next month is another one, or none)."""
    steps = driver_steps(t)
    chain = month_chain(steps).where(F.col("next_month").isNotNull())
    x = steps.join(F.broadcast(chain.select("month", "next_month")), "month")  # one row per month
    return x.where(~F.col("own_next").eqNullSafe(F.col("next_month"))).select(F.col("next_month").alias("month"), DRV)


def month_new_drivers(t: DataFrame) -> DataFrame:
    """(month, driver_id): drivers of ``month`` absent in the previous
    observed year-month (in the first month everybody is new)."""
    steps = driver_steps(t)
    x = steps.join(F.broadcast(month_chain(steps).select("month", "prev_month")), "month")  # one row per month
    return x.where(F.col("prev_month").isNull() | ~F.col("own_prev").eqNullSafe(F.col("prev_month"))).select("month", DRV)
