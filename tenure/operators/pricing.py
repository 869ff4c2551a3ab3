"""Price sensitivity: daily activity, elasticity, optimal price (quadratic
fit), per-segment sensitivity, demand and revenue curves, price trends.

Price-ordered operations (percent change, centred rolling mean) run on the
table of distinct prices with the global order helpers, so no single task
holds all prices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.numeric import centred_rolling_mean, quad_fit
from tenure.functions.ordering import ffill_ordered, global_order, shift_ordered
from tenure.operators.common import AMT, DRV, TS, join_salted, mavg
from tenure.session import cut_lineage


def daily_activity(t: DataFrame) -> DataFrame:
    """Transactions per (driver, day); ``transaction_date`` is the day at
    midnight; is_active = 1."""
    d = t.where(F.col(DRV).isNotNull() & F.col(TS).isNotNull())
    day = F.to_date(TS).cast("timestamp_ntz")
    return (d.groupBy(DRV, day.alias(TS)).agg(F.count(F.lit(1)).alias("transactions"))
             .withColumn("is_active", (F.col("transactions") > 0).cast("int")))


def daily_activity_join(t: DataFrame) -> DataFrame:
    """Rows left-joined to the daily activity on the *exact* timestamp (so
    only midnight rows find their day), giving ``is_active``.  A (driver,
    timestamp) that holds many of the rows is salted."""
    a = daily_activity(t).select(DRV, TS, "is_active")
    return join_salted(t, a, [DRV, TS])


def elasticity_curve(df: DataFrame, price: str, demand: str, by=()) -> DataFrame:
    """Per distinct price (per segment with ``by``): mean demand, percent
    changes along increasing price (demand forward-filled first, as pandas
    ``pct_change``), elasticity = demand change / price change."""
    by = [by] if isinstance(by, str) else list(by)
    if len(by) > 1:
        raise ValueError("one segment column at most")
    keep = F.col(price).isNotNull()
    for b in by:
        keep = keep & F.col(b).isNotNull()
    g = df.where(keep).groupBy(*by, price).agg(F.avg(demand).alias("demand"))
    o = global_order(g, [*by, price])
    o = ffill_ordered(o, "demand", "_dfill")
    o = shift_ordered(o, [price, "_dfill"], 1, key=by[0] if by else None, suffix="_prev")
    pp = F.try_divide(F.col(price), F.col(f"{price}_prev")) - 1
    dp = F.try_divide(F.col("_dfill"), F.col("_dfill_prev")) - 1
    return o.select(*by, F.col(price).alias("price"), "demand", pp.alias("price_pct_change"),
                    dp.alias("demand_pct_change"), F.try_divide(dp, pp).alias("elasticity"))


def price_elasticity(df: DataFrame, price: str, demand: str) -> DataFrame:
    """Mean elasticity over prices (NULLs skipped), one row."""
    return elasticity_curve(df, price, demand).agg(F.avg("elasticity").alias("elasticity"))


def optimal_price(df: DataFrame, price: str, revenue: str, by=()) -> DataFrame:
    """Quadratic fit of Σ revenue per price; the vertex is the optimal price
    (a maximum only if ``is_maximum``)."""
    by = [by] if isinstance(by, str) else list(by)
    g = df.where(F.col(price).isNotNull()).groupBy(*by, price).agg(F.sum(revenue).alias("_rev"))
    f = quad_fit(g, price, "_rev", by)
    return f.select(*by, F.col("vertex_x").alias("optimal_price"), F.col("vertex_y").alias("estimated_revenue"),
                    "a", "is_maximum")


def segment_price_sensitivity(df: DataFrame, segment: str, price: str, demand: str, revenue: str) -> DataFrame:
    """Per segment: mean elasticity and optimal price, each on the segment's
    own rows.  Both start from one table of (segment, price) with the mean
    demand and the revenue, so the rows are read once."""
    g = (df.where(F.col(segment).isNotNull() & F.col(price).isNotNull()).groupBy(segment, price)
           .agg(F.avg(demand).alias("_demand"), F.sum(revenue).alias("_revenue")))
    g = cut_lineage(g)
    e = elasticity_curve(g, price, "_demand", by=segment).groupBy(segment).agg(F.avg("elasticity").alias("elasticity"))
    return e.join(optimal_price(g, price, "_revenue", by=segment), segment)


def demand_curve(t: DataFrame, window: int = 5) -> DataFrame:
    """Mean is_active per amount in amount order, smoothed by a centred
    rolling mean of ``min(window, n)`` rows (full window required)."""
    a = daily_activity_join(t).where(F.col(AMT).isNotNull())
    g = a.groupBy(AMT).agg(F.avg("is_active").alias("is_active"))
    o = global_order(g, [AMT])
    w = max(1, min(window, o.count()))  # one number, from the checkpointed order
    return centred_rolling_mean(o, "is_active", w, "smoothed_demand").select(AMT, "is_active", "smoothed_demand")


def revenue_curve(df: DataFrame, price: str, revenue: str, points: int = 100) -> DataFrame:
    """``points`` evenly spaced prices from min to max with the revenue of a
    parabola fitted on the *rows* (not price groups)."""
    f = quad_fit(df, price, revenue, with_range=True)  # one row
    x = f.select("a", "b", "c", F.col("x_min").alias("_lo"), F.col("x_max").alias("_hi"),
                 F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(points - 1)
    p = F.when(F.col("i") == points - 1, F.col("_hi")).otherwise(F.col("_lo") + F.col("i") * step)
    x = x.withColumn("price", p)
    rev = F.col("a") * F.col("price") * F.col("price") + F.col("b") * F.col("price") + F.col("c")
    return x.select("i", "price", rev.alias("revenue"))


def price_trends(t: DataFrame) -> DataFrame:
    """Mean, sample std and count of amounts per exact timestamp."""
    return (t.where(F.col(TS).isNotNull()).groupBy(F.col(TS).alias("date"))
             .agg(mavg(AMT).alias("mean_price"), F.stddev_samp(AMT).alias("std_price"),
                  F.count(AMT).alias("transactions")))
