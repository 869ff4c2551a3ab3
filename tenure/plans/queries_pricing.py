"""Registered queries: daily activity, elasticity, optimal price, curves."""

from __future__ import annotations

from tenure.operators import pricing as P
from tenure.plans.catalog import ACT, ACT_CTE, MIX, MIXED_CTE, PR, PRICING_CTE, T, T_CTE, mavg, r6, register, rnd, sql
from tenure.plans.queries_drivers import hist_sql


def quad_sql(src: str, x: str, y: str, by: str | None = None) -> list[str]:
    """CTEs ``qm``, ``qs``, ``qf`` computing the centred quadratic fit like
    :func:`tenure.functions.numeric.quad_fit` (``qf`` has a, b, c, vertex_x,
    vertex_y, is_maximum[, by])."""
    b = f"{by}, " if by else ""
    on = f"ON m.{by} = d.{by}" if by else "ON TRUE"
    return [
        f"qd AS (SELECT {b}CAST({x} AS DOUBLE) AS qx, CAST({y} AS DOUBLE) AS qy FROM {src} "
        f"WHERE {x} IS NOT NULL AND {y} IS NOT NULL)",
        f"qm AS (SELECT {b}avg(qx) AS m, stddev_pop(qx) AS s FROM qd {'GROUP BY ' + by if by else ''})",
        f"""qs AS (SELECT {('m.' + by + ', ') if by else ''}any_value(m) AS m, any_value(s) AS s, count(*) AS n,
            sum(z) AS s1, sum(z*z) AS s2, sum(z*z*z) AS s3, sum(z*z*z*z) AS s4, sum(qy) AS t0, sum(z*qy) AS t1,
            sum(z*z*qy) AS t2 FROM (SELECT d.*, (d.qx - m.m) / m.s AS z, m.m, m.s FROM qd d JOIN qm m {on}) m
            {'GROUP BY m.' + by if by else ''})""",
        """qdet AS (SELECT *, s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2) AS det,
            t2 * (s2 * n - s1 * s1) - s3 * (t1 * n - s1 * t0) + s2 * (t1 * s1 - s2 * t0) AS da,
            s4 * (t1 * n - t0 * s1) - t2 * (s3 * n - s1 * s2) + s2 * (s3 * t0 - t1 * s2) AS db,
            s4 * (s2 * t0 - s1 * t1) - s3 * (s3 * t0 - s2 * t1) + t2 * (s3 * s1 - s2 * s2) AS dc FROM qs)""",
        """qabc AS (SELECT *, da / det AS A, db / det AS B, dc / det AS C FROM qdet)""",
        f"""qf AS (SELECT {b}n, A / (s * s) AS a, B / s - 2 * A * m / (s * s) AS b,
            A * m * m / (s * s) - B * m / s + C AS c, (m * 2 * A - B * s) / (2 * A) AS vertex_x,
            (4 * A * C - B * B) / (4 * A) AS vertex_y, A < 0 AS is_maximum FROM qabc)""",
    ]


@register("daily_activity", sql(ACT_CTE, """SELECT driver_id, CAST(CAST(transaction_date AS DATE) AS TIMESTAMP) AS transaction_date,
  count(*) AS transactions, CAST(count(*) > 0 AS INTEGER) AS is_active FROM t
WHERE driver_id IS NOT NULL AND transaction_date IS NOT NULL GROUP BY 1, 2"""))
def q_daily(spark, d):
    return P.daily_activity(ACT(spark, d))


_DA = """da AS (SELECT driver_id, CAST(CAST(transaction_date AS DATE) AS TIMESTAMP) AS day, 1 AS is_active FROM t
  WHERE driver_id IS NOT NULL AND transaction_date IS NOT NULL GROUP BY 1, 2)"""


@register("daily_activity_join", sql(MIXED_CTE, _DA, """SELECT t.*, da.is_active FROM t LEFT JOIN da
  ON da.driver_id = t.driver_id AND da.day = t.transaction_date"""))
def q_daily_join(spark, d):
    return P.daily_activity_join(MIX(spark, d))


_EL = [
    "g AS (SELECT price, avg(demand) AS demand FROM pr WHERE price IS NOT NULL GROUP BY price)",
    """o AS (SELECT price, demand, last_value(demand IGNORE NULLS) OVER (ORDER BY price
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dfill FROM g)""",
    """l AS (SELECT price, demand, dfill, lag(price) OVER (ORDER BY price) AS pp,
        lag(dfill) OVER (ORDER BY price) AS dprev FROM o)""",
    """e AS (SELECT price, demand, price / pp - 1 AS price_pct_change, dfill / dprev - 1 AS demand_pct_change,
        (dfill / dprev - 1) / (price / pp - 1) AS elasticity FROM l)""",
]


@register("elasticity_curve", sql(PRICING_CTE, *_EL, """SELECT price, demand, round(price_pct_change, 9) AS price_pct_change,
  round(demand_pct_change, 9) AS demand_pct_change, round(elasticity, 6) AS elasticity FROM e"""))
def q_elcurve(spark, d):
    return rnd(P.elasticity_curve(PR(spark, d), "price", "demand"), price_pct_change=9, demand_pct_change=9,
               elasticity=6)


@register("price_elasticity", sql(PRICING_CTE, *_EL, "SELECT round(avg(elasticity), 6) AS elasticity FROM e"))
def q_el(spark, d):
    return rnd(P.price_elasticity(PR(spark, d), "price", "demand"), elasticity=6)


@register("optimal_price", sql(PRICING_CTE, "gp AS (SELECT price, sum(revenue) AS rev FROM pr WHERE price IS NOT NULL GROUP BY price)",
  *quad_sql("gp", "price", "rev"), """SELECT round(vertex_x, 4) AS optimal_price, round(vertex_y, 2) AS estimated_revenue,
  round(a, 6) AS a, is_maximum FROM qf"""))
def q_opt(spark, d):
    return rnd(P.optimal_price(PR(spark, d), "price", "revenue"), optimal_price=4, estimated_revenue=2, a=6)


@register("segment_price_sensitivity", sql(PRICING_CTE,
  """g AS (SELECT segment, price, avg(demand) AS demand FROM pr WHERE price IS NOT NULL AND segment IS NOT NULL
     GROUP BY segment, price)""",
  """o AS (SELECT segment, price, last_value(demand IGNORE NULLS) OVER (PARTITION BY segment ORDER BY price
     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dfill FROM g)""",
  """el AS (SELECT segment, avg(e) AS elasticity FROM (
     SELECT segment, (dfill / lag(dfill) OVER w - 1) / (price / lag(price) OVER w - 1) AS e
     FROM o WINDOW w AS (PARTITION BY segment ORDER BY price)) GROUP BY segment)""",
  """gp AS (SELECT segment, price, sum(revenue) AS rev FROM pr WHERE price IS NOT NULL AND segment IS NOT NULL
     GROUP BY segment, price)""",
  *quad_sql("gp", "price", "rev", by="segment"),
  """SELECT el.segment, round(elasticity, 6) AS elasticity, round(vertex_x, 4) AS optimal_price,
     round(vertex_y, 2) AS estimated_revenue, round(a, 6) AS a, is_maximum FROM el JOIN qf ON qf.segment = el.segment"""))
def q_seg_price(spark, d):
    return rnd(P.segment_price_sensitivity(PR(spark, d), "segment", "price", "demand", "revenue"), elasticity=6,
               optimal_price=4, estimated_revenue=2, a=6)


@register("demand_curve", sql(MIXED_CTE, """da AS (SELECT driver_id, CAST(CAST(transaction_date AS DATE) AS TIMESTAMP) AS day,
  1 AS is_active FROM t WHERE driver_id IS NOT NULL AND transaction_date IS NOT NULL GROUP BY 1, 2)""",
  """g AS (SELECT t.amount, avg(da.is_active) AS is_active FROM t LEFT JOIN da
     ON da.driver_id = t.driver_id AND da.day = t.transaction_date WHERE t.amount IS NOT NULL GROUP BY t.amount)""",
  """SELECT amount, is_active, CASE WHEN count(is_active) OVER w = 5 THEN avg(is_active) OVER w END AS smoothed_demand
  FROM g WINDOW w AS (ORDER BY amount ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""))
def q_demand(spark, d):
    return P.demand_curve(MIX(spark, d))


@register("revenue_curve", sql(PRICING_CTE, *quad_sql("pr", "price", "revenue"),
  "rg AS (SELECT CAST(min(price) AS DOUBLE) AS lo, CAST(max(price) AS DOUBLE) AS hi FROM pr)",
  """pts AS (SELECT i, CASE WHEN i = 99 THEN hi ELSE lo + i * ((hi - lo) / 99) END AS price, a, b, c
     FROM rg, qf, (SELECT CAST(unnest(range(0, 100)) AS INTEGER) AS i))""",
  "SELECT i, round(price, 6) AS price, round(a * price * price + b * price + c, 2) AS revenue FROM pts"))
def q_revcurve(spark, d):
    return rnd(P.revenue_curve(PR(spark, d), "price", "revenue"), price=6, revenue=2)


@register("price_trends", sql(T_CTE, f"""SELECT transaction_date AS date, {r6(mavg('amount'))} AS mean_price,
  round(stddev_samp(amount), 4) AS std_price, count(amount) AS transactions FROM t
WHERE transaction_date IS NOT NULL GROUP BY transaction_date"""))
def q_ptrends(spark, d):
    return rnd(P.price_trends(T(spark, d)), means=("mean_price",), std_price=4)


@register("elasticity_histogram", sql(PRICING_CTE, *_EL, hist_sql("e", "elasticity", 20)))
def q_el_hist(spark, d):
    from tenure.functions.numeric import histogram
    return rnd(histogram(P.elasticity_curve(PR(spark, d), "price", "demand"), "elasticity", 20),
               bin_start=6, bin_end=6)
