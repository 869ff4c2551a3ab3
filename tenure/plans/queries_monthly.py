"""Registered queries: month-over-month churn, monthly and kind statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.functions.numeric import half_even, thousands
from tenure.functions.timeutil import month_name
from tenure.operators import monthly as M
from tenure.plans.catalog import T, T_CTE, mavg, msum, r6, register, rnd, sql

MONTH = "CAST(date_trunc('month', transaction_date) AS DATE)"
MNUM = "CAST(month(transaction_date) AS INTEGER)"


def _flows(key_sql: str) -> list[str]:
    return [
        f"""dm AS (SELECT DISTINCT driver_id, {key_sql} AS month FROM t
                 WHERE driver_id IS NOT NULL AND transaction_date IS NOT NULL)""",
        "ch AS (SELECT month, lag(month) OVER (ORDER BY month) AS prev_month FROM (SELECT DISTINCT month FROM dm))",
        "act AS (SELECT month, count(*) AS active FROM dm GROUP BY month)",
        """ret AS (SELECT ch.month, count(*) AS retained FROM ch
                  JOIN dm a ON a.month = ch.prev_month
                  JOIN dm b ON b.driver_id = a.driver_id AND b.month = ch.month GROUP BY ch.month)""",
        """f AS (SELECT ch.month, ch.prev_month, act.active, coalesce(pa.active, 0) AS previous_active,
                  coalesce(ret.retained, 0) AS retained
                FROM ch JOIN act ON act.month = ch.month LEFT JOIN act pa ON pa.month = ch.prev_month
                LEFT JOIN ret ON ret.month = ch.month)""",
    ]


@register("monthly_churn_calendar", sql(T_CTE, *_flows(MNUM), """SELECT month, active AS active_drivers,
  previous_active - retained AS churned_drivers, active - retained AS new_drivers,
  round(CASE WHEN previous_active > 0 THEN (previous_active - retained) / previous_active ELSE 0.0 END, 6) AS churn_rate,
  previous_active,
  round(CASE WHEN previous_active > 0 THEN (active - previous_active) / previous_active END, 6) AS net_growth
FROM f"""))
def q_mcc(spark, d):
    return rnd(M.monthly_churn_calendar(T(spark, d)), churn_rate=6, net_growth=6)


@register("monthly_churn", sql(T_CTE, *_flows(MONTH), """SELECT month, previous_active AS active_prev,
  active AS active_current, previous_active - retained AS churned,
  round(CASE WHEN previous_active > 0 THEN (previous_active - retained) / previous_active ELSE 0.0 END, 6) AS churn_rate
FROM f WHERE prev_month IS NOT NULL"""))
def q_mc(spark, d):
    return rnd(M.monthly_churn(T(spark, d)), churn_rate=6)


def _stats_sql(key: str) -> str:
    return sql(T_CTE, f"""SELECT {key} AS month, count(DISTINCT driver_id) AS n_drivers,
  round({msum('amount')}, 2) AS total_amount, {r6(mavg('amount'))} AS avg_amount,
  count(amount) AS n_transactions
FROM t WHERE transaction_date IS NOT NULL GROUP BY 1""")


@register("monthly_stats", _stats_sql(MONTH))
def q_ms(spark, d):
    return rnd(M.monthly_stats(T(spark, d)), means=("avg_amount",), total_amount=2)


@register("monthly_stats_calendar", _stats_sql(MNUM))
def q_msc(spark, d):
    return rnd(M.monthly_stats(T(spark, d), key="month"), means=("avg_amount",), total_amount=2)


@register("kind_stats", sql(T_CTE, f"""SELECT kind, count(DISTINCT driver_id) AS n_drivers,
  round({msum('amount')}, 2) AS total_amount, {r6(mavg('amount'))} AS avg_amount,
  count(amount) AS n_transactions
FROM t WHERE kind IS NOT NULL GROUP BY kind"""))
def q_ks(spark, d):
    return rnd(M.kind_stats(T(spark, d)), means=("avg_amount",), total_amount=2)


@register("monthly_trend", sql(T_CTE, *_flows(MONTH),
  f"rev AS (SELECT {MONTH} AS month, {msum('amount')} AS revenue FROM t WHERE transaction_date IS NOT NULL GROUP BY 1)",
  """x AS (SELECT f.month, f.active AS drivers, coalesce(rev.revenue, 0) AS revenue,
     CASE WHEN previous_active > 0 THEN (previous_active - retained) / previous_active ELSE 0.0 END AS churn_rate,
     CASE WHEN previous_active > 0 THEN (active - previous_active) / previous_active ELSE 0.0 END AS growth_rate
   FROM f LEFT JOIN rev ON rev.month = f.month)""",
  """SELECT month, drivers, round(revenue, 2) AS revenue, round(churn_rate, 6) AS churn_rate,
       round(growth_rate, 6) AS growth_rate, round(revenue * churn_rate, 2) AS revenue_at_risk FROM x"""))
def q_mt(spark, d):
    return rnd(M.monthly_trend(T(spark, d)), revenue=2, churn_rate=6, growth_rate=6, revenue_at_risk=2)


@register("net_churn_trend", sql(T_CTE, f"""c AS (SELECT {MONTH} AS month, count(DISTINCT driver_id) AS n FROM t
    WHERE driver_id IS NOT NULL AND transaction_date IS NOT NULL GROUP BY 1)""",
  """cal AS (SELECT CAST(unnest(generate_series(CAST(min(month) AS TIMESTAMP), CAST(max(month) AS TIMESTAMP),
            INTERVAL 1 MONTH)) AS DATE) AS month FROM c)""",
  """x AS (SELECT cal.month, coalesce(c.n, 0) AS n_drivers,
            lag(coalesce(c.n, 0)) OVER (ORDER BY cal.month) AS prev FROM cal LEFT JOIN c ON c.month = cal.month)""",
  """SELECT month, n_drivers, round(CASE WHEN prev IS NULL THEN 1.0 WHEN prev = 0 AND n_drivers = 0 THEN 1.0
       WHEN prev = 0 THEN NULL ELSE 1 - n_drivers / prev END, 6) AS churn_rate FROM x"""))
def q_nct(spark, d):
    return rnd(M.net_churn_trend(T(spark, d)), churn_rate=6)


@register("transaction_seasonality", sql(T_CTE, f"""c AS (SELECT {MNUM} AS month, count(*) AS n_transactions
    FROM t WHERE transaction_date IS NOT NULL GROUP BY 1)""",
  "SELECT month, n_transactions, round(n_transactions / max(n_transactions) OVER (), 6) AS seasonality FROM c"))
def q_ts(spark, d):
    return rnd(M.transaction_seasonality(T(spark, d)), seasonality=6)


@register("month_churned_drivers", sql(T_CTE, *_flows(MONTH)[:2], """SELECT ch.month, a.driver_id
FROM ch JOIN dm a ON a.month = ch.prev_month
WHERE NOT EXISTS (SELECT 1 FROM dm b WHERE b.driver_id = a.driver_id AND b.month = ch.month)"""))
def q_mcd(spark, d):
    return M.month_churned_drivers(T(spark, d))


@register("month_new_drivers", sql(T_CTE, *_flows(MONTH)[:2], """SELECT ch.month, a.driver_id
FROM ch JOIN dm a ON a.month = ch.month
WHERE NOT EXISTS (SELECT 1 FROM dm b WHERE b.driver_id = a.driver_id AND b.month = ch.prev_month)"""))
def q_mnd(spark, d):
    return M.month_new_drivers(T(spark, d))


@register("seasonality_labels", sql(T_CTE, f"""c AS (SELECT {MNUM} AS month, count(*) AS n FROM t WHERE transaction_date IS NOT NULL GROUP BY 1)""",
  """SELECT month, strftime(make_date(2000, month, 1), '%B') AS month_name, format('{:,}', n) AS label,
       round_even(n / 8.0, 2) AS eighth FROM c"""))
def q_labels(spark, d):
    x = M.transaction_seasonality(T(spark, d))
    return x.select("month", month_name("month").alias("month_name"), thousands("n_transactions").alias("label"),
                    half_even(F.col("n_transactions") / 8.0).alias("eighth"))
