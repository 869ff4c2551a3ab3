"""Registered queries: sources, churn KPIs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.operators import churn
from tenure.plans.catalog import (ACT, CHURNED, PER_LAST, REF, T, T_CTE, ACT_CTE, fd, mavg, r6, register, rnd,
                                  sql)
from tenure.sources.readers import load_transactions


@register("scan_transactions", sql(T_CTE, "SELECT * FROM t"))
def q_scan(spark, d):
    return load_transactions(spark, d)


@register("churn_basic_metrics", sql(T_CTE, REF, """per AS (
  SELECT driver_id, max(transaction_date) AS last, coalesce(sum(amount), 0) AS total
  FROM t WHERE driver_id IS NOT NULL GROUP BY driver_id)""", f"""x AS (
  SELECT count(*) AS total_drivers,
         count(*) FILTER (WHERE last < ref_date - INTERVAL 30 DAY) AS churned_drivers,
         count(*) FILTER (WHERE last >= ref_date - INTERVAL 30 DAY) AS n_active,
         {mavg('CASE WHEN last >= ref_date - INTERVAL 30 DAY THEN total END')} / 1.0 AS active_rev
  FROM per, ref)""",
 """SELECT total_drivers, churned_drivers, round(churned_drivers / total_drivers, 6) AS churn_rate,
       round(active_rev * (n_active * (churned_drivers / total_drivers)), 2) AS revenue_at_risk FROM x"""))
def q_basic(spark, d):
    return rnd(churn.churn_basic_metrics(T(spark, d)), churn_rate=6, revenue_at_risk=2)


@register("driver_lifetimes", sql(T_CTE, f"""SELECT driver_id, min(transaction_date) AS first_transaction,
  max(transaction_date) AS last_transaction,
  {fd('min(transaction_date)', 'max(transaction_date)')} AS lifetime_days
FROM t WHERE driver_id IS NOT NULL GROUP BY driver_id"""))
def q_lifetimes(spark, d):
    return churn.driver_lifetimes(T(spark, d))


@register("lifetime_summary", sql(T_CTE, f"""lt AS (SELECT driver_id,
  {fd('min(transaction_date)', 'max(transaction_date)')} AS lifetime_days
  FROM t WHERE driver_id IS NOT NULL GROUP BY driver_id)""",
 """SELECT round(avg(lifetime_days), 6) AS avg_days_to_churn,
       round(quantile_cont(lifetime_days, 0.5), 6) AS median_days_to_churn FROM lt"""))
def q_lifetime_summary(spark, d):
    return rnd(churn.lifetime_summary(T(spark, d)), avg_days_to_churn=6, median_days_to_churn=6)


@register("churned_drivers", sql(T_CTE, REF, PER_LAST, CHURNED, "SELECT driver_id, last_transaction FROM ch"))
def q_churned(spark, d):
    return churn.churned_drivers(T(spark, d))


@register("revenue_before_churn", sql(T_CTE, REF, PER_LAST, CHURNED, """r AS (
  SELECT t.driver_id, coalesce(sum(CASE WHEN t.transaction_date >= ch.last_transaction - INTERVAL 30 DAY
                                   THEN t.amount END), 0) AS rev
  FROM t JOIN ch ON t.driver_id = ch.driver_id GROUP BY t.driver_id)""",
 f"SELECT {r6("coalesce(avg(rev), 0)")} AS avg_revenue_before_churn FROM r"))
def q_rev_before(spark, d):
    return rnd(churn.revenue_before_churn(T(spark, d)), means=("avg_revenue_before_churn",))


@register("churn_by_segment", sql(T_CTE, PER_LAST, """sd AS (
  SELECT DISTINCT kind, driver_id FROM t WHERE driver_id IS NOT NULL AND kind IS NOT NULL)""",
 """x AS (SELECT sd.kind, per.last, max(per.last) OVER (PARTITION BY sd.kind) AS seg_ref
  FROM sd JOIN per ON sd.driver_id = per.driver_id)""",
 """SELECT kind, round(avg(CASE WHEN last < seg_ref - INTERVAL 30 DAY THEN 1.0 ELSE 0.0 END), 6) AS churn_rate,
       count(*) AS n_drivers FROM x GROUP BY kind"""))
def q_churn_by_segment(spark, d):
    return rnd(churn.churn_by_segment(T(spark, d)), churn_rate=6)


@register("churn_seasonality", sql(T_CTE, REF, PER_LAST, CHURNED,
 """SELECT CAST(date_trunc('month', last_transaction) AS DATE) AS month, count(*) AS churned_drivers
FROM ch GROUP BY 1"""))
def q_seasonality(spark, d):
    return churn.churn_seasonality(T(spark, d))


@register("segment_churn_last_kind", sql(T_CTE, REF, """per AS (
  SELECT driver_id, max(transaction_date) AS last,
         arg_max(kind, tx_id) FILTER (WHERE kind IS NOT NULL) AS last_kind
  FROM t WHERE driver_id IS NOT NULL GROUP BY driver_id)""",
 f"""SELECT last_kind AS kind,
       round(avg(CASE WHEN {fd('last', 'ref_date')} > 30 THEN 1.0 ELSE 0.0 END), 6) AS churn_rate,
       count(*) AS total_drivers
FROM per, ref WHERE last_kind IS NOT NULL GROUP BY last_kind"""))
def q_last_kind(spark, d):
    return rnd(churn.segment_churn_last_kind(T(spark, d)), churn_rate=6)


@register("transaction_churn_flag", sql(T_CTE, REF, PER_LAST, CHURNED,
 """SELECT t.*, CASE WHEN ch.driver_id IS NULL THEN 0 ELSE 1 END AS churn
FROM t LEFT JOIN ch ON t.driver_id = ch.driver_id"""))
def q_tx_flag(spark, d):
    return churn.transaction_churn_flag(T(spark, d))


@register("kpi_summary", sql(T_CTE, REF, """per AS (
  SELECT driver_id, max(transaction_date) AS last, min(transaction_date) AS first,
         coalesce(sum(amount), 0) AS total
  FROM t WHERE driver_id IS NOT NULL GROUP BY driver_id)""", f"""x AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE last < ref_date - INTERVAL 30 DAY) AS c,
         count(*) FILTER (WHERE last >= ref_date - INTERVAL 30 DAY) AS a,
         {mavg('CASE WHEN last >= ref_date - INTERVAL 30 DAY THEN total END')} AS ar,
         avg({fd('first', 'last')}) AS lt
  FROM per, ref)""",
 """SELECT round(c / n, 6) AS churn_rate, round(lt, 6) AS avg_days_to_churn,
       round(ar * (a * (c / n)), 2) AS revenue_at_risk FROM x"""))
def q_kpi(spark, d):
    return rnd(churn.kpi_summary(T(spark, d)), churn_rate=6, avg_days_to_churn=6, revenue_at_risk=2)


@register("activity_churn_basic_metrics", sql(ACT_CTE, REF, """per AS (
  SELECT driver_id, max(transaction_date) AS last, coalesce(sum(amount), 0) AS total
  FROM t WHERE driver_id IS NOT NULL GROUP BY driver_id)""", f"""x AS (
  SELECT count(*) AS total_drivers,
         count(*) FILTER (WHERE last < ref_date - INTERVAL 1 DAY) AS churned_drivers,
         count(*) FILTER (WHERE last >= ref_date - INTERVAL 1 DAY) AS n_active,
         {mavg('CASE WHEN last >= ref_date - INTERVAL 1 DAY THEN total END')} / (1 / 30.0) AS active_rev
  FROM per, ref)""",
 """SELECT total_drivers, churned_drivers, round(churned_drivers / total_drivers, 6) AS churn_rate,
       round(active_rev * (n_active * (churned_drivers / total_drivers)), 2) AS revenue_at_risk FROM x"""))
def q_act_basic(spark, d):
    return rnd(churn.churn_basic_metrics(ACT(spark, d), window_days=1), churn_rate=6, revenue_at_risk=2)
