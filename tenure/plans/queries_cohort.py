"""Registered queries: cohort retention / LTV."""

from __future__ import annotations

from tenure.operators import cohort as C
from tenure.plans.catalog import T, T_CTE, mavg, r6, register, rnd, sql

MIDX = "(year({c}) * 12 + month({c}) - 1)"

_DM = [
    """dm AS (SELECT driver_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month,
        coalesce(sum(amount), 0) AS amount FROM t
        WHERE driver_id IS NOT NULL AND transaction_date IS NOT NULL GROUP BY 1, 2)""",
    """dmc AS (SELECT dm.*, min(month) OVER (PARTITION BY driver_id) AS cohort_month FROM dm)""",
    f"""cc AS (SELECT cohort_month, CAST({MIDX.format(c='month')} - {MIDX.format(c='cohort_month')} AS BIGINT) AS period_number,
        count(*) AS drivers, sum(amount) AS ltv FROM dmc GROUP BY 1, 2)""",
    """ret AS (SELECT cohort_month, period_number, drivers,
        drivers / max(CASE WHEN period_number = 0 THEN drivers END) OVER (PARTITION BY cohort_month) AS retention,
        ltv, max(CASE WHEN period_number = 0 THEN ltv END) OVER (PARTITION BY cohort_month) AS ltv0 FROM cc)""",
]


@register("cohort_assign", sql(T_CTE, f"""SELECT t.*,
  CAST(date_trunc('month', f.first) AS DATE) AS cohort_month,
  CAST({MIDX.format(c='t.transaction_date')} - {MIDX.format(c='f.first')} AS BIGINT) AS period_number
FROM t LEFT JOIN (SELECT driver_id, min(transaction_date) AS first FROM t WHERE driver_id IS NOT NULL
  GROUP BY driver_id) f ON f.driver_id = t.driver_id"""))
def q_assign(spark, d):
    return C.cohort_assign(T(spark, d))


@register("cohort_retention", sql(T_CTE, *_DM,
  "SELECT cohort_month, period_number, drivers, round(retention, 6) AS retention FROM ret"))
def q_ret(spark, d):
    return rnd(C.cohort_retention(T(spark, d)), retention=6)


PERIODS = 80  # calendar months of ``orders`` at every scale


def _wide_sql(value: str, digits: int) -> str:
    cols = ", ".join(f"round(max(CASE WHEN period_number = {p} THEN {value} END), {digits}) AS period_{p}" for p in range(PERIODS))
    return sql(T_CTE, *_DM, f"SELECT cohort_month, {cols} FROM ret GROUP BY cohort_month")


@register("cohort_retention_wide", _wide_sql("retention", 6))
def q_ret_wide(spark, d):
    w = C.cohort_retention_wide(T(spark, d))
    return rnd(w, **{c: 6 for c in w.columns[1:]})


@register("cohort_ltv_wide", _wide_sql("ltv", 2))
def q_ltv_wide(spark, d):
    w = C.cohort_ltv_wide(T(spark, d))
    return rnd(w, **{c: 2 for c in w.columns[1:]})


@register("cohort_ltv", sql(T_CTE, *_DM, "SELECT cohort_month, period_number, round(CAST(ltv AS DOUBLE), 2) AS ltv FROM cc"))
def q_ltv(spark, d):
    return rnd(C.cohort_ltv(T(spark, d)), ltv=2)


@register("cohort_ltv_cumulative", sql(T_CTE, *_DM, """SELECT cohort_month, period_number, round(CAST(ltv AS DOUBLE), 2) AS ltv,
  round(CAST(sum(ltv) OVER (PARTITION BY cohort_month ORDER BY period_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE), 2)
  AS cumulative_ltv FROM cc"""))
def q_ltv_cum(spark, d):
    return rnd(C.cohort_ltv_cumulative(T(spark, d)), ltv=2, cumulative_ltv=2)


@register("cohort_period_means", sql(T_CTE, *_DM, f"""SELECT period_number, round(avg(retention), 6) AS avg_retention,
  {r6(mavg('ltv'))} AS avg_ltv FROM ret GROUP BY period_number"""))
def q_pm(spark, d):
    return rnd(C.cohort_period_means(T(spark, d)), means=("avg_ltv",), avg_retention=6)


@register("cohort_value_per_retained", sql(T_CTE, *_DM, """SELECT period_number,
  round(avg(CASE WHEN retention * ltv0 <> 0 THEN ltv / (retention * ltv0) END), 6) AS value_per_retained
FROM ret GROUP BY period_number"""))
def q_vpr(spark, d):
    return rnd(C.cohort_value_per_retained(T(spark, d)), value_per_retained=6)
