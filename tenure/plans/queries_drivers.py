"""Registered queries: sources / profile, segments, driver tables, RFM."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.operators import drivers as D
from tenure.operators import features as FE
from tenure.operators import segments as S
from tenure.plans.catalog import PROF, PROFILE_CTE, REF, T, T_CTE, fd, mavg, msum, r6, register, rnd, sql

MONTH = "CAST(date_trunc('month', transaction_date) AS DATE)"
AS_OF = "2002-01-01 00:00:00"


@register("dataset_profile", sql(T_CTE, """SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns,
  min(transaction_date) AS min_date, max(transaction_date) AS max_date FROM t"""))
def q_profile(spark, d):
    t = T(spark, d)
    return t.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(t.columns)).cast("long").alias("n_columns"),
                 F.min("transaction_date").alias("min_date"), F.max("transaction_date").alias("max_date"))


@register("missing_counts", sql(PROFILE_CTE, """SELECT column_name, n_missing FROM (
  SELECT count(*) FILTER (WHERE driver_id IS NULL) AS driver_id,
         count(*) FILTER (WHERE acctbal IS NULL) AS acctbal,
         count(*) FILTER (WHERE data_cadastro IS NULL) AS data_cadastro,
         count(*) FILTER (WHERE ultima_data_ativo IS NULL) AS ultima_data_ativo,
         count(*) FILTER (WHERE valor_medio_corrida IS NULL) AS valor_medio_corrida,
         count(*) FILTER (WHERE numero_corridas IS NULL) AS numero_corridas FROM prof)
UNPIVOT (n_missing FOR column_name IN (driver_id, acctbal, data_cadastro, ultima_data_ativo,
         valor_medio_corrida, numero_corridas))"""))
def q_missing(spark, d):
    return FE.missing_counts(PROF(spark, d))


@register("profile_features", sql(PROFILE_CTE, f"""SELECT driver_id, acctbal, data_cadastro, ultima_data_ativo,
  {r6('valor_medio_corrida')} AS valor_medio_corrida, numero_corridas,
  {fd('ultima_data_ativo', "TIMESTAMP '" + AS_OF + "'")} AS dias_inativo,
  round(valor_medio_corrida * numero_corridas, 2) AS receita_total,
  {fd('data_cadastro', "TIMESTAMP '" + AS_OF + "'")} AS tempo_cadastro FROM prof"""))
def q_profile_features(spark, d):
    return rnd(FE.profile_features(PROF(spark, d), AS_OF), means=("valor_medio_corrida",), receita_total=2)


@register("distinct_kinds", sql(T_CTE, "SELECT DISTINCT kind FROM t"))
def q_kinds(spark, d):
    return T(spark, d).select("kind").distinct()


@register("payments_per_driver_by_kind", sql(T_CTE, """SELECT driver_id, count(*) AS total_pagamentos
FROM t WHERE kind = 'RECURRENCY' AND driver_id IS NOT NULL GROUP BY driver_id"""))
def q_ppd(spark, d):
    return D.payments_per_driver(T(spark, d), "RECURRENCY")


@register("segment_profile", sql(T_CTE, f"""g AS (SELECT kind, count(DISTINCT driver_id) AS total_drivers,
  {msum('amount')} AS total_revenue, {mavg('amount')} AS avg_amount, count(amount) AS transaction_count
  FROM t WHERE kind IS NOT NULL GROUP BY kind)""",
 """SELECT kind, total_drivers, round(total_revenue, 2) AS total_revenue, round(avg_amount + 3.7e-8, 6) AS avg_amount,
  transaction_count, round(transaction_count / total_drivers, 6) AS avg_transactions,
  round(total_revenue / sum(total_revenue) OVER (), 6) AS revenue_share FROM g"""))
def q_segprof(spark, d):
    return rnd(S.segment_profile(T(spark, d)), means=("avg_amount",), total_revenue=2, avg_transactions=6, revenue_share=6)


_STRATEGY = [
    REF,
    f"""mv AS (SELECT kind, {mavg('v')} AS monthly_value FROM (
        SELECT kind, {MONTH} AS m, coalesce(sum(amount), 0) AS v FROM t
        WHERE kind IS NOT NULL AND transaction_date IS NOT NULL GROUP BY 1, 2) GROUP BY kind)""",
    f"""dr AS (SELECT kind, count(*) AS n_drivers,
        avg(CASE WHEN {fd('last', 'ref_date')} > 30 THEN 1.0 ELSE 0.0 END) AS churn_rate FROM (
        SELECT kind, driver_id, max(transaction_date) AS last FROM t
        WHERE kind IS NOT NULL AND driver_id IS NOT NULL GROUP BY 1, 2), ref GROUP BY kind)""",
    """s AS (SELECT mv.kind, monthly_value, n_drivers, churn_rate, monthly_value / n_drivers AS avg_value_per_driver,
        monthly_value * churn_rate AS revenue_at_risk FROM mv JOIN dr ON mv.kind = dr.kind)""",
]


@register("segment_strategy", sql(T_CTE, *_STRATEGY, f"""SELECT kind, {r6("monthly_value")} AS monthly_value,
  n_drivers, round(churn_rate, 6) AS churn_rate, round(avg_value_per_driver, 4) AS avg_value_per_driver,
  round(revenue_at_risk, 4) AS revenue_at_risk FROM s"""))
def q_segstrat(spark, d):
    return rnd(S.segment_strategy(T(spark, d)), means=("monthly_value",), churn_rate=6, avg_value_per_driver=4,
               revenue_at_risk=4)


@register("segment_priority", sql(T_CTE, *_STRATEGY, """SELECT kind, round(revenue_at_risk * churn_rate, 4) AS score,
  round(n_drivers / max(n_drivers) OVER () * 50, 6) AS relative_size,
  round(revenue_at_risk / sum(revenue_at_risk) OVER (), 6) AS impact_share FROM s"""))
def q_segprio(spark, d):
    return rnd(S.segment_priority(T(spark, d)), score=4, relative_size=6, impact_share=6)


_SUMMARY = f"""ds AS (SELECT driver_id, max(transaction_date) AS ultimo_pagamento,
  min(transaction_date) AS primeiro_pagamento, count(transaction_date) AS total_pagamentos,
  {mavg('amount')} AS valor_medio, {msum('amount')} AS valor_total,
  count(*) FILTER (WHERE kind = 'RECURRENCY') AS pagamentos_recorrentes,
  count(*) FILTER (WHERE kind = 'FIRST_PAYMENT_EXCHANGE') AS trocas_carro,
  count(*) FILTER (WHERE kind = 'FIRST_PAYMENT') AS contratos_novos,
  {fd('max(transaction_date)', '(SELECT max(transaction_date) FROM t)')} AS dias_sem_pagar
  FROM t WHERE driver_id IS NOT NULL GROUP BY driver_id)"""


@register("driver_summary", sql(T_CTE, _SUMMARY, f"""SELECT driver_id, ultimo_pagamento, primeiro_pagamento,
  total_pagamentos, {r6("valor_medio")} AS valor_medio, round(valor_total, 2) AS valor_total,
  pagamentos_recorrentes, trocas_carro, contratos_novos, dias_sem_pagar, dias_sem_pagar > 28 AS churn FROM ds"""))
def q_dsum(spark, d):
    return rnd(D.driver_summary(T(spark, d)), means=("valor_medio",), valor_total=2)


@register("churn_by_new_contracts", sql(T_CTE, _SUMMARY, """SELECT contratos_novos,
  round(avg(CASE WHEN dias_sem_pagar > 28 THEN 1.0 ELSE 0.0 END), 6) AS churn_rate, count(*) AS n_drivers
FROM ds GROUP BY contratos_novos"""))
def q_cbnc(spark, d):
    return rnd(D.churn_by_new_contracts(T(spark, d)), churn_rate=6)


@register("payment_flow", sql(T_CTE, _SUMMARY, """SELECT * FROM (VALUES
  ('new_contract', 'recurring_payment', (SELECT CAST(sum(contratos_novos) AS BIGINT) FROM ds)),
  ('recurring_payment', 'churn', (SELECT CAST(count(*) FILTER (WHERE dias_sem_pagar > 28) AS BIGINT) FROM ds)))
  AS v(source, target, value)"""))
def q_flow(spark, d):
    return D.payment_flow(T(spark, d))


@register("driver_value_vs_inactivity", sql(T_CTE, _SUMMARY, f"""SELECT driver_id, {r6("valor_medio")} AS valor_medio,
  dias_sem_pagar, dias_sem_pagar > 28 AS churn FROM ds"""))
def q_dvi(spark, d):
    return rnd(D.driver_value_vs_inactivity(T(spark, d)), means=("valor_medio",))


_BEHAV = f"""b AS (SELECT p.driver_id, p.avg_amount, m.transactions_per_month, p.amount_std,
  {fd('p.last', '(SELECT max(transaction_date) FROM t)')} AS days_since_last FROM (
    SELECT driver_id, {mavg('amount')} AS avg_amount, coalesce(stddev_samp(amount), 0) AS amount_std,
           max(transaction_date) AS last FROM t WHERE driver_id IS NOT NULL GROUP BY driver_id) p
  LEFT JOIN (SELECT driver_id, avg(n) AS transactions_per_month FROM (
    SELECT driver_id, {MONTH} AS m, count(*) AS n FROM t
    WHERE driver_id IS NOT NULL AND transaction_date IS NOT NULL GROUP BY 1, 2) GROUP BY driver_id) m
  ON m.driver_id = p.driver_id)"""

_BLONG = """bl AS (SELECT driver_id, metric, value FROM (SELECT driver_id, CAST(avg_amount AS DOUBLE) AS avg_amount,
  CAST(transactions_per_month AS DOUBLE) AS transactions_per_month, CAST(amount_std AS DOUBLE) AS amount_std,
  CAST(days_since_last AS DOUBLE) AS days_since_last FROM b)
  UNPIVOT (value FOR metric IN (avg_amount, transactions_per_month, amount_std, days_since_last)))"""


@register("behavioral_metrics", sql(T_CTE, _BEHAV, f"""SELECT driver_id, {r6("avg_amount")} AS avg_amount,
  round(transactions_per_month, 6) AS transactions_per_month, round(amount_std, 4) AS amount_std,
  days_since_last FROM b"""))
def q_behav(spark, d):
    return rnd(D.behavioral_metrics(T(spark, d)), means=("avg_amount",), transactions_per_month=6, amount_std=4)


@register("behavioral_box_stats", sql(T_CTE, _BEHAV, _BLONG, """q AS (SELECT metric,
  quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
  FROM bl WHERE value IS NOT NULL GROUP BY metric)""",
 """SELECT bl.metric, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
  round(min(value), 4) AS min, round(max(value), 4) AS max,
  round(min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)), 4) AS lower_whisker,
  round(max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)), 4) AS upper_whisker
FROM bl JOIN q ON q.metric = bl.metric WHERE value IS NOT NULL GROUP BY bl.metric, q1, median, q3"""))
def q_box(spark, d):
    return rnd(D.behavioral_box_stats(T(spark, d)), q1=4, median=4, q3=4, min=4, max=4,
               lower_whisker=4, upper_whisker=4)


def hist_sql(src: str, value: str, bins: int, by: str | None = None, hue: str | None = None) -> str:
    """DuckDB text of :func:`tenure.functions.numeric.histogram` over relation ``src``."""
    byc, hc = f"{by}, " if by else "", f", {hue}" if hue else ""
    rows = f"(SELECT * FROM {src} WHERE {value} IS NOT NULL)"
    of = lambda a, b: f" AND {a}.{by} = {b}.{by}" if by else ""
    hues = f"JOIN (SELECT DISTINCT {byc}{hue} FROM {rows}) h ON TRUE{of('h', 'r')}" if hue else ""
    return f"""SELECT {f'g.{by}, ' if by else ''}g.bin, round(lo + (g.bin - 1) * ((hi - lo) / {bins}), 6) AS bin_start,
  round(lo + g.bin * ((hi - lo) / {bins}), 6) AS bin_end{f', g.{hue}' if hue else ''},
  count(s.{value}) AS count FROM (
  SELECT r.*, bin{f', h.{hue}' if hue else ''} FROM (
    SELECT {byc}CASE WHEN min({value}) = max({value}) THEN min({value}) - 0.5 ELSE CAST(min({value}) AS DOUBLE) END AS lo,
           CASE WHEN min({value}) = max({value}) THEN max({value}) + 0.5 ELSE CAST(max({value}) AS DOUBLE) END AS hi
    FROM {rows} {'GROUP BY ' + by if by else ''}) r {hues}, (SELECT unnest(range(1, {bins} + 1)) AS bin)) g
LEFT JOIN {rows} s ON least(CAST(floor((CAST(s.{value} AS DOUBLE) - lo) * {bins} / (hi - lo)) AS BIGINT) + 1, {bins}) = g.bin
  {of('s', 'g')}{f' AND s.{hue} = g.{hue}' if hue else ''}
GROUP BY {f'g.{by}, ' if by else ''}g.bin, lo, hi{f', g.{hue}' if hue else ''}"""


@register("amount_histogram_auto", sql(T_CTE, """q AS (SELECT count(amount) AS n, min(amount) AS lo, max(amount) AS hi,
  quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM t)""",
 """r AS (SELECT *, greatest(CASE WHEN q3 > q1 THEN 2 * (q3 - q1) / pow(n, 1.0 / 3) ELSE (hi - lo) / (log2(n) + 1) END, (hi - lo) / 1000) AS raw FROM q)""",
 "p AS (SELECT *, pow(10, floor(log10(raw))) AS step FROM r)",
 """w AS (SELECT *, step * CASE WHEN raw <= step THEN 1 WHEN raw <= 2 * step THEN 2 WHEN raw <= 5 * step THEN 5 ELSE 10 END AS width FROM p)""",
 "e AS (SELECT *, floor(lo / width) * width AS start, CAST(ceil((hi - floor(lo / width) * width) / width - 1e-9) AS BIGINT) AS bins FROM w)",
 """SELECT b.bin, round(start + (b.bin - 1) * width, 6) AS bin_start, round(start + b.bin * width, 6) AS bin_end, count(t.amount) AS count
FROM e, unnest(range(1, bins + 1)) AS b(bin) LEFT JOIN t ON least(CAST(floor((t.amount - start) / width) AS BIGINT) + 1, bins) = b.bin
GROUP BY b.bin, start, width"""))
def q_amount_hist_auto(spark, d):
    from tenure.functions.numeric import histogram
    return rnd(histogram(T(spark, d), "amount", None), bin_start=6, bin_end=6)


@register("amount_histogram", sql(T_CTE, hist_sql("t", "amount", 50)))
def q_amount_hist(spark, d):
    from tenure.functions.numeric import histogram
    return rnd(histogram(T(spark, d), "amount", 50), bin_start=6, bin_end=6)


@register("behavior_histogram", sql(T_CTE, _BEHAV, _BLONG, hist_sql("bl", "value", 20, by="metric")))
def q_behav_hist(spark, d):
    return rnd(D.behavior_histogram(T(spark, d)), bin_start=6, bin_end=6)


@register("value_by_churn_histogram", sql(T_CTE, _SUMMARY,
  "dv AS (SELECT valor_medio, dias_sem_pagar > 28 AS churn FROM ds)", hist_sql("dv", "valor_medio", 30, hue="churn")))
def q_vbc_hist(spark, d):
    return rnd(D.value_by_churn_histogram(T(spark, d)), bin_start=6, bin_end=6)


_KINDS_SORTED = ["FIRST_PAYMENT", "FIRST_PAYMENT_EXCHANGE", "RECURRENCY"]


@register("driver_features", sql(T_CTE, REF, f"""SELECT driver_id, count(amount) AS total_transactions,
  {r6(mavg('amount'))} AS avg_amount, round(stddev_samp(amount), 4) AS std_amount,
  round({msum('amount')}, 2) AS total_amount, min(transaction_date) AS first_transaction,
  max(transaction_date) AS last_transaction,
  {fd('min(transaction_date)', 'max(transaction_date)')} AS days_active,
  round(count(amount) / ({fd('min(transaction_date)', 'max(transaction_date)')} + 1), 6) AS avg_transaction_per_day,
  CAST({fd('max(transaction_date)', 'any_value(ref_date)')} > 30 AS BIGINT) AS churn,
  {', '.join(f"round(avg(CASE WHEN kind = '{k}' THEN 1.0 ELSE 0.0 END), 6) AS payment_type_{k}" for k in _KINDS_SORTED)}
FROM t, ref WHERE driver_id IS NOT NULL GROUP BY driver_id"""))
def q_dfeat(spark, d):
    return rnd(D.driver_features(T(spark, d)), means=("avg_amount",), std_amount=4, total_amount=2,
               avg_transaction_per_day=6, **{f"payment_type_{k}": 6 for k in _KINDS_SORTED})


def qcut_sql(col: str, src: str, q: int = 5) -> str:
    probs = ", ".join(str(i / q) for i in range(1, q))
    return f"(SELECT quantile_cont({col}, [{probs}]) FROM {src})"


@register("rfm_scores", sql(T_CTE, REF, f"""r AS (SELECT driver_id,
  {fd('max(transaction_date)', "any_value(ref_date) + INTERVAL 1 DAY")} AS recency,
  count(amount) AS frequency, {msum('amount')} AS monetary FROM t, ref
  WHERE driver_id IS NOT NULL GROUP BY driver_id)""",
 f"""e AS (SELECT {qcut_sql('recency', 'r')} AS er, {qcut_sql('frequency', 'r')} AS ef, {qcut_sql('monetary', 'r')} AS em)""",
 """s AS (SELECT r.*,
   6 - (1 + list_count(list_filter(er, lambda x: x < recency))) AS recency_score,
   1 + list_count(list_filter(ef, lambda x: x < frequency)) AS frequency_score,
   1 + list_count(list_filter(em, lambda x: x < monetary)) AS monetary_score FROM r, e)""",
 """SELECT driver_id, recency, frequency, round(monetary, 2) AS monetary, CAST(recency_score AS INTEGER) AS recency_score,
  CAST(frequency_score AS INTEGER) AS frequency_score, CAST(monetary_score AS INTEGER) AS monetary_score,
  CAST(recency_score * 100 + frequency_score * 10 + monetary_score AS INTEGER) AS rfm_score,
  round((6 - recency_score) / 5.0, 6) AS churn_risk FROM s"""))
def q_rfm(spark, d):
    return rnd(D.rfm_scores(T(spark, d)), monetary=2, churn_risk=6)
