"""Registered queries: evaluation tables on the deterministic scored frame,
correlation tables, and the Spark ML keys (rows-only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.functions.numeric import histogram
from tenure.operators import drivers as D
from tenure.operators import evaluation as EV
from tenure.operators import features as FE
from tenure.operators.churn import transaction_churn_flag
from tenure.plans.catalog import REF, T, T_CTE, fd, mavg, msum, register, rnd, sql
from tenure.plans.queries_drivers import _SUMMARY, hist_sql
from tenure.plans.queries_features import _DF_SQL, _FEAT

SCORED = [
    REF,
    """sx AS (SELECT driver_id, max(transaction_date) AS last,
        max(CASE WHEN transaction_date < ref_date - INTERVAL 180 DAY THEN transaction_date END) AS lb,
        any_value(ref_date) AS ref_date FROM t, ref WHERE driver_id IS NOT NULL GROUP BY driver_id)""",
    f"""sy AS (SELECT driver_id, last, ref_date, {fd('lb', "ref_date - INTERVAL 180 DAY")} AS d FROM sx WHERE lb IS NOT NULL)""",
    f"""s AS (SELECT driver_id, CAST({fd('last', 'ref_date')} > 30 AS INTEGER) AS y_true,
        CAST(coalesce(CAST(d AS DOUBLE) / CAST(max(d) OVER () AS DOUBLE) >= 0.5, false) AS INTEGER) AS y_pred,
        CAST(d AS DOUBLE) / CAST(max(d) OVER () AS DOUBLE) AS y_prob FROM sy)""",
    "g AS (SELECT y_prob, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM s WHERE y_prob IS NOT NULL GROUP BY y_prob)",
    """c AS (SELECT y_prob, pos, neg, row_number() OVER (ORDER BY y_prob DESC) - 1 AS i,
        sum(pos) OVER (ORDER BY y_prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps,
        sum(neg) OVER (ORDER BY y_prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps FROM g)""",
]


def S(spark, d):
    return EV.scored_fixture(T(spark, d))


@register("scored_fixture", sql(T_CTE, *SCORED, "SELECT driver_id, y_true, y_pred, round(y_prob, 9) AS y_prob FROM s"))
def q_scored_fixture(spark, d):
    return rnd(S(spark, d), y_prob=9)


@register("confusion_matrix", sql(T_CTE, *SCORED, """SELECT a.y_true, b.y_pred,
  (SELECT count(*) FROM s WHERE s.y_true = a.y_true AND s.y_pred = b.y_pred) AS count
FROM (SELECT unnest([0, 1]) AS y_true) a, (SELECT unnest([0, 1]) AS y_pred) b"""))
def q_cm(spark, d):
    return EV.confusion_matrix(S(spark, d))


@register("roc_auc", sql(T_CTE, *SCORED, """SELECT round(sum(pos * (negcum - neg + 0.5 * neg)) / (sum(pos) * sum(neg)), 9)
  AS roc_auc FROM (SELECT *, sum(neg) OVER (ORDER BY y_prob ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS negcum
  FROM g)"""))
def q_auc(spark, d):
    return rnd(EV.roc_auc(S(spark, d)), roc_auc=9)


@register("roc_curve", sql(T_CTE, *SCORED, """n AS (SELECT *, lag(tps) OVER (ORDER BY i) AS tp_p, lead(tps) OVER (ORDER BY i) AS tp_n,
  lag(fps) OVER (ORDER BY i) AS fp_p, lead(fps) OVER (ORDER BY i) AS fp_n, max(i) OVER () AS last_i,
  max(tps) OVER () AS P, max(fps) OVER () AS N FROM c)""",
 """SELECT CAST(NULL AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL
SELECT y_prob, round(fps / N, 9), round(tps / P, 9) FROM n
WHERE i = 0 OR i = last_i OR (fp_p - 2 * fps + fp_n) <> 0 OR (tp_p - 2 * tps + tp_n) <> 0"""))
def q_roc(spark, d):
    return rnd(EV.roc_curve(S(spark, d)), fpr=9, tpr=9)


@register("pr_curve", sql(T_CTE, *SCORED, """SELECT y_prob AS threshold,
  round(CASE WHEN tps + fps <> 0 THEN tps / (tps + fps) ELSE 0.0 END, 9) AS precision,
  round(CASE WHEN max(tps) OVER () = 0 THEN 1.0 ELSE tps / max(tps) OVER () END, 9) AS recall FROM c
UNION ALL SELECT CAST(NULL AS DOUBLE), 1.0, 0.0"""))
def q_pr(spark, d):
    return rnd(EV.pr_curve(S(spark, d)), precision=9, recall=9)


@register("classification_report", sql(T_CTE, *SCORED, """k AS (SELECT
  count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS c00, count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS c01,
  count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS c10, count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS c11 FROM s)""",
 """m AS (SELECT *, CASE WHEN c00 + c10 <> 0 THEN c00 / (c00 + c10) ELSE 0.0 END AS p0,
   CASE WHEN c00 + c01 <> 0 THEN c00 / (c00 + c01) ELSE 0.0 END AS r0,
   CASE WHEN c01 + c11 <> 0 THEN c11 / (c01 + c11) ELSE 0.0 END AS p1,
   CASE WHEN c10 + c11 <> 0 THEN c11 / (c10 + c11) ELSE 0.0 END AS r1,
   c00 + c01 AS s0, c10 + c11 AS s1, c00 + c01 + c10 + c11 AS n FROM k)""",
 """f AS (SELECT *, CASE WHEN p0 + r0 <> 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f0,
   CASE WHEN p1 + r1 <> 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1 FROM m)""",
 """SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1_score, 9) AS f1_score,
  CAST(support AS BIGINT) AS support FROM (
  SELECT '0' AS label, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM f
  UNION ALL SELECT '1', p1, r1, f1, s1 FROM f
  UNION ALL SELECT 'accuracy', NULL, NULL, CASE WHEN n <> 0 THEN (c00 + c11) / n ELSE 0.0 END, n FROM f
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM f
  UNION ALL SELECT 'weighted avg', CASE WHEN n <> 0 THEN (p0 * s0 + p1 * s1) / n ELSE 0.0 END,
     CASE WHEN n <> 0 THEN (r0 * s0 + r1 * s1) / n ELSE 0.0 END, CASE WHEN n <> 0 THEN (f0 * s0 + f1 * s1) / n ELSE 0.0 END, n FROM f)"""))
def q_report(spark, d):
    return rnd(EV.classification_report(S(spark, d)), precision=9, recall=9, f1_score=9)


@register("calibration", sql(T_CTE, *SCORED, """e AS (SELECT list_sort(list_distinct(quantile_cont(y_prob,
  [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM s WHERE y_prob IS NOT NULL)""",
 """b AS (SELECT s.*, len(list_filter(edges[2:len(edges) - 1], lambda q: q < y_prob)) AS bin FROM s, e
   WHERE y_prob IS NOT NULL)""",
 """SELECT CAST(bin AS INTEGER) AS bin, round(avg(y_prob), 9) AS prob_pred, round(avg(CAST(y_true AS DOUBLE)), 9) AS actual,
  count(*) AS n FROM b GROUP BY bin"""))
def q_cal(spark, d):
    return rnd(EV.calibration(S(spark, d)), prob_pred=9, actual=9)


@register("probability_histogram", sql(T_CTE, *SCORED[:4], hist_sql("s", "y_prob", 30)))
def q_prob_hist(spark, d):
    return rnd(histogram(S(spark, d), "y_prob", 30), bin_start=6, bin_end=6)


# The numeric columns of the driver feature table, in its order: what the
# queries take from the frame itself, spelt out for the SQL.
NUMERIC = ["driver_id", "total_transactions", "avg_amount", "std_amount", "total_amount", "days_active",
           "avg_transaction_per_day", "churn", "payment_type_FIRST_PAYMENT",
           "payment_type_FIRST_PAYMENT_EXCHANGE", "payment_type_RECURRENCY"]
INPUTS = [c for c in NUMERIC if c not in ("driver_id", "churn")]


def _corr_sql(cols, relation):
    """DuckDB text of all pairs' correlations, from one pass over ``relation``."""
    pairs = ", ".join(f"{{'x': '{a}', 'y': '{b}', 'r': corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))}}" for a in cols for b in cols)
    return f"SELECT p.x AS x, p.y AS y, round(p.r, 6) + 0.0 AS r FROM (SELECT unnest([{pairs}]) AS p FROM {relation})"


@register("correlation_matrix", sql(T_CTE, REF, _DF_SQL, _corr_sql(NUMERIC, "dfe")))
def q_corr(spark, d):
    return rnd(EV.correlation_matrix(D.driver_features(T(spark, d))), r=6)


SUMMARY_NUMERIC = ["driver_id", "total_pagamentos", "valor_medio", "valor_total", "pagamentos_recorrentes", "trocas_carro",
                   "contratos_novos", "dias_sem_pagar"]


@register("summary_correlation_matrix", sql(T_CTE, _SUMMARY, _corr_sql(SUMMARY_NUMERIC, "ds")))
def q_corr_summary(spark, d):
    return rnd(EV.correlation_matrix(D.driver_summary(T(spark, d))), r=6)


TX_NUMERIC = ["tx_id", "driver_id", "amount", "transaction_frequency", "days_since_first", "days_since_last", "avg_payment",
              "payment_volatility", "payment_range", "payment_consistency", "usage_intensity", "total_value",
              "avg_value_per_month", "value_trend", "risk_score", "value_frequency_interaction", "risk_value_interaction",
              "seasonal_value"]


@register("transaction_correlation_matrix", sql(T_CTE, *_FEAT, _corr_sql(TX_NUMERIC, "w")))
def q_corr_tx(spark, d):
    return rnd(EV.correlation_matrix(FE.transaction_features(T(spark, d))), r=6)


@register("churn_correlation", sql(T_CTE, REF, _DF_SQL, "SELECT * FROM (" + "\nUNION ALL ".join(
    f"SELECT '{f}' AS feature, round(abs(corr(CAST({f} AS DOUBLE), CAST(churn AS DOUBLE))), 6) AS correlation FROM dfe"
    for f in INPUTS) + ")"))
def q_churn_corr(spark, d):
    from tenure.models.prepare import model_columns
    df = D.driver_features(T(spark, d))
    return rnd(EV.churn_correlation(df, model_columns(df), "churn"), correlation=6)


@register("correlation_graph", sql(T_CTE, REF, _DF_SQL, "cm AS (" + "\nUNION ALL ".join(
    f"SELECT '{a}' AS source, '{b}' AS target, abs(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))) AS w FROM dfe"
    for i, a in enumerate(INPUTS) for b in INPUTS[i + 1:]) + ")",
    "SELECT source, target, round(w, 6) AS weight FROM cm WHERE w > 0.3"))
def q_graph(spark, d):
    from tenure.models.prepare import model_columns
    df = D.driver_features(T(spark, d))
    return rnd(EV.correlation_graph(df, model_columns(df), 0.3), weight=6)


def _flagged(spark, d):
    return transaction_churn_flag(FE.transaction_features(T(spark, d)), 30)


@register("churn_correlation_top", None)
def q_churn_corr_top(spark, d):
    from tenure.models.importance import churn_correlation_top
    return rnd(churn_correlation_top(_flagged(spark, d), "churn", 5), correlation=6)


@register("importance_graph", None)
def q_importance_graph(spark, d):
    from tenure.models.importance import importance_graph
    return rnd(importance_graph(_flagged(spark, d), "churn", 10, 0.3), weight=6)


# --- model keys (no SQL form: rows-only) --------------------------------

def _model_data(spark, d):
    from tenure.models.prepare import fill_features, model_columns, stratified_split
    df = D.driver_features(T(spark, d))
    feats = model_columns(df)
    train, test = stratified_split(fill_features(df, feats), "churn", materialize=True)
    return train, test, feats


@register("stratified_split_counts", sql(T_CTE, REF, _DF_SQL, """k AS (SELECT churn, count(*) AS n,
  CAST(floor(0.2 * count(*) + 0.5) AS BIGINT) AS n_test FROM dfe GROUP BY churn)""",
  "SELECT 'train' AS split, churn, n - n_test AS n FROM k UNION ALL SELECT 'test', churn, n_test FROM k"))
def q_split_counts(spark, d):
    from tenure.models.prepare import stratified_split_counts
    return stratified_split_counts(D.driver_features(T(spark, d)), "churn")


# Every key fits what it needs, so its time is its own.

def _search(spark, d, kind, data=None):
    from tenure.models.train import train
    tr, _, feats = data or _model_data(spark, d)
    return train(tr, feats, "churn", kind=kind, id_col="driver_id")


def _cv(kind):
    def q(spark, d):
        from tenure.models.train import predict
        data = _model_data(spark, d)
        return predict(_search(spark, d, kind, data), data[1])
    return q


register("cv_rf", None)(_cv("rf"))
register("cv_gbt", None)(_cv("gb"))


def _select(spark, d):
    from tenure.models.train import select_model
    data = _model_data(spark, d)
    return *select_model(_search(spark, d, "rf", data), _search(spark, d, "gb", data), data[1]), data[1]


@register("model_selection", None)
def q_model_selection(spark, d):
    kind, _, a_rf, a_gb, _ = _select(spark, d)
    return spark.createDataFrame([(kind, float(a_rf), float(a_gb))], "selected string, auc_rf double, auc_gb double")


@register("scored", None)
def q_scored(spark, d):
    from tenure.models.train import predict
    _, best, _, _, test = _select(spark, d)
    return predict(best, test)


@register("feature_importance", None)
def q_importance(spark, d):
    from tenure.models.importance import feature_importance
    data = _model_data(spark, d)
    return feature_importance(spark, _search(spark, d, "rf", data).bestModel, data[2], k=20)


@register("churn_drivers_importance", None)
def q_drivers_importance(spark, d):
    from tenure.models.importance import churn_drivers_importance
    imp, _, _ = churn_drivers_importance(_flagged(spark, d), "churn")
    return imp
