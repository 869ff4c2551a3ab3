"""Registered queries: transaction features, IQR treatment, feature text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.operators import drivers as D
from tenure.operators import features as FE
from tenure.plans.catalog import REF, T, T_CTE, fd, mavg, msum, r6, register, rnd, sql

MONTH = "CAST(date_trunc('month', transaction_date) AS DATE)"
BASE = ["tx_id", "driver_id", "transaction_date", "amount", "kind"]
ROUND = {"usage_intensity": 6, "value_trend": 4, "payment_volatility": 4, "payment_range": 2,
         "payment_consistency": 6, "risk_score": 6, "risk_value_interaction": 2,
         "value_frequency_interaction": 2, "seasonal_value": 4, "total_value": 2}
MEANS = ("avg_payment", "avg_value_per_month")

_FEAT = [
    f"""ds AS (SELECT driver_id, count(transaction_date) AS transaction_frequency, min(transaction_date) AS first_ts,
        max(transaction_date) AS last_ts, {mavg('amount')} AS avg_payment, stddev_samp(amount) AS payment_volatility,
        max(amount) - min(amount) AS payment_range, {msum('amount')} AS total_value
        FROM t WHERE driver_id IS NOT NULL GROUP BY driver_id)""",
    f"""mm AS (SELECT driver_id, {MONTH} AS ym, {mavg('amount')} AS avg_value_per_month FROM t
        WHERE driver_id IS NOT NULL GROUP BY 1, 2)""",
    """o AS (SELECT t.*, row_number() OVER (PARTITION BY driver_id ORDER BY transaction_date, tx_id) - 1 AS pos,
        avg(amount) OVER (PARTITION BY driver_id ORDER BY transaction_date, tx_id
                          ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS usage_intensity FROM t)""",
    "vt AS (SELECT driver_id, CASE WHEN count(amount) > 1 THEN regr_slope(amount, pos) END AS value_trend FROM o WHERE driver_id IS NOT NULL GROUP BY driver_id)",
    f"""x AS (SELECT o.tx_id, o.driver_id, o.transaction_date, o.amount, o.kind, o.usage_intensity,
        ds.transaction_frequency, ds.avg_payment, ds.payment_volatility, ds.payment_range, ds.total_value,
        mm.avg_value_per_month, vt.value_trend,
        CAST(isodow(o.transaction_date) - 1 AS INTEGER) AS day_of_week,
        CAST(month(o.transaction_date) AS INTEGER) AS month, CAST(quarter(o.transaction_date) AS INTEGER) AS quarter,
        CASE WHEN isodow(o.transaction_date) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend,
        {fd('ds.first_ts', 'o.transaction_date')} AS days_since_first,
        {fd('ds.last_ts', 'o.transaction_date')} AS days_since_last,
        CASE WHEN ds.avg_payment <> 0 THEN o.amount / ds.avg_payment END AS payment_consistency
      FROM o LEFT JOIN ds ON ds.driver_id = o.driver_id
      LEFT JOIN mm ON mm.driver_id = o.driver_id AND mm.ym = CAST(date_trunc('month', o.transaction_date) AS DATE)
      LEFT JOIN vt ON vt.driver_id = o.driver_id)""",
    """y AS (SELECT x.*, CAST(coalesce(amount < avg_payment AND payment_consistency < 0.8, false) AS INTEGER) AS late_payment_risk
      FROM x)""",
    """z AS (SELECT y.*,
        (CASE WHEN avg_payment <> 0 THEN payment_volatility / avg_payment END + late_payment_risk - transaction_frequency) / 3
          AS risk_score FROM y)""",
    """w AS (SELECT z.*, avg_payment * transaction_frequency AS value_frequency_interaction,
        risk_score * total_value AS risk_value_interaction,
        amount * sin(6.283185307179586 * month / 12) AS seasonal_value FROM z)""",
]


def _select(cols: list[str]) -> str:
    # "+ 0.0" turns DuckDB's -0.0 into 0.0 (Spark's rounding never yields -0.0)
    parts = [f"{r6(c)} AS {c}" if c in MEANS else f"round({c}, {ROUND[c]}) + 0.0 AS {c}" if c in ROUND else c for c in BASE + cols]
    return "SELECT " + ", ".join(parts) + " FROM w"


def _reg(name, fn, cols):
    @register(name, sql(T_CTE, *_FEAT, _select(cols)))
    def q(spark, d):
        return rnd(fn(T(spark, d)), means=MEANS, **{c: ROUND[c] for c in cols if c in ROUND})
    return q


_reg("temporal_features", FE.temporal_features, FE.TEMPORAL)
_reg("behavioral_features", FE.behavioral_features, FE.BEHAVIORAL)
_reg("monetary_features", FE.monetary_features, FE.MONETARY)
_reg("risk_features", FE.risk_features, FE.RISK)
_reg("interaction_features", FE.interaction_features, FE.INTERACTION)
_reg("transaction_features", FE.transaction_features, FE.ALL_FEATURES)


@register("rolling_usage", sql(T_CTE, *_FEAT, _select(["usage_intensity"])))
def q_rolling(spark, d):
    t = T(spark, d)
    return rnd(FE.rolling_usage(t).select(*BASE, "usage_intensity"), usage_intensity=6)


@register("value_trend", sql(T_CTE, *_FEAT, "SELECT driver_id, round(value_trend, 4) + 0.0 AS value_trend FROM vt"))
def q_trend(spark, d):
    return rnd(FE.value_trend(T(spark, d)), value_trend=4)


_DF_COLS = ["driver_id", "total_transactions", "avg_amount", "std_amount", "total_amount", "days_active",
            "avg_transaction_per_day", "payment_type_FIRST_PAYMENT", "payment_type_FIRST_PAYMENT_EXCHANGE",
            "payment_type_RECURRENCY"]
_KS = ["FIRST_PAYMENT", "FIRST_PAYMENT_EXCHANGE", "RECURRENCY"]
_DF_SQL = f"""dfe AS (SELECT driver_id, count(amount) AS total_transactions, {mavg('amount')} AS avg_amount,
  stddev_samp(amount) AS std_amount, {msum('amount')} AS total_amount,
  min(transaction_date) AS first_transaction, max(transaction_date) AS last_transaction,
  {fd('min(transaction_date)', 'max(transaction_date)')} AS days_active,
  count(amount) / ({fd('min(transaction_date)', 'max(transaction_date)')} + 1) AS avg_transaction_per_day,
  CAST({fd('max(transaction_date)', 'any_value(ref_date)')} > 30 AS BIGINT) AS churn,
  {', '.join(f"avg(CASE WHEN kind = '{k}' THEN 1.0 ELSE 0.0 END) AS payment_type_{k}" for k in _KS)}
  FROM t, ref WHERE driver_id IS NOT NULL GROUP BY driver_id)"""
_IQR_ROUND = {"std_amount": 4, "total_amount": 4, "avg_transaction_per_day": 6,
              **{f"payment_type_{k}": 6 for k in _KS}}


def _iqr_sql() -> str:
    qs = ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}" for c in _DF_COLS)
    out = []
    for c in ["driver_id", "total_transactions", "avg_amount", "std_amount", "total_amount", "first_transaction",
              "last_transaction", "days_active", "avg_transaction_per_day", "churn",
              *[f"payment_type_{k}" for k in _KS]]:
        if c in _DF_COLS:
            q1, med, q3 = f"q_{c}[1]", f"q_{c}[2]", f"q_{c}[3]"
            e = (f"CASE WHEN CAST({c} AS DOUBLE) < {q1} - 1.5 * ({q3} - {q1}) OR CAST({c} AS DOUBLE) > {q3} + 1.5 * ({q3} - {q1}) "
                 f"THEN {med} ELSE CAST({c} AS DOUBLE) END")
            out.append(f"{r6(e)} AS {c}" if c == "avg_amount" else f"round({e}, {_IQR_ROUND[c]}) AS {c}" if c in _IQR_ROUND else f"{e} AS {c}")
        else:
            out.append(c)
    return f"SELECT {', '.join(out)} FROM dfe, (SELECT {qs} FROM dfe) q"


@register("iqr_outlier_treatment", sql(T_CTE, REF, _DF_SQL, _iqr_sql()))
def q_iqr(spark, d):
    return rnd(FE.iqr_outlier_treatment(D.driver_features(T(spark, d)), "churn"), means=("avg_amount",), **_IQR_ROUND)


_TEXT = ["total_transactions", "days_active", "churn"]


@register("feature_text_rows", sql(T_CTE, REF, _DF_SQL, "SELECT driver_id, " + " || ' ' || ".join(
    f"'{c} ' || coalesce(CAST({c} AS VARCHAR), 'nan')" for c in _TEXT) + " AS feature_text FROM dfe"))
def q_text_rows(spark, d):
    df = D.driver_features(T(spark, d))
    return FE.feature_text(df, _TEXT, embedder=lambda texts: [[]] * len(texts), id_col="driver_id").select("driver_id", "feature_text")


@register("feature_text", None)
def q_text(spark, d):
    df = D.driver_features(T(spark, d))
    return FE.feature_text(df, ["total_transactions", "avg_amount", "total_amount", "days_active"],
                           id_col="driver_id")


_SCALED = [c for c in _DF_COLS if c != "driver_id"]


@register("scaled_features", sql(T_CTE, REF, _DF_SQL, "SELECT driver_id, " + ", ".join(
    f"round(CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE CASE WHEN {c} IS NOT NULL THEN 0.0 END END, 6) + 0.0 AS {c}"
    for c in _SCALED) + " FROM dfe"))
def q_scaled(spark, d):
    from tenure.models.prepare import model_columns, scaled_features
    df = D.driver_features(T(spark, d))
    cols = model_columns(df)
    return rnd(scaled_features(df, cols).select("driver_id", *cols), **{c: 6 for c in cols})


_DF_ALL = ["driver_id", "total_transactions", "avg_amount", "std_amount", "total_amount", "first_transaction", "last_transaction",
           "days_active", "avg_transaction_per_day", "churn", *[f"payment_type_{k}" for k in _KS]]


@register("driver_missing_counts", sql(T_CTE, REF, _DF_SQL, "SELECT column_name, n_missing FROM (SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in _DF_ALL) + f" FROM dfe) UNPIVOT (n_missing FOR column_name IN ({', '.join(_DF_ALL)}))"))
def q_driver_missing(spark, d):
    return FE.missing_counts(D.driver_features(T(spark, d)))
