"""Transaction-level features (temporal, behaviour, monetary, risk,
interaction), profile features, IQR outlier treatment, feature text.

Per-driver statistics are computed with one ``groupBy(driver_id)`` and
joined back (a heavy driver's rows are salted, see ``join_drivers``) instead
of a window partitioned by driver, which would put its rows in one task.
Row-order features (3-row rolling mean, slope over row position) use the
global row index of :mod:`tenure.functions.ordering`: a driver's rows are
contiguous in that index, so a lag is an equi-join on the index and the
slope over positions is ``regr_slope(amount, index)`` (slope is invariant
to shifting x), a plain aggregate.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import HashingTF, Word2Vec, Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.functions.ordering import GIDX, PID, global_order, shifts_ordered
from tenure.functions.quantiles import column_quantiles
from tenure.functions.timeutil import floor_days, month_start
from tenure.operators.common import AMT, DRV, TS, TX, heavy_drivers, heavy_keys, join_drivers, join_salted, mavg, sum0
from tenure.sources.schema import numeric_columns

TEMPORAL = ["day_of_week", "month", "quarter", "is_weekend", "transaction_frequency",
            "days_since_first", "days_since_last"]
BEHAVIORAL = ["avg_payment", "payment_volatility", "payment_range", "payment_consistency", "usage_intensity"]
MONETARY = ["total_value", "avg_value_per_month", "value_trend"]
RISK = ["late_payment_risk", "risk_score"]
INTERACTION = ["value_frequency_interaction", "risk_value_interaction", "seasonal_value"]
ALL_FEATURES = TEMPORAL + BEHAVIORAL + MONETARY + RISK + INTERACTION


def _ordered(t: DataFrame) -> DataFrame:
    """Rows in (driver, date, tx_id) order with the global index ``_gidx``."""
    return global_order(t, [DRV, TS, TX])


def rolling_usage(t: DataFrame, n: int = 3, out: str = "usage_intensity", ordered: DataFrame | None = None) -> DataFrame:
    """Mean of the driver's last ``n`` rows (current included, at least one),
    in (date, tx_id) order; NULL amounts are skipped."""
    o = ordered if ordered is not None else _ordered(t)
    ks = list(range(1, n))
    o = shifts_ordered(o, [AMT], ks, [f"_l{k}" for k in ks], key=DRV)
    lags = [F.col(f"{AMT}_l{k}") for k in ks]
    vals = [F.col(AMT)] + lags
    s = sum((F.coalesce(v, F.lit(0.0)) for v in vals[1:]), F.coalesce(vals[0], F.lit(0.0)))
    c = sum((v.isNotNull().cast("int") for v in vals[1:]), vals[0].isNotNull().cast("int"))
    return (o.withColumn(out, F.when(c > 0, s / c))
             .drop(*[f"{AMT}_l{k}" for k in range(1, n)]))


def value_trend(t: DataFrame, ordered: DataFrame | None = None) -> DataFrame:
    """Per driver: least-squares slope of amount over row position 0..n-1
    (NULL for a single row)."""
    o = ordered if ordered is not None else _ordered(t)
    return (o.where(F.col(DRV).isNotNull()).groupBy(DRV)
             .agg(F.regr_slope(F.col(AMT), F.col(GIDX).cast("double")).alias("value_trend")))


def _driver_stats(t: DataFrame, with_slope: bool = False) -> DataFrame:
    """All per-driver statistics in one aggregation (partial, skew-safe);
    with ``with_slope`` ``t`` must carry ``_gidx`` and the slope is added."""
    slope = [F.regr_slope(F.col(AMT), F.col(GIDX).cast("double")).alias("value_trend")] if with_slope else []
    return t.where(F.col(DRV).isNotNull()).groupBy(DRV).agg(
        F.count(TS).alias("transaction_frequency"), F.min(TS).alias("_first"), F.max(TS).alias("_last"),
        mavg(AMT).alias("avg_payment"), F.stddev_samp(AMT).alias("payment_volatility"),
        (F.max(AMT) - F.min(AMT)).alias("payment_range"),
        sum0(AMT).alias("total_value"), *slope)


def transaction_features(t: DataFrame, groups=("temporal", "behavioral", "monetary", "risk", "interaction")) -> DataFrame:
    """The input rows plus the feature columns of the requested groups."""
    groups = set(groups)
    need_roll = "behavioral" in groups
    need_mon = "monetary" in groups
    base_cols = list(t.columns)
    if need_roll or need_mon:
        o = _ordered(t)
        stats = _driver_stats(o, with_slope=need_mon)  # one aggregation: stats and slope
        rows = (rolling_usage(t, ordered=o) if need_roll else o).drop(GIDX, PID)
    else:
        stats = _driver_stats(t)
        rows = t
    if need_mon:
        # per-driver stats joined onto the (driver, month) means first (both are
        # aggregates), so the rows are shuffled for one join, keyed by
        # (driver, month): a hot driver is spread over its months, a hot month
        # of a driver is salted
        mm = (t.where(F.col(DRV).isNotNull()).groupBy(DRV, month_start(TS).alias("_ym"))
               .agg(mavg(AMT).alias("avg_value_per_month")))
        hot = heavy_keys(o.withColumn("_ym", month_start(TS)), [DRV, "_ym"])  # the sorted copy has been written
        x = join_salted(rows.withColumn("_ym", month_start(TS)), mm.join(stats, DRV), [DRV, "_ym"], hot=hot).drop("_ym")
    else:
        x = join_drivers(rows, stats, heavy_drivers(t))
    x = (x.withColumn("day_of_week", F.weekday(TS))
          .withColumn("month", F.month(TS))
          .withColumn("quarter", F.quarter(TS))
          .withColumn("is_weekend", F.when(F.weekday(TS).isin(5, 6), 1).otherwise(0))
          .withColumn("days_since_first", floor_days("_first", TS))
          .withColumn("days_since_last", floor_days("_last", TS))
          .withColumn("payment_consistency", F.try_divide(F.col(AMT), F.col("avg_payment"))))
    late = F.coalesce((F.col(AMT) < F.col("avg_payment")) & (F.col("payment_consistency") < 0.8), F.lit(False))
    x = (x.withColumn("late_payment_risk", late.cast("int"))
          .withColumn("risk_score", (F.try_divide(F.col("payment_volatility"), F.col("avg_payment"))
                                     + F.col("late_payment_risk") - F.col("transaction_frequency")) / 3)
          .withColumn("value_frequency_interaction", F.col("avg_payment") * F.col("transaction_frequency"))
          .withColumn("risk_value_interaction", F.col("risk_score") * F.col("total_value"))
          .withColumn("seasonal_value", F.col(AMT) * F.sin(2 * math.pi * F.col("month") / 12)))
    want = {"temporal": TEMPORAL, "behavioral": BEHAVIORAL, "monetary": MONETARY,
            "risk": RISK, "interaction": INTERACTION}
    cols = [c for g in ("temporal", "behavioral", "monetary", "risk", "interaction") if g in groups for c in want[g]]
    return x.select(*base_cols, *cols)


def temporal_features(t: DataFrame) -> DataFrame:
    return transaction_features(t, ["temporal"])


def behavioral_features(t: DataFrame) -> DataFrame:
    return transaction_features(t, ["behavioral"])


def monetary_features(t: DataFrame) -> DataFrame:
    return transaction_features(t, ["monetary"])


def risk_features(t: DataFrame) -> DataFrame:
    return transaction_features(t, ["risk"])


def interaction_features(t: DataFrame) -> DataFrame:
    return transaction_features(t, ["interaction"])


def profile_features(df: DataFrame, as_of: str) -> DataFrame:
    """Optional profile columns: days inactive / since sign-up as of ``as_of``
    (a timestamp literal — the reference's "now"), total revenue."""
    now = F.lit(as_of).cast("timestamp_ntz")
    if "ultima_data_ativo" in df.columns:
        df = df.withColumn("dias_inativo", floor_days(F.col("ultima_data_ativo").cast("timestamp_ntz"), now))
    if "valor_medio_corrida" in df.columns and "numero_corridas" in df.columns:
        df = df.withColumn("receita_total", F.col("valor_medio_corrida") * F.col("numero_corridas"))
    if "data_cadastro" in df.columns:
        df = df.withColumn("tempo_cadastro", floor_days(F.col("data_cadastro").cast("timestamp_ntz"), now))
    return df


def missing_counts(df: DataFrame) -> DataFrame:
    """(column_name, n_missing) for every column, from one aggregation."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return agg.unpivot([], df.columns, "column_name", "n_missing")


def iqr_outlier_treatment(df: DataFrame, target: str, k: float = 1.5, exclude=()) -> DataFrame:
    """Per numeric column (64-bit int / double) other than ``target``:
    values outside ``[Q1 − k·IQR, Q3 + k·IQR]`` become the column median.
    Treated columns are returned as double.  Quantiles are exact, selected for
    all columns together in three scans; the rows are neither copied nor moved."""
    cols = numeric_columns(df, exclude=[target, *exclude])
    bounds = column_quantiles(df, cols, [0.25, 0.5, 0.75])
    out = []
    for c in df.columns:
        v = F.col(c).cast("double")
        if c in cols and bounds[c][0] is not None:
            q1, med, q3 = bounds[c]
            iqr = q3 - q1
            out.append(F.when((v < q1 - k * iqr) | (v > q3 + k * iqr), F.lit(med)).otherwise(v).alias(c))
        else:
            out.append(v.alias(c) if c in cols else F.col(c))
    return df.select(*out)


def token_vectors(texts: DataFrame, text_col: str = "feature_text", size: int = 32, max_rows: int = 20_000,
                  min_count: int = 1, seed: int = 42) -> Word2VecModel:
    """Vectors of the tokens of ``texts``, learnt from their neighbours in a text.

    At most ``max_rows`` texts, the first in hash order, are learnt from, so the
    token table is bounded; tokens seen less than ``min_count`` times in them have no vector.
    ``model.getVectors()`` is the table (word, vector)."""
    some = texts.orderBy(F.xxhash64(text_col), text_col).limit(max_rows).select(_tokens(text_col).alias("_tok"))
    return Word2Vec(inputCol="_tok", outputCol="_vec", vectorSize=size, minCount=min_count, seed=seed, numPartitions=1).fit(some)


def _tokens(text_col: str) -> F.Column:
    return F.split(F.lower(text_col), " ")


def feature_text(df: DataFrame, columns: list[str], embedder=None, num_features: int | None = None,
                 id_col: str | None = None, model: Word2VecModel | None = None) -> DataFrame:
    """Row → text ``"col value col value …"`` → vector.

    The vector is the mean of the vectors of the text's tokens (a token without
    one counts as zeros), taken on the JVM; they come from ``model`` or are learnt from
    the texts (:func:`token_vectors`).  ``num_features`` asks for hashed token counts
    (``HashingTF``) of that length instead.  ``embedder`` (pandas Series of text → list
    of float lists) replaces it and runs batched through ``mapInPandas``.
    """
    parts = []
    for c in columns:
        parts += [F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("nan"))]
    keep = [id_col] if id_col else []
    x = df.select(*keep, F.concat_ws(" ", *parts).alias("feature_text"))
    if embedder is None and num_features:
        v = HashingTF(inputCol="_tok", outputCol="_vec", numFeatures=num_features).transform(x.withColumn("_tok", _tokens("feature_text")))
        return v.select(*keep, "feature_text", vector_to_array("_vec").alias("embedding"))
    if embedder is None:
        if model is None and x.isEmpty():
            return x.withColumn("embedding", F.lit(None).cast("array<float>"))
        model = model or token_vectors(x)
        v = model.transform(x.withColumn(model.getInputCol(), _tokens("feature_text")))
        return v.select(*keep, "feature_text", vector_to_array(model.getOutputCol(), "float32").alias("embedding"))
    schema = T.StructType([*[f for f in x.schema.fields],
                           T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in batches:
            pdf = pdf.copy()
            pdf["embedding"] = list(embedder(pdf["feature_text"]))
            yield pdf

    return x.mapInPandas(run, schema)
