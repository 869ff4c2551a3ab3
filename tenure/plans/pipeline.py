"""The staged retention job and persistence of its results.

read → transaction features → churn / cohort / segment tables → price tables →
driver importances → model → evaluation tables.  Every table is written by Spark (one
folder per table; features and metrics as versions with a manifest); nothing is
collected on the driver except the model's trees and AUCs.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.functions.timeutil import month_start
from tenure.operators import churn, cohort, drivers, evaluation, features, monthly, pricing, segments

DATA = "processed_transactions"
VERSIONS = "versions"
MANIFEST = ("version string, written timestamp_ntz, last_processed timestamp_ntz, fingerprint string, n_rows long, "
            "columns array<string>, metrics array<string>")


def fingerprint(df: DataFrame) -> str:
    """Tells inputs apart: a hash of the columns, the number of rows and two sums of
    row hashes, from one scan; the rows' order doesn't matter."""
    names = "|".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    cols = [F.col(f"`{c}`") for c in df.columns]
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("a"),
               F.sum(F.xxhash64(F.lit(1), *cols).cast("decimal(38,0)")).alias("b")).first()
    return hashlib.sha256(f"{names}|{r.n}|{r.a}|{r.b}".encode()).hexdigest()


def write_processed(df: DataFrame, metrics: dict[str, DataFrame], path: str, partition_by_month: bool = True,
                    files_per_month: int = 4, source: str | None = None) -> str:
    """Processed transactions (partitioned by month, so later reads prune) and each
    metric frame as a new version under ``path``; returns its name.

    The manifest (time, rows, columns, metrics, ``source``: the input's
    :func:`fingerprint`) is written last.  A version without one, left by a run
    that was stopped, is never read, and older versions stay as they are.  Rows
    are dealt by month and a spread key first, so a month has ``files_per_month``
    files at most instead of one per task."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    at = f"{path}/{VERSIONS}/{version}"
    if partition_by_month:
        w = df.withColumn("_month", month_start("transaction_date"))
        w = w.repartition("_month", F.pmod(F.xxhash64(*df.columns), F.lit(files_per_month)))
        w.write.partitionBy("_month").parquet(f"{at}/{DATA}")
    else:
        df.write.parquet(f"{at}/{DATA}")
    for name, m in metrics.items():
        m.write.parquet(f"{at}/metrics/{name}")
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    row = (version, now, now, source, spark.read.parquet(f"{at}/{DATA}").count(), list(df.columns), list(metrics))
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.parquet(f"{at}/manifest")
    return version


def load_processed(spark: SparkSession, path: str, source: str | None = None) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """The newest finished version that :func:`write_processed` wrote, and its manifest;
    with ``source`` only one made from that input.  FileNotFoundError if there is
    none; any other failure to read is raised as it is."""
    try:
        meta = spark.read.schema(MANIFEST).parquet(f"{path}/{VERSIONS}/*/manifest")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no processed data under {path}") from e
        raise
    meta = meta.where(F.col("fingerprint") == source) if source is not None else meta
    row = meta.orderBy(F.desc("written"), "version").first()  # one row per version
    if row is None:
        raise FileNotFoundError(f"no finished version of this input under {path}")
    at = f"{path}/{VERSIONS}/{row.version}"
    df = spark.read.parquet(f"{at}/{DATA}").select(*row.columns)
    return df, {n: spark.read.parquet(f"{at}/metrics/{n}") for n in row.metrics}, meta.where(F.col("version") == row.version)


def churn_tables(t: DataFrame) -> dict[str, DataFrame]:
    """KPIs, the advanced bundle, monthly, segment and cohort tables."""
    return {
        "churn_basic_metrics": churn.churn_basic_metrics(t),
        **churn.advanced_metrics(t),
        "churn_by_segment": churn.churn_by_segment(t),
        "monthly_churn": monthly.monthly_churn(t),
        "monthly_trend": monthly.monthly_trend(t),
        "kind_stats": monthly.kind_stats(t),
        "segment_profile": segments.segment_profile(t),
        "segment_strategy": segments.segment_strategy(t),
        "segment_priority": segments.segment_priority(t),
        "cohort_retention": cohort.cohort_retention(t),
        "cohort_ltv": cohort.cohort_ltv(t),
        "cohort_ltv_cumulative": cohort.cohort_ltv_cumulative(t),
        "cohort_period_means": cohort.cohort_period_means(t),
        "cohort_value_per_retained": cohort.cohort_value_per_retained(t),
        "driver_features": drivers.driver_features(t),
        "rfm_scores": drivers.rfm_scores(t),
    }


def price_tables(p: DataFrame) -> dict[str, DataFrame]:
    """Price stage on a frame with price, demand, revenue and segment."""
    return {
        "elasticity_curve": pricing.elasticity_curve(p, "price", "demand"),
        "optimal_price": pricing.optimal_price(p, "price", "revenue"),
        "segment_price_sensitivity": pricing.segment_price_sensitivity(p, "segment", "price", "demand", "revenue"),
        "revenue_curve": pricing.revenue_curve(p, "price", "revenue"),
    }


def evaluation_tables(scored: DataFrame) -> dict[str, DataFrame]:
    """Evaluation tables of a scored frame (y_true, y_pred, y_prob)."""
    return {"confusion_matrix": evaluation.confusion_matrix(scored), "roc_auc": evaluation.roc_auc(scored),
            "roc_curve": evaluation.roc_curve(scored), "pr_curve": evaluation.pr_curve(scored),
            "classification_report": evaluation.classification_report(scored), "calibration": evaluation.calibration(scored)}


def _write_tables(tables: dict[str, DataFrame], out: str, stage: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{stage}/{name}")


def run_pipeline(spark: SparkSession, t: DataFrame, out: str, prices: DataFrame | None = None, train_model: bool = True,
                 reuse: bool = True, grids: dict | None = None) -> dict:
    """The whole job on a canonical transactions frame; returns a summary.

    Features and metrics are written once and read from there by the later
    stages (price tables, importances, model, evaluation).  With ``reuse`` a
    finished result of the same input under ``out`` is read instead of computed again."""
    summary: dict = {"out": out, "reused": False}
    source = fingerprint(t)
    try:
        if not reuse:
            raise FileNotFoundError
        feats, metrics, _ = load_processed(spark, out, source)
        summary["reused"] = True
    except FileNotFoundError:
        write_processed(features.transaction_features(t), churn_tables(t), out, source=source)
        feats, metrics, _ = load_processed(spark, out, source)
    if prices is not None:
        _write_tables(price_tables(prices), out, "prices")
    if train_model:
        from tenure.models.importance import churn_drivers_importance, feature_importance
        from tenure.models.prepare import fill_features, model_columns, stratified_split
        from tenure.models.train import predict, save_model, select_model, train
        importances, _, _ = churn_drivers_importance(churn.transaction_churn_flag(feats), "churn")
        _write_tables({"driver_importance": importances}, out, "causal")
        df = metrics["driver_features"]
        cols = model_columns(df)
        tr, te = stratified_split(fill_features(df, cols), "churn", materialize=True)
        grids = grids or {}
        rf, gb = (train(tr, cols, kind=k, grid=grids.get(k), id_col="driver_id") for k in ("rf", "gb"))
        kind, best, a_rf, a_gb = select_model(rf, gb, te)
        save_model(best, f"{out}/model")  # the selected model is the one saved
        predict(best, te).write.mode("overwrite").parquet(f"{out}/model_tables/scored")
        scored = spark.read.parquet(f"{out}/model_tables/scored")
        _write_tables(evaluation_tables(scored) | {"feature_importance": feature_importance(spark, best, cols, k=None)}, out, "model_tables")
        summary.update({"selected": kind, "auc_rf": a_rf, "auc_gb": a_gb})
    return summary
