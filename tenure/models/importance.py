"""Feature importances and the driver ("causal") analysis model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.models.ensemble import TreeModel
from tenure.models.prepare import fill_features
from tenure.models.train import fit_forest
from tenure.operators.evaluation import churn_correlation, correlation_graph
from tenure.session import cut_lineage
from tenure.sources.schema import numeric_columns

IDS = ("driver_id", "tx_id")


def feature_importance(spark: SparkSession, model, names: list[str], k: int | None = 20) -> DataFrame:
    """(feature, importance) of a fitted tree model, sorted, top ``k``.

    A :class:`TreeModel` gives them by aggregating its node table.  A Spark ML
    model's importance vector has one entry per feature (model metadata, not
    data), so it is built on the driver."""
    tree = model.stages[-1] if hasattr(model, "stages") else model
    if isinstance(tree, TreeModel):
        known = spark.createDataFrame(list(enumerate(names)), "number int, feature string")
        own = tree.importances(spark).withColumnRenamed("feature", "number")
        df = (known.join(F.broadcast(own), "number", "left").select("feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))
              .orderBy(F.desc("importance"), "feature"))
        return df.limit(k) if k else df
    imp = tree.featureImportances.toArray().tolist()
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())])
    df = spark.createDataFrame(list(zip(names, [float(v) for v in imp])), schema).orderBy(F.desc("importance"))
    return df.limit(k) if k else df


def model_rows(df: DataFrame, label: str = "churn", exclude=IDS) -> DataFrame:
    """The numeric columns and the label of ``df``, written once: the fit and the
    correlations of its top features read them several times."""
    feats = numeric_columns(df, exclude=[label, *exclude])
    return cut_lineage(df.select(*feats, F.col(label).cast("int").alias(label)))


def churn_drivers_importance(df: DataFrame, label: str = "churn", trees: int = 20, depth: int = 5,
                             seed: int = 42, exclude=IDS) -> tuple[DataFrame, list[str], object]:
    """Random forest (20 trees, depth 5, sqrt features) on the numeric
    columns; returns (importances sorted, feature names, model).  Scaling
    is omitted: it does not change a tree."""
    return _importance_of(model_rows(df, label, exclude), label, trees, depth, seed)


def _importance_of(rows: DataFrame, label: str, trees: int = 20, depth: int = 5, seed: int = 42) -> tuple[DataFrame, list[str], object]:
    feats = [c for c in rows.columns if c != label]
    model = fit_forest(fill_features(rows, feats), feats, label, trees, depth, seed)
    return feature_importance(rows.sparkSession, model, feats, k=None), feats, model


def _top(rows: DataFrame, k: int, label: str, **model_args) -> list[tuple[str, float]]:
    imp, _, _ = _importance_of(rows, label, **model_args)
    return [(r.feature, r.importance) for r in imp.orderBy(F.desc("importance"), "feature").limit(k).collect()]


def top_features(df: DataFrame, k: int, label: str = "churn", **model_args) -> list[tuple[str, float]]:
    """The ``k`` most important features of the driver model with their importances."""
    return _top(model_rows(df, label), k, label, **model_args)


def churn_correlation_top(df: DataFrame, label: str = "churn", k: int = 5, **model_args) -> DataFrame:
    """|corr(feature, label)| of the ``k`` most important features."""
    rows = model_rows(df, label)
    return churn_correlation(rows, [f for f, _ in _top(rows, k, label, **model_args)], label)


def importance_graph(df: DataFrame, label: str = "churn", k: int = 10, threshold: float = 0.3, **model_args) -> DataFrame:
    """Correlation graph of the ``k`` most important features: node rows
    (source, NULL, importance) and edge rows (source, target, |corr|)."""
    rows = model_rows(df, label)
    top = _top(rows, k, label, **model_args)
    nodes = df.sparkSession.createDataFrame([(f, None, float(w)) for f, w in top], "source string, target string, weight double")
    return nodes.unionByName(correlation_graph(rows, [f for f, _ in top], threshold))
