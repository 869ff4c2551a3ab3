"""A fitted tree ensemble: a node table, and the Spark ML stage that scores with it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One row per node: its number in a heap (children 2i and 2i + 1), the feature and the largest
#: value that goes left (both null in a leaf), the decrease of impurity, the training weight, the node's value.
NODES = "tree int, node int, feature int, cut double, gain double, count double, value double"


class TreeModel(Model, HasFeaturesCol, MLWritable, MLReadable):
    """Scores a vector of features with trees: adds rawPrediction, probability and prediction.

    ``kind`` rf: the trees' values are class-1 shares and their mean is the
    probability; gb: their sum is the margin m, the probability 1 / (1 + exp(-2m))."""

    kind = Param(Params._dummy(), "kind", "rf or gb", TypeConverters.toString)

    def __init__(self, kind: str = "rf", node_rows: list[tuple] | None = None):
        super().__init__()
        self._setDefault(featuresCol="features")
        self._set(kind=kind)
        self.node_rows = node_rows or []

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The node table."""
        return spark.createDataFrame(self.node_rows, NODES)

    def importances(self, spark: SparkSession) -> DataFrame:
        """(feature number, importance): decrease of impurity over all nodes of a feature, weighted by
        the nodes' rows; a forest's trees count alike.  Sums to 1."""
        own = self.nodes(spark).where("feature IS NOT NULL").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("count")).alias("g"))
        per_tree = own.groupBy("tree").agg(F.sum("g").alias("t"))
        share = F.try_divide(F.col("g"), F.col("t")) if self.getOrDefault(self.kind) == "rf" else F.col("g")
        imp = own.join(per_tree, "tree").groupBy("feature").agg(F.sum(share).alias("s"))
        return imp.crossJoin(F.broadcast(imp.agg(F.sum("s").alias("all")))).select("feature", F.try_divide("s", "all").alias("importance"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        score = _scorer(self.node_rows, mean=self.getOrDefault(self.kind) == "rf")
        x = dataset.withColumn("_score", score(vector_to_array(F.col(self.getFeaturesCol()))))
        s = F.col("_score")
        if self.getOrDefault(self.kind) == "rf":
            raw, p = F.array(1 - s, s), s
        else:
            raw, p = F.array(-s, s), 1 / (1 + F.exp(-2 * s))
        return (x.withColumn("rawPrediction", array_to_vector(raw)).withColumn("probability", array_to_vector(F.array(1 - p, p)))
                .withColumn("prediction", (p > 0.5).cast("double")).drop("_score"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


def _scorer(node_rows: list[tuple], mean: bool):
    """Pandas UDF from an array of features to the mean or sum of the trees' values."""
    trees = 1 + max((r[0] for r in node_rows), default=0)
    size = 1 + max((r[1] for r in node_rows), default=1)
    feature, cut, value = np.full((trees, size), -1, np.int16), np.zeros((trees, size)), np.zeros((trees, size))
    for tree, node, f, c, _, _, v in node_rows:
        value[tree, node] = v
        if f is not None:
            feature[tree, node], cut[tree, node] = f, c

    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        x = np.nan_to_num(np.array(features.tolist(), float).reshape(len(features), -1), nan=np.inf)
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for t in range(trees):
            node = np.ones(len(x), np.int64)
            while (f := feature[t, node]).max(initial=-1) >= 0:
                node = np.where(f >= 0, 2 * node + (x[rows, np.maximum(f, 0)] > cut[t, node]), node)
            total += value[t, node]
        return pd.Series(total / trees if mean else total)
    return score


class _Writer(MLWriter):
    def __init__(self, instance: TreeModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.nodes(self.sparkSession).coalesce(1).write.parquet(f"{path}/nodes")


class _Reader(MLReader):
    def load(self, path: str) -> TreeModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = TreeModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.node_rows = [tuple(r) for r in self.sparkSession.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect()]
        return model
