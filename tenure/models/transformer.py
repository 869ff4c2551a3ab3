"""Transaction features as a Spark ML stage, so that they can be part of a saved model."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from tenure.operators.features import transaction_features

GROUPS = ["temporal", "behavioral", "monetary", "risk", "interaction"]


class TransactionFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``transform`` adds the feature columns of ``groups`` to a canonical transactions frame."""

    groups = Param(Params._dummy(), "groups", "feature groups to add", TypeConverters.toListString)

    @keyword_only
    def __init__(self, groups: list[str] | None = None):
        super().__init__()
        self._setDefault(groups=GROUPS)
        if groups is not None:
            self._set(groups=groups)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return transaction_features(dataset, self.getOrDefault(self.groups))
