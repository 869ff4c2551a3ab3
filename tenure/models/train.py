"""Grid search of tree classifiers with cross-validation, and model selection.

All models of a search are grown together, level by level
(:mod:`tenure.models.growth`): those of the five folds, and those of all training
rows, of which the best is kept.  What configurations share is grown once: a forest
of 100 trees is the first half of one of 200, a tree of depth 5 the top of one of
depth 10, 100 rounds of boosting the beginning of 200.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
from pyspark import RDD
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.models import growth
from tenure.models.ensemble import TreeModel
from tenure.operators.evaluation import roc_auc_by

# The parameter grids of the search.
GRID = {
    "rf": {"numTrees": [100, 200], "maxDepth": [5, 10]},
    "gb": {"maxIter": [100, 200], "maxDepth": [3, 5], "stepSize": [0.1, 0.01]},
}


@dataclass
class Search:
    """A finished search: mean validation AUC of every configuration, and the best one's model of all rows."""

    params: list[dict]
    avgMetrics: list[float]
    bestModel: PipelineModel
    foldMetrics: dict[tuple[int, int], float] = field(default_factory=dict)  # (configuration, fold) -> AUC

    @property
    def bestParams(self) -> dict:
        return self.params[int(np.argmax(self.avgMetrics))]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.bestModel.transform(df)


def train(df: DataFrame, features: list[str], label: str = "churn", kind: str = "rf", grid: dict | None = None,
          folds: int = 5, seed: int = 42, id_col: str | None = None) -> Search:
    """Grid search (default: the whole ``GRID[kind]``) with k-fold CV on ROC-AUC.

    ``df`` must carry the stratified ``fold`` column of
    :func:`tenure.models.prepare.stratified_split`."""
    if kind not in GRID:
        raise ValueError("kind must be 'rf' or 'gb'")
    g = GRID[kind] | (grid or {})
    if extra := set(g) - set(GRID[kind]):
        raise ValueError(f"unknown parameters: {sorted(extra)}")
    params = [dict(zip(g, values)) for values in itertools.product(*g.values())]
    edges, rows = growth.bin_edges(df, features)
    data = growth.blocks(df, features, label, edges, rows, "fold", id_col)
    search = _forests if kind == "rf" else _boosted
    scores, model_of, held = search(df, data, rows, params, list(range(folds)), edges, seed)
    per_fold = {(r.config, r.fold): r.roc_auc for r in roc_auc_by(scores, ["config", "fold"]).collect()}
    for rdd in (data, *held):
        rdd.unpersist()
    means = [float(np.mean([per_fold[i, f] for f in range(folds) if per_fold.get((i, f)) is not None] or [0.5])) for i in range(len(params))]
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    best = TreeModel(kind, model_of(int(np.argmax(means))))
    return Search(params, means, PipelineModel([assembler, best]), per_fold)


def fit_forest(df: DataFrame, features: list[str], label: str = "churn", trees: int = 20, depth: int = 5, seed: int = 42,
               id_col: str | None = None) -> PipelineModel:
    """A forest fitted to all rows of ``df``."""
    edges, rows = growth.bin_edges(df, features)
    data = growth.blocks(df, features, label, edges, rows, None, id_col)
    grown, _ = growth.forest(data, rows, trees, depth, [-1], len(edges), seed)
    data.unpersist()
    nodes = [row for t in range(trees) for row in _node_rows(grown, t, t, depth, edges)]
    return PipelineModel([VectorAssembler(inputCols=features, outputCol="features"), TreeModel("rf", nodes)])


def _scores(df: DataFrame, parts: RDD) -> DataFrame:
    """(config, fold, y_true, y_prob) of validation rows, given as (config, fold, labels, scores) of many rows each."""
    import pandas as pd

    packed = parts.map(lambda p: (p[0], p[1], p[2].astype(np.int8).tobytes(), p[3].astype(float).tobytes()))
    frame = df.sparkSession.createDataFrame(packed, "config int, fold int, y binary, p binary", verifySchema=False)

    def unpack(batches):
        for b in batches:
            for r in b.itertuples():
                yield pd.DataFrame({"config": r.config, "fold": r.fold, "y_true": np.frombuffer(r.y, np.int8).astype(np.int32),
                                    "y_prob": np.frombuffer(r.p, float)})
    return frame.mapInPandas(unpack, "config int, fold int, y_true int, y_prob double")


def _forests(df: DataFrame, data: RDD, rows: int, params: list[dict], folds: list[int], edges: list[np.ndarray], seed: int):
    trees, depth = max(p["numTrees"] for p in params), max(p["maxDepth"] for p in params)
    grown, fold = growth.forest(data, rows, trees, depth, [*folds, -1], len(edges), seed)
    sent = data.context.broadcast(growth.slim(grown))  # bounded by the grid: a node is a few bytes

    def validate(block):
        bins, y, f, _ = block
        for own in folds:
            at = np.flatnonzero(f == own)
            for d in sorted({p["maxDepth"] for p in params}) if len(at) else ():
                running = np.zeros(len(at))
                for n, values in enumerate(sent.value.scores(bins[at], d, np.flatnonzero(fold == own)), 1):
                    running += values
                    for i, p in enumerate(params):
                        if (p["maxDepth"], p["numTrees"]) == (d, n):
                            yield i, own, y[at], running / n

    def model_of(i: int) -> list[tuple]:
        n, d = params[i]["numTrees"], params[i]["maxDepth"]
        return [row for t, c in enumerate(np.flatnonzero(fold == -1)[:n]) for row in _node_rows(grown, c, t, d, edges)]
    return _scores(df, data.flatMap(validate)), model_of, []


def _boosted(df: DataFrame, data: RDD, rows: int, params: list[dict], folds: list[int], edges: list[np.ndarray], seed: int):
    kinds = sorted({(p["maxDepth"], p["stepSize"]) for p in params})
    chains = [(d, r, f) for d, r in kinds for f in [*folds, -1]]
    depths, rates, left_out = (np.array(x) for x in zip(*chains))
    iterations, features = {p["maxIter"] for p in params}, len(edges)

    def validation(own: list[tuple], done: int, block):
        """(config, fold, labels, scores) of the rows that the chains ``own`` left out."""
        _, y, f, _, margin = block
        for c, (d, r, fold) in enumerate(own):
            at = np.flatnonzero(f == fold)
            for i, p in enumerate(params):
                if (p["maxDepth"], p["stepSize"], p["maxIter"]) == (d, r, done):
                    yield i, fold, y[at], margin[c, at]
    if rows > growth.ROWS_AT_ONCE:
        rounds, after = growth.boost(data, lambda x: growth.kept(x, df), max(iterations), depths, rates, left_out, features, seed, iterations)
        found = [state.flatMap(lambda b, done=done: validation(chains, done, b)) for done, state in after.items()]
        scores, held = data.context.union(found), list(after.values())
    else:
        def some(blocks: list, at: slice):
            rounds, after = growth.boost(blocks, lambda x: x, max(iterations), depths[at], rates[at], left_out[at], features, seed, iterations)
            return rounds, [row for done, state in after.items() for b in state for row in validation(chains[at], done, b)]
        dealt = growth.kept(growth.dealt(data, some, len(chains), 1), df)
        rounds = [growth.joined(list(t)) for t in zip(*_same_depth(dealt.map(lambda x: x[0]).collect(), int(depths.max())))]
        scores, held = dealt.flatMap(lambda x: x[1]), [dealt]

    def model_of(i: int) -> list[tuple]:
        p = params[i]
        c = chains.index((p["maxDepth"], p["stepSize"], -1))
        return [row for t, trees in enumerate(rounds[:p["maxIter"]]) for row in _node_rows(trees, c, t, p["maxDepth"], edges)]
    return _scores(df, scores), model_of, held


def _same_depth(parts: list[list[growth.Trees]], depth: int) -> list[list[growth.Trees]]:
    """Rounds of chains grown apart, as arrays of one size."""
    return [[t.padded(depth) for t in rounds] for rounds in parts]


def _node_rows(trees: growth.Trees, chain: int, number: int, depth: int, edges: list[np.ndarray]) -> list[tuple]:
    """Node-table rows of one tree, cut off at ``depth``."""
    out, todo = [], [1]
    while todo:
        i = todo.pop(0)
        f = int(trees.feature[chain, i]) if i < min(1 << depth, trees.feature.shape[1]) else -1
        value, count = float(trees.value[chain, i]), float(trees.count[chain, i])
        if f < 0:
            out.append((number, i, None, None, 0.0, count, value))
            continue
        out.append((number, i, f, float(edges[f][trees.cut[chain, i]]), float(trees.gain[chain, i]), count, value))
        todo += [2 * i, 2 * i + 1]
    return out


def predict(model, df: DataFrame, label: str = "churn", keep=("driver_id",)) -> DataFrame:
    """(keep…, y_true, y_pred, y_prob) of a fitted model."""
    p = model.transform(df.withColumn(label, F.col(label).cast("double")))
    return p.select(*keep, F.col(label).cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"),
                    vector_to_array("probability")[1].alias("y_prob"))


def auc(model, df: DataFrame, label: str = "churn") -> float:
    ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction", metricName="areaUnderROC")
    return ev.evaluate(model.transform(df.withColumn(label, F.col(label).cast("double"))))


def select_model(rf: Search, gb: Search, test: DataFrame, label: str = "churn"):
    """The model with the higher test AUC (a tie goes to gradient boosting).
    Returns (kind, best PipelineModel, auc_rf, auc_gb)."""
    a_rf, a_gb = auc(rf, test, label), auc(gb, test, label)
    if a_rf > a_gb:
        return "rf", rf.bestModel, a_rf, a_gb
    return "gb", gb.bestModel, a_rf, a_gb


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
