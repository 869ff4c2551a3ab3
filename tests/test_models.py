"""Trees grown level by level: against plain growth, Spark ML's search, and both ways of dealing the work."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from tenure.models import growth
from tenure.models.importance import feature_importance
from tenure.models.prepare import stratified_split
from tenure.models.train import fit_forest, predict, train
from tenure.operators.evaluation import roc_auc, roc_auc_by

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(5000):
        a, b, c = rng.normal(), rng.integers(0, 4), rng.normal()
        y = int(rng.random() < 1 / (1 + np.exp(-(1.5 * a + (b == 2) * 2 - 0.8 * a * c))))
        rows.append((i, float(a), float(b), float(c), float(rng.normal()), y))
    return spark.createDataFrame(rows, "driver_id long, a double, b double, c double, d double, churn long")


@pytest.fixture(scope="module")
def split(table):
    return stratified_split(table, "churn", materialize=True)


def plain_tree(bins, weight, target, picked_of, depth):
    """{node: (feature, cut, weight, mean)} by trying every cut of every node."""
    out, todo = {}, [(1, np.flatnonzero(weight > 0), 0)]
    while todo:
        node, rows, level = todo.pop()
        w, t = weight[rows], target[rows]
        out[node] = (-1, 0, w.sum(), (w * t).sum() / w.sum())
        best = (1e-12, None)
        for f in picked_of(node) if level < depth and w.sum() > 1 else ():
            for cut in range(growth.MAX_BINS):
                left = bins[rows, f] <= cut
                if 0 < w[left].sum() < w.sum():
                    lw, rw, ls, rs = w[left].sum(), w[~left].sum(), (w * t)[left].sum(), (w * t)[~left].sum()
                    gain = (ls ** 2 / lw + rs ** 2 / rw - (ls + rs) ** 2 / w.sum()) / w.sum()
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, cut))
        if best[1]:
            f, cut = best[1]
            out[node] = (f, cut, *out[node][2:])
            left = bins[rows, f] <= cut
            todo += [(2 * node, rows[left], level + 1), (2 * node + 1, rows[~left], level + 1)]
    return out


def test_grown_trees_equal_plain_ones():
    rng = np.random.default_rng(1)
    block = (rng.integers(0, 32, (300, 5)).astype(np.uint8), rng.integers(0, 2, 300).astype(np.int8), np.zeros(300, np.int8), np.arange(300))
    weight = rng.poisson(1, (3, 300))
    trees, numbers = growth.Trees(3, 4), np.array([0, 1, 2])
    growth.grow([block], trees, np.array([4, 4, 2]), numbers, 5, 3, 7, lambda b, c: (weight[c], np.broadcast_to(b[1].astype(float), weight[c].shape)), np.int32)
    for c, depth in enumerate((4, 4, 2)):
        want = plain_tree(block[0], weight[c], block[1].astype(float), lambda node: growth.pick_features(7, numbers[[c]], np.array([node]), 5, 3)[0], depth)
        nodes = {i for i in range(1, 32) if trees.count[c, i] > 0}
        assert nodes == set(want)
        for i in nodes:
            f, cut, n, mean = want[i]
            assert trees.count[c, i] == n and trees.value[c, i] == pytest.approx(mean)
            if i < 16:
                assert (trees.feature[c, i], trees.cut[c, i] if f >= 0 else 0) == (f, cut)


@pytest.mark.parametrize("kind, grid", [("rf", {"numTrees": [3, 6], "maxDepth": [2, 4]}), ("gb", {"maxIter": [4, 7], "maxDepth": [2, 3], "stepSize": [0.1]})])
def test_rows_or_chains_dealt_give_the_same_search(split, monkeypatch, kind, grid):
    tr, te = split
    monkeypatch.setattr(growth, "BLOCK_ROWS", 1000)
    near = train(tr, FEATURES, kind=kind, grid=grid, id_col="driver_id")
    monkeypatch.setattr(growth, "ROWS_AT_ONCE", 0)
    monkeypatch.setattr(growth, "NODES_PER_JOB", 10)
    monkeypatch.setattr(growth, "CHAINS_PER_KEY", 4)
    far = train(tr, FEATURES, kind=kind, grid=grid, id_col="driver_id")
    assert far.params == near.params and len(near.params) == 4
    assert far.avgMetrics == pytest.approx(near.avgMetrics, abs=1e-9)
    a, b = ({r.driver_id: r.y_prob for r in predict(m, te).collect()} for m in (near, far))
    assert a == pytest.approx(b, abs=1e-9)


def test_shared_growth_equals_single_configurations(split):
    """100 of 200 trees, depth 5 of 10: what the whole grid reports is what each configuration alone gives."""
    tr, _ = split
    for kind, grid in (("rf", {"numTrees": [3, 6], "maxDepth": [2, 4]}), ("gb", {"maxIter": [3, 6], "maxDepth": [2, 3], "stepSize": [0.1, 0.5]})):
        whole = train(tr, FEATURES, kind=kind, grid=grid, id_col="driver_id")
        for p, m in list(zip(whole.params, whole.avgMetrics))[::3]:
            one = train(tr, FEATURES, kind=kind, grid={k: [v] for k, v in p.items()}, id_col="driver_id")
            assert one.avgMetrics == pytest.approx([m], abs=1e-9)


@pytest.mark.parametrize("kind", ["rf", "gb"])
def test_auc_like_spark_ml(split, kind):
    tr, _ = split
    if kind == "rf":
        est, grid = RandomForestClassifier(labelCol="churn", numTrees=60, maxDepth=5, seed=1), {"numTrees": [60], "maxDepth": [5]}
        tolerance = 0.005
    else:
        est, grid = GBTClassifier(labelCol="churn", maxIter=20, maxDepth=3, stepSize=0.1, seed=1), {"maxIter": [20], "maxDepth": [3], "stepSize": [0.1]}
        tolerance = 0.005
    cv = CrossValidator(estimator=Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), est]),
                        estimatorParamMaps=ParamGridBuilder().build(), evaluator=BinaryClassificationEvaluator(labelCol="churn"), numFolds=5, foldCol="fold")
    want = cv.fit(tr.withColumn("churn", F.col("churn").cast("double"))).avgMetrics
    got = train(tr, FEATURES, kind=kind, grid=grid, id_col="driver_id")
    assert got.avgMetrics == pytest.approx(want, abs=tolerance)


def test_unknown_parameters_and_kinds(split):
    with pytest.raises(ValueError):
        train(split[0], FEATURES, kind="svm")
    with pytest.raises(ValueError):
        train(split[0], FEATURES, kind="rf", grid={"trees": [1]})


def test_model_scores_follow_the_node_table(spark, table):
    model = fit_forest(table, FEATURES, trees=4, depth=3, id_col="driver_id")
    nodes = {(r.tree, r.node): r for r in model.stages[-1].nodes(spark).collect()}
    got = {r.driver_id: r.y_prob for r in predict(model, table).collect()}
    for r in table.limit(50).collect():
        values = []
        for t in range(4):
            i = 1
            while nodes[t, i].feature is not None:
                i = 2 * i + (r[FEATURES[nodes[t, i].feature]] > nodes[t, i].cut)
            values.append(nodes[t, i].value)
        assert got[r.driver_id] == pytest.approx(np.mean(values))


def test_importances_from_the_node_table(spark, table):
    model = fit_forest(table, FEATURES, trees=5, depth=4, id_col="driver_id")
    want = np.zeros(4)
    for t in range(5):
        own = np.zeros(4)
        for r in model.stages[-1].node_rows:
            if r[0] == t and r[2] is not None:
                own[r[2]] += r[4] * r[5]
        want += own / own.sum() / 5
    got = {r.feature: r.importance for r in feature_importance(spark, model, FEATURES, k=None).collect()}
    assert [got[f] for f in FEATURES] == pytest.approx(want.tolist())


def test_one_class_and_constant_features(spark):
    df = spark.createDataFrame([(i, 1.0, 0, i % 2) for i in range(10)], "driver_id long, f double, churn long, fold int")
    s = train(df, ["f"], kind="gb", folds=2, grid={"maxIter": [2], "maxDepth": [2], "stepSize": [0.1]})
    assert s.avgMetrics == [0.5] and {r.y_pred for r in predict(s, df).collect()} == {0}


def test_auc_of_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), int(rng.random() < .4), float(rng.integers(0, 9))) for g in rng.integers(0, 5, 400)] + [(9, 1, 1.0)]
    df = spark.createDataFrame(rows, "g int, y_true int, y_prob double").repartition(3)
    got = {r.g: r.roc_auc for r in roc_auc_by(df, ["g"]).collect()}
    for g in range(5):
        assert got[g] == pytest.approx(roc_auc(df.where(F.col("g") == g)).first().roc_auc)
    assert got[9] is None


def test_tasks_are_bounded_and_folds_share_draws(split, monkeypatch):
    tr, _ = split
    monkeypatch.setattr(growth, "BLOCK_ROWS", 100)
    edges, rows = growth.bin_edges(tr, FEATURES)
    data = growth.blocks(tr, FEATURES, "churn", edges, rows, "fold", "driver_id")
    assert data.getNumPartitions() <= 2 * data.context.defaultParallelism < rows / 100  # each task returns sums of all nodes
    own, drawn = data.collect(), []
    poisson = growth.poisson
    monkeypatch.setattr(growth, "poisson", lambda u: drawn.append(len(u)) or poisson(u))
    monkeypatch.setattr(growth, "ROWS_AT_ONCE", 0)
    growth.forest(own[:1], rows, 4, 1, [0, 1, 2, -1], len(edges), 1)
    assert drawn == [4]  # one of 16 chains each before
    data.unpersist()


def test_poisson_numbers_of_hashes():
    u = np.random.default_rng(5).integers(0, 2 ** 64, 200_000, dtype=np.uint64)
    near = np.concatenate([(growth._POISSON[:7] * 2 ** 53).astype(np.uint64) + np.uint64(d) << np.uint64(11) for d in (0, 1, 2)])
    for x in (u, near, np.array([0, 2 ** 64 - 1], np.uint64)):
        assert (growth.poisson(x) == np.searchsorted(growth._POISSON, (x >> np.uint64(11)) * 2.0 ** -53)).all()


def test_boosting_reads_margins_made_once_a_round(split, monkeypatch):
    tr, _ = split
    edges, rows = growth.bin_edges(tr, FEATURES)
    data = growth.blocks(tr, FEATURES, "churn", edges, rows, "fold", "driver_id")
    seen, grow = [], growth.grow
    monkeypatch.setattr(growth, "grow", lambda state, *a, **k: seen.append(state.is_cached) or grow(state, *a, **k))
    before = data.context._jsc.getPersistentRDDs().size()
    _, after = growth.boost(data, lambda x: growth.kept(x, tr), 7, np.array([2]), np.array([.1]), np.array([-1]), len(edges), 1)
    assert seen == [False] + [True] * 6  # later rounds applied all trees since the last written round at every level
    assert data.context._jsc.getPersistentRDDs().size() == before + len(after) == before + 1
    for rdd in (data, *after.values()):
        rdd.unpersist()
