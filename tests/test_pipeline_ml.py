"""Persistence round trip, ML training / save / load, schema checks."""

import tempfile

import numpy as np
import pytest
from conftest import tx
from pyspark.sql import functions as F

from tenure.models.importance import churn_drivers_importance
from tenure.models.prepare import fill_features, model_columns, scaled_features, stratified_split
from tenure.models.train import load_model, predict, save_model, train
from tenure.plans.pipeline import load_processed, write_processed
from tenure.sources.schema import canonicalize, validate


def test_validate_and_canonicalize(spark):
    with pytest.raises(ValueError):
        validate(spark.createDataFrame([(1,)], "driver_id long"))
    raw = spark.createDataFrame([("2024-01-02 10:00:00", 1, float("nan"), "RECURRENCY")],
                                "date string, driver_id long, amount double, kind string")
    c = canonicalize(raw).first()
    assert c.amount is None and str(c.transaction_date) == "2024-01-02 10:00:00" and c.tx_id is not None


def test_persistence_round_trip(spark):
    t = tx(spark, [(1, 1, "2024-01-01 00:00:00", 5.0, "A"), (2, 2, "2024-02-01 00:00:00", 7.0, "B")])
    d = tempfile.mkdtemp(prefix="tenure-proc-")
    write_processed(t, {"m": t.groupBy("kind").count()}, d)
    df, metrics, meta = load_processed(spark, d)
    assert sorted(df.columns) == sorted(t.columns) and df.count() == 2
    assert metrics["m"].count() == 2 and meta.first().n_rows == 2
    with pytest.raises(FileNotFoundError):
        load_processed(spark, d + "/nothing")


def separable(spark, n=200):
    rows = [(i, float(i % 2) * 10 + (i % 7) * 0.1, float(i % 5), i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "driver_id long, f1 double, f2 double, churn long")


def test_split_is_stratified_and_deterministic(spark):
    df = separable(spark)
    tr, te = stratified_split(df, "churn")
    c = {r.churn: r["count"] for r in te.groupBy("churn").count().collect()}
    assert c == {0: 20, 1: 20}
    again = {r.driver_id for r in stratified_split(df, "churn")[1].collect()}
    assert again == {r.driver_id for r in te.collect()}
    assert set(r.fold for r in tr.select("fold").distinct().collect()) == set(range(5))


def test_train_predict_save_load(spark):
    df = separable(spark)
    cols = model_columns(df)
    assert cols == ["f1", "f2"]
    tr, te = stratified_split(fill_features(df, cols), "churn", materialize=True, folds=3)
    m = train(tr, cols, kind="rf", folds=3, grid={"numTrees": [5], "maxDepth": [3]})
    p = predict(m, te).collect()
    assert all(0.0 <= r.y_prob <= 1.0 for r in p)
    assert sum(r.y_pred == r.y_true for r in p) / len(p) > 0.9  # separable
    d = tempfile.mkdtemp(prefix="tenure-model-")
    save_model(m.bestModel, d)
    again = predict(load_model(d), te).collect()
    assert [r.y_prob for r in again] == [r.y_prob for r in predict(m.bestModel, te).collect()]


def test_importance_sums_to_one(spark):
    imp, feats, _ = churn_drivers_importance(separable(spark), "churn", trees=5, depth=3)
    vals = [r.importance for r in imp.collect()]
    assert abs(sum(vals) - 1.0) < 1e-9 and "driver_id" not in feats


def test_scaled_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    r = scaled_features(df, ["a", "b"]).collect()
    assert sorted(x.a for x in r) == [-1.0, 1.0] and all(x.b == 0.0 for x in r)


def test_grids_are_whole():
    from tenure.models.train import GRID
    sizes = {k: int(np.prod([len(v) for v in g.values()])) for k, g in GRID.items()}
    assert sizes == {"rf": 4, "gb": 8}


def test_run_pipeline_end_to_end(spark):
    from tenure.plans.pipeline import run_pipeline
    from tenure.sources import load_pricing, load_transactions
    t = load_transactions(spark, "/root/testdata/sf0.001")
    out = tempfile.mkdtemp(prefix="tenure-pipe-")
    grids = {"rf": {"numTrees": [5], "maxDepth": [3]}, "gb": {"maxIter": [2], "maxDepth": [2]}}
    summary = run_pipeline(spark, t, out, prices=load_pricing(spark, "/root/testdata/sf0.001"), grids=grids)
    assert summary["selected"] in ("rf", "gb") and 0.0 <= summary["auc_rf"] <= 1.0 and not summary["reused"]
    df, metrics, meta = load_processed(spark, out)
    assert df.count() == t.count() and "risk_score" in df.columns
    assert metrics["cohort_retention"].count() > 0 and meta.first().n_rows == t.count()
    for table in ("prices/revenue_curve", "causal/driver_importance", "model_tables/roc_curve", "model_tables/feature_importance"):
        assert spark.read.parquet(f"{out}/{table}").count() > 0
    model = load_model(f"{out}/model")
    assert len(model.stages) == 2
    assert run_pipeline(spark, t, out, train_model=False)["reused"]


def test_feature_transformer_in_a_saved_model(spark):
    from pyspark.ml import PipelineModel

    from tenure.models.transformer import TransactionFeatures
    from tenure.operators.features import transaction_features
    from tenure.sources import load_transactions
    t = load_transactions(spark, "/root/testdata/sf0.001")
    d = tempfile.mkdtemp(prefix="tenure-stage-")
    PipelineModel([TransactionFeatures(groups=["temporal", "risk"])]).write().overwrite().save(d)
    got = PipelineModel.load(d).transform(t)
    want = transaction_features(t, ["temporal", "risk"])
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and TransactionFeatures().transform(t).columns[-1] == "seasonal_value"
