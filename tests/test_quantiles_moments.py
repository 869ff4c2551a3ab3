"""Selection and sketches of quantiles, co-moments, automatic bins."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tenure.functions import comoments, quantiles
from tenure.functions.numeric import histogram, qcut_score, qcut_scores, round_bins
from tenure.functions.quantiles import column_quantiles
from tenure.operators.evaluation import churn_correlation, correlation_matrix

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(11)
    n = 6000
    data = pd.DataFrame({
        "wide": np.exp(rng.normal(0, 8, n)) * rng.choice([-1, 1], n), "ties": rng.integers(0, 4, n).astype(float), "hot": np.where(rng.random(n) < .6, 7.0, rng.normal(7, 1, n)),
        "same": 0.1, "none": np.nan, "gaps": np.where(rng.random(n) < .5, np.nan, rng.normal(0, 1, n))})
    df = spark.createDataFrame(data).withColumn("gaps", F.when(F.col("ties") == 0, F.lit(None)).otherwise(F.col("gaps")))
    return df.repartition(5).cache(), data.assign(gaps=data.gaps.where(data.ties != 0))


@pytest.mark.parametrize("few, accuracy", [(1_000_000, 10_000), (40, 50), (1, 20)])
def test_selected_quantiles_equal_numpy(frame, monkeypatch, few, accuracy):
    """Also if brackets have to be narrowed again and again, and where ties keep them large."""
    monkeypatch.setattr(quantiles, "FEW", few)
    df, data = frame
    got = column_quantiles(df, list(data.columns), PROBS, accuracy=accuracy)
    for c in data.columns:
        v = data[c].dropna()
        assert got[c] == ([None] * len(PROBS) if v.empty else pytest.approx(np.quantile(v, PROBS), rel=1e-12, abs=1e-300))


def test_a_sketch_that_misses_is_noticed(frame, monkeypatch):
    """Brackets are verified by exact counts; one that misses its rank is opened."""
    df, data = frame
    real = quantiles._Bracket.__init__

    def shifted(self, column, rank, least, most, lo, hi):
        real(self, column, rank, least, most, most, most)
    monkeypatch.setattr(quantiles._Bracket, "__init__", shifted)
    assert column_quantiles(df, ["gaps"], [0.5])["gaps"] == pytest.approx([data.gaps.median()])


def test_selection_has_no_sort_of_rows(frame):
    df, _ = frame
    rows = qcut_scores(df, ["wide"], 5)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryTableScan")[0] and "Sort" not in plan.split("InMemoryTableScan")[0]


@pytest.mark.parametrize("accuracy", [20, 1000])
def test_sketch_ranks_are_within_the_bound(frame, accuracy):
    df, data = frame
    for c in ("wide", "ties", "gaps"):
        v = np.sort(data[c].dropna())
        for p, q in zip(PROBS, column_quantiles(df, [c], PROBS, exact=False, accuracy=accuracy)[c]):
            low, high = np.searchsorted(v, q, "left"), np.searchsorted(v, q, "right")
            assert low - 1 <= (p + 1 / accuracy) * len(v) and high + 1 >= (p - 1 / accuracy) * len(v)


def test_qcut_from_a_sketch(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).alias("g"))
    sizes = [r["count"] for r in qcut_score(df, "x", 5, "s", exact=False, accuracy=1000).groupBy("s").count().collect()]
    assert len(sizes) == 5 and all(abs(n - 2000) <= 2 * 10_000 / 1000 + 1 for n in sizes)
    by = qcut_score(df, "x", 4, "s", by="g", exact=False, accuracy=1000)
    assert all(abs(r["count"] - 1250) <= 2 * 5000 / 1000 + 1 for r in by.groupBy("g", "s").count().collect())
    assert "Sort [" not in by._jdf.queryExecution().optimizedPlan().toString()
    exact = {r.x: r.s for r in qcut_score(df, "x", 5, "s").collect()}
    assert [exact[float(x)] for x in (0, 1999, 2000, 9999)] == [1, 1, 2, 5]


def test_correlations_equal_pandas(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(1e6, 1, 3000)
    data = pd.DataFrame({"a": a, "b": 2 * a + rng.normal(0, 1, 3000), "c": rng.normal(0, 1, 3000), "k": 0.1, "n": np.nan})
    data.loc[rng.random(3000) < .3, "b"] = np.nan
    data.loc[rng.random(3000) < .3, "c"] = np.nan
    df = spark.createDataFrame(data).withColumn("c", F.when(F.isnan("c"), F.lit(None)).otherwise(F.col("c"))).repartition(7)
    got = {(r.x, r.y): r.r for r in correlation_matrix(df).collect()}
    want = data.corr()
    assert len(got) == 25
    for x in data:
        for y in data:
            if "k" in (x, y) or "n" in (x, y):
                assert got[x, y] is None
            else:
                assert got[x, y] == pytest.approx(want.loc[x, y], abs=1e-9)
        assert got[x, x] == (None if x in "kn" else 1.0)
    top = {r.feature: r.correlation for r in churn_correlation(df, ["b", "c"], "a").collect()}
    assert top == pytest.approx({f: abs(want.loc[f, "a"]) for f in ("b", "c")}, abs=1e-9)
    empty = correlation_matrix(df.limit(0)).collect()
    assert len(empty) == 25 and all(r.r is None for r in empty)


def test_correlations_read_the_rows_once(spark, tmp_path):
    spark.range(1000).selectExpr("id", "cast(id as double) * 2 as b", "rand(1) as c").write.parquet(f"{tmp_path}/t")
    m = correlation_matrix(spark.read.parquet(f"{tmp_path}/t"))
    m.collect()
    assert m._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan") == 1


def test_merging_in_any_order_gives_the_same():
    rng = np.random.default_rng(1)
    x = rng.normal(50, 3, (90, 3))
    x[rng.random(x.shape) < .2] = np.nan
    whole = comoments.of_rows(x)
    parts = [comoments.of_rows(x[i:i + 7]) for i in range(0, 90, 7)]
    left = parts[0]
    for p in parts[1:]:
        left = comoments.merge(left, p)
    right = parts[-1]
    for p in parts[-2::-1]:
        right = comoments.merge(p, right)
    assert np.allclose(whole, left) and np.allclose(whole, right)


def test_automatic_bins(spark):
    assert round_bins(3.0, 3.0, 3.0, 3.0, 9) == (2.5, 1.0, 1)
    start, width, bins = round_bins(-3.3, 17.0, 2.0, 8.0, 1000)
    assert (start, width, bins) == (-4.0, 2.0, 11)
    assert round_bins(0.0, 1e9, 1.0, 2.0, 1000)[2] <= 1000
    rng = np.random.default_rng(8)
    v = rng.normal(700, 100, 2000)
    rows = histogram(spark.createDataFrame([(float(x),) for x in v], "x double"), "x", None).orderBy("bin").collect()
    edges = [rows[0].bin_start] + [r.bin_end for r in rows]
    assert [r["count"] for r in rows] == np.histogram(v, edges)[0].tolist() and sum(r["count"] for r in rows) == 2000
    assert 10 < len(rows) < 100 and rows[0].bin_start == round(rows[0].bin_start)
    with pytest.raises(ValueError):
        histogram(spark.createDataFrame([(1.0, 1)], "x double, g int"), "x", None, by="g")
