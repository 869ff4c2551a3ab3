"""Quantiles, qcut scores, histograms, quadratic fit, global order, rolling."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tenure.functions.numeric import (centred_rolling_mean, exact_quantiles, histogram, qcut_score,
                                      quad_fit)
from tenure.functions.ordering import GIDX, cumsum_ordered, global_order, shift_ordered


def test_exact_quantiles_match_pandas(spark):
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0, 5.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r.prob: r.quantile for r in exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    s = pd.Series(vals)
    for p, q in got.items():
        assert abs(q - s.quantile(p)) < 1e-12


def test_qcut_with_and_without_dropping_ties(spark):
    vals = [1, 1, 1, 1, 1, 1, 2, 3, 4, 5]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "i long, x double")
    kept = [r.s for r in qcut_score(df, "x", 5, "s").orderBy("i").collect()]
    # edges 1, 1, 1, 1.4, 3.2, 5: the label counts the inner edges below x
    assert kept == [1, 1, 1, 1, 1, 1, 4, 4, 5, 5]
    dropped = [r.s for r in qcut_score(df, "x", 5, "s", drop_duplicates=True, base=0).orderBy("i").collect()]
    ref = pd.qcut(pd.Series(vals, dtype=float), 5, labels=False, duplicates="drop").tolist()
    assert dropped == ref


def test_histogram_counts_sum_to_n(spark):
    rng = np.random.default_rng(1)
    vals = rng.normal(size=500).tolist()
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    h = histogram(df, "x", 20).collect()
    assert sum(r["count"] for r in h) == 500
    counts, _ = np.histogram(vals, bins=20)
    got = [0] * 20
    for r in h:
        got[r.bin - 1] = r["count"]
    assert sum(abs(a - b) for a, b in zip(got, counts)) <= 2  # edge ulps only


def test_quad_fit_parabola_maximum(spark):
    rows = [(float(p), -(p - 5.0) ** 2 + 100.0) for p in range(0, 11)]
    f = quad_fit(spark.createDataFrame(rows, "p double, r double"), "p", "r").first()
    assert abs(f.vertex_x - 5.0) < 1e-9 and abs(f.vertex_y - 100.0) < 1e-9 and f.is_maximum
    assert abs(f.a + 1.0) < 1e-9


def test_quad_fit_matches_polyfit(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(900, 1000, 300)
    y = 3e-3 * x ** 2 - 5 * x + rng.normal(0, 10, 300)
    f = quad_fit(spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double"), "x", "y").first()
    a, b, c = np.polyfit(x, y, 2)
    assert abs(f.a - a) / abs(a) < 1e-7 and abs(f.b - b) / abs(b) < 1e-7 and abs(f.c - c) / abs(c) < 1e-7


def test_global_order_hot_key(spark):
    # one key holds most rows: the index must still be a permutation in order
    rows = [(0 if i % 10 else i, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, u long")
    o = global_order(df, ["k", "u"]).select("k", "u", GIDX).toPandas()
    assert sorted(o[GIDX]) == list(range(3000))
    o = o.sort_values(GIDX)
    assert list(zip(o.k, o.u)) == sorted(zip(o.k, o.u))


def test_lag_and_cumsum(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(50)], "i long, v double")
    o = global_order(df, ["i"])
    lag = {r.i: r.v_lag1 for r in shift_ordered(o, ["v"], 1).collect()}
    assert lag[0] is None and lag[10] == 9.0
    cs = {r.i: r.v_cum for r in cumsum_ordered(o, ["v"]).collect()}
    assert cs[49] == sum(range(50))


def test_centred_rolling_even_and_odd(spark):
    vals = [1.0, 4.0, 2.0, 8.0, 5.0, 7.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i long, v double")
    o = global_order(df, ["i"])
    for w in (4, 5):
        got = [r.s for r in centred_rolling_mean(o, "v", w, "s").orderBy("i").collect()]
        ref = pd.Series(vals).rolling(w, center=True).mean().tolist()
        for a, b in zip(got, ref):
            assert (a is None and np.isnan(b)) or abs(a - b) < 1e-12


def test_legal_input_does_not_crash(spark):
    from tenure.functions.numeric import histogram, quad_fit
    from tenure.operators.evaluation import calibration
    one = spark.createDataFrame([("a", 5.0, 1.0), ("a", 5.0, 2.0), ("b", 1.0, 1.0), ("b", 2.0, 4.0), ("b", 3.0, 9.0)], "s string, x double, y double")
    fit = {r.s: r for r in quad_fit(one, "x", "y", by="s").collect()}
    assert fit["a"].a is None and abs(fit["b"].a - 1.0) < 1e-9
    flat = spark.createDataFrame([(0.5, 1), (0.5, 0)], "y_prob double, y_true int")
    assert [tuple(r) for r in calibration(flat).collect()] == [(0, 0.5, 0.5, 2)]
    h = histogram(spark.createDataFrame([(float("nan"),), (1.0,), (2.0,), (None,)], "v double"), "v", 4).orderBy("bin").collect()
    assert [r["count"] for r in h] == [1, 0, 0, 1] and h[0].bin_start == 1.0 and h[-1].bin_end == 2.0


def test_amounts_are_not_rounded(spark):
    from tenure.operators import churn, monthly
    t = spark.createDataFrame([(1, 1, 0.004), (2, 1, 0.004), (3, 2, 0.004), (4, 3, 1e17)], "tx_id long, driver_id long, amount double") \
        .selectExpr("tx_id", "driver_id", "to_timestamp_ntz('2024-01-01') AS transaction_date", "amount", "IF(driver_id = 3, 'B', 'A') AS kind")
    k = {r.kind: r for r in monthly.kind_stats(t).collect()}
    assert abs(k["A"].total_amount - 0.012) < 1e-15 and abs(k["A"].avg_amount - 0.004) < 1e-15 and k["B"].total_amount == 1e17
    assert churn.churn_basic_metrics(t).first().total_drivers == 3
