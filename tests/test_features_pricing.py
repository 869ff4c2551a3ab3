"""Transaction features by hand, single-transaction drivers, IQR, pricing."""

import numpy as np
import pandas as pd
from conftest import tx

from tenure.operators import drivers, features, pricing


def frame(spark):
    rows = [(1, 1, "2024-01-01 10:00:00", 100.0, "A"), (2, 1, "2024-01-03 00:00:00", 50.0, "B"),
            (3, 1, "2024-01-03 00:00:00", 80.0, "A"), (4, 1, "2024-02-10 00:00:00", 30.0, "A"),
            (5, 2, "2024-01-05 00:00:00", 70.0, "A"),  # single-transaction driver
            (6, 3, "2024-01-07 00:00:00", 10.0, "B"), (7, 3, "2024-01-06 00:00:00", 20.0, "B")]
    return tx(spark, rows)


def test_transaction_features_by_hand(spark):
    t = frame(spark)
    got = features.transaction_features(t).toPandas().set_index("tx_id").sort_index()
    # worked out by hand: driver 1 in order 100, 50, 80, 30; driver 3 in order 20, 10
    assert np.allclose(got.usage_intensity, [100, 75, 230 / 3, 160 / 3, 70, 15, 20])
    assert np.allclose(got.value_trend[[1, 2, 3, 4]], -18.0) and np.allclose(got.value_trend[[6, 7]], -10.0)
    assert got.value_trend[[5]].isna().all()
    assert got.loc[5, "risk_score"] is None or np.isnan(got.loc[5, "risk_score"])  # std of one row is NULL
    assert got.loc[1, "days_since_last"] == -40 and got.loc[4, "days_since_first"] == 39
    assert got.loc[1, "day_of_week"] == 0 and got.loc[1, "quarter"] == 1


def test_driver_features_single_row_and_shares(spark):
    f = {r.driver_id: r for r in drivers.driver_features(frame(spark), kinds=("A", "B")).collect()}
    assert f[2].std_amount is None and f[2].days_active == 0 and f[2].avg_transaction_per_day == 1.0
    assert f[1].payment_type_A == 0.75 and f[1].payment_type_B == 0.25


def test_iqr_replaces_outliers_with_median(spark):
    vals = [10.0, 11.0, 12.0, 13.0, 14.0, 15.0, 16.0, 17.0, -100.0, 500.0]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vals)], "i long, x double, churn long")
    out = [r.x for r in features.iqr_outlier_treatment(df, "churn", exclude=["i"]).orderBy("i").collect()]
    med = float(pd.Series(vals).median())
    assert out[:8] == vals[:8] and out[8] == med and out[9] == med


def test_rfm_scores_ranges(spark):
    r = drivers.rfm_scores(frame(spark)).collect()
    for x in r:
        assert 1 <= x.recency_score <= 5 and 0 < x.churn_risk <= 1
        assert x.rfm_score == x.recency_score * 100 + x.frequency_score * 10 + x.monetary_score


def test_elasticity_with_forward_fill(spark):
    rows = [(1.0, 10.0), (2.0, None), (4.0, 5.0)]
    df = spark.createDataFrame(rows, "p double, d double")
    got = {r.price: r.elasticity for r in pricing.elasticity_curve(df, "p", "d").collect()}
    g = pd.DataFrame(rows, columns=["p", "d"]).groupby("p")["d"].mean().reset_index()
    e = g["d"].ffill().pct_change() / g["p"].pct_change()
    for p, v in zip(g.p, e):
        assert (got[p] is None and np.isnan(v)) or abs(got[p] - v) < 1e-12


def test_daily_activity_join_hits_only_midnight(spark):
    r = {x.tx_id: x.is_active for x in pricing.daily_activity_join(frame(spark)).collect()}
    assert r[1] is None and r[2] == 1


def test_feature_text(spark):
    df = spark.createDataFrame([(1, 2.5, 3)], "driver_id long, a double, b long")
    r = features.feature_text(df, ["a", "b"], id_col="driver_id", num_features=16).first()
    assert r.feature_text == "a 2.5 b 3" and len(r.embedding) == 16 and sum(r.embedding) == 4
    r2 = features.feature_text(df, ["a", "b"], id_col="driver_id",
                               embedder=lambda s: [[float(len(x))] for x in s]).first()
    assert r2.embedding == [9.0]
