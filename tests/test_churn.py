"""Churn predicates CP1 / CP2 / CP3 at their boundaries, time of day, nulls."""

from conftest import tx

from tenure.functions.timeutil import floor_days
from tenure.operators import churn, drivers

REF = "2024-03-31 00:00:00"


def boundary(spark):
    # last transactions 30 d, 30 d + 1 s, 31 d, 28 d, 29 d before the reference date
    rows = [(1, 1, "2024-03-01 00:00:00", 10.0, "RECURRENCY"),
            (2, 2, "2024-02-29 23:59:59", 10.0, "RECURRENCY"),
            (3, 3, "2024-02-29 00:00:00", 10.0, "FIRST_PAYMENT"),
            (4, 4, "2024-03-03 00:00:00", 10.0, "FIRST_PAYMENT"),
            (5, 5, "2024-03-02 00:00:00", 10.0, None),
            (6, 6, REF, 10.0, "RECURRENCY")]
    return tx(spark, rows)


def test_cp1_strict_timestamp(spark):
    got = {r.driver_id for r in churn.churned_drivers(boundary(spark), 30).collect()}
    assert got == {2, 3}  # 30 d exactly is not churned; 30 d + 1 s is


def test_cp2_whole_days(spark):
    f = {r.driver_id: r.churn for r in drivers.driver_features(boundary(spark)).collect()}
    assert f == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0}  # 30 d + 1 s floors to 30 days


def test_cp3_28_days(spark):
    f = {r.driver_id: r.churn for r in drivers.driver_summary(boundary(spark)).collect()}
    assert f == {1: True, 2: True, 3: True, 4: False, 5: True, 6: False}


def test_floor_days_negative(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-02 12:00:00' a, timestamp_ntz'2024-01-01 00:00:00' b")
    r = df.select(floor_days("a", "b").alias("x"), floor_days("b", "a").alias("y")).first()
    assert (r.x, r.y) == (-2, 1)


def test_basic_metrics_and_revenue_at_risk(spark):
    t = boundary(spark)
    r = churn.churn_basic_metrics(t, 30).first()
    assert (r.total_drivers, r.churned_drivers) == (6, 2)
    assert abs(r.churn_rate - 2 / 6) < 1e-12
    # mean monthly revenue of the 4 active drivers (10 each) × 4 × rate
    assert abs(r.revenue_at_risk - 10.0 * 4 * (2 / 6)) < 1e-9


def test_segment_uses_subset_reference_date(spark):
    rows = [(1, 1, "2024-01-01 00:00:00", 5.0, "A"), (2, 2, "2024-02-15 00:00:00", 5.0, "A"),
            (3, 3, "2024-06-30 00:00:00", 5.0, "B")]
    res = {r.kind: r.churn_rate for r in churn.churn_by_segment(tx(spark, rows), "kind", 30).collect()}
    # segment A is judged against its own last date (2024-02-15): driver 1 churned
    assert res == {"A": 0.5, "B": 0.0}


def test_last_kind_skips_nulls(spark):
    rows = [(1, 1, "2024-01-01 00:00:00", 5.0, "A"), (2, 1, "2024-01-02 00:00:00", 5.0, None),
            (3, 2, "2024-01-02 00:00:00", 5.0, "B")]
    res = {r.kind: r.total_drivers for r in churn.segment_churn_last_kind(tx(spark, rows)).collect()}
    assert res == {"A": 1, "B": 1}


def test_revenue_before_churn_zero_when_nobody_churned(spark):
    rows = [(1, 1, "2024-01-01 00:00:00", 5.0, "A"), (2, 2, "2024-01-02 00:00:00", 5.0, "A")]
    assert churn.revenue_before_churn(tx(spark, rows)).first()[0] == 0.0


def test_revenue_before_churn_window(spark):
    rows = [(1, 1, "2024-01-01 00:00:00", 1.0, "A"), (2, 1, "2024-01-20 00:00:00", 2.0, "A"),
            (3, 1, "2024-01-31 00:00:00", 4.0, "A"), (4, 2, "2024-06-01 00:00:00", 8.0, "A")]
    # driver 1 churned; rows within 30 days of its last (inclusive): 2024-01-01 .. 01-31 → 7
    assert churn.revenue_before_churn(tx(spark, rows)).first()[0] == 7.0
