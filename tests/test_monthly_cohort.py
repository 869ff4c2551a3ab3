"""Month-over-month churn (calendar vs year-month), cohorts, properties."""

from conftest import tx

from tenure.operators import cohort, monthly


def frame(spark):
    rows = [(1, 1, "2023-01-05 00:00:00", 1.0, "A"), (2, 2, "2023-01-06 00:00:00", 2.0, "A"),
            (3, 1, "2023-03-05 00:00:00", 3.0, "A"),  # no February
            (4, 3, "2024-01-07 00:00:00", 4.0, "A")]  # year wrap onto month 1
    return tx(spark, rows)


def test_calendar_months_merge_years(spark):
    r = {x.month: x for x in monthly.monthly_churn_calendar(frame(spark)).collect()}
    assert sorted(r) == [1, 3]
    assert (r[1].active_drivers, r[1].churned_drivers, r[1].new_drivers, r[1].churn_rate) == (3, 0, 3, 0.0)
    # previous observed month of March is January (3 drivers); only driver 1 stays
    assert (r[3].previous_active, r[3].churned_drivers, r[3].new_drivers) == (3, 2, 0)


def test_year_month_observed_months(spark):
    r = [(str(x.month), x.active_prev, x.active_current, x.churned) for x in
         monthly.monthly_churn(frame(spark)).orderBy("month").collect()]
    assert r == [("2023-03-01", 2, 1, 1), ("2024-01-01", 1, 1, 1)]


def test_flow_identity(spark):
    for x in monthly.monthly_churn_calendar(frame(spark)).collect():
        assert x.previous_active - x.churned_drivers + x.new_drivers == x.active_drivers


def test_net_churn_trend_fills_empty_months(spark):
    r = {str(x.month): (x.n_drivers, x.churn_rate) for x in monthly.net_churn_trend(frame(spark)).collect()}
    assert len(r) == 13
    assert r["2023-01-01"] == (2, 1.0)          # first month
    assert r["2023-02-01"] == (0, 1.0)          # empty month
    assert r["2023-03-01"] == (1, None)         # x / 0
    assert r["2023-04-01"] == (0, 1.0)


def test_cohort_retention_and_ltv(spark):
    rows = [(1, 1, "2024-01-01 00:00:00", 10.0, "A"), (2, 2, "2024-01-02 00:00:00", 20.0, "A"),
            (3, 1, "2024-02-01 00:00:00", 5.0, "A"), (4, 1, "2024-03-01 00:00:00", 1.0, "A"),
            (5, 3, "2024-02-03 00:00:00", 7.0, "A")]
    t = tx(spark, rows)
    ret = {(str(r.cohort_month), r.period_number): r.retention for r in cohort.cohort_retention(t).collect()}
    assert ret == {("2024-01-01", 0): 1.0, ("2024-01-01", 1): 0.5, ("2024-01-01", 2): 0.5, ("2024-02-01", 0): 1.0}
    cum = {(str(r.cohort_month), r.period_number): r.cumulative_ltv for r in cohort.cohort_ltv_cumulative(t).collect()}
    assert cum[("2024-01-01", 2)] == 36.0
    total = sum(r.ltv for r in cohort.cohort_ltv(t).collect())
    assert total == 43.0  # Σ LTV = Σ amount
    means = {r.period_number: r.avg_retention for r in cohort.cohort_period_means(t).collect()}
    assert means == {0: 1.0, 1: 0.5, 2: 0.5}  # missing cells skipped
    wide = cohort.cohort_retention_wide(t, 3).orderBy("cohort_month").collect()
    assert wide[1].period_1 is None
