"""Plan guards: no transaction-level window partitioned by driver (a hot
driver would sit in one task), no cartesian product of data-sized sides,
and column pruning at the scan."""

import pytest

import __spark_entry__ as E
from tenure.plans.catalog import REGISTRY

SF = "/root/testdata/sf0.001"
ML = {"cv_rf", "cv_gbt", "model_selection", "scored", "feature_importance", "churn_drivers_importance",
      "churn_correlation_top", "importance_graph"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - ML))
def test_no_window_partitioned_by_driver(spark, name):
    p = plan(E.queries()[name](spark, SF))
    assert "windowspecdefinition(driver_id" not in p
    assert "CartesianProduct" not in p


def test_scan_reads_only_needed_columns(spark):
    p = plan(E.queries()["churn_basic_metrics"](spark, SF))
    assert "o_orderpriority" not in p and "o_orderstatus" not in p
