"""Every registered query with SQL, on sf0.001, against DuckDB on the same parquet."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from tenure.plans.catalog import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = ["customer", "orders", "lineitem", "part", "events"]


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def con():
    if not os.path.exists(SF):
        pytest.skip("test data absent")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(k for k, q in REGISTRY.items() if q.oracle))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = df.columns
    a = sorted(tuple(canon(r[c]) for c in sorted(cols)) for r in df.collect())
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == sorted(cols)
    idx = [dcols.index(c) for c in sorted(cols)]
    b = sorted(tuple(canon(r[i]) for i in idx) for r in res.fetchall())
    assert a == b


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "retention" in df.columns
