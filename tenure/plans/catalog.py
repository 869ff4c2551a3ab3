"""Catalog of registered queries: Spark plan + independent DuckDB SQL.

Each entry reads the given tables (through the fixture views) and runs one
operator on the whole input.  Computed doubles are rounded in the *query*
layer only — the same rounding in the SQL — so that the engines' different
summation orders cannot change the compared digits; the library functions
themselves return unrounded values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.plans.sqlviews import ACT_CTE, MIXED_CTE, NUDGE, PRICING_CTE, PROFILE_CTE, T_CTE, mavg, msum, r6, sql
from tenure.plans.sqlviews import floor_days as fd
from tenure.sources import load_activity, load_customer_profile, load_mixed, load_pricing, load_transactions


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, oracle)
        return fn
    return deco


def rnd(df: DataFrame, means: tuple[str, ...] = (), **digits: int) -> DataFrame:
    """Round the named double columns (query layer only); ``means`` are means
    of amounts, rounded like ``sqlviews.r6``."""
    def one(c):
        if c in means:
            return F.round(F.col(c) + NUDGE, 6).alias(c)
        return F.round(F.col(c), digits[c]).alias(c) if c in digits else F.col(c)
    return df.select(*[one(c) for c in df.columns])


def T(spark, d):
    return load_transactions(spark, d)


def ACT(spark, d):
    return load_activity(spark, d)


def MIX(spark, d):
    return load_mixed(spark, d)


def PR(spark, d):
    return load_pricing(spark, d)


def PROF(spark, d):
    return load_customer_profile(spark, d)


# Shared SQL fragments ---------------------------------------------------
REF = "ref AS (SELECT max(transaction_date) AS ref_date FROM t)"
PER_LAST = "per AS (SELECT driver_id, max(transaction_date) AS last FROM t WHERE driver_id IS NOT NULL GROUP BY driver_id)"
CHURNED = ("ch AS (SELECT p.driver_id, p.last AS last_transaction FROM per p, ref "
           "WHERE p.last < ref.ref_date - INTERVAL 30 DAY)")

from tenure.plans import queries_churn, queries_monthly, queries_drivers, queries_cohort, queries_features, queries_pricing, queries_eval  # noqa: E402,F401,I001
