"""A driver holding most rows, split over several range partitions: the
order-dependent features must still equal the single-machine result."""

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tenure.operators import features
from tenure.sources.readers import read_transactions_csv


def hot_frame(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        d = 1 if i % 3 else int(rng.integers(2, 40))  # driver 1 holds two thirds of the rows
        day = int(rng.integers(0, 300))
        rows.append((i, d, f"2024-01-01 00:00:00", float(rng.integers(100, 10000)) / 100, "A", day))
    df = spark.createDataFrame(rows, "tx_id long, driver_id long, ts string, amount double, kind string, day int")
    return df.select("tx_id", "driver_id",
                     (F.to_timestamp_ntz("ts") + F.make_dt_interval(F.col("day"))).alias("transaction_date"),
                     "amount", "kind")


def test_hot_driver_rolling_and_slope(spark):
    t = hot_frame(spark)
    got = features.transaction_features(t, ["behavioral", "monetary"]).toPandas().set_index("tx_id").sort_index()
    by_driver = {}
    for r in sorted(t.collect(), key=lambda r: (r.driver_id, r.transaction_date, r.tx_id)):
        by_driver.setdefault(r.driver_id, []).append((r.tx_id, r.amount))
    for rows in by_driver.values():
        n, seen = len(rows), []
        mid = (n - 1) / 2
        spread = sum((k - mid) ** 2 for k in range(n))
        trend = sum((k - mid) * a for k, (_, a) in enumerate(rows)) / spread if spread else None
        for tx, amount in rows:
            seen = (seen + [amount])[-3:]
            assert np.isclose(got.usage_intensity[tx], sum(seen) / len(seen))
            assert pd.isna(got.value_trend[tx]) if trend is None else np.isclose(float(got.value_trend[tx]), trend, atol=1e-9)


def test_heavy_driver_is_spread_over_the_join(spark):
    from tenure.operators.common import heavy_drivers, join_drivers
    t = hot_frame(spark)
    per = t.groupBy("driver_id").agg(F.min("amount").alias("low"))
    heavy = heavy_drivers(t)
    assert 1 in {r.driver_id for r in heavy.collect()} and heavy.count() <= 200
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        j = join_drivers(t, per, heavy)
        sizes = [r["count"] for r in j.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 1500 and max(sizes) < 2 * 1500 / 8
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = {r.driver_id: r.low for r in per.collect()}
    assert all(r.low == want[r.driver_id] for r in j.collect())


def test_read_csv_raw_layout(spark):
    d = tempfile.mkdtemp(prefix="tenure-csv-")
    with open(f"{d}/t.csv", "w") as f:
        f.write("date,driver_id,amount,kind\n2024-01-01 10:00:00,1,10.5,RECURRENCY\nnot a date,2,3.0,FIRST_PAYMENT\n")
    t = read_transactions_csv(spark, f"{d}/t.csv")
    assert t.columns == ["tx_id", "driver_id", "transaction_date", "amount", "kind"]
    r = sorted(t.collect(), key=lambda x: x.driver_id)
    assert str(r[0].transaction_date) == "2024-01-01 10:00:00" and r[1].transaction_date is None


def test_csv_rows_are_numbered_in_file_order(spark):
    d = tempfile.mkdtemp(prefix="tenure-csv-")
    for name, first in (("a", 0), ("b", 500)):
        with open(f"{d}/{name}.csv", "w") as f:
            f.write("date,driver_id,amount,kind\n" + "".join(f"2024-01-01 10:00:00,{first + k},1.0,A\n" for k in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "2k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = read_transactions_csv(spark, d).collect()
            assert sorted((r.tx_id, r.driver_id) for r in rows) == [(k, k) for k in range(1000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_lags_cross_partition_borders(spark):
    from tenure.functions.ordering import global_order, shifts_ordered
    t = spark.createDataFrame([(k, k // 7, float(k)) for k in range(60)], "k long, g long, v double").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep several small partitions
    try:
        o = global_order(t, ["g", "k"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    rows = shifts_ordered(o, ["v"], [1, 3, -2], ["_a", "_b", "_c"], key="g").collect()
    value = lambda k, g: float(k) if 0 <= k < 60 and k // 7 == g else None
    assert len(rows) == 60 and len({r._pid for r in rows}) > 1
    for r in rows:
        assert (r.v_a, r.v_b, r.v_c) == (value(r.k - 1, r.g), value(r.k - 3, r.g), value(r.k + 2, r.g))
