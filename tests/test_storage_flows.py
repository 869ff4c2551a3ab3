"""Versioned results, coercion reports, numbering of files, month flows, salted joins, token vectors."""

import datetime as dt

import numpy as np
import pytest
from conftest import tx
from pyspark.sql import functions as F

from tenure.operators import features, monthly, pricing
from tenure.operators.common import heavy_keys, join_salted
from tenure.plans import pipeline
from tenure.sources.readers import read_transactions, read_transactions_csv
from tenure.sources.schema import Coercion, canonicalize

ROWS = [(i, i % 7, f"2024-{1 + i % 5:02d}-{1 + i % 28:02d} 00:00:00", float(i), "A") for i in range(60)]


# --- results ---------------------------------------------------------------------

def test_a_changed_input_is_computed_again(spark, tmp_path):
    t, out = tx(spark, ROWS), str(tmp_path / "o")
    assert not pipeline.run_pipeline(spark, t, out, train_model=False)["reused"]
    assert pipeline.run_pipeline(spark, t.orderBy(F.rand(3)).repartition(3), out, train_model=False)["reused"]  # order doesn't matter
    changed = tx(spark, ROWS[:-1] + [(59, 3, "2024-05-04 00:00:00", 59.5, "A")])
    assert not pipeline.run_pipeline(spark, changed, out, train_model=False)["reused"]
    feats, _, meta = pipeline.load_processed(spark, out)
    assert feats.where("tx_id = 59").first().amount == 59.5 and meta.count() == 1
    assert pipeline.run_pipeline(spark, t, out, train_model=False)["reused"]  # the older version is still there


def test_a_stopped_run_is_never_read(spark, tmp_path, monkeypatch):
    t, out = tx(spark, ROWS), str(tmp_path / "o")
    pipeline.write_processed(t, {"m": t.groupBy("kind").count()}, out)

    class Stopped(Exception):
        pass

    def stop(*args, **kwargs):
        raise Stopped
    bad = t.withColumn("amount", F.lit(-1.0))
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", stop)  # the manifest is made last
        with pytest.raises(Stopped):
            pipeline.write_processed(bad, {"m": bad.groupBy("kind").count()}, out)
    df, metrics, meta = pipeline.load_processed(spark, out)
    assert df.agg(F.min("amount")).first()[0] == 0.0 and metrics["m"].count() == 1 and meta.first().n_rows == 60
    with pytest.raises(FileNotFoundError):
        pipeline.load_processed(spark, out, source="another input")
    first = tx(spark, ROWS[:3])
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", stop)
        with pytest.raises(Stopped):
            pipeline.write_processed(first, {}, str(tmp_path / "new"))
    with pytest.raises(FileNotFoundError):
        pipeline.load_processed(spark, str(tmp_path / "new"))


# --- sources -----------------------------------------------------------------------

def test_lost_fields_are_counted(spark, tmp_path):
    (tmp_path / "t.csv").write_text("date,driver_id,amount,kind\n2024-01-01 10:00:00,1,10.5,A\nnot a date,2,3.0,A\n2024-01-02,3,abc,A\n2024-01-03,4,NaN,A\n")
    c = Coercion()
    t = read_transactions_csv(spark, str(tmp_path / "t.csv"), coercion=c)
    assert c.counts() == {"rows": 4, "bad_dates": 1, "bad_amounts": 1, "malformed": 1}
    assert t.columns == ["tx_id", "driver_id", "transaction_date", "amount", "kind"] and t.count() == 4
    with pytest.raises(ValueError):
        read_transactions_csv(spark, str(tmp_path / "t.csv"), coercion=Coercion(max_share=0.1))
    own = Coercion()
    frame = spark.createDataFrame([("x", 1, 1.0), ("2024-01-01", 2, float("nan"))], "date string, driver_id long, amount double")
    assert canonicalize(frame, own).count() == 2 and own.check() == {"rows": 2, "bad_dates": 1, "bad_amounts": 1, "malformed": 0}


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_files_without_ids_are_numbered_in_file_order(spark, tmp_path, fmt):
    for name, first in (("a", 0), ("b", 300)):
        df = spark.range(first, first + 300, 1, 1).selectExpr("'2024-01-01 10:00:00' as date", "id as driver_id", "1.0D as amount", "'A' as kind")
        df.write.format(fmt).save(str(tmp_path / name))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "3k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            t = read_transactions(spark, f"{tmp_path}/*/", fmt)
            assert sorted((r.tx_id, r.driver_id) for r in t.collect()) == [(k, k) for k in range(600)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_ids_of_a_frame_stay_the_same(spark):
    df = spark.range(200).repartition(4).selectExpr("'2024-01-01' as date", "id as driver_id", "rand() as amount")
    t = canonicalize(df)
    assert {(r.tx_id, r.amount) for r in t.collect()} == {(r.tx_id, r.amount) for r in t.collect()}


# --- month flows -------------------------------------------------------------------

def test_month_flows_equal_sets(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 25)), f"{rng.choice([2022, 2023, 2024])}-{rng.choice([1, 2, 5, 11]):02d}-03 00:00:00", 1.0, "A") for i in range(150)]
    t = tx(spark, rows)
    for key in ("year_month", "month"):
        of = {}
        for _, d, ts, _, _ in rows:
            of.setdefault(dt.date(int(ts[:4]), int(ts[5:7]), 1) if key == "year_month" else int(ts[5:7]), set()).add(d)
        order = sorted(of)
        got = {(r.month.date() if hasattr(r.month, "date") else r.month): (r.active, r.previous_active, r.retained, r.churned, r.new) for r in monthly.month_flows(t, key).collect()}
        assert got == {m: (len(of[m]), len(p), len(of[m] & p), len(p - of[m]), len(of[m] - p))
                       for m, p in zip(order, [set()] + [of[x] for x in order])}
        if key == "year_month":
            day = lambda m: m.date() if hasattr(m, "date") else m
            gone = {(day(r.month), r.driver_id) for r in monthly.month_churned_drivers(t).collect()}
            new = {(day(r.month), r.driver_id) for r in monthly.month_new_drivers(t).collect()}
            assert gone == {(b, d) for a, b in zip(order, order[1:]) for d in of[a] - of[b]}
            assert new == {(order[0], d) for d in of[order[0]]} | {(b, d) for a, b in zip(order, order[1:]) for d in of[b] - of[a]}


def test_month_flows_shuffle_the_drivers_once(spark):
    plan = monthly.month_flows(tx(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(driver_id") == 1 and "Join" not in plan


# --- salted joins --------------------------------------------------------------------

def test_heavy_key_tuples_are_found(spark):
    df = spark.range(30_000).selectExpr("id", "case when id % 3 = 0 then 5 when id % 3 = 1 then null else id end as d", "cast(id % 2 as string) as s")
    hot = heavy_keys(df, ["d", "s"])
    want = {r.h for r in df.where("d = 5 or d is null").select(F.xxhash64("d", "s").alias("h")).distinct().collect()}
    assert want <= set(hot) and len(hot) <= 400
    assert heavy_keys(spark.range(5000), ["id"]) == []


@pytest.mark.parametrize("case", ["timestamp", "null driver"])
def test_hot_driver_and_timestamp_is_spread(spark, case):
    """A third of 300,000 rows on one (driver, timestamp)."""
    hot = "id % 3 = 0"
    driver = f"case when {hot} then 1 else 2 + id % 50000 end" if case == "timestamp" else f"case when {hot} then null else 2 + id % 50000 end"
    t = spark.range(300_000).selectExpr("id as tx_id", f"{driver} as driver_id", f"timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(case when {hot} then 0 else id % 100 end as int)) as transaction_date",
                                        "1.0D as amount", "'A' as kind")
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in zip(keys, ("-1", "8", "false")):
            spark.conf.set(k, v)
        j = pricing.daily_activity_join(t)
        sizes = [r["count"] for r in j.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 300_000 and max(sizes) < 2 * 300_000 / 8
        assert j.where("is_active = 1").count() == (300_000 if case == "timestamp" else 200_000)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_salted_join_equals_plain_join(spark):
    rows = spark.range(4000).selectExpr("id", "case when id % 2 = 0 then 1 else id end as k", "id % 3 as m")
    per = rows.groupBy("k", "m").agg(F.max("id").alias("top")).where("top % 5 <> 0")
    got = join_salted(rows, per, ["k", "m"]).select("id", "k", "m", "top")
    want = rows.join(per, ["k", "m"], "left").select("id", "k", "m", "top")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


# --- vectors -------------------------------------------------------------------------

def test_row_vectors_are_the_mean_of_token_vectors(spark):
    df = spark.range(300).selectExpr("id", "id % 5 as a", "cast(id % 3 as double) as b", "cast(null as string) as c")
    texts = features.feature_text(df, ["a", "b", "c"], embedder=lambda t: [[]] * len(t), id_col="id")
    model = features.token_vectors(texts, size=8, min_count=70)
    got = {r.id: r.embedding for r in features.feature_text(df, ["a", "b", "c"], model=model, id_col="id").collect()}
    from pyspark.ml.functions import vector_to_array
    model.getVectors().select("word", vector_to_array("vector").alias("v")).createOrReplaceTempView("token_table")
    texts.createOrReplaceTempView("row_texts")
    want = spark.sql("""SELECT id, i, sum(coalesce(v[i], 0)) / any_value(n) AS m FROM (
        SELECT id, token, size(split(feature_text, ' ')) AS n, i FROM row_texts, LATERAL explode(split(lower(feature_text), ' ')) AS x(token), LATERAL explode(sequence(0, 7)) AS y(i)) r
        LEFT JOIN token_table t ON t.word = r.token GROUP BY id, i""").collect()
    assert len(got) == 300 and len(want) == 2400 and model.getVectors().count() < 20
    for r in want:
        assert got[r.id][r.i] == pytest.approx(r.m, abs=1e-6)
    assert any(abs(x) > 1e-4 for x in got[0])
