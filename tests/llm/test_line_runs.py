"""The line runs: what the anti join decides, and how runs are joined."""

import pytest

from tenure.llm import linededup

LINE = "a line that many documents hold, more than forty characters long"


def frame(spark, rows):
    return spark.createDataFrame([(bytearray(h), d) for h, d in rows], "h binary, doc long")


def holds(k, j):
    """Lines 0 to 39 are in 24 of 30 documents, the others in 4 (too few)."""
    return (k * 7 + j) % 5 != 0 if j < 40 else (k - j) % 30 in (0, 3, 11, 20)


def dropped(spark):
    docs = [(k, "\n".join(f"{LINE} {j}" for j in range(80) if holds(k, j))) for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc_id: r.n_dropped for r in linededup.line_report(df, batches=4, fanout=2).collect()}


def plain():
    holders = {j: [k for k in range(30) if holds(k, j)] for j in range(80)}
    return {k: sum(k in h and k != max(h) and len(h) >= 5 for h in holders.values()) for k in range(30)}


def test_anti_join_decides(spark, monkeypatch):
    assert dropped(spark) == plain()
    monkeypatch.setattr(linededup.LineRuns, "fresh", lambda self, counted: counted)
    assert dropped(spark) != plain()


def test_every_key_is_in_one_run(spark):
    store = linededup.LineRuns(spark, fanout=2, buckets=3)
    for k in range(5):
        store.add(frame(spark, [(b"%d" % (i % (7 + k)), 10 * k + i) for i in range(9)]))
    keys = [bytes(r.h) for run in store.runs() for r in run.collect()]
    assert sorted(keys) == sorted(set(keys)) and len(keys) == 9
    assert {bytes(r.h): (r.n_docs, r.max_doc) for r in store.totals().collect()}[b"8"] == (3, 48)
    store.close()
    assert store.runs() == [] and store.totals().count() == 0


@pytest.mark.parametrize("aqe", ["true", "false"])
def test_runs_are_not_shuffled(spark, aqe):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        store = linededup.LineRuns(spark, fanout=9)
        store.add(frame(spark, [(b"a", 1), (b"b", 2)]))
        store.add(frame(spark, [(b"c", 3)]))
        left = store.fresh(frame(spark, [(b"a", 4), (b"d", 4)]).groupBy("h").count())
        assert [bytes(r.h) for r in left.collect()] == [b"d"]
        plan = left._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Bucketed: true") == 2 and plan.count("Exchange hashpartitioning") == 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    store.close()
