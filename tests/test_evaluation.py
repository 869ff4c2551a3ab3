"""Evaluation tables against brute force on a small scored frame."""

import itertools

from tenure.operators import evaluation as ev


def scored(spark):
    rows = [(1, 0.9, 1), (1, 0.8, 1), (0, 0.8, 1), (1, 0.4, 0), (0, 0.3, 0), (0, 0.1, 0)]
    return spark.createDataFrame(rows, "y_true int, y_prob double, y_pred int")


def test_auc_brute_force(spark):
    s = scored(spark)
    rows = s.collect()
    pos = [r.y_prob for r in rows if r.y_true == 1]
    neg = [r.y_prob for r in rows if r.y_true == 0]
    brute = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg)) / (len(pos) * len(neg))
    assert abs(ev.roc_auc(s).first().roc_auc - brute) < 1e-12


def test_confusion_complete_grid(spark):
    cm = {(r.y_true, r.y_pred): r["count"] for r in ev.confusion_matrix(scored(spark)).collect()}
    assert cm == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 2}


def test_roc_points_and_trapezoid(spark):
    pts = sorted((r.fpr, r.tpr) for r in ev.roc_curve(scored(spark), drop_intermediate=False).collect())
    assert pts[0] == (0.0, 0.0) and pts[-1] == (1.0, 1.0)
    area = sum((x1 - x0) * (y0 + y1) / 2 for (x0, y0), (x1, y1) in zip(pts, pts[1:]))
    assert abs(area - ev.roc_auc(scored(spark)).first().roc_auc) < 1e-12


def test_pr_curve_end_point(spark):
    r = ev.pr_curve(scored(spark)).collect()
    assert any(x.threshold is None and x.precision == 1.0 and x.recall == 0.0 for x in r)


def test_classification_report(spark):
    r = {x.label: x for x in ev.classification_report(scored(spark)).collect()}
    assert abs(r["1"].precision - 2 / 3) < 1e-12 and abs(r["accuracy"].f1_score - 4 / 6) < 1e-12


def test_correlation(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, -float(i), 1.0) for i in range(10)], "x double, a double, b double, c double")
    m = {(r.x, r.y): r.r for r in ev.correlation_matrix(df, ["x", "a", "b", "c"]).collect()}
    assert abs(m[("x", "a")] - 1) < 1e-12 and abs(m[("x", "b")] + 1) < 1e-12 and m[("x", "c")] is None
    g = {(r.source, r.target) for r in ev.correlation_graph(df, ["x", "a", "b", "c"], 0.3).collect()}
    assert g == {("x", "a"), ("x", "b"), ("a", "b")}
