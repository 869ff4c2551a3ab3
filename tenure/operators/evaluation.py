"""Model-evaluation tables on a scored frame ``S`` (y_true, y_pred, y_prob)
and correlation tables.

Curves and the AUC group by distinct score first, then use the global order
helpers (running sums across partitions) — never a single-task window over
all scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions import comoments
from tenure.functions.numeric import qcut_score
from tenure.functions.ordering import GIDX, PID, cumsum_ordered, global_order, shifts_ordered
from tenure.functions.timeutil import floor_days, minus_days
from tenure.operators.common import DRV, TS, drivers, ref_date, with_ref
from tenure.session import cut_lineage
from tenure.sources.schema import numeric_columns


def scored_fixture(t: DataFrame, horizon_days: int = 180, days: int = 30) -> DataFrame:
    """A deterministic scored frame per driver (no model):
    y_true = churn (CP2), y_prob = whole days since the last transaction
    before a cut-off ``horizon_days`` before the last date, ÷ its maximum;
    y_pred = y_prob ≥ 0.5.  Drivers without a row before the cut-off are
    left out."""
    rows = with_ref(drivers(t), ref_date(t)).withColumn("_cut", minus_days("ref_date", horizon_days))
    per = rows.groupBy(DRV, "ref_date", "_cut").agg(
        F.max(TS).alias("_last"), F.max(F.when(F.col(TS) < F.col("_cut"), F.col(TS))).alias("_lb"))
    y = per.where(F.col("_lb").isNotNull()).withColumn("_d", floor_days("_lb", "_cut"))
    mx = y.agg(F.max("_d").alias("_mx"))
    z = with_ref(y, mx)
    prob = F.try_divide(F.col("_d").cast("double"), F.col("_mx").cast("double"))
    return z.select(DRV, (floor_days("_last", "ref_date") > days).cast("int").alias("y_true"),
                    F.coalesce(prob >= 0.5, F.lit(False)).cast("int").alias("y_pred"), prob.alias("y_prob"))


def confusion_matrix(s: DataFrame) -> DataFrame:
    """The complete 2×2 grid (y_true, y_pred, count), zeros included."""
    t, p = F.col("y_true"), F.col("y_pred")
    c = s.agg(*[F.count_if((t == a) & (p == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])
    cells = F.array(*[F.struct(F.lit(a).alias("y_true"), F.lit(b).alias("y_pred"), F.col(f"c{a}{b}").alias("count"))
                      for a in (0, 1) for b in (0, 1)])
    return c.select(F.explode(cells).alias("c")).select("c.*")


def _score_groups(s: DataFrame) -> DataFrame:
    return (s.where(F.col("y_prob").isNotNull()).groupBy("y_prob")
             .agg(F.sum(F.col("y_true").cast("long")).alias("pos"),
                  F.sum((1 - F.col("y_true")).cast("long")).alias("neg")))


def roc_auc(s: DataFrame) -> DataFrame:
    """Area under the ROC curve (ties count one half), one row."""
    g = global_order(_score_groups(s), ["y_prob"])
    c = cumsum_ordered(g, ["neg"])
    x = c.agg(F.sum(F.col("pos") * (F.col("neg_cum") - F.col("neg") + 0.5 * F.col("neg"))).alias("_a"),
              F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return x.select(F.try_divide(F.col("_a"), F.col("_p") * F.col("_n")).alias("roc_auc"))


def roc_auc_by(s: DataFrame, by: list[str]) -> DataFrame:
    """Area under the ROC curve of every group, (*by, roc_auc), with one sort over
    all groups: running sums are taken across groups and each group's start is
    subtracted.  A group with one class only has NULL."""
    counts = (s.where(F.col("y_prob").isNotNull()).groupBy(*by, "y_prob")
              .agg(F.sum(F.col("y_true").cast("long")).alias("pos"), F.sum((1 - F.col("y_true")).cast("long")).alias("neg")))
    c = cumsum_ordered(global_order(counts, [*by, "y_prob"]), ["neg"])
    below = F.col("neg_cum") - 0.5 * F.col("neg")
    x = c.groupBy(*by).agg(F.sum(F.col("pos") * below).alias("_a"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
                           F.min(F.col("neg_cum") - F.col("neg")).alias("_start"))
    return x.select(*by, F.try_divide(F.col("_a") - F.col("_start") * F.col("_p"), F.col("_p") * F.col("_n")).alias("roc_auc"))


def _curve_points(s: DataFrame) -> DataFrame:
    """Distinct thresholds in descending order with cumulative tps / fps."""
    g = global_order(_score_groups(s), [F.col("y_prob").desc()])
    return cumsum_ordered(g, ["pos", "neg"]).withColumnRenamed("pos_cum", "tps").withColumnRenamed("neg_cum", "fps")


def roc_curve(s: DataFrame, drop_intermediate: bool = True) -> DataFrame:
    """ROC points (threshold, fpr, tpr), starting at (0, 0) with a NULL
    threshold; collinear intermediate points dropped."""
    c = _curve_points(s).select(PID, GIDX, "y_prob", "tps", "fps")
    tot = c.agg(F.max("tps").alias("_P"), F.max("fps").alias("_N"), F.max(GIDX).alias("_last"))
    if drop_intermediate:
        c = shifts_ordered(c, ["tps", "fps"], [1, -1], ["_p", "_n"])
        c = with_ref(c, tot)
        bend = ((F.col("fps_p") - 2 * F.col("fps") + F.col("fps_n")) != 0) | \
               ((F.col("tps_p") - 2 * F.col("tps") + F.col("tps_n")) != 0)
        c = c.where((F.col(GIDX) == 0) | (F.col(GIDX) == F.col("_last")) | bend)
    else:
        c = with_ref(c, tot)
    pts = c.select(F.col("y_prob").alias("threshold"), F.try_divide(F.col("fps"), F.col("_N")).alias("fpr"),
                   F.try_divide(F.col("tps"), F.col("_P")).alias("tpr"))
    start = tot.select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


def pr_curve(s: DataFrame) -> DataFrame:
    """Precision–recall points (threshold, precision, recall) for every
    distinct threshold, plus the end point (precision 1, recall 0)."""
    c = _curve_points(s)
    tot = c.agg(F.max("tps").alias("_P"))
    x = with_ref(c, tot)
    ps = F.col("tps") + F.col("fps")
    pts = x.select(F.col("y_prob").alias("threshold"),
                   F.when(ps != 0, F.col("tps") / ps).otherwise(F.lit(0.0)).alias("precision"),
                   F.when(F.col("_P") == 0, F.lit(1.0)).otherwise(F.col("tps") / F.col("_P")).alias("recall"))
    end = tot.select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                     F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def classification_report(s: DataFrame) -> DataFrame:
    """precision, recall, f1_score, support per class, accuracy, macro and
    weighted averages (zero division gives 0)."""
    t, p = F.col("y_true"), F.col("y_pred")
    c = s.agg(*[F.count_if((t == a) & (p == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])

    def zdiv(a, b):
        return F.when(b != 0, a / b).otherwise(F.lit(0.0))

    rows = []
    for k in (0, 1):
        tp = F.col(f"c{k}{k}")
        pred = F.col(f"c0{k}") + F.col(f"c1{k}")
        sup = F.col(f"c{k}0") + F.col(f"c{k}1")
        pr, rc = zdiv(tp, pred), zdiv(tp, sup)
        rows.append((str(k), pr, rc, zdiv(2 * pr * rc, pr + rc), sup))
    n = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    acc = zdiv(F.col("c00") + F.col("c11"), n)
    macro = [(rows[0][i] + rows[1][i]) / 2 for i in (1, 2, 3)]
    weighted = [zdiv(rows[0][i] * rows[0][4] + rows[1][i] * rows[1][4], n) for i in (1, 2, 3)]
    structs = [F.struct(F.lit(lbl).alias("label"), a.alias("precision"), b.alias("recall"), f.alias("f1_score"),
                        sp.cast("long").alias("support")) for lbl, a, b, f, sp in rows]
    structs.append(F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                            F.lit(None).cast("double").alias("recall"), acc.alias("f1_score"),
                            n.cast("long").alias("support")))
    structs.append(F.struct(F.lit("macro avg").alias("label"), macro[0].alias("precision"), macro[1].alias("recall"),
                            macro[2].alias("f1_score"), n.cast("long").alias("support")))
    structs.append(F.struct(F.lit("weighted avg").alias("label"), weighted[0].alias("precision"),
                            weighted[1].alias("recall"), weighted[2].alias("f1_score"), n.cast("long").alias("support")))
    return c.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def calibration(s: DataFrame, q: int = 10, exact: bool = True) -> DataFrame:
    """Quantile bins of y_prob (duplicate edges dropped): mean predicted vs
    actual rate per bin.  ``exact=False`` takes the edges from a sketch."""
    rows = s.where(F.col("y_prob").isNotNull()).select("y_prob", "y_true")
    b = qcut_score(cut_lineage(rows) if exact else rows, "y_prob", q, "bin", drop_duplicates=True, base=0, exact=exact)
    return b.groupBy("bin").agg(F.avg("y_prob").alias("prob_pred"), F.avg(F.col("y_true").cast("double")).alias("actual"),
                                F.count(F.lit(1)).alias("n"))


def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson correlations of ``cols`` (default: every
    numeric column) as long rows (x, y, r), from one scan.

    Every task keeps co-moments of all pairs (rows, means and centred products of
    the rows in which both are there), which are merged pairwise, a square root of
    the tasks' number at a time.  NULL and NaN are missing; a constant column has
    NULL, a column with itself exactly 1."""
    cols = cols if cols is not None else numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "x string, y string, r double")
    x = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    parts = x.mapInArrow(comoments.of_batches, "m binary")
    some = max(1, int(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    merged = parts.repartition(some).mapInArrow(comoments.merged, "m binary").repartition(1).mapInArrow(comoments.merged, "m binary")
    found = merged.mapInArrow(comoments.correlations(cols), "x string, y string, r double")
    pairs = df.sparkSession.createDataFrame([(a, b) for a in cols for b in cols], "x string, y string")  # also without rows
    return pairs.join(F.broadcast(found), ["x", "y"], "left")  # a row per pair of columns


def churn_correlation(df: DataFrame, features: list[str], label: str = "churn") -> DataFrame:
    """|corr(feature, label)| per feature, ascending."""
    m = correlation_matrix(df, [*dict.fromkeys([*features, label])])
    return (m.where((F.col("y") == label) & F.col("x").isin(features))
            .select(F.col("x").alias("feature"), F.abs("r").alias("correlation")).orderBy("correlation"))


def correlation_graph(df: DataFrame, features: list[str], threshold: float = 0.3) -> DataFrame:
    """Edges (source, target, weight) between features i < j (list order)
    with |corr| above ``threshold``."""
    pos = {f: i for i, f in enumerate(features)}
    m = correlation_matrix(df, features)
    idx = F.create_map(*[x for f, i in pos.items() for x in (F.lit(f), F.lit(i))])
    return (m.where((idx[F.col("x")] < idx[F.col("y")]) & (F.abs("r") > threshold))
             .select(F.col("x").alias("source"), F.col("y").alias("target"), F.abs("r").alias("weight")))
