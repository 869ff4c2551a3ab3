"""Numeric DataFrame helpers: exact quantiles, quantile scores, histograms,
quadratic least squares, centred rolling means.

Exact quantiles of whole columns are selected without a sort
(:mod:`tenure.functions.quantiles`); those of groups are computed by sorting (range
partitioned) and picking the two rows around each rank, never by collecting a
group's values (or a value→count map) in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions.ordering import GIDX, global_order, shifts_ordered
from tenure.functions.quantiles import ACCURACY, column_quantiles
from tenure.session import few_rows


#: Up to so many (group, probability) pairs the ranks looked for are broadcast.
FEW_RANKS = 50_000


def _cols(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by=()) -> DataFrame:
    """Linear-interpolation quantiles (pandas / numpy default) per group.

    Returns long rows ``(*by, prob, quantile)``.  NULL values are skipped.
    """
    by = _cols(by)
    # the row id breaks ties: a value held by a third of the rows is still
    # split over many range partitions
    base = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"),
                                                      F.monotonically_increasing_id().alias("_tie"))
    ordered = global_order(base, [*by, "_v", "_tie"])
    grp = ordered.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(GIDX).alias("_start"))
    probs_arr = F.array(*[F.lit(float(p)) for p in probs])
    tgt = (grp.select(*by, "_n", "_start", F.explode(probs_arr).alias("prob"))
              .withColumn("_pos", F.col("prob") * (F.col("_n") - 1))
              .withColumn("_frac", F.col("_pos") - F.floor("_pos"))
              .select(*by, "prob", "_frac", F.explode(F.array(
                  F.struct((F.col("_start") + F.floor("_pos")).alias(GIDX), F.lit(True).alias("_low")),
                  F.struct((F.col("_start") + F.ceil("_pos")).alias(GIDX), F.lit(False).alias("_low")))).alias("_t"))
              .select(*by, "prob", "_frac", f"_t.{GIDX}", "_t._low"))
    # Two ranks per group and probability.  Few groups: the ranks go to the
    # sorted values, which are read once and not shuffled again.
    groups = grp.count() if by else 1
    tgt = F.broadcast(tgt) if groups * len(probs) <= FEW_RANKS else tgt
    out = ordered.select(GIDX, "_v").join(tgt, GIDX).groupBy(*by, "prob", "_frac").agg(
        F.max(F.when(F.col("_low"), F.col("_v"))).alias("_vlo"), F.max(F.when(~F.col("_low"), F.col("_v"))).alias("_vhi"))
    q = F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")
    return out.select(*by, "prob", q.alias("quantile"))


def qcut_edges(df: DataFrame, value: str, q: int, by=()) -> DataFrame:
    """The ``q+1`` quantile edges of ``qcut`` as an array column ``edges``."""
    by = _cols(by)
    probs = [i / q for i in range(q + 1)]
    qs = exact_quantiles(df, value, probs, by)
    agg = F.array_sort(F.collect_list(F.struct("prob", "quantile")))  # q+1 entries per group
    e = F.transform(agg, lambda s: s["quantile"]).alias("edges")
    return qs.groupBy(*by).agg(e) if by else qs.agg(e)


def _count_below(edges: list, x: Column) -> Column:
    """Number of inner edges (all but the first and last) strictly below ``x``."""
    below = F.lit(0)
    for e in edges[1:-1]:
        below = below + F.when(F.lit(e) < x, 1).otherwise(0)
    return below


def qcut_scores(df: DataFrame, values: list[str], q: int, suffix: str = "_score", base: int = 1, exact: bool = True,
                accuracy: int = ACCURACY) -> DataFrame:
    """:func:`qcut_score` for several columns, whose edges are found together."""
    edges = column_quantiles(df, values, [i / q for i in range(q + 1)], exact, accuracy)
    return df.select("*", *[F.when(F.col(c).isNotNull(), _count_below(edges[c], F.col(c)) + base).alias(c + suffix) for c in values])


def qcut_score(df: DataFrame, value: str, q: int, out: str, by=(), drop_duplicates: bool = False,
               base: int = 1, exact: bool = True, accuracy: int = ACCURACY) -> DataFrame:
    """``qcut(x, q, labels=False) + base`` as a column ``out``.

    Bins are right-closed, the lowest edge included, so the label is the
    number of inner edges strictly below ``x``.  Tied edges are kept (pandas
    raises there); ``drop_duplicates`` removes them first (``duplicates='drop'``).
    With ``exact=False`` the edges come from a mergeable sketch whose rank error
    is 1/``accuracy`` of the rows (of a group), in one aggregation.  Without
    groups the edges are ``q + 1`` numbers; with ``by`` a table of one row per group.
    """
    by = _cols(by)
    probs = [i / q for i in range(q + 1)]
    if not by:
        edges = column_quantiles(df, [value], probs, exact, accuracy)[value]
        if drop_duplicates:
            edges = sorted(set(edges)) if edges[0] is not None else edges
        return df.withColumn(out, F.when(F.col(value).isNotNull(), _count_below(edges, F.col(value)) + base))
    if exact:
        edges = qcut_edges(df, value, q, by)
    else:
        edges = df.groupBy(*by).agg(F.percentile_approx(F.col(value).cast("double"), probs, accuracy).alias("edges"))
    if drop_duplicates:
        edges = edges.withColumn("edges", F.array_distinct("edges"))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    label = F.aggregate(inner, F.lit(0), lambda acc, e: acc + F.when(e < F.col(value), 1).otherwise(0))
    return df.join(edges, by, "left").withColumn(out, F.when(F.col(value).isNotNull(), label + base)).drop("edges")


#: Bins of an automatic histogram at most: outliers widen the bins instead.
MAX_AUTO_BINS = 1000


def round_bins(lo: float, hi: float, q1: float, q3: float, n: int) -> tuple[float, float, int]:
    """(start, width, bins): bins of 1, 2 or 5 times a power of ten, from a multiple of their width on.

    The width is Freedman and Diaconis' ``2 IQR / n^(1/3)``, or the range over
    Sturges' ``log2(n) + 1`` bins if the quartiles are one, rounded up."""
    if lo == hi:
        return lo - 0.5, 1.0, 1
    raw = max(2 * (q3 - q1) / n ** (1 / 3) or (hi - lo) / (math.log2(n) + 1), (hi - lo) / MAX_AUTO_BINS)
    power = 10.0 ** math.floor(math.log10(raw))
    width = next(m * power for m in (1, 2, 5, 10) if m * power >= raw * (1 - 1e-12))
    start = math.floor(lo / width) * width
    return start, width, max(1, math.ceil((hi - start) / width - 1e-9))


def histogram(df: DataFrame, value: str, bins: int | None, hue: str | None = None, by=()) -> DataFrame:
    """Equal-width histogram over ``[min, max]`` (last bin closed), per ``by`` group.

    Without ``bins`` (and groups) their number and round edges follow from the
    quartiles and the number of rows, see :func:`round_bins`.

    Returns ``(*by, bin, bin_start, bin_end, [hue], count)`` for every bin
    (and every ``hue`` value of the group), empty ones with count 0; ``bin`` is
    1-based.  NULL and NaN values are left out.  A constant column gets the
    range ``x ± 0.5``.  The range table has one row per group (one row without
    groups), the grid ``bins`` rows per group and hue.
    """
    by = _cols(by)
    x = F.col(value).cast("double")
    d = df.where(x.isNotNull() & ~F.isnan(x)).select(*by, *([hue] if hue else []), x.alias("_x"))
    rng = d.groupBy(*by).agg(F.min("_x").alias("_lo0"), F.max("_x").alias("_hi0")).where(F.col("_lo0").isNotNull())
    flat = F.when(F.col("_lo0") == F.col("_hi0"), 0.5).otherwise(0.0)
    rng = rng.select(*by, (F.col("_lo0") - flat).alias("_lo"), (F.col("_hi0") + flat).alias("_hi"))
    if bins is None:
        if by:
            raise ValueError("bins are needed for a histogram by group")
        n = d.count()
        lo, q1, q3, hi = column_quantiles(d, ["_x"], [0.0, 0.25, 0.75, 1.0])["_x"]
        start, size, bins = round_bins(lo, hi, q1, q3, n) if n else (0.0, 1.0, 1)
        rng = rng.select(F.lit(start).alias("_lo"), F.lit(start + bins * size).alias("_hi"))
    b = F.least(F.floor((F.col("_x") - F.col("_lo")) * F.lit(bins) / (F.col("_hi") - F.col("_lo"))).cast("long") + 1,
                F.lit(bins).cast("long"))
    keys = [*by, "bin"] + ([hue] if hue else [])
    rng = few_rows(rng) if by else rng
    ranged = d.crossJoin(F.broadcast(rng)) if not by else d.join(rng, by)
    counts = ranged.withColumn("bin", b).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if hue:  # one row per range and hue value: the range goes to the values, few or many
        values = d.select(*by, hue).distinct()
        rng = values.join(rng, by) if by else values.crossJoin(F.broadcast(rng))
    grid = rng.withColumn("bin", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(bins).cast("long"))))
    match = [grid[k].eqNullSafe(counts[k]) for k in keys]
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    return (grid.join(counts, match, "left")
                .select(*[grid[c] for c in by], grid["bin"],
                        (F.col("_lo") + (grid["bin"] - 1) * width).alias("bin_start"),
                        (F.col("_lo") + grid["bin"] * width).alias("bin_end"),
                        *([grid[hue]] if hue else []), F.coalesce("_n", F.lit(0).cast("long")).alias("count")))


def quad_fit(df: DataFrame, x: str, y: str, by=(), with_range: bool = False) -> DataFrame:
    """Least-squares parabola ``y = a x² + b x + c`` per group (``polyfit`` deg 2).

    Two aggregations: mean / spread of ``x``, then power sums of the centred,
    scaled ``z = (x − m)/s`` (well conditioned), solved in closed form and
    mapped back.  Returns ``(*by, n, a, b, c, vertex_x, vertex_y, is_maximum)``;
    fewer than three distinct ``x`` have no single parabola: all NULL but ``n``.
    ``with_range`` adds ``x_min`` and ``x_max`` from the same first pass.
    """
    by = _cols(by)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"),
                                                                      F.col(y).cast("double").alias("_y"))
    m = d.groupBy(*by).agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"),
                          F.min("_x").alias("x_min"), F.max("_x").alias("x_max"))
    dz = (d.crossJoin(F.broadcast(m)) if not by else d.join(few_rows(m), by)).withColumn(
        "_z", F.try_divide(F.col("_x") - F.col("_m"), F.col("_s")))
    z, yy = F.col("_z"), F.col("_y")
    sums = dz.groupBy(*by, "_m", "_s", "x_min", "x_max").agg(
        F.count(F.lit(1)).alias("n"), F.sum(z).alias("s1"), F.sum(z * z).alias("s2"),
        F.sum(z * z * z).alias("s3"), F.sum(z * z * z * z).alias("s4"), F.sum(yy).alias("t0"),
        F.sum(z * yy).alias("t1"), F.sum(z * z * yy).alias("t2"))
    return sums.select(*by, "n", *_solve_quadratic(), *(["x_min", "x_max"] if with_range else []))


def _solve_quadratic() -> list[Column]:
    n, s1, s2, s3, s4 = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4"))
    t0, t1, t2, m, s = (F.col(c) for c in ("t0", "t1", "t2", "_m", "_s"))
    # normal equations  [s4 s3 s2; s3 s2 s1; s2 s1 n] · [A B C] = [t2 t1 t0]
    det = s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2)
    da = t2 * (s2 * n - s1 * s1) - s3 * (t1 * n - s1 * t0) + s2 * (t1 * s1 - s2 * t0)
    db = s4 * (t1 * n - t0 * s1) - t2 * (s3 * n - s1 * s2) + s2 * (s3 * t0 - t1 * s2)
    dc = s4 * (s2 * t0 - s1 * t1) - s3 * (s3 * t0 - s2 * t1) + t2 * (s3 * s1 - s2 * s2)
    A, B, C = F.try_divide(da, det), F.try_divide(db, det), F.try_divide(dc, det)
    a = F.try_divide(A, s * s)
    b = F.try_divide(B, s) - F.try_divide(2 * A * m, s * s)
    c = F.try_divide(A * m * m, s * s) - F.try_divide(B * m, s) + C
    return [a.alias("a"), b.alias("b"), c.alias("c"), F.try_divide(m * 2 * A - B * s, 2 * A).alias("vertex_x"),
            F.try_divide(4 * A * C - B * B, 4 * A).alias("vertex_y"), (A < 0).alias("is_maximum")]


def centred_rolling_mean(df: DataFrame, value: str, w: int, out: str) -> DataFrame:
    """Centred rolling mean over ``w`` rows in ``_gidx`` order, full window required.

    pandas ``rolling(w, center=True).mean()``: the window is the rows
    ``i-(w-1-o) .. i+o`` with ``o = (w-1)//2``; NULL unless all ``w`` rows
    exist and are non-NULL.  Built from ``w-1`` shifts (``w`` is small).
    """
    o = (w - 1) // 2
    offs = [k for k in range(-(w - 1 - o), o + 1) if k != 0]
    sufs = [f"_r{k + w}" for k in offs]
    cur = shifts_ordered(df, [value], [-k for k in offs], sufs)
    names = [value + s for s in sufs]
    parts = [F.col(value)] + [F.col(n) for n in names]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return cur.withColumn(out, total / F.lit(float(w))).drop(*names)


def half_even(x, digits: int = 2) -> Column:
    """Rounding of ties to the even digit (numpy's ``round``)."""
    return F.bround(F.col(x) if isinstance(x, str) else x, digits)


def thousands(x, digits: int = 0) -> Column:
    """Number as text with thousands separators."""
    return F.format_number(F.col(x) if isinstance(x, str) else x, digits)
