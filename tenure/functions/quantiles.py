"""Quantiles of several columns at once: exact by selection, or from a mergeable sketch.

Exact selection never sorts or moves the rows.  A first aggregation takes a
quantile sketch of every column (rank error 1/``ACCURACY`` of the rows, merged map
side), which gives each wanted quantile a bracket of two values around it; a second
one counts what lies below and inside the brackets; brackets that hold too many rows
are narrowed by a sketch of their rows; at last only the rows inside brackets, a few
in ``ACCURACY``, are grouped by value and the wanted ranks picked.  That is three
scans of the columns up to ``ACCURACY * FEW / 4`` rows, two more for every further
factor of ``ACCURACY / 4``.

With ``exact=False`` the sketch's values are the answer, from one scan: the rank of
the value for p lies between (p - 1/accuracy) and (p + 1/accuracy) times the rows.
NULL and NaN are skipped; a column without values has None for every quantile.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's accuracy: its rank error is 1/ACCURACY of the rows.
ACCURACY = 10_000
#: A bracket with more rows than this (and more than one value) is narrowed first.
FEW = 1_000_000


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float], exact: bool = True,
                     accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """The quantiles at ``probs`` of every column; exact ones interpolate linearly (pandas, numpy).

    ``df`` is read several times: write an expensive one first (``cut_lineage``)."""
    if not columns:
        return {}
    x = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    if not exact:
        row = x.agg(*[F.percentile_approx(f"c{i}", list(probs), accuracy).alias(f"q{i}") for i in range(len(columns))]).first()
        return {c: row[f"q{i}"] or [None] * len(probs) for i, c in enumerate(columns)}
    row = x.agg(*[e for i in range(len(columns)) for e in (
        F.count(f"c{i}").alias(f"n{i}"), F.min(f"c{i}").alias(f"lo{i}"), F.max(f"c{i}").alias(f"hi{i}"),
        F.percentile_approx(f"c{i}", [min(1.0, max(0.0, p + s * 2 / accuracy)) for p in probs for s in (-1, 1)], accuracy).alias(f"q{i}"))]).first()
    found = [_Bracket(i, p * (row[f"n{i}"] - 1), row[f"lo{i}"], row[f"hi{i}"], *row[f"q{i}"][2 * k:2 * k + 2])
             for i in range(len(columns)) if row[f"n{i}"] for k, p in enumerate(probs)]
    _count(x, found)
    while large := [b for b in found if b.inside > FEW and b.lo < b.hi and b.narrows]:
        _narrow(x, large, accuracy)
    values = iter(_pick(x, found))
    return {c: [next(values) if row[f"n{i}"] else None for _ in probs] for i, c in enumerate(columns)}


class _Bracket:
    """Two values with the wanted rank between them, and exact counts of the rows below and inside."""

    def __init__(self, column: int, rank: float, least: float, most: float, lo: float, hi: float):
        self.column, self.rank, self.least, self.most, self.lo, self.hi = column, rank, least, most, lo, hi
        self.below = self.inside = 0
        self.narrows = True

    def holds(self) -> bool:
        return self.below <= math.floor(self.rank) and math.ceil(self.rank) < self.below + self.inside

    def within(self):
        c = F.col(f"c{self.column}")
        return (c >= F.lit(self.lo)) & (c <= F.lit(self.hi))


def _count(x: DataFrame, brackets: list[_Bracket]) -> None:
    """Count below and inside; a bracket that misses its rank (a sketch doesn't) opens to the whole column."""
    row = x.agg(*[e for k, b in enumerate(brackets) for e in (
        F.count_if(F.col(f"c{b.column}") < F.lit(b.lo)).alias(f"b{k}"), F.count_if(b.within()).alias(f"i{k}"))]).first() if brackets else None
    missed = []
    for k, b in enumerate(brackets):
        b.below, b.inside = row[f"b{k}"], row[f"i{k}"]
        if not b.holds():
            b.lo, b.hi = b.least, b.most
            missed.append(b)
    if missed:
        _count(x, missed)


def _narrow(x: DataFrame, brackets: list[_Bracket], accuracy: int) -> None:
    """Cut every bracket to a few in ``accuracy`` of its rows; one that its ties keep large is left as it is."""
    sides = []
    for b in brackets:
        p = (b.rank - b.below) / b.inside
        sides.append([min(1.0, max(0.0, p + s * 2 / accuracy)) for s in (-1, 1)])
    row = x.agg(*[F.percentile_approx(F.when(b.within(), F.col(f"c{b.column}")), s, accuracy).alias(f"q{k}")
                  for k, (b, s) in enumerate(zip(brackets, sides))]).first()
    old = [(b.lo, b.hi, b.inside) for b in brackets]
    for k, b in enumerate(brackets):
        b.lo, b.hi = row[f"q{k}"]
    _count(x, brackets)
    for b, (lo, hi, inside) in zip(brackets, old):
        b.narrows = b.inside < inside


def _pick(x: DataFrame, brackets: list[_Bracket]) -> list[float]:
    """The interpolated value at every bracket's rank, from the rows inside brackets grouped by value."""
    if not brackets:
        return []
    entries = F.array_compact(F.array(*[F.when(b.within(), F.struct(F.lit(k).alias("k"), F.col(f"c{b.column}").alias("v"))) for k, b in enumerate(brackets)]))
    ranks = F.array(*[F.array(F.lit(math.floor(b.rank) - b.below), F.lit(math.ceil(b.rank) - b.below)) for b in brackets])
    counts = x.select(F.explode(entries).alias("e")).select("e.*").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("k").orderBy("v")  # distinct values of one bracket: bounded by narrowing
    placed = counts.withColumn("upto", F.sum("n").over(w)).withColumn("at", F.explode(F.get(ranks, F.col("k"))))
    rows = placed.where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n"))).select("k", "at", "v").collect()  # two rows a quantile
    value = {(r.k, r.at): r.v for r in rows}
    out = []
    for k, b in enumerate(brackets):
        low, high = (value[k, f(b.rank) - b.below] for f in (math.floor, math.ceil))
        out.append(low + (high - low) * (b.rank - math.floor(b.rank)))
    return out
