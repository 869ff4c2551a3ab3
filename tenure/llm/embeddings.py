"""Embedding near-duplicates: spherical k-means cells and blocked cosine products.

Equal vectors are one node from the start.  Spherical k-means, fitted on a
bounded sample (``sample`` vectors picked by hash), assigns every vector to the
cell of its nearest centre.  A link may cross cells, so a vector also visits
each lower-numbered cell that a partner could belong to: for unit vectors x in
cell A and y in cell B with cosine >= t, the distance of x and y is at most
sqrt(2 - 2t), and so y.(cB - cA) is at most sqrt(2 - 2t) |cB - cA|.  Vectors
beyond that bound can't link into A; no link is lost.

A cell's members and visitors are dealt into blocks of about ``block`` rows,
and a pair of blocks is one task's unit: a matrix product in double precision.
A unit returns each row's number of links and a spanning forest of its links,
never the pairs, so a group of near copies of any size stays linear in output
and bounded in memory.

Defined results for odd input: a vector that is null, empty or zero, or holds
a null or non-finite component links with nothing; vectors of different lengths
don't link; a row without an id links with nothing, counts for nobody and is
kept; repeated rows are vectors of their own and link with each other; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import cut, small_batches
from tenure.llm.components import connected_components

THRESHOLD = 0.9


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision (by their largest component first, against overflow)."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """``k`` unit centres of the unit rows ``x``; an empty cell keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        cell = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        norm = np.sqrt((sums * sums).sum(axis=1))
        ok = norm > 0
        centres[ok] = sums[ok] / norm[ok, None]
    return centres


def _rows(column, dim: int) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _placer(shared, threshold: float):
    """Every node's home cell and the cells that it visits."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            dims = batch.column(2).value_lengths().to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                centres, gaps = shared.value[int(dim)]
                near = unit_rows(_rows(part.column(2), int(dim))) @ centres.T
                home = near.argmax(axis=1)
                own = near[np.arange(len(near)), home]
                visit = own[:, None] - near <= math.sqrt(2 - 2 * threshold) * gaps[home] + 1e-9
                visit &= np.arange(len(centres)) < home[:, None]
                row, cell = np.nonzero(visit)
                row, cell = np.concatenate((np.arange(len(home)), row)), np.concatenate((home, cell))
                at = np.concatenate((np.zeros(len(home), np.int32), np.ones(len(row) - len(home), np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(at),
                     *(c.take(pa.array(row)) for c in part.columns)], names=["dim", "cell", "visitor", "node", "n", "vector"])
    return run


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest (row, column) of a bipartite link matrix, breadth first."""
    out = []
    todo = links.any(axis=1)
    free = links.any(axis=0)
    while todo.any():
        front = np.array([todo.argmax()])
        todo[front] = False
        while len(front):
            sub = links[front] & free
            cols = np.flatnonzero(sub.any(axis=0))
            out += zip(front[sub[:, cols].argmax(axis=0)].tolist(), cols.tolist())
            free[cols] = False
            sub = links[:, cols] & todo[:, None]
            front = np.flatnonzero(sub.any(axis=1))
            out += zip(front.tolist(), cols[sub[front].argmax(axis=1)].tolist() if len(front) else [])
            todo[front] = False
    return out


def _comparer(threshold: float):
    """Units arrive as runs of rows (unit, side, node, n, vector); side 0 stands on both sides."""
    def compare(side, node, n, x) -> tuple[list, list, list]:
        x = unit_rows(x)
        if side[0] == 0:
            i = j = np.arange(len(node))
        else:
            i, j = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        links = x[i] @ x[j].T >= threshold
        if side[0] == 0:
            np.fill_diagonal(links, False)
        a = links @ n[j]
        ids, counts = [node[i]], [a]
        if side[0] != 0:
            ids.append(node[j])
            counts.append(n[i] @ links)
        pairs = forest(links)
        left = np.array([p[0] for p in pairs], np.int64)
        right = np.array([p[1] for p in pairs], np.int64)
        return np.concatenate(ids), np.concatenate(counts), node[i][left], node[j][right]

    def run(batches) -> Iterator:
        import pyarrow as pa

        def out(rows):
            side, node, n, vectors = rows
            ids, counts, a, b = compare(side, node, n, vectors)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((ids[some], a))), pa.array(np.concatenate((counts[some], np.zeros(len(a), np.int64)))),
                 pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(b, pa.int64())])], names=["a", "links", "b"])
        held: list[tuple] = []
        unit = None
        for batch in batches:
            units = batch.column(0).to_numpy()
            at = np.concatenate(([0], np.flatnonzero(np.diff(units)) + 1, [len(units)])) if len(units) else [0]
            for lo, hi in zip(at, at[1:]):
                if unit is not None and units[lo] != unit:
                    yield from out([np.concatenate(c) for c in zip(*held)])
                    held = []
                unit = units[lo]
                part = batch.slice(lo, hi - lo)
                dim = len(part.column(4)[0])
                held.append((part.column(1).to_numpy(), part.column(2).to_numpy(), part.column(3).to_numpy(), _rows(part.column(4), dim)))
        if held:
            yield from out([np.concatenate(c) for c in zip(*held)])
    return run


def _units(placed: DataFrame, block: int) -> DataFrame:
    """Rows dealt to units (pairs of blocks): (unit, side, node, n, vector)."""
    cell = ["dim", "cell"]
    # One row per cell: at most `cells` rows per vector length.
    blocks = (placed.groupBy(*cell).agg(F.sum(1 - F.col("visitor")).alias("members"), F.sum("visitor").alias("visitors"))
              .select(*cell, F.ceil(F.col("members") / block).alias("nm"), F.ceil(F.col("visitors") / block).alias("nv")))
    x = placed.join(F.broadcast(blocks), cell)
    own = F.expr("CAST(pmod(xxhash64(node), IF(visitor = 1, nv, nm)) AS INT)")
    x = x.withColumn("own", own)
    # Members meet the members of their own and of every other block, then all blocks of visitors.
    pair = lambda kind, i, j, side: f"struct('{kind}' AS kind, CAST({i} AS INT) AS i, CAST({j} AS INT) AS j, {side} AS side)"
    of_members = (f"transform(sequence(0, CAST(nm AS INT) - 1), k -> IF(k = own, {pair('m', 'k', 'k', 0)}, "
                  f"IF(k > own, {pair('m', 'own', 'k', 1)}, {pair('m', 'k', 'own', 2)})))")
    to_visitors = f"IF(nv = 0, array(), transform(sequence(0, CAST(nv AS INT) - 1), k -> {pair('v', 'own', 'k', 1)}))"
    of_visitors = f"IF(nm = 0, array(), transform(sequence(0, CAST(nm AS INT) - 1), k -> {pair('v', 'k', 'own', 2)}))"
    x = x.withColumn("u", F.explode(F.expr(f"IF(visitor = 1, {of_visitors}, concat({of_members}, {to_visitors}))")))
    return x.select(F.xxhash64("dim", "cell", "u.kind", "u.i", "u.j").alias("unit"), F.col("u.side").alias("side"), "node", "n", "vector")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding",
                    per_cell: int = 2048, cells: int = 1024, sample: int = 16384, block: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vector"))
    finite = F.expr("forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(vector, x -> x <> 0)")
    good = F.coalesce(F.col("id").isNotNull() & finite, F.lit(False))
    nodes = cut(rows.filter(good).groupBy("vector").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
                .withColumn("node", F.monotonically_increasing_id()))
    if nodes.isEmpty():
        linked = spark.createDataFrame([], "node long, n_links long, component long")
    else:
        models = {}
        for r in nodes.groupBy(F.size("vector").alias("dim")).count().collect():  # one row per vector length
            k = max(1, min(cells, -(-r["count"] // per_cell)))
            picked = (nodes.filter(F.size("vector") == r["dim"]).orderBy(F.xxhash64("node")).limit(max(sample, k)).select("vector").collect())
            centres = spherical_kmeans(unit_rows(np.array([p.vector for p in picked], float)), k)
            gaps = np.sqrt(((centres[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)) if k <= 64 else \
                np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
            models[r["dim"]] = (centres, gaps)
        kind = dict(nodes.dtypes)["vector"]
        placed = (nodes.select("node", "n", "vector")
                  .transform(small_batches).mapInArrow(_placer(spark.sparkContext.broadcast(models), threshold),
                              f"dim int, cell int, visitor int, node long, n long, vector {kind}"))
        n_part = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        found = cut(_units(placed, block).repartition(n_part, "unit").sortWithinPartitions("unit", "side")
                    .transform(small_batches).mapInArrow(_comparer(threshold), "a long, links long, b long"))
        roots = connected_components(found.filter("b IS NOT NULL").select("a", "b"))
        linked = (nodes.select("node").join(found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links")), "node", "left")
                  .join(roots, "node", "left").select("node", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "node").alias("component")))
    linked = cut(linked)
    named = nodes.join(linked, "node")
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_vector = cut(named.join(lowest, "component").select("vector", (F.col("n_links") + F.col("n") - 1).alias("n_links"), "component_id"))
    compared = rows.filter(good).join(by_vector, "vector").select("id", "n_links", "component_id")
    alone = rows.filter(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return (compared.union(alone)
            .select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")))


#: DuckDB form of ``near_duplicates`` over ``embeddings`` (all pairs: for small tables).
SQL = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
n AS (SELECT r, vec_id, x, sqrt(list_inner_product(x, x)) AS norm FROM v
      WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
g AS (SELECT r, vec_id, list_transform(x, lambda c: c / norm) AS u FROM n WHERE norm > 0),
l AS (SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.r <> b.r AND len(a.u) = len(b.u) AND list_inner_product(a.u, b.u) >= {THRESHOLD}),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT reach.a, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.r) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.r
"""
