"""Histogram trees grown level by level, all models of a search together.

Training rows are blocks of small integers: the bin of every feature, the label,
the fold.  A *chain* is one tree being grown for one model and one left-out fold.
For every level one Spark job adds up, for each open node, feature and bin, the
weight and the weighted target of the rows in it; the sums of all blocks are
added on the executors, the best cut of each node is picked there, and only the
cuts come back.  So the driver holds the trees, never rows, and a level costs one
pass whatever the number of models.

Nodes are numbered as in a heap: 1 is the root, 2i and 2i + 1 are the children of
i.  A row goes to the left child if its bin is at most the node's cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.session import checkpoint_dir

MAX_BINS = 32
BLOCK_ROWS = 16_384
#: Tasks per core at most: each task returns sums of all open nodes, whatever its number of rows.
TASKS_PER_CORE = 2
#: Open nodes whose sums are added up in one job: 1.5 KB each for three features.
NODES_PER_JOB = 40_000
CHAINS_PER_KEY = 16
#: Up to so many training rows every task has them all, and a few chains.
ROWS_AT_ONCE = 200_000
CHAINS_PER_TASK = 4

Blocks = "RDD | list"  # of (bins, label, fold, id[, margins])


# --- training rows -------------------------------------------------------------

def bin_edges(df: DataFrame, features: list[str], bins: int = MAX_BINS) -> tuple[list[np.ndarray], int]:
    """Increasing upper edges of each feature's bins but the last (quantiles), and the number of rows, from one aggregation."""
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(F.col(c).cast("double"), probs, 10_000).alias(f"e{i}") for i, c in enumerate(features)],
                 *[F.max(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(features)]).first()
    out = []
    for i in range(len(features)):
        e = np.unique(np.array(row[f"e{i}"] or [], float))
        out.append(e[e < row[f"m{i}"]] if row[f"m{i}"] is not None else e)  # nothing lies above the largest value
    return out, row.n


def blocks(df: DataFrame, features: list[str], label: str, edges: list[np.ndarray], rows: int, fold: str | None = None,
           id_col: str | None = None) -> RDD:
    """Blocks (bins, label, fold, id) of NumPy arrays, kept in the checkpoint folder, a task per ``BLOCK_ROWS`` rows or more.

    The id only seeds a row's sampling: ``id_col``, else a hash of the row."""
    key = F.col(id_col).cast("long") if id_col else F.xxhash64(*df.columns)
    x = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(label).cast("int").alias("y"),
                  (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"), key.alias("id"))

    # every level is a job: tasks of a few rows would cost more than their work, and more tasks shuffle more sums
    parts = max(1, min(-(-rows // BLOCK_ROWS), TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism))
    x = x.coalesce(parts) if x.rdd.getNumPartitions() >= parts else x.repartition(parts)

    def pack(batches) -> Iterable:
        import pyarrow as pa
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                bins = np.empty((part.num_rows, len(edges)), np.uint8)
                for i, e in enumerate(edges):
                    bins[:, i] = np.searchsorted(e, part.column(i).to_numpy(zero_copy_only=False), side="left")
                y, f, ids = (part.column(len(edges) + j).to_numpy(zero_copy_only=False) for j in range(3))
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in
                                                  (bins, y.astype(np.int8), f.astype(np.int8), ids.astype(np.int64))], names=["b", "y", "f", "i"])

    def unpack(r):
        y = np.frombuffer(r.y, np.int8)
        return np.frombuffer(r.b, np.uint8).reshape(len(y), -1), y, np.frombuffer(r.f, np.int8), np.frombuffer(r.i, np.int64)
    return kept(x.mapInArrow(pack, "b binary, y binary, f binary, i binary").rdd.map(unpack), df)


def kept(rdd: RDD, df: DataFrame) -> RDD:
    """``rdd`` written to the shared checkpoint folder, and read from there if an executor is lost."""
    checkpoint_dir(df.sparkSession)
    rdd = rdd.persist()
    rdd.checkpoint()
    rdd.count()
    return rdd


# --- trees ------------------------------------------------------------------------

class Trees:
    """One tree per chain, as arrays over heap numbers."""

    def __init__(self, chains: int, depth: int):
        self.depth = depth
        self.feature = np.full((chains, 1 << depth), -1, np.int8)
        self.cut = np.zeros((chains, 1 << depth), np.uint8)
        self.value = np.zeros((chains, 2 << depth))
        self.gain = np.zeros((chains, 1 << depth))
        self.count = np.zeros((chains, 2 << depth))

    def splits(self, levels: int) -> tuple[np.ndarray, np.ndarray]:
        """Features and cuts of the nodes above level ``levels``; a leaf sends all rows to its left child."""
        feature, cut = self.feature[:, :1 << levels], self.cut[:, :1 << levels]
        return np.maximum(feature, 0), np.where(feature >= 0, cut, 255).astype(np.uint8)

    def scores(self, bins: np.ndarray, levels: int | None = None, chains: Iterable[int] | None = None) -> Iterable[np.ndarray]:
        """For every chain the value of each row's node after ``levels`` levels, or of the leaf before."""
        levels = self.depth if levels is None else levels
        feature, cut = self.splits(levels)
        flat, base = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        value = self.value[:, :2 << levels].copy()
        for level in range(levels):  # what a leaf's rows reach has the leaf's value
            i = np.arange(1 << level, 2 << level)
            leaf = self.feature[:, i] < 0
            for child in (2 * i, 2 * i + 1):
                value[:, child] = np.where(leaf, value[:, i], value[:, child])
        for c in range(len(feature)) if chains is None else chains:
            yield value[c].take(walk(feature[c].astype(np.int64), cut[c], flat, base, levels))

    def padded(self, depth: int) -> "Trees":
        """The same trees in arrays for ``depth`` levels."""
        out = Trees(len(self.feature), depth)
        for name in ("feature", "cut", "value", "gain", "count"):
            own = getattr(self, name)
            getattr(out, name)[:, :own.shape[1]] = own
        return out


def walk(feature: np.ndarray, cut: np.ndarray, flat: np.ndarray, base: np.ndarray, levels: int) -> np.ndarray:
    """Heap number that every row has reached in a tree after ``levels`` levels; ``base`` is where its bins begin in ``flat``."""
    node = np.ones(len(base), np.int64)
    for _ in range(levels):
        at = feature.take(node)
        at += base
        right = flat.take(at) > cut.take(node)
        node += node
        node += right
    return node


def pick_features(seed: int, trees: np.ndarray, nodes: np.ndarray, n: int, k: int) -> np.ndarray:
    """``k`` of ``n`` features for every (tree, node), by hash, in ascending order."""
    if k >= n:
        return np.tile(np.arange(n), (len(nodes), 1))
    h = scatter(scatter(trees.astype(np.uint64) * np.uint64(4099) + nodes.astype(np.uint64), seed)[:, None] + np.arange(n, dtype=np.uint64), seed)
    return np.sort(np.argsort(h, 1, kind="stable")[:, :k], 1)


def scatter(x: np.ndarray, seed: int) -> np.ndarray:
    """Well mixed 64-bit hashes of integers (the SplitMix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def best_cuts(sums: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """For every node (feature, cut, gain, weight, target, left weight, left target); feature -1: it stays a leaf.

    ``sums`` is (node, picked feature, bin, 2).  The gain is the decrease of the
    target's variance per unit of weight, for 0/1 targets half that of Gini's impurity."""
    left = np.cumsum(sums.astype(float), 2)
    total = left[:, :1, -1:, :]
    n, s = left[..., 0], left[..., 1]
    rn, rs = total[..., 0] - n, total[..., 1] - s
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where((n > 0) & (rn > 0), s * s / n + rs * rs / rn - total[..., 1] ** 2 / total[..., 0], -1.0)
    flat = score.reshape(len(score), -1)
    at = flat.argmax(1)
    rows, (j, cut) = np.arange(len(flat)), np.unravel_index(at, score.shape[1:])
    weight, target = total[:, 0, 0, 0], total[:, 0, 0, 1]
    gain = flat[rows, at] / np.maximum(weight, 1e-300)
    feature = np.where(gain > 1e-12, picked[rows, j], -1)
    return np.stack([feature, cut, gain, weight, target, n[rows, j, cut], s[rows, j, cut]], 1)


def grow(data: Blocks, trees: Trees, depths: np.ndarray, numbers: np.ndarray, features: int, k: int, seed: int,
         targets: Callable, dtype=float) -> None:
    """Grow ``trees`` in place.

    ``targets(block, chains)`` gives weights and targets (chain, row) of a
    block's rows for a slice of chains, with weight 0 for rows left out;
    ``numbers`` are the trees' numbers, ``depths`` their largest depths."""
    open_nodes = np.stack([np.arange(len(depths)), np.ones(len(depths), int)], 1)  # (chain, node), sorted
    for level in range(trees.depth):
        open_nodes = open_nodes[depths[open_nodes[:, 0]] > level]
        if not len(open_nodes):
            return
        found = [cuts for part in _parts(open_nodes) for cuts in _level(data, trees, part, level, numbers, features, k, seed, targets, dtype)]
        open_nodes = _take(trees, np.concatenate([p for p, _ in found]), np.concatenate([c for _, c in found]))


def _parts(open_nodes: np.ndarray) -> list[np.ndarray]:
    """Open nodes for one job each, whole keys of chains together."""
    key = open_nodes[:, 0] // CHAINS_PER_KEY
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    parts, begin = [], 0
    for a, b in zip(starts, [*starts[1:], len(key)]):
        if b - begin > NODES_PER_JOB and a > begin:
            parts.append(open_nodes[begin:a])
            begin = a
    return [*parts, open_nodes[begin:]]


#: Integer sums of weights and targets are added up in one double, this far apart, for so many blocks.
APART, BLOCKS_IN_ONE = 2.0 ** 26, 64


def _level(data: Blocks, trees: Trees, part: np.ndarray, level: int, numbers: np.ndarray, features: int, k: int, seed: int, targets: Callable,
           dtype) -> list[tuple[np.ndarray, np.ndarray]]:
    keys = part[:, 0] // CHAINS_PER_KEY
    of_key = {int(q): part[keys == q] for q in np.unique(keys)}
    feature, cuts = trees.splits(level)
    numbers = {q: numbers[nodes[:, 0]] for q, nodes in of_key.items()}
    low, high = int(part[0, 0]), int(part[-1, 0]) + 1
    feature, cuts, whole = feature[low:high], cuts[low:high], np.issubdtype(dtype, np.integer)

    def picked_of(q):
        return pick_features(seed, numbers[q], of_key[q][:, 1], features, k)

    def add_up(own):
        plan, sums, held = {}, {}, {}
        for q, nodes in of_key.items():
            # a key's nodes are sorted by chain: a range of them for each
            plan[q] = picked_of(q), [(int(c), *np.searchsorted(nodes[:, 0], [c, c + 1])) for c in np.unique(nodes[:, 0])]
            held[q] = np.zeros((1 if whole else 2, k, len(nodes), MAX_BINS))

        def decode():
            for q, one in held.items():
                target = np.floor(one[0] / APART)
                both = np.stack([one[0] - target * APART, target]).astype(np.int64)
                sums[q] = sums[q] + both if q in sums else both
                one[:] = 0
        for number, block in enumerate(own, 1):
            flat, width = block[0].ravel(), block[0].shape[1]
            for q, (picked, ranges) in plan.items():
                first = q * CHAINS_PER_KEY
                weight, target = targets(block, slice(first, first + CHAINS_PER_KEY))
                for c, a, b in ranges:
                    r = np.flatnonzero(weight[c - first])
                    base = r * width
                    slot = np.full(2 << level, -1, np.int64)
                    slot[of_key[q][a:b, 1]] = np.arange(b - a)
                    at = slot.take(walk(feature[c - low].astype(np.int64), cuts[c - low], flat, base, level))
                    if b - a < 1 << level and (closed := at < 0).any():
                        r, base, at = (x[~closed] for x in (r, base, at))
                    w, t = weight[c - first].take(r).astype(float), target[c - first].take(r)
                    into, size, plain = held[q][:, :, a:b], (b - a) * MAX_BINS, not whole and bool((w == 1).all())
                    t = w * t
                    if whole:
                        w = w + APART * t
                    cell0 = at * MAX_BINS
                    for j in range(k):
                        cell = flat.take(base + (j if k == features else picked[a:b, j].take(at))) + cell0
                        into[0, j] += np.bincount(cell, None if plain else w, size).reshape(-1, MAX_BINS)
                        if not whole:
                            into[1, j] += np.bincount(cell, t, size).reshape(-1, MAX_BINS)
            if whole and number % BLOCKS_IN_ONE == 0:
                decode()
        if whole:
            decode()
        return [(q, _narrow(x)) for q, x in (sums if whole else held).items()]

    def cut(pair):
        q, sums = pair
        return of_key[q], best_cuts(sums.transpose(2, 1, 3, 0), picked_of(q))
    if isinstance(data, list):
        return [cut(pair) for pair in add_up(data)]
    parts = min(len(of_key), data.getNumPartitions())
    return data.mapPartitions(add_up).reduceByKey(_added, parts).map(cut).collect()


def _narrow(x: np.ndarray) -> np.ndarray:
    """Integers of 0 or more in the smallest type that holds them; others as they are."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))) if x.dtype.kind in "iu" else x


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b if a.dtype.kind == "f" else _narrow(np.add(a, b, dtype=np.int64))


def _take(trees: Trees, nodes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Enter the cuts of ``nodes`` into the trees; returns the children that can be cut again."""
    c, i = nodes[:, 0], nodes[:, 1]
    feature, cut, gain, n, s, ln, ls = cuts.T
    trees.count[c, i], trees.value[c, i] = n, np.divide(s, n, out=np.zeros_like(s), where=n > 0)
    split = feature >= 0
    c, i, feature, cut, gain, n, s, ln, ls = (x[split] for x in (c, i, feature, cut, gain, n, s, ln, ls))
    trees.feature[c, i], trees.cut[c, i], trees.gain[c, i] = feature, cut, gain
    children = []
    for child, cn, cs in ((2 * i, ln, ls), (2 * i + 1, n - ln, s - ls)):
        trees.count[c, child], trees.value[c, child] = cn, cs / cn
        children.append(np.stack([c, child], 1)[cn > 1])
    both = np.concatenate(children)
    return both[np.lexsort((both[:, 1], both[:, 0]))]


# --- ensembles ----------------------------------------------------------------------

_POISSON = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040], float))
# The weight that the first 12 bits decide, 255 where they don't.
_POISSON_OF = np.searchsorted(_POISSON, np.arange(4096) / 4096).astype(np.uint8)
_POISSON_OF[(_POISSON * 4096).astype(int)] = 255
_POISSON_OF[0] = 0


def poisson(u: np.ndarray) -> np.ndarray:
    """Poisson(1) numbers of uniform 64-bit hashes."""
    w = _POISSON_OF.take((u >> np.uint64(52)).astype(np.int64))
    open_ = w == 255
    w[open_] = np.searchsorted(_POISSON, (u[open_] >> np.uint64(11)) * 2.0 ** -53)
    return w


def forest(data: RDD, rows: int, trees: int, depth: int, folds: list[int], features: int, seed: int) -> tuple[Trees, np.ndarray]:
    """(trees, folds of the chains): ``trees`` trees for every left-out fold (-1: none left out), a tree's folds side by side.

    A tree has bootstrap weights drawn from Poisson(1) by (row, tree) and sees
    the rounded-up square root of the features' number at each node.  A row's
    weight and a node's features don't depend on the number or depth of the trees, so
    the first 100 of 200 are a forest of 100, and trees of depth 10 cut off at
    depth 5 are trees of depth 5."""
    fold = np.tile(np.array(folds), trees)
    number = np.repeat(np.arange(trees), len(folds))
    k = int(np.ceil(np.sqrt(features)))

    def some(own: Blocks, at: slice) -> Trees:
        left_out, numbers = fold[at], number[at]

        def targets(block, chains):
            _, y, f, ids = block
            drawn, of = np.unique(numbers[chains], return_inverse=True)  # the folds of a tree share its weights
            w = poisson(scatter(scatter(ids.view(np.uint64), seed)[None, :] + drawn.astype(np.uint64)[:, None], seed + 1))[of]
            w[f[None, :] == left_out[chains][:, None]] = 0
            return w, np.broadcast_to(y[None, :], w.shape)
        grown = Trees(len(left_out), depth)
        grow(own, grown, np.full(len(left_out), depth), numbers, features, k, seed, targets, np.int32)
        return grown
    if rows > ROWS_AT_ONCE:
        return some(data, slice(None)), fold
    return joined(dealt(data, some, len(fold)).collect()), fold


def dealt(data: RDD, work: Callable, chains: int, per_task: int = CHAINS_PER_TASK) -> RDD:
    """``work(blocks, slice of chains)`` in tasks of their own, all rows being sent to each executor once."""
    spark = data.context
    rows = spark.broadcast(data.collect())  # at most ROWS_AT_ONCE rows of a few bytes
    starts = range(0, chains, per_task)
    return spark.parallelize(starts, len(starts)).map(lambda at: work(rows.value, slice(at, min(chains, at + per_task))))


def joined(parts: list[Trees]) -> Trees:
    """The chains of several parts as one, in order."""
    out = Trees(0, parts[0].depth)
    for name in ("feature", "cut", "value", "gain", "count"):
        setattr(out, name, np.concatenate([getattr(p, name) for p in parts]))
    return out


def residuals(y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """Negative gradient of the logistic loss 2 log(1 + exp(-2ym)), y being -1 or 1."""
    return 4 * y / (1 + np.exp(np.clip(2 * y * margin, -700, 700)))


#: Boosting rounds after which the margins are written to the checkpoint folder; between them they are kept by the executors.
ROUNDS_KEPT = 5


def boost(data: Blocks, keep: Callable, rounds: int, depths: np.ndarray, rates: np.ndarray, folds: np.ndarray, features: int, seed: int,
          at: Iterable[int] = ()) -> tuple[list[Trees], dict]:
    """(trees of every round, blocks as they were after the rounds of ``at``), a tree per chain and round.

    The first tree is fitted to the labels -1 and 1, the others to the loss's
    negative gradient and scaled by the chain's rate; a leaf's value is the mean.
    Margins (chain, row) of all rows, those left out too, travel at the end of the
    blocks.  Distributed blocks are kept by the executors after every round and
    written by ``keep`` every ``ROUNDS_KEPT`` rounds, from where a lost one is made again."""
    at, local = {rounds, *at}, isinstance(data, list)

    def each(blocks: Blocks, f: Callable) -> Blocks:
        return [f(b) for b in blocks] if local else blocks.map(f)
    state, before, out, snapshots = each(data, lambda b: (*b, np.zeros((len(depths), len(b[1]))))), None, [], {}
    for done in range(1, rounds + 1):
        grown = Trees(len(depths), int(depths.max()))

        def targets(block, chains, first=done == 1):
            y, margin = block[1] * 2.0 - 1, block[4][chains]
            r = np.broadcast_to(y, margin.shape) if first else residuals(y, margin)
            return block[2][None, :] != folds[chains][:, None], r
        grow(state, grown, depths, np.zeros(len(depths), int), features, features, seed, targets)
        grown.value *= (1.0 if done == 1 else rates[:, None])
        out.append(grown)
        if before is not None and not any(before is x for x in snapshots.values()):
            before.unpersist()  # the round's jobs have read what was made of it
        before = None if local else state
        state = each(state, lambda b, last=slim(grown): (*b[:4], b[4] + np.stack(list(last.scores(b[0])))))
        if local or done % ROUNDS_KEPT == 0 or done in at:
            state = keep(state)
        else:
            state.persist(StorageLevel.MEMORY_AND_DISK)
        if done in at:
            snapshots[done] = state
    if before is not None and not any(before is x for x in snapshots.values()):
        before.unpersist()
    return out, snapshots


def slim(t: Trees) -> Trees:
    """What is needed to apply a tree."""
    s = Trees(0, t.depth)
    s.feature, s.cut, s.value, s.gain, s.count = t.feature, t.cut, t.value, None, None
    return s
