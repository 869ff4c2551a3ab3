"""SimHash near-duplicates: 64-bit fingerprints joined on a binary trie.

A text is lower-cased in A-Z, cut into words at ASCII white space and into
shingles of ``words`` words (fewer words: the whole sequence).  A bit of the
fingerprint is set if it is set in over half of the shingles' XXH64 hashes
(seed 42, repeats included); a text without words has fingerprint zero.

Fingerprints link at ``bits`` or fewer differing bits.  The self-join walks a
binary trie in pairs of nodes, adds up differing bits and leaves a pair as
soon as it exceeds the budget.  To spread the walk over a cluster, the
fingerprints stand in ``bits + 1`` tries, each with another block of bits
first: two fingerprints within the budget agree on one whole block, so they
meet below equal prefixes of one trie, and that subtree is one task's unit.
A subtree of over ``limit`` fingerprints is first replaced by the pairs of its
child subtrees that are within the budget (as often as needed).  Copies are
one fingerprint throughout and a unit emits a spanning forest of its links,
not all pairs.

Defined results for odd input: null and empty texts have fingerprint zero and
link like any other; a row without an id gets the component of equal
fingerprints that have ids (null if there are none) and links nothing itself;
repeated rows and ids are separate rows with one component each; empty input
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import cut, free_name, small_batches
from tenure.llm.components import connected_components

SEED = 42
WIDTH = 64
#: Bits by which a large subtree is cut into pairs of its children.
STEP = 6


# --- fingerprints ---------------------------------------------------------------------------

def fingerprint(text: bytes, words: int = 3) -> int:
    """Unsigned fingerprint of one text."""
    from xxhash import xxh64_intdigest
    w = text.lower().split()
    if not w:
        return 0
    if len(w) <= words:
        hashes = [xxh64_intdigest(b" ".join(w), SEED)]
    else:
        hashes = [xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(words)))]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(WIDTH, np.int64)
    for at in range(0, len(h), 1 << 16):  # a very long text is counted in pieces
        part = h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprinter(words: int):
    def run(batches) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            fps = [0 if t is None else fingerprint(t.encode(), words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), batch.column(2)],
                                             names=["id", "fp", "key"])
    return run


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id long, fp long: the fingerprint's 64 bits as a signed number, key long: a hash of the text) of every row."""
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), text_key(text_col).alias("key"))
    return rows.transform(small_batches).mapInArrow(_fingerprinter(words), "id long, fp long, key long")


def text_key(text_col: str) -> Column:
    """Tells the different texts of one id apart."""
    return F.xxhash64(F.col(text_col).cast("string"))


# --- the trie -------------------------------------------------------------------------------

def trie_pairs(v: np.ndarray, left: tuple[int, int], right: tuple[int, int], bit: int, budget: int,
               leaf: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of the sorted values ``v`` within ``budget`` differing bits, i in ``left``, j in ``right``.

    ``left`` and ``right`` are index ranges of two trie nodes whose bits above
    ``bit`` are alike within a node; equal ranges mean one node joined with
    itself.  ``budget`` is what the nodes' prefixes have left.
    """
    stack = [(left, right, bit, budget)]
    while stack:
        (a0, a1), (b0, b1), bit, left_over = stack.pop()
        na, nb = a1 - a0, b1 - b0
        if not na or not nb or ((a0, a1) == (b0, b1) and na < 2):
            continue
        if na * nb <= leaf or bit < 0:
            low = np.uint64((1 << (bit + 1)) - 1) if bit >= 0 else np.uint64(0)
            d = np.bitwise_count((v[a0:a1, None] ^ v[None, b0:b1]) & low)
            i, j = np.nonzero(d <= left_over)
            i, j = i + a0, j + b0
            if (a0, a1) == (b0, b1):
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            continue
        one = np.uint64(1 << bit)

        def split(lo, hi):
            return lo + int(np.searchsorted((v[lo:hi] & one) > 0, True))
        am = split(a0, a1)
        if (a0, a1) == (b0, b1):
            stack += [((a0, am), (a0, am), bit - 1, left_over), ((am, a1), (am, a1), bit - 1, left_over)]
            if left_over:
                stack.append(((a0, am), (am, a1), bit - 1, left_over - 1))
        else:
            bm = split(b0, b1)
            stack += [((a0, am), (b0, bm), bit - 1, left_over), ((am, a1), (bm, b1), bit - 1, left_over)]
            if left_over:
                stack += [((a0, am), (bm, b1), bit - 1, left_over - 1), ((am, a1), (b0, bm), bit - 1, left_over - 1)]


class Forest:
    """Union-find that tells whether a link joins two trees."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        above = self.above
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.above[max(x, y)] = min(x, y)
        return True


def _joiner(bits: int):
    """Links below the equal node pairs of rows sorted by (trie, depth, l, r, side)."""
    def unit(u: np.ndarray, depth: int, l: int, r: int, sides: np.ndarray) -> tuple[list, list]:  # noqa: E741
        bit, low = WIDTH - depth - 1, np.uint64((1 << (WIDTH - depth)) - 1) if depth else ~np.uint64(0)
        spent = (l ^ r).bit_count()
        seen, a, b = Forest(), [], []
        if l == r:
            v = np.sort(u)
            parts, lo, hi = v, (0, len(v)), (0, len(v))
        else:
            lv, rv = np.sort(u[sides == 1]), np.sort(u[sides == 2])
            parts, lo, hi = np.concatenate((lv, rv)), (0, len(lv)), (len(lv), len(lv) + len(rv))
        for i, j in trie_pairs(parts & low, lo, hi, bit, bits - spent):
            for x, y in zip(parts[i].tolist(), parts[j].tolist()):
                if seen.join(x, y):
                    a.append(x)
                    b.append(y)
        return a, b

    def run(batches) -> Iterator:
        import pyarrow as pa
        names = ["trie", "depth", "l", "r", "side", "v"]
        rest = None
        tries, firsts, seconds = [], [], []

        def close(cols, last: bool):
            """Work off the whole units of ``cols``; what may go on in the next batch is returned."""
            key = np.stack([cols[k] for k in range(4)])
            n = key.shape[1]
            edge = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            at = np.concatenate(([0], edge, [n]))
            sizes = np.diff(at)
            done = len(sizes) if last else len(sizes) - 1
            small = np.zeros(n, bool)
            for k in np.flatnonzero(sizes[:done] > 32):
                s = slice(at[k], at[k + 1])
                a, b = unit(cols[5][s].view(np.uint64), int(cols[1][at[k]]), int(cols[2][at[k]]), int(cols[3][at[k]]), cols[4][s])
                tries.extend([int(cols[0][at[k]])] * len(a))
                firsts.extend(a)
                seconds.extend(b)
            # Small units are leaves of the trie: rows of one unit at distance 1, 2, ... are compared at once.
            few = (sizes > 1) & (sizes <= 32)
            few[done:] = False
            small = np.repeat(few, sizes)
            unit_of = np.repeat(np.arange(len(sizes)), sizes)
            i = np.flatnonzero(small)
            v, side = cols[5].view(np.uint64), cols[4]
            for d in range(1, 32):
                i = i[(i + d < n)]
                i = i[unit_of[i] == unit_of[i + d]]
                if not len(i):
                    break
                ok = (np.bitwise_count(v[i] ^ v[i + d]) <= bits) & ((side[i] == 0) | (side[i] != side[i + d]))
                hit = i[ok]
                tries.extend(cols[0][hit].tolist())
                firsts.extend(v[hit].tolist())
                seconds.extend(v[hit + d].tolist())
            return [c[at[done]:] for c in cols] if not last else None

        def out():
            t, a, b = np.array(tries, np.uint64), np.array(firsts, np.uint64), np.array(seconds, np.uint64)
            for k in (tries, firsts, seconds):
                k.clear()
            return pa.RecordBatch.from_arrays([pa.array(unrotate(x, t, bits).view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(n).to_numpy() for n in names]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            if len(cols[0]):
                rest = close(cols, False)
            if firsts:
                yield out()
        if rest is not None and len(rest[0]):
            close(rest, True)
            if firsts:
                yield out()
    return run


def block_starts(bits: int) -> list[int]:
    """First bit of each of the ``bits + 1`` blocks, counted from the highest bit, and the width."""
    return [WIDTH * k // (bits + 1) for k in range(bits + 2)]


def unrotate(v: np.ndarray, trie: np.ndarray, bits: int) -> np.ndarray:
    """Undo the rotation that put block ``trie`` first."""
    s = np.array(block_starts(bits)[:-1], np.uint64)[trie.astype(np.int64)] if len(v) else np.zeros(0, np.uint64)
    return (v >> s) | (v << ((np.uint64(WIDTH) - s) % np.uint64(WIDTH))) if len(v) else v


def _nodes(fps: DataFrame, bits: int) -> DataFrame:
    """Every fingerprint in every trie, at the node of its first block."""
    starts = block_starts(bits)
    rows = []
    for k in range(bits + 1):
        s, width = starts[k], starts[k + 1] - starts[k]
        v = F.col("fp") if s == 0 else F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", WIDTH - s))
        prefix = F.shiftrightunsigned(v, WIDTH - width) if width < WIDTH else v
        rows.append(F.struct(F.lit(k).alias("trie"), F.lit(width).alias("depth"), prefix.alias("l"),
                             prefix.alias("r"), F.lit(0).alias("side"), v.alias("v")))
    return fps.select(F.explode(F.array(*rows)).alias("n")).select("n.*")


def _children(rows: DataFrame, bits: int) -> DataFrame:
    """Rows of node pairs replaced by rows of the pairs of their children within the budget."""
    step = F.least(F.lit(STEP), WIDTH - F.col("depth"))
    own = F.expr("shiftrightunsigned(v, CAST(64 - depth - step AS INT)) & (shiftleft(1L, step) - 1)")
    spent = F.bit_count(F.col("l").bitwiseXOR(F.col("r")))
    others = F.expr(f"filter(sequence(0L, shiftleft(1L, step) - 1), c -> bit_count(c ^ own) <= {bits} - spent)")
    x = (rows.withColumn("step", step).withColumn("own", own).withColumn("spent", spent)
         .withColumn("other", F.explode(others)))
    up = lambda c, low: F.expr(f"shiftleft({c}, step) | {low}")
    first = (F.col("side") == 1) | ((F.col("side") == 0) & (F.col("own") <= F.col("other")))
    return x.select("trie", (F.col("depth") + F.col("step")).cast("int").alias("depth"),
                    F.when(first, up("l", "own")).otherwise(up("l", "other")).alias("l"),
                    F.when(first, up("r", "other")).otherwise(up("r", "own")).alias("r"),
                    F.when((F.col("side") == 0) & (F.col("own") == F.col("other")), F.lit(0))
                    .when(first, F.lit(1)).otherwise(F.lit(2)).alias("side"), "v")


def trie_links(fps: DataFrame, bits: int = 2, limit: int = 100_000) -> DataFrame:
    """(a, b): links that connect all distinct ``fp`` within ``bits`` differing bits (a spanning forest of each unit)."""
    key = ["trie", "depth", "l", "r"]
    open_rows, ready = _nodes(fps, bits), None
    while True:
        large = cut(open_rows.groupBy(*key).count().filter((F.col("count") > limit) & (F.col("depth") < WIDTH)).select(*key))
        if large.isEmpty():
            ready = open_rows if ready is None else ready.union(open_rows)
            break
        small = open_rows.join(large, key, "left_anti")
        ready = small if ready is None else ready.union(small)
        open_rows = cut(_children(open_rows.join(large, key, "left_semi"), bits))
    n = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return (ready.repartition(n, *key).sortWithinPartitions(*key, "side", "v")
            .transform(small_batches).mapInArrow(_joiner(bits), "a long, b long"))


def classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 2,
            limit: int = 100_000) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id: smallest id reachable by links) of every row."""
    return (_classes(documents, id_col, text_col, words, bits, limit)
            .select(F.col("id").alias(id_col), hex16(F.col("fp")).alias("fingerprint"), "component_id"))


def _classes(documents: DataFrame, id_col: str, text_col: str, words: int, bits: int, limit: int = 100_000) -> DataFrame:
    """(fp, id, key, root: the smallest fingerprint of the component, component_id) of every row."""
    rows = cut(fingerprints(documents, id_col, text_col, words))
    reps = cut(rows.filter("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep")))
    roots = connected_components(trie_links(reps.select("fp"), bits, limit))
    joined = cut(reps.join(roots, F.col("fp") == F.col("node"), "left")
                 .select("fp", "rep", F.coalesce("component", "fp").alias("root")))
    lowest = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_fp = cut(joined.join(lowest, "root").select("fp", "root", "component_id"))
    return rows.join(of_fp, "fp", "left")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(documents: DataFrame, words: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of every component: a row of its smallest id, of that id's texts in the
    component the one with the smallest (fingerprint, text hash); rows without id stay.

    What goes is decided by id and text: of an id with different texts each text
    stays or goes with its own component.  Rows alike in id and text are one."""
    rows = _classes(documents, id_col, text_col, words, bits).filter("id = component_id")
    kept = rows.groupBy("root").agg(F.min(F.struct("id", "fp", "key")).alias("one")).select("one.id", "one.key").distinct()
    own_id, own_key = free_name(documents, "_id"), free_name(documents, "_key")
    keyed = documents.withColumns({own_id: F.col(id_col).cast("long"), own_key: text_key(text_col)})
    # The join and the removal of repeated rows share one exchange by id and text.
    match = (F.col(own_id) == F.col("kept.id")) & (F.col(own_key) == F.col("kept.key"))
    one = keyed.join(cut(kept).alias("kept"), match, "left_semi").dropDuplicates([own_id, own_key])
    return one.select(*documents.columns).unionByName(documents.filter(F.col(id_col).isNull()))
