"""Ranked lexical search: dual-tree search with coordinate-maximum bounds.

An item's vector holds, for each of its terms, the term's weight times its
repeats; a document's holds the saturated term frequency scaled by the document's
length.  All values are integers of 0 or more, and a score is their dot product.

Both sides are hierarchies.  The items' is built once; every task builds one over
``GROUP`` documents at a time.  A node keeps, for every term, the largest value
below it, so the dot product of two nodes' maxima is at least the score of every
pair below them.  Node pairs are visited together from the roots, and a pair goes
with everything below it as soon as its bound is less than the smallest k-th best
score of the item node's items.  Pairs of leaves that remain are scored exactly.
A bound that equals the k-th score is followed up, for a smaller id wins a tie.

Documents never move: one pass counts documents, terms and the documents that
hold each item term; a second one searches.  Every task returns at most k rows an
item, which are ranked in two steps.  Items are taken in blocks of ``ITEM_CHARS``
characters, a pair of passes each: what a task holds is bounded by a block, however
many items there are.

Defined results for odd input: a null or empty text has no terms; such an item has
no rows, such a document none either and doesn't count; every row of either table
counts by itself, repeated ids included; of equal scores the smaller document id
comes first, a missing id last; a long text is read in segments; extra columns are
ignored; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.llm.common import cut, small_batches
from tenure.llm.licenses import TABLE
from tenure.llm.terms import segments

K = 20
#: Characters of item texts searched for in one pair of passes.
ITEM_CHARS = 16 << 20
#: Documents of one hierarchy, and rows of a leaf on both sides.
GROUP, DOC_LEAF, ITEM_LEAF = 2048, 16, 8
#: Terms are hashed to so many signed sums to tell which vectors are alike; this shapes the trees, not the results.
SKETCH = 512


def term_stats(documents: DataFrame, terms: set[bytes], text_col: str = "text") -> tuple[int, int, dict[bytes, int]]:
    """(documents with a term, all their terms, documents that hold each of ``terms``), over the whole table."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        n, total, held = 0, 0, Counter()
        for b in batches:
            for text in b.column(0).cast(pa.binary()).to_pylist():
                found, size = set(), 0
                for part in segments(text, TABLE):
                    size += len(part)
                    found |= terms.intersection(part)
                n, total = n + (size > 0), total + size
                held.update(found)
        yield pa.RecordBatch.from_arrays([pa.array([None, *held], pa.binary()), pa.array([n, *held.values()], pa.int64()),
                                          pa.array([total] + [0] * len(held), pa.int64())], names=["term", "n", "total"])
    rows = documents.select(F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL").transform(small_batches)
    counted = (rows.mapInArrow(run, "term binary, n long, total long").groupBy("term")
               .agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect())  # a row per term of the items
    n, total = next(((r.n, r.total) for r in counted if r.term is None), (0, 0))
    return n, total, {bytes(r.term): r.n for r in counted if r.term is not None}


# --- hierarchies ---------------------------------------------------------------

class Node:
    """A node over the rows ``lo`` to ``hi`` of an ordered table of sparse vectors, with its coordinate maxima."""

    __slots__ = ("lo", "hi", "children", "terms", "top")

    def __init__(self, lo: int, hi: int, children: list["Node"], terms: np.ndarray, top: np.ndarray):
        self.lo, self.hi, self.children, self.terms, self.top = lo, hi, children, terms, top


def _maxima(terms: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each term once, with its largest value."""
    if not len(terms):
        return terms, values
    order = np.argsort(terms, kind="stable")
    terms, values = terms[order], values[order]
    first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
    return terms[first], np.maximum.reduceat(values, first)


def _order(sketch: np.ndarray, leaf: int) -> tuple[np.ndarray, list]:
    """An order of the rows and nested (lo, hi, halves) ranges of it: alike rows stand together.

    A range is halved at the median of how much nearer its rows are to one of
    two unlike rows than to the other, then twice so with the halves' means."""
    rows = np.arange(len(sketch))
    unit = sketch / np.maximum(np.sqrt((sketch * sketch).sum(1, keepdims=True)), 1e-9)

    def halve(lo: int, hi: int):
        if hi - lo <= leaf:
            return (lo, hi, [])
        own = unit[rows[lo:hi]]
        a = own[np.argmin(own @ own[0])]
        b = own[np.argmin(own @ a)]
        mid = (hi - lo) // 2
        for _ in range(3):
            order = np.argpartition(own @ (b - a), mid)
            a, b = own[order[:mid]].mean(0), own[order[mid:]].mean(0)
        rows[lo:hi] = rows[lo:hi][order]
        return (lo, hi, [halve(lo, lo + mid), halve(lo + mid, hi)])
    return rows, halve(0, len(sketch))


def hierarchy(vectors: list[tuple[np.ndarray, np.ndarray]], leaf: int, dtype) -> tuple[np.ndarray, Node]:
    """(order of the rows, root node) of sparse vectors (terms, values)."""
    sketch = np.zeros((len(vectors), SKETCH))
    for row, (terms, values) in zip(sketch, vectors):
        spread = terms * 0x9E3779B1 & 0xFFFFFFFF
        np.add.at(row, (spread >> 7) % SKETCH, np.where(spread >> 31, -1.0, 1.0) * values)
    rows, ranges = _order(sketch, leaf)

    def node(lo, hi, halves) -> Node:
        children = [node(*h) for h in halves]
        parts = [(c.terms, c.top) for c in children] or [vectors[r] for r in rows[lo:hi]]
        terms, top = _maxima(np.concatenate([t for t, _ in parts]), np.concatenate([v for _, v in parts]))
        return Node(lo, hi, children, terms, top.astype(dtype))
    return rows, node(*ranges)


class Items:
    """A block of items: their terms' weights, and the hierarchy over their vectors."""

    def __init__(self, texts: list[Counter], n: int, total: int, held: dict[bytes, int]):
        self.n, self.total = n, total
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, df in held.items()}
        self.vocabulary = {t: i for i, t in enumerate(sorted(t for t, w in weights.items() if w > 0))}
        vectors = []
        for c in texts:
            own = sorted((self.vocabulary[t], weights[t] * times) for t, times in c.items() if t in self.vocabulary)
            vectors.append((np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], np.int64)))
        largest = max((int(v.sum()) for _, v in vectors), default=0)
        # a document's values are below 10**6; doubles add integers below 2**53 exactly
        self.dtype = np.float64 if largest * 10 ** 6 < 2 ** 53 else np.int64
        self.rows, self.root = hierarchy(vectors, ITEM_LEAF, self.dtype)
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # per leaf: its terms and (term, item) values
        self._fill(self.root, vectors)

    def _fill(self, node: Node, vectors) -> None:
        for c in node.children:
            self._fill(c, vectors)
        if not node.children:
            block = np.zeros((len(node.terms), node.hi - node.lo), self.dtype)
            for j, r in enumerate(self.rows[node.lo:node.hi]):
                terms, values = vectors[r]
                block[np.searchsorted(node.terms, terms), j] = values
            self.blocks[node.lo] = node.terms, block

    def vector(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """The (terms, values) of a whole document text."""
        size, found, get = 0, [], self.vocabulary.get
        for part in segments(text, TABLE):
            size += len(part)
            ids, times = np.unique(np.array([i for i in map(get, part) if i is not None], np.int64), return_counts=True)
            found.append((ids, times))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ids, tf = found[0] if len(found) == 1 else _sums(found)
        m = 100 - 25 + (25 * size * self.n) // self.total
        return ids, (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _sums(parts) -> tuple[np.ndarray, np.ndarray]:
    ids, where = np.unique(np.concatenate([i for i, _ in parts]), return_inverse=True)
    out = np.zeros(len(ids), np.int64)
    np.add.at(out, where, np.concatenate([t for _, t in parts]))
    return ids, out


class Search:
    """The k best documents of every item among those given so far."""

    def __init__(self, items: Items, k: int):
        self.items, self.k = items, k
        self.best: list[list[tuple]] = [[] for _ in items.rows]      # heaps of (score, -id, id), in the items' tree order
        self.kth = np.ones(len(items.rows), items.dtype)              # what a score must reach; scores of 0 don't count
        self.scratch = np.zeros(len(items.vocabulary), items.dtype)
        self.wide = np.zeros((DOC_LEAF, len(items.vocabulary)), items.dtype)
        self.scored = 0

    def add(self, ids: list, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Take a group of documents: build their hierarchy and visit it together with the items'."""
        if not vectors:
            return
        rows, root = hierarchy(vectors, DOC_LEAF, self.items.dtype)
        self._visit(root, [self.items.root], rows, ids, vectors)

    def _alive(self, nodes: list[Node]) -> list[Node]:
        """The item nodes whose bound with the document node in ``scratch`` can still matter."""
        return [i for i in nodes if i.top @ self.scratch[i.terms] >= self.kth[i.lo:i.hi].min()]

    def _visit(self, docs: Node, nodes: list[Node], rows, ids, vectors) -> None:
        self.scratch[docs.terms] = docs.top
        alive = self._alive(nodes)
        if docs.children:
            self.scratch[docs.terms] = 0
            below = [c for i in alive for c in (i.children or [i])]
            for child in docs.children if below else ():
                self._visit(child, below, rows, ids, vectors)
            return
        leaves = []
        while alive:
            leaves += [i for i in alive if not i.children]
            alive = self._alive([c for i in alive for c in i.children])
        self.scratch[docs.terms] = 0
        if leaves:
            own = rows[docs.lo:docs.hi]
            for line, r in zip(self.wide, own):
                line[vectors[r][0]] = vectors[r][1]
            for leaf in leaves:
                self._score(leaf, [ids[r] for r in own])
            self.wide[:, docs.terms] = 0

    def _score(self, leaf: Node, ids: list) -> None:
        terms, block = self.items.blocks[leaf.lo]
        scores = self.wide[:len(ids), terms] @ block
        self.scored += scores.size
        for d, j in zip(*np.nonzero(scores >= self.kth[leaf.lo:leaf.hi])):
            at = leaf.lo + int(j)
            heap = self.best[at]
            entry = (int(scores[d, j]), -math.inf if ids[d] is None else -ids[d], ids[d])
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry[:2] > heap[0][:2]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.kth[at] = heap[0][0]


# --- on Spark --------------------------------------------------------------------

def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[Counter]]]:
    """(ids, term counts) of the items that have terms, ``ITEM_CHARS`` characters at a time."""
    ids, texts, size = [], [], 0
    for r in items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).toLocalIterator():
        counts = Counter(w for part in segments((r.text or "").encode(), TABLE) for w in part)
        if counts:
            ids.append(r.id)
            texts.append(counts)
            size += len(r.text)
        if size >= ITEM_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _search_block(documents: DataFrame, item_ids: list, texts: list[Counter], k: int, first: int, schema: T.StructType,
                  id_col: str, text_col: str) -> DataFrame:
    n, total, held = term_stats(documents, {t for c in texts for t in c}, text_col)
    items = Items(texts, n, total, held)

    def run(batches) -> Iterator:
        import pyarrow as pa
        search, ids, vectors = Search(items, k), [], []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                v = items.vector(text)
                if len(v[0]):
                    ids.append(doc)
                    vectors.append(v)
                if len(ids) == GROUP:
                    search.add(ids, vectors)
                    ids, vectors = [], []
        search.add(ids, vectors)
        rows = [(first + int(items.rows[at]), item_ids[items.rows[at]], doc, score)
                for at, heap in enumerate(search.best) for score, _, doc in heap]
        types = (pa.int64(), item_type, pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=schema.names)
    from pyspark.sql.pandas.types import to_arrow_type
    item_type = to_arrow_type(schema["item_id"].dataType)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.filter("text IS NOT NULL").transform(small_batches).mapInArrow(run, schema)


def search(documents: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item, with scores above 0."""
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", items.schema[item_col].dataType),
                           T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    found, first = None, 0
    for ids, texts in _item_blocks(items, item_col, item_text_col):
        block = _search_block(documents, ids, texts, k, first, schema, id_col, text_col)
        block = cut(_ranked(block, k, "item", F.pmod(F.spark_partition_id(), F.lit(64))))
        found, first = block if found is None else found.unionByName(block), first + len(ids)
    if found is None:
        found = documents.sparkSession.createDataFrame([], schema)
    return _ranked(found, k, "item").select("item_id", "rank", "doc_id", "score")


def _ranked(rows: DataFrame, k: int, *by) -> DataFrame:
    """The ``k`` best rows of each group; ``by`` ends in a salt in the first of the two steps."""
    salted = rows.withColumn("salt", by[1]) if len(by) > 1 else rows.withColumn("salt", F.lit(0))
    w = Window.partitionBy(by[0], "salt").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return salted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("item", "item_id", "doc_id", "score", "rank")


SQL = """WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n, CAST(sum(len(terms)) AS BIGINT) AS total FROM d),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS size, unnest(terms) AS term FROM d)
    WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
x AS (SELECT tf.doc_id, tf.term, CAST(floor(1000 * ln((2 * s.n + 2) / (2 * df.df + 1))) AS BIGINT)
    * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * tf.size * s.n) // s.total))) AS v FROM tf JOIN df USING (term), s),
r AS (SELECT item_id, doc_id, CAST(sum(times * v) AS BIGINT) AS score FROM q JOIN x USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 20"""
