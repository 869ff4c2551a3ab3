"""Benchmark decontamination: pigeonhole pieces, then Myers' bit-parallel distance.

Texts and items are compared in normal form: lower case, with every run of
characters that are not letters or digits as one space.  An item of ``m``
characters may differ from a passage by ``floor(rate * m)`` edits.  It is cut
into one piece more than that, so that a passage within the budget holds one
piece unchanged; all pieces of all items are looked up at once with an
Aho-Corasick automaton, and around every hit the whole item is compared with
the text by Myers' algorithm (one bit per item character).

The benchmark is the stated reference set: its size is measured first, and it
goes to the tasks in blocks of at most about ``block_chars`` characters, each
compared with all documents in one pass without a shuffle.

Defined results for odd input: null and empty texts hold no leak; null and
empty items (in normal form) match nothing; an item too short for one edit has
to stand exactly, on word limits; a null id stays null in the result; repeated
items and documents each give their own rows; empty tables give an empty
result; extra columns are ignored (and pass through ``drop_leaks``).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import small_batches

RATE = 0.1
_APART = re.compile(r"[\W_]+")
LEAKS = "doc_id long, item_id long, distance int, start long, end long"


def normal(text: str | None) -> str:
    return _APART.sub(" ", text.lower()).strip() if text else ""


def original_span(text: str, a: int, b: int) -> tuple[int, int]:
    """Code points of ``text`` that [a, b) of its normal form stands for (lower case may change lengths)."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    at, n, first = [], 0, True
    for m in re.finditer(r"[^\W_]+", low):
        n += 0 if first else 1
        first = False
        at.append((n, n + len(m.group()), m.start()))
        n += len(m.group())
    start, end = None, 0
    for lo, hi, src in at:
        if hi > a and lo < b:
            if start is None:
                start = src + max(0, a - lo)
            end = src + min(hi, b) - lo
    return (0, 0) if start is None else (start, end)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length that make up the item, with their offsets."""
    n = errors + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Myers:
    """Least edit distance of a pattern to any substring of a text, with Python integers as bit vectors."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.peq: dict[str, int] = defaultdict(int)
        for k, c in enumerate(pattern):
            self.peq[c] |= 1 << k
        self.peq = dict(self.peq)

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end of the first substring that has it)."""
        m, full, top, get = self.m, (1 << self.m) - 1, 1 << (self.m - 1), self.peq.get
        pv, mv, score, best, end = full, 0, self.m, self.m, 0
        for k, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best, end = score, k + 1
            ph = ph << 1
            mh = mh << 1
            pv = (mh & full) | (full & ~(xv | ph))
            mv = ph & xv & full
        return best, end


def follows(part: str, t: str, at: int) -> bool:
    """Whether ``part`` stands in ``t`` from ``at`` on with at most one edit."""
    if t.startswith(part, at):
        return True
    n, p, size = len(t), 0, len(part)
    while p < size and at + p < n and part[p] == t[at + p]:
        p += 1
    rest, q = part[p + 1:], at + p
    return t.startswith(rest, q + 1) or t.startswith(part[p:], q + 1) or t.startswith(rest, q)


def precedes(part: str, t: str, end: int) -> bool:
    """Whether ``part`` stands in ``t`` up to ``end`` with at most one edit."""
    if t.endswith(part, 0, end):
        return True
    p, size = 0, len(part)
    while p < size and p < end and part[size - 1 - p] == t[end - 1 - p]:
        p += 1
    rest, whole, q = part[:size - 1 - p], part[:size - p], end - p
    return t.endswith(rest, 0, max(0, q - 1)) or t.endswith(whole, 0, max(0, q - 1)) or t.endswith(rest, 0, q)


class Matcher:
    """The automaton and the patterns of one block of items."""

    def __init__(self, items: list[tuple], rate: float):
        import ahocorasick
        self.items, self.auto = [], ahocorasick.Automaton()
        found: dict[str, list] = {}
        for item_id, text in items:
            t = normal(text)
            if not t:
                continue
            errors = int(rate * len(t))
            j = len(self.items)
            self.items.append([item_id, t, errors, None, None])
            cut = pieces(t, errors)
            for k, (at, piece) in enumerate(cut):
                partner = cut[k ^ 1][1] if k ^ 1 < len(cut) else None
                found.setdefault(piece, []).append((j, at, partner, k % 2))
        for piece, where in found.items():
            self.auto.add_word(piece, (len(piece), where))
        if found:
            self.auto.make_automaton()

    def _patterns(self, j: int) -> tuple[Myers, Myers]:
        item = self.items[j]
        if item[3] is None:
            item[3], item[4] = Myers(item[1]), Myers(item[1][::-1])
        return item[3], item[4]

    def leaks(self, text: str | None) -> list[tuple]:
        """(item id, distance, start, end in the text's code points): the best passage of every item found."""
        if not self.items or not (t := normal(text)):
            return []
        windows: dict[int, list] = {}
        items = self.items
        for end, (size, where) in self.auto.iter(t):
            for j, at, partner, second in where:
                if partner is not None and not (precedes(partner, t, end + 1 - size) if second else follows(partner, t, end + 1)):
                    continue
                spare = items[j][2]
                lo = end + 1 - size - at - spare
                hi = lo + len(items[j][1]) + 2 * spare
                w = windows.setdefault(j, [])
                while w and lo <= w[-1][1]:  # a later hit may stand for an earlier start
                    a, b = w.pop()
                    lo, hi = min(lo, a), max(hi, b)
                w.append([lo, hi])
        out = []
        for j, spans in windows.items():
            item_id, item, errors = items[j][:3]
            best = None
            for lo, hi in spans:
                lo, hi = max(0, lo), min(len(t), hi)
                if hi - lo < len(item) - errors:
                    continue
                part = t[lo:hi]
                at = part.find(item)
                if errors == 0:
                    padded = f" {t} "
                    k = padded.find(f" {item} ")
                    if k >= 0:
                        best = (0, k, k + len(item))
                        break
                    continue
                if at >= 0:
                    best = (0, lo + at, lo + at + len(item))
                    break
                if not self._likely(item, part, errors):
                    continue
                forward, backward = self._patterns(j)
                d, end = forward.best(part)
                if d <= errors and (best is None or d < best[0]):
                    # The same distance read backwards from the end gives the start.
                    back = part[max(0, end - len(item) - d):end][::-1]
                    _, length = backward.best(back)
                    best = (d, lo + end - length, lo + end)
            if best is not None:
                start, end = original_span(text, best[1], best[2])
                out.append((item_id, best[0], start, end))
        return out

    @staticmethod
    def _likely(item: str, part: str, errors: int) -> bool:
        """False only if the window can't hold the item: each edit destroys at most four of its 4-grams."""
        n = len(item) - 3
        if n <= 4 * errors:
            return True
        own = {part[k:k + 4] for k in range(len(part) - 3)}
        miss, most = 0, 4 * errors
        for k in range(n):
            if item[k:k + 4] not in own:
                miss += 1
                if miss > most:
                    return False
        return True


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_chars`` characters, one at a time."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield sorted(((r.id, r.text) for r in part.collect()), key=str)  # one block, of bounded size


def find_leaks(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = 4_000_000) -> DataFrame:
    """One row per document row and item found in it: least distance and span (``LEAKS``)."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = spark.createDataFrame([], LEAKS)
    for items in _blocks(benchmark, "item_id", "text", block_chars):
        found = found.union(rows.transform(small_batches).mapInArrow(_finder(spark.sparkContext.broadcast(items), rate), LEAKS))
    return found


def _finder(shared, rate: float):
    def run(batches) -> Iterator:
        import pyarrow as pa
        m = Matcher(shared.value, rate)
        for batch in batches:
            docs, rows = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = m.leaks(text.as_py())
                docs += [doc] * len(got)
                rows += got
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                 pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                names=["doc_id", "item_id", "distance", "start", "end"])
    return run


def drop_leaks(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = 4_000_000,
               text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that hold no item of the benchmark, in one pass per block."""
    spark, k = documents.sparkSession, documents.columns.index(text_col)

    def keeper(shared):
        def run(batches) -> Iterator:
            import pyarrow as pa
            m = Matcher(shared.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not m.leaks(t.as_py()) for t in batch.column(k)], pa.bool_()))
        return run
    for items in _blocks(benchmark, "item_id", "text", block_chars):
        documents = documents.transform(small_batches).mapInArrow(keeper(spark.sparkContext.broadcast(items)), documents.schema)
    return documents
