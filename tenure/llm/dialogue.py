"""Conversation structure repair: a rank-convergence parallel Viterbi search.

The rows of a conversation are edited at least cost until their role initials
read ``(s?(ua)+)?``: an optional system message, then user and assistant in turn.
A row is kept (0), given the role user or assistant (2) or deleted (3); blank and
repeated rows must be deleted, a truncated row that stays costs 1 more, and empty
user or assistant messages can be inserted anywhere (2 each).

How it runs:

1. Equal rows of one turn become one narrow row with a count; texts are
   represented by their hashes.  The narrow rows are sorted over the cluster by
   (conversation, turn, role, text's beginning, hash), so a conversation that
   holds a third of all rows is divided as well.
2. Blocks of ``block_rows`` consecutive rows are the chunks of the search.
   Each chunk computes its rows' costs to go, backward, from a speculative vector
   at its end (that of a conversation's end).
3. In fix-up passes a chunk takes the vector at the start of the chunk behind it
   and reruns from its last row until the new vectors differ from the old ones by
   a constant only: from there on the old ones hold, shifted.  Passes end when no
   chunk's first vector changes its shape.  Sequences that never converge (roles
   that fit nowhere swap the two states for ever) would need a pass per chunk, so
   after ``passes`` of them the chunks' cost matrices are composed by doubling.
4. The stitched vectors tell every state's cheapest next edit, ties in the order
   delete, insert, keep, rerole, which gives the ASCII-least audit.  A chunk maps
   its four states at the start to states at its end; the maps are composed by
   doubling, then every chunk writes its part of the audit.
5. Texts move once: edits and texts are sorted together by the rows' key and
   merged as a stream.

Defined results for odd input: nulls in the id, turn, role or text read as one
space (a null turn sorts first and is left out of the gaps); a row whose role has
another initial than s, u and a can't be kept; rows of one turn are taken in the
order of role, the text's first 32 characters and its SHA-256; equal rows are duplicates of
the first; a conversation without rows, or of which every row goes, has an empty
repair; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.functions.ordering import GIDX, global_order, shifts_ordered
from tenure.llm.common import cut, small_batches

INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
SOLID = r"[^\x20\x09-\x0D]"

# States of the repaired conversation: nothing yet, after s, after u, after a.
INSERTED = np.array([2, 2, 3, 2])                                  # state after an inserted message
KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1] * 4])  # by initial (s, u, a, other) and state
CLOSE = np.array([0, 2 * INSERT, INSERT, 0], np.int64)             # cost of a proper end, by state
MUST_GO = 8                                                        # kind of a row: 2 * initial + truncated, or this
FAR = 1 << 40


# --- input ------------------------------------------------------------------

def _said(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by crc32("conv_id:turn") % 20.

    0 drops the row (copies 0), 1 empties its text, 2 removes its ``.!?``, 3
    repeats it (copies 2), 4 gives it the role user."""
    how = F.crc32(F.concat(_said(conv_col), F.lit(":"), _said(turn_col)).cast("binary")) % 20
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                                _said(role_col).alias("role"), _said(text_col).alias("text"), how.alias("how"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("how") == 0, 0).when(F.col("how") == 3, 2).otherwise(1).cast("long").alias("copies"))


def plain_rows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """The rows as they are, in the form of :func:`damage`."""
    return conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                                _said(role_col).alias("role"), _said(text_col).alias("text"), F.lit(1).cast("long").alias("copies"))


KEY = ["conv", "turn", "role", "head", "hash"]


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the key that names a row and sorts it: never null but for the turn."""
    conv = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    return rows.select(conv.alias("conv"), "conv_id", "turn", "role", F.substring("text", 1, 32).alias("head"),
                       F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("hash"), "text", "copies")


# --- narrow rows with their faults --------------------------------------------

def _distinct_rows(keyed: DataFrame) -> DataFrame:
    """One row per distinct (conversation, turn, role, text) with its copies."""
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    narrow = keyed.select(*KEY, "conv_id", "copies", (~F.col("text").rlike(SOLID)).alias("blank"),
                          (~last.isin(".", "!", "?")).alias("truncated"))
    return narrow.groupBy(*KEY).agg(F.first("conv_id").alias("conv_id"), F.sum("copies").alias("copies"),
                                    F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))


def _ordered(distinct: DataFrame) -> DataFrame:
    """The rows that exist, in order, with their kind, faults and what their order tells.

    The first row of every (conversation, role, text) is found by a partially
    aggregated minimum and met again by its whole key, which is unique on both
    sides: a text that fills a conversation isn't one task's work."""
    rows = distinct.filter("copies > 0")
    turn = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    firsts = (rows.groupBy("conv", "role", "hash").agg(F.min(turn).alias("t"))
              .select(*[F.col(c).alias(f"{c}_1") for c in ("conv", "role", "hash")], F.col("t.turn").alias("turn_1"), F.lit(True).alias("first")))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_1")) for c in ("conv", "role", "hash", "turn")]
    rows = rows.join(firsts, same, "left").select(*rows.columns, F.coalesce("first", F.lit(False)).alias("first"))
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    late = F.when(F.col("first"), F.col("copies") - 1).otherwise(F.col("copies"))
    rows = rows.select(
        *KEY, "copies", initial.alias("initial"),
        F.when(F.col("blank") | ~F.col("first"), MUST_GO).otherwise(2 * number + F.col("truncated").cast("int")).alias("kind"),
        F.when(F.col("blank"), F.col("copies")).otherwise(0).alias("n_blank"), F.when(F.col("blank"), 0).otherwise(late).alias("n_late"),
        (~F.col("blank") & F.col("first") & F.col("truncated")).cast("long").alias("n_truncated"))
    rows = shifts_ordered(global_order(rows, KEY), ["turn", "initial"], [1], ["_p"], key="conv")
    pair = F.concat("initial_p", "initial")
    return (rows.withColumn("n_illegal", F.col("copies") - 1 + F.coalesce((~pair.isin("su", "ua", "au")).cast("long"), F.lit(0)))
            .withColumn("new_turn", (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_p"))).cast("long")))


# --- the search inside a chunk (NumPy over many chunks at a time) ----------------

def _padded(lists) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of an Arrow list column; the values of a shorter list end in -1."""
    lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    out = np.full((len(lengths), max(1, lengths.max(initial=0))), -1, np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
    return out, lengths


def _edits(kind: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs (chunk, state, edit) of deleting, keeping and reroling a row of ``kind``, given the costs behind it."""
    initial, late = np.clip(kind, 0, 7) // 2, np.clip(kind, 0, 7) % 2 * TRUNCATED
    to = KEPT[initial]
    live = (kind < MUST_GO)[:, None]
    keep = np.where(live & (to >= 0), np.take_along_axis(after, np.maximum(to, 0), 1) + late[:, None], FAR)
    rerole = np.where(live, after[:, INSERTED] + REROLE + late[:, None], FAR)
    return np.stack([after + DELETE, keep, rerole], 2)


def _back(kind: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The costs to go before a row (insertions included) from those behind it."""
    act = _edits(kind, after).min(2)
    one = act[:, INSERTED] + INSERT
    two = act[:, INSERTED[INSERTED]] + 2 * INSERT
    return np.where((kind < 0)[:, None], after, np.minimum(np.minimum(act, one), two))


def _shape(v: np.ndarray) -> np.ndarray:
    return v - v[..., :1]


def _costs(kinds: np.ndarray, end: np.ndarray, old: np.ndarray | None = None) -> np.ndarray:
    """Vectors (chunk, row, state) before every row.  With ``old`` vectors a chunk
    stops where the new one differs from the old one by a constant."""
    n, rows = kinds.shape
    out = np.empty((n, rows + 1, 4), np.int64)
    out[:, rows] = end
    live = np.arange(n)
    for i in range(rows - 1, -1, -1):
        new = _back(kinds[live, i], out[live, i + 1])
        out[live, i] = new
        if old is not None:
            settled = (_shape(new) == _shape(old[live, i])).all(1) & (kinds[live, i] >= 0)
            done = live[settled]
            out[done, :i] = old[done, :i] + (out[done, i, :1] - old[done, i, :1])[:, None]
            live = live[~settled]
            if not len(live):
                break
    return out


def _choices(kinds: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edit, state behind the row), by chunk, row and state: edit 0 deletes, 1 inserts (and looks
    again), 2 keeps, 3 reroles; the first that is cheapest."""
    n, rows = kinds.shape
    edit = np.zeros((n, rows, 4), np.int64)
    to = np.tile(np.arange(4), (n, rows, 1))
    for i in range(rows):
        acts, best = _edits(kinds[:, i], costs[:, i + 1]), costs[:, i]
        e = np.select([acts[:, :, 0] == best, best[:, INSERTED] + INSERT == best, acts[:, :, 1] == best], [0, 1, 2], 3)
        step = np.select([e == 0, e == 2], [np.arange(4)[None, :], KEPT[np.clip(kinds[:, i], 0, 7) // 2]], INSERTED[None, :])
        for _ in range(2):  # an insertion is followed by what its state chooses
            step = np.where(e == 1, np.take_along_axis(step, np.broadcast_to(INSERTED, step.shape), 1), step)
        none = (kinds[:, i] < 0)[:, None]
        edit[:, i], to[:, i] = e, np.where(none, np.arange(4), step)
    return edit, to


def _unpack(vectors, rows: int) -> np.ndarray:
    """The stored vectors of chunks, padded at the end to ``rows`` rows."""
    out = np.zeros((len(vectors), rows + 1, 4), np.int64)
    for k, b in enumerate(vectors.to_pylist()):
        v = np.frombuffer(b, np.int32).reshape(-1, 4)
        out[k, :len(v)] = v
        out[k, len(v):] = v[-1]
    return out


def _pack(costs: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    return [costs[k, :n + 1].astype(np.int32).tobytes() for k, n in enumerate(lengths)]


# --- chunks as rows ------------------------------------------------------------

CHUNK = "conv string, block long, kinds array<int>, more array<long>, vectors binary, start array<int>"


def _speculate(batches) -> Iterator:
    """Vectors of every chunk as if its conversation ended with it."""
    import pyarrow as pa
    for b in batches:
        kinds, lengths = _padded(b.column("kinds"))
        # a shorter chunk's padding passes the vector on unchanged
        costs = _costs(kinds, np.broadcast_to(CLOSE, (len(kinds), 4)))
        yield pa.RecordBatch.from_arrays(
            [b.column("conv"), b.column("block"), b.column("kinds"), b.column("more"), pa.array(_pack(costs, lengths), pa.binary()),
             pa.array(list(costs[:, 0].astype(np.int32)), pa.list_(pa.int32()))], names=["conv", "block", "kinds", "more", "vectors", "start"])


def _fix(batches) -> Iterator:
    """One fix-up pass: chunks whose next chunk begins with another vector than they assumed run again."""
    import pyarrow as pa
    for b in batches:
        kinds, lengths = _padded(b.column("kinds"))
        old = _unpack(b.column("vectors"), kinds.shape[1])
        behind = np.array(b.column("behind").to_pylist(), np.int64).reshape(-1, 4)
        behind -= behind.min(1, keepdims=True)  # decisions depend on differences alone, so numbers stay small
        again = (_shape(behind) != _shape(old[:, -1])).any(1)
        new = old.copy()
        if again.any():
            new[again] = _costs(kinds[again], behind[again], old[again])
        changed = (_shape(new[:, 0]) != _shape(old[:, 0])).any(1)
        yield pa.RecordBatch.from_arrays(
            [b.column("conv"), b.column("block"), b.column("kinds"), b.column("more"), pa.array(_pack(new, lengths), pa.binary()),
             pa.array(list(new[:, 0].astype(np.int32)), pa.list_(pa.int32())), pa.array(changed)],
            names=["conv", "block", "kinds", "more", "vectors", "start", "changed"])


def _matrices(batches) -> Iterator:
    """Cost matrix (16 values, row by row) of every chunk: state before it to state behind it."""
    import pyarrow as pa
    for b in batches:
        kinds, _ = _padded(b.column("kinds"))
        to = [_costs(kinds, np.where(np.arange(4) == t, 0, FAR)[None, :].repeat(len(kinds), 0))[:, 0] for t in range(4)]
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("block"), pa.array(list(np.stack(to, 2).reshape(-1, 16)),
                                                                                       pa.list_(pa.int64()))], names=["conv", "block", "value"])


def _maps(batches) -> Iterator:
    """The state behind a chunk for each of the four states before it."""
    import pyarrow as pa
    for b in batches:
        kinds, _ = _padded(b.column("kinds"))
        _, to = _choices(kinds, _unpack(b.column("vectors"), kinds.shape[1]))
        state = np.tile(np.arange(4), (len(kinds), 1))
        for i in range(kinds.shape[1]):
            state = np.take_along_axis(to[:, i], state, 1)
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("block"), pa.array(list(state.astype(np.int32)), pa.list_(pa.int32()))],
                                         names=["conv", "block", "value"])


TRACE = "conv string, block long, edits array<string>, audit string, cost long"
_LETTERS = {0: "D", 2: "K"}


def _trace(batches) -> Iterator:
    """Edits of every row from the chunk's first state on.

    An edit is written as letters: u and a insert a message of that role, then D
    deletes, K keeps, U and A give the row that role; letters of a last chunk's
    last row after a blank are messages at the conversation's end."""
    import pyarrow as pa
    for b in batches:
        kinds, lengths = _padded(b.column("kinds"))
        more, _ = _padded(b.column("more"))
        edit, _ = _choices(kinds, _unpack(b.column("vectors"), kinds.shape[1]))
        edits, audits, costs = [], [], []
        for k, (state, is_last) in enumerate(zip(b.column("state").to_pylist(), b.column("is_last").to_pylist())):
            own, audit, cost = [], [], 0
            for i in range(lengths[k]):
                kind, letters = kinds[k, i], ""
                while (e := edit[k, i, state]) == 1:
                    state = INSERTED[state]
                    letters += "ua"[state - 2]
                    cost += INSERT
                if e == 0:
                    letters += "D"
                    cost += DELETE
                else:
                    cost += kind % 2 * TRUNCATED + (REROLE if e == 3 else 0)
                    state = KEPT[kind // 2, state] if e == 2 else INSERTED[state]
                    letters += "K" if e == 2 else "UA"[state - 2]
                cost += DELETE * int(more[k, i])
                own.append(letters)
                audit.append(letters + "D" * int(more[k, i]))
            if is_last and own and CLOSE[state]:
                tail = "ua" if state == 1 else "a"
                own[-1] += " " + tail
                audit.append(tail)
                cost += INSERT * len(tail)
            edits.append(own)
            audits.append("".join(audit).translate(AUDIT))
            costs.append(cost)
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("block"), pa.array(edits, pa.list_(pa.string())), pa.array(audits, pa.string()),
                                          pa.array(costs, pa.int64())], names=["conv", "block", "edits", "audit", "cost"])


AUDIT = str.maketrans("uaUA", "IIRR")


def _compose_chains(links: DataFrame, join: Callable[[Column, Column], Column]) -> DataFrame:
    """(conv, block, value): the value of every chunk joined with all behind its ``hop`` links, by
    doubling: a chain of n chunks takes log2(n) rounds."""
    while not links.filter("hop IS NOT NULL").isEmpty():
        other = links.select("conv", F.col("block").alias("hop"), F.col("value").alias("v2"), F.col("hop").alias("hop2"))
        links = cut(links.join(other, ["conv", "hop"], "left").select(
            "conv", "block", F.when(F.col("hop").isNull(), F.col("value")).otherwise(join(F.col("value"), F.col("v2"))).alias("value"),
            F.col("hop2").alias("hop")))
    return links.select("conv", "block", "value")


def _min_plus(a: Column, b: Column) -> Column:
    return F.array(*[F.least(F.lit(FAR), *[a[4 * s + m] + b[4 * m + t] for m in range(4)]) for s in range(4) for t in range(4)])


def _stitched(chunks: DataFrame, passes: int) -> DataFrame:
    """``chunks`` with vectors that are right up to a constant, and ``is_last``."""
    begins = chunks.select("conv", (F.col("block") - 1).alias("block"), F.col("start").alias("behind"))
    linked = cut(chunks.join(begins, ["conv", "block"], "left"))
    last = linked.filter("behind IS NULL").select(*chunks.columns, F.lit(True).alias("is_last"))
    moving, done = linked.filter("behind IS NOT NULL"), 0
    one = CHUNK + ", changed boolean"
    while True:
        fixed = cut(moving.mapInArrow(_fix, one))
        done += 1
        if fixed.filter("changed").isEmpty():
            return fixed.drop("changed").withColumn("is_last", F.lit(False)).unionByName(last)
        chunks = fixed.drop("changed")
        if done == passes:
            begins = _true_starts(chunks, last)
        else:
            begins = chunks.select("conv", "block", "start").unionByName(last.select("conv", "block", "start"))
        moving = chunks.join(begins.select("conv", (F.col("block") - 1).alias("block"), F.col("start").alias("behind")), ["conv", "block"])


def _true_starts(moving: DataFrame, last: DataFrame) -> DataFrame:
    """First vectors of all chunks from composed cost matrices, however long the chains are."""
    heads = moving.select("conv").distinct()
    links = (moving.select("conv", "block", "kinds", (F.col("block") + 1).alias("hop"))
             .unionByName(last.join(heads, "conv", "left_semi").select("conv", "block", "kinds", F.lit(None).cast("long").alias("hop"))))
    hops = links.select("conv", "block", "hop")
    matrices = cut(links.select("conv", "block", "kinds").mapInArrow(_matrices, "conv string, block long, value array<bigint>")
                   .join(hops, ["conv", "block"]))
    close = [int(c) for c in CLOSE]
    vector = [F.least(*[F.col("value")[4 * s + t] + close[t] for t in range(4)]) for s in range(4)]
    low = F.least(*vector)
    return _compose_chains(matrices, _min_plus).select("conv", "block", F.array(*[(v - low).cast("int") for v in vector]).alias("start"))


def _with_states(chunks: DataFrame) -> DataFrame:
    """``chunks`` with the state before each: that behind the chunk before, 0 for the first."""
    before = chunks.select("conv", (F.col("block") + 1).alias("block"))
    follows = chunks.select("conv", "block").join(before, ["conv", "block"]).select("conv", "block", (F.col("block") - 1).alias("hop"))
    leads = chunks.filter(~F.col("is_last"))
    maps = leads.select("conv", "block", "kinds", "vectors").mapInArrow(_maps, "conv string, block long, value array<int>")
    links = cut(maps.join(follows, ["conv", "block"], "left").select(
        "conv", "block", "value", F.when(F.size(F.array_distinct("value")) > 1, F.col("hop")).alias("hop")))
    ends = _compose_chains(links, lambda a, b: F.transform(b, lambda x: F.get(a, x)))
    states = ends.select("conv", (F.col("block") + 1).alias("block"), F.col("value")[0].alias("state"))
    return chunks.join(states, ["conv", "block"], "left").withColumn("state", F.coalesce("state", F.lit(0)))


# --- results --------------------------------------------------------------------

class Repair:
    """The repair of a table of rows as :func:`plain_rows` or :func:`damage` gives them."""

    def __init__(self, rows: DataFrame, block_rows: int = 64, passes: int = 6):
        self.keyed = _keyed(rows)
        self.distinct = cut(_distinct_rows(self.keyed))
        ordered = _ordered(self.distinct)
        self.ordered = ordered = cut(ordered)
        entry = F.struct(F.col(GIDX).alias("at"), F.col("kind"), (F.col("copies") - 1).alias("more"))
        blocks = (ordered.groupBy("conv", F.floor(F.col(GIDX) / block_rows).alias("block"))
                  .agg(F.array_sort(F.collect_list(entry)).alias("rows")))  # at most block_rows of them
        blocks = blocks.select("conv", "block", F.col("rows.kind").cast("array<int>").alias("kinds"), F.col("rows.more").alias("more"))
        self.first_at = ordered.groupBy("conv", F.floor(F.col(GIDX) / block_rows).alias("block")).agg(F.min(GIDX).alias("first_at"))
        chunks = cut(blocks.mapInArrow(_speculate, CHUNK))
        self.traced = cut(_with_states(_stitched(chunks, passes)).select("conv", "block", "kinds", "more", "vectors", "is_last", "state")
                          .mapInArrow(_trace, TRACE))

    def row_edits(self) -> DataFrame:
        """(key, place, edits) of the rows that stay or have messages inserted at them."""
        at = self.traced.join(self.first_at, ["conv", "block"]).select(F.col("first_at"), F.posexplode("edits").alias("i", "edits"))
        at = at.filter("edits <> 'D'").select((F.col("first_at") + F.col("i")).alias(GIDX), "edits")
        return self.ordered.select(*KEY, GIDX).join(at, GIDX)

    def rows(self) -> DataFrame:
        """The repaired conversations: (conv, conv_id, place, turn, role, text, edit).

        ``place`` orders the rows; a conversation's rows stand together in this
        frame, in order, and follow one another across partitions.  ``edit`` is
        keep, rerole or insert; inserted rows have no turn and an empty text."""
        none = F.lit(None)
        texts = self.keyed.filter("copies > 0").select(*KEY, "conv_id", F.lit(1).alias("kind"), none.cast("long").alias("at"),
                                                       none.cast("string").alias("edits"), "text")
        id_type = self.keyed.schema["conv_id"].dataType
        edits = self.row_edits().select(*KEY, none.cast(id_type).alias("conv_id"), F.lit(0).alias("kind"), F.col(GIDX).alias("at"), "edits",
                                        none.cast("string").alias("text"))
        # equal keys meet in one partition; the range partitioner divides a large conversation
        both = texts.unionByName(edits).repartitionByRange(*KEY).sortWithinPartitions(*KEY, "kind")
        schema = T.StructType([T.StructField("conv", T.StringType()), T.StructField("conv_id", id_type), T.StructField("place", T.LongType()),
                               T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                               T.StructField("text", T.StringType()), T.StructField("edit", T.StringType())])
        return both.transform(small_batches).mapInArrow(_merge, schema)

    def report(self) -> DataFrame:
        """One row per conversation of the input: its faults, the cost and audit of its repair and the
        SHA-256 of the repaired ``role:text`` lines."""
        counts = self.ordered.select("conv", "turn", "new_turn", "n_blank", "n_late", "n_truncated", F.col("n_illegal"))
        parts = (self.distinct.select("conv", "conv_id").unionByName(counts, allowMissingColumns=True)
                 .unionByName(self.traced.select("conv", "block", "audit", "cost"), allowMissingColumns=True)
                 .unionByName(digests(self.rows()), allowMissingColumns=True))
        piece = F.when(F.col("audit").isNotNull(), F.struct("block", "audit"))
        out = parts.groupBy("conv").agg(
            F.first("conv_id", ignorenulls=True).alias("conv_id"),
            (F.max("turn") - F.min("turn") + 1 - F.sum("new_turn")).alias("gaps"),
            *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in
              (("n_blank", "blank"), ("n_late", "duplicate"), ("n_truncated", "truncated"), ("n_illegal", "illegal"), ("cost", "cost"))],
            F.array_sort(F.collect_list(piece)).alias("pieces"), F.max("sha").alias("sha"))
        return out.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost",
                          F.array_join(F.col("pieces.audit"), "").alias("audit"),
                          F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _merge(batches) -> Iterator:
    """Rows in key order, a row's edits before its texts: the repaired rows."""
    import pyarrow as pa
    key, at, edits, used = None, None, None, True
    for b in batches:
        names = b.schema.names
        cols = [b.column(names.index(c)).to_pylist() for c in [*KEY, "conv_id", "kind", "at", "edits", "text"]]
        out = []
        for conv, turn, role, head, hash_, conv_id, kind, place, letters, text in zip(*cols):
            if kind == 0:
                key, at, edits, used = (conv, turn, role, head, hash_), place, letters, False
                continue
            if used or key != (conv, turn, role, head, hash_):
                continue  # deleted, or a further copy
            used = True
            own, _, tail = edits.partition(" ")
            spot = 8 * at
            for c in own:
                if c in "ua":
                    out.append((conv, conv_id, spot, None, {"u": "user", "a": "assistant"}[c], "", "insert"))
                elif c == "K":
                    out.append((conv, conv_id, spot, turn, role, text, "keep"))
                elif c in "UA":
                    out.append((conv, conv_id, spot, turn, {"U": "user", "A": "assistant"}[c], text, "rerole"))
                spot += c != "D"
            for c in tail:
                out.append((conv, conv_id, spot, None, {"u": "user", "a": "assistant"}[c], "", "insert"))
                spot += 1
        fields = [("conv", pa.string()), ("conv_id", b.schema.field("conv_id").type), ("place", pa.int64()), ("turn", pa.int64()),
                  ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


#: Bytes of a conversation that a task holds back until it knows that no other partition goes on with it.
HELD = 4 << 20


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, sha): SHA-256 of every conversation's ``role:text`` lines, joined by newlines.

    ``repaired`` is the frame of :meth:`Repair.rows`.  A conversation that lies
    inside a partition is hashed there.  Those at a partition's ends, and those
    longer than ``HELD`` bytes, are sent on as pieces and hashed as a stream in
    order: a SHA-256 can't be computed in parts, so a conversation's lines pass
    one task, which keeps none of them."""
    def near(batches) -> Iterator:
        import hashlib
        import pyarrow as pa

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in
                                               enumerate((pa.string(), pa.string(), pa.int64(), pa.binary()))], names=["conv", "sha", "place", "piece"])
        current, lines, size, whole, place = None, [], 0, False, 0
        for b in batches:
            out = []
            for conv, at, role, text in zip(*[b.column(b.schema.names.index(c)).to_pylist() for c in ("conv", "place", "role", "text")]):
                if conv != current:
                    if current is not None:
                        joined = b"".join(lines)
                        out.append((current, hashlib.sha256(joined[1:]).hexdigest(), None, None) if whole else (current, None, place, joined))
                    # the first conversation of a partition may have begun in the one before
                    whole, current, lines, size, place = current is not None, conv, [], 0, at
                line = b"\n" + f"{role}:{text}".encode()
                lines.append(line)
                size += len(line)
                if size > HELD:
                    out.append((conv, None, place, b"".join(lines)))
                    whole, lines, size, place = False, [], 0, at + 1
            if out:
                yield batch(out)
        if lines:
            yield batch([(current, None, place, b"".join(lines))])

    def far(batches) -> Iterator:
        import hashlib
        import pyarrow as pa
        current, h = None, None
        for b in batches:
            out = []
            for conv, piece in zip(b.column("conv").to_pylist(), b.column("piece").to_pylist()):
                if conv != current:
                    if h is not None:
                        out.append((current, h.hexdigest()))
                    current, h, piece = conv, hashlib.sha256(), piece[1:]
                h.update(piece)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string())], names=["conv", "sha"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.string()), pa.array([h.hexdigest()], pa.string())], names=["conv", "sha"])

    first = cut(repaired.mapInArrow(near, "conv string, sha string, place long, piece binary"))
    pieces = first.filter("piece IS NOT NULL").select("conv", "place", "piece").repartition("conv").sortWithinPartitions("conv", "place")
    return first.filter("sha IS NOT NULL").select("conv", "sha").unionByName(pieces.mapInArrow(far, "conv string, sha string"))


def repair(conversations: DataFrame, **columns) -> DataFrame:
    """The repaired conversations: (conv_id, place, turn, role, text, edit), see :meth:`Repair.rows`."""
    return Repair(plain_rows(conversations, **columns)).rows().drop("conv")


def damaged_report(conversations: DataFrame) -> DataFrame:
    """The report of the repair of ``conversations`` after :func:`damage`."""
    return Repair(damage(conversations)).report()


# --- the same in SQL ----------------------------------------------------------------

_ROLE = {2: "user", 3: "assistant"}


def _value(c, a: str, t: str) -> str:
    """Cost, audit and lines from a state on; compared in this order."""
    return f"{{'c': {c}, 'a': {a}, 't': {t}}}"


def _act(s: int) -> str:
    """The best way on from state ``s`` that begins with the row's edit, given the states ``e0`` to ``e3`` behind it."""
    found = [_value(f"e{s}.c + 3", f"'D' || e{s}.a", f"e{s}.t")]
    for i, to in zip("sua", KEPT.tolist()):
        if to[s] >= 0:
            e = f"e{to[s]}"
            found.append(f"CASE WHEN live AND i = '{i}' THEN " + _value(f"{e}.c + late", f"'K' || {e}.a", f"chr(10) || role || ':' || text || {e}.t") + " END")
    k = int(INSERTED[s])
    found.append("CASE WHEN live THEN " + _value(f"e{k}.c + 2 + late", f"'R' || e{k}.a", f"chr(10) || '{_ROLE[k]}:' || text || e{k}.t") + " END")
    return f"list_min([{', '.join(found)}]) AS b{s}"


def _best(s: int) -> str:
    """With up to two messages inserted before."""
    k = int(INSERTED[s])
    m = int(INSERTED[k])
    one = _value(f"b{k}.c + 2", f"'I' || b{k}.a", f"chr(10) || '{_ROLE[k]}:' || b{k}.t")
    two = _value(f"b{m}.c + 4", f"'II' || b{m}.a", f"chr(10) || '{_ROLE[k]}:' || chr(10) || '{_ROLE[m]}:' || b{m}.t")
    return f"list_min([b{s}, {one}, {two}]) AS e{s}"


def sql() -> str:
    """DuckDB SQL of :func:`damaged_report` over ``conversations``: one step back per row, all states at a time."""
    return f"""WITH RECURSIVE o AS MATERIALIZED (SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k,
    coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
h AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) % 20 AS how FROM o),
g AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
    CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE how WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM g),
q AS (SELECT *, left(role, 1) AS i, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    right(regexp_replace(text, '[\\x20\\x09-\\x0D]+$', ''), 1) NOT IN ('.', '!', '?') AS cut,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair FROM p),
r AS MATERIALIZED (SELECT *, NOT blank AND NOT again AS live, CASE WHEN cut THEN 1 ELSE 0 END AS late FROM q),
dp AS (SELECT conv_id, count(*) + 1 AS pos, {_value(0, "''", "''")} AS e0, {_value(4, "'II'", "chr(10) || 'user:' || chr(10) || 'assistant:'")} AS e1,
    {_value(2, "'I'", "chr(10) || 'assistant:'")} AS e2, {_value(0, "''", "''")} AS e3 FROM r GROUP BY conv_id
  UNION ALL
  SELECT conv_id, pos, {', '.join(_best(s) for s in range(4))} FROM (
    SELECT r.conv_id, r.pos, {', '.join(_act(s) for s in range(4))} FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.pos = dp.pos - 1)),
f AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (live AND cut) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(e0.c, 0) AS BIGINT) AS cost, coalesce(e0.a, '') AS audit, sha256(substr(coalesce(e0.t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN dp ON dp.conv_id IS NOT DISTINCT FROM a.conv_id AND dp.pos = 1"""
