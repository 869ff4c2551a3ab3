"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from tenure.llm import dialogue


def said(x):
    return " " if x is None else str(x)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        how = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return out


def plain_report(original, rows):
    """The report by trying every edit of every row, one conversation at a time."""
    want = {}
    for conv in {r[0] for r in original}:
        own = sorted((r[1:] for r in rows if r[0] == conv),
                     key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.sha256(r[2].encode()).digest()))
        turns = {t for t, _, _ in own if t is not None}
        faults, seen = [], set()
        for _, role, text in own:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        step = {"": "su", "s": "u", "u": "a", "a": "u"}
        lead = {"s": "s", "u": "u", "a": "a"}

        @lru_cache(None)
        def best(i, state):
            """(cost, audit, repaired lines) of the rows from i on."""
            found = []
            if i == len(own):
                if state in ("", "a"):
                    found.append((0, "", ()))
            else:
                _, role, text = own[i]
                found.append(tuple(x + y for x, y in zip((3, "D", ()), best(i + 1, state))))
                if faults[i] not in ("blank", "duplicate"):
                    late = faults[i] == "truncated"
                    if role[:1] in lead and role[:1] in step[state]:
                        found.append(tuple(x + y for x, y in zip((late, "K", (f"{role}:{text}",)), best(i + 1, role[:1]))))
                    for new in ("user", "assistant"):
                        if new[0] in step[state]:
                            found.append(tuple(x + y for x, y in zip((2 + late, "R", (f"{new}:{text}",)), best(i + 1, new[0]))))
            return min(found) if found else (10 ** 9, "", ())

        @lru_cache(None)
        def search(i, state, inserts=0):
            """As best, with up to three insertions before row i."""
            found = [here(i, state)]
            if inserts < 3:
                for new in ("user", "assistant"):
                    if new[0] in step[state]:
                        found.append(tuple(x + y for x, y in zip((2, "I", (f"{new}:",)), search(i, new[0], inserts + 1))))
            return min(found)

        here, best_next = best, search
        best = best_next  # the rows behind are searched with insertions as well
        cost, audit, lines = search(0, "")
        want[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                      sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])), cost, audit,
                      hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return want


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def as_dict(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def random_rows(seed, n, roles):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut", "", " \n", "Why?", "long text that ends", "end. \t", None, "\u0085", "é."]
    return [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts) if rng.random() < .6 else f"t{i}.")
            for i in range(n)]


@pytest.mark.parametrize("seed, roles", [(1, ["user", "assistant"]), (2, ["system", "user", "assistant", None, "tool", ""]), (3, ["system", "tool"])])
def test_report_equals_plain_search(spark, seed, roles):
    rows = random_rows(seed, 60, roles)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, conv string").repartition(5)
    damaged = seed == 2
    frame = dialogue.damage(df) if damaged else dialogue.plain_rows(df)
    plain = plain_damage(rows) if damaged else [(c, t, said(r), said(x)) for c, t, r, x in rows]
    assert as_dict(dialogue.Repair(frame, block_rows=4).report()) == plain_report(rows, plain)


@pytest.mark.parametrize("passes", [1, 50])
def test_long_conversation_that_never_converges(spark, passes):
    """Roles that fit nowhere: speculation is wrong in every second chunk, and stays so without composed matrices."""
    rows = [(7, i, "tool" if i % 41 else "user", f"line {i}.") for i in range(103)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = dialogue.Repair(dialogue.plain_rows(df), block_rows=8, passes=passes)
    assert as_dict(got.report()) == plain_report(rows, rows)


def test_fixups_decide(spark, monkeypatch):
    """Without fix-up passes the result is wrong: the speculative vectors aren't the answer."""
    def unfixed(batches):
        import pyarrow as pa
        for b in batches:
            names = ["conv", "block", "kinds", "more", "vectors", "start"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array([False] * b.num_rows)], names=[*names, "changed"])

    rows = [(7, i, "tool", f"line {i}.") for i in range(13)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(dialogue, "_fix", unfixed)
    assert as_dict(dialogue.Repair(dialogue.plain_rows(df), block_rows=2).report()) != plain_report(rows, rows)


def test_repair_returns_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "More?"), (1, 1, "user", "More?"), (1, 2, "assistant", "Done."), (2, 0, "system", "S.")]
    df = spark.createDataFrame(rows, "c long, turn long, role string, text string").withColumnRenamed("turn", "place")
    got = dialogue.repair(df, conv_col="c", turn_col="place").orderBy("place").collect()
    assert [(r.conv_id, r.turn, r.role, r.text, r.edit) for r in got] == [
        (1, 0, "user", "Hi.", "keep"), (1, None, "assistant", "", "insert"), (1, 1, "user", "More?", "keep"), (1, 2, "assistant", "Done.", "keep")]


def test_empty_and_dropped(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert dialogue.damaged_report(df).collect() == []
    drop = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(drop, 0, "user", "x")], df.schema)
    assert as_dict(dialogue.damaged_report(one)) == {drop: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_digest_of_long_conversations(spark, monkeypatch):
    """Conversations over several partitions and over the held bytes are hashed as a stream."""
    monkeypatch.setattr(dialogue, "HELD", 300)
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", f"{c} {i} " + "x" * (i % 7 * 20) + ".") for c in range(5) for i in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    assert as_dict(dialogue.Repair(dialogue.plain_rows(df)).report()) == plain_report(rows, rows)
