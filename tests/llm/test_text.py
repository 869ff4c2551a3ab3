import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenure.llm import decontam, linededup, pii, quality, suffix, wordhash

random.seed(5)
WORDS = ["".join(random.choice("abcdefgh") for _ in range(random.randint(1, 6))) for _ in range(60)]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


# --- word hashes ----------------------------------------------------------------------------

def test_word_hashes_depend_on_the_word_alone():
    texts = [b"", b"one two  three", b"\t two\none\x0b", "é one".encode(), b"x" * 5000, b"ONE"]
    h, at = wordhash.hash_words(texts)
    words = [w for t in texts for w in t.split()]
    assert at.tolist() == np.cumsum([0] + [len(t.split()) for t in texts]).tolist()
    assert len({(w, int(x)) for w, x in zip(words, h)}) == len(set(words)) == len(set(h.tolist()))
    folded, _ = wordhash.hash_words(texts, fold_case=True)
    assert folded[-1] == folded[0]
    long = [("w%d " % k).encode() * 400_000 for k in range(2)]  # over the prepared powers
    h, at = wordhash.hash_words(long)
    assert len(set(h.tolist())) == 2 and at.tolist() == [0, 400_000, 800_000]
    for size in (1, 7, 100):  # segments don't change a hash
        again = wordhash.hash_words(texts, segment=size)
        assert [x.tolist() for x in again] == [x.tolist() for x in wordhash.hash_words(texts)]


# --- quality --------------------------------------------------------------------------------

def test_sparse_rows_are_unit_vectors_per_text():
    texts = [b"", b"a b a b", b"a"]
    owner, feature, value = quality.sparse_rows(texts, 12)
    for k in (1, 2):
        assert np.isclose((value[owner == k] ** 2).sum(), 1)
    assert not (owner == 0).any()
    one = quality.sparse_rows([b"a b a b"], 12)
    assert (one[1] == feature[owner == 1]).all()  # alone or in a batch


def test_ftrl_against_a_plain_loop():
    rows = [(np.array([0, 2]), np.array([.6, .8])), (np.array([1]), np.array([1.]))] * 20
    y = np.array([1, 0] * 20, float)
    got = quality.ftrl(rows, y, 2, epochs=2)
    z, n = [0.0] * 5, [0.0] * 5
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.5

    def w(i):
        return 0.0 if abs(z[i]) <= l1 else (np.sign(z[i]) * l1 - z[i]) / ((beta + n[i] ** .5) / alpha + l2)
    for _ in range(2):
        for (f, v), t in zip(rows, y):
            x = dict(zip([*f.tolist(), 4], [*v.tolist(), 1.0]))
            ws = {i: w(i) for i in x}
            p = 1 / (1 + np.exp(-sum(ws[i] * x[i] for i in x)))
            for i in x:
                g = (p - t) * x[i]
                s = ((n[i] + g * g) ** .5 - n[i] ** .5) / alpha
                z[i] += g - s * ws[i]
                n[i] += g * g
    assert np.allclose(got, [w(i) for i in range(5)])


def test_held_out_accuracy_and_odd_rows(spark):
    good = [(k, prose(40), 1) for k in range(300)]
    bad = [(1000 + k, " | ".join(random.choice(WORDS) for _ in range(30)), 0) for k in range(100)]
    docs = spark.createDataFrame([(k, t, 0.5) for k, t, _ in good + bad] + [(5000, None, 0.), (5001, "", 0.), (None, prose(30), 0.), (1, good[1][1], 0.)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, y) for k, _, y in good + bad] + [(5000, None), (None, 1)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 404
    truth = {k: y for k, _, y in good + bad}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert held and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    empty = [r.score for r in rows if r.doc_id in (5000, 5001)]
    assert empty[0] == empty[1]
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


# --- lines ----------------------------------------------------------------------------------

def drop_lines(docs, min_chars, min_docs):
    holders = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for k, t in docs:
        for x in (t or "").split("\n"):
            if k is not None and len(key(x)) >= min_chars:
                holders.setdefault(key(x), set()).add(k)
    out = []
    for k, t in docs:
        kept = [x for x in (t or "").split("\n") if k is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == k]
        out.append((k, len((t or "").split("\n")), len((t or "").split("\n")) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches, fanout", [(1, 3), (5, 2)])
def test_lines_against_brute_force(spark, batches, fanout):
    pool = ["  The Hot Line of Éverything and more \x0b", "the hot line of Éverything and more", "short", "x" * 30, "É" * 30, "é" * 30, ""] + [prose(6) for _ in range(8)]
    docs = [(k, "\n".join(random.choice(pool) for _ in range(random.randint(0, 6)))) for k in range(60)]
    docs += [(None, "\n".join(pool)), (70, None), (71, ""), (71, pool[0]), (5, pool[0])]
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, n_lines int")
    got = linededup.line_report(df, min_chars=20, min_docs=4, batches=batches, fanout=fanout).collect()
    assert sorted(map(tuple, got), key=str) == drop_lines(docs, 20, 4)
    assert linededup.dedup_lines(df).columns == ["doc_id", "text", "n_lines", "n_lines_", "n_dropped"]
    assert linededup.line_report(df.limit(0)).count() == 0


def test_runs_tell_fresh_keys_from_known_ones(spark):
    store = linededup.LineRuns(spark, fanout=2)
    frame = lambda rows: spark.createDataFrame([(bytearray(h), d) for h, d in rows], "h binary, doc long")
    store.add(frame([(b"a", 1), (b"b", 2), (b"a", 1)]))
    assert sorted(bytes(r.h) for r in store.fresh(frame([(b"a", 3), (b"c", 3)])).collect()) == [b"c"]
    store.add(frame([(b"a", 3), (b"c", 3)]))
    store.add(frame([(b"d", 4)]))
    assert [len(x) for x in store.levels] == [1, 1]
    assert sorted((bytes(r.h), r.n_docs, r.max_doc) for r in store.totals().collect()) == [(b"a", 2, 3), (b"b", 1, 2), (b"c", 1, 3), (b"d", 1, 4)]


# --- suffix arrays --------------------------------------------------------------------------

def test_minimisers_choose_by_content_and_leave_no_gap():
    text = prose(400).encode()
    h, at = wordhash.hash_words([prose(9).encode(), text, prose(60).encode() + b" " + text[:900]])
    pos, g = suffix.minimisers(h, at, 5, 11)
    whole, ok = suffix._grams(h, at, 5)
    chosen = set()
    for lo, hi in zip(at, at[1:]):
        for s in range(lo, hi - 14):
            w = whole[s:s + 11]
            chosen |= {s + int(k) for k in np.flatnonzero(w == w.min())}
    assert sorted(chosen) == pos.tolist() and (whole[pos] == g).all() and ok[pos].all()


def windows(docs, n):
    seen = {}
    for k, t in docs:
        w = (t or "").split()
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i:i + n]), set()).add(k)
    return seen


def test_passages_against_brute_force(spark):
    rng = random.Random(3)
    big = [f"w{k}" for k in range(5000)]
    text = lambda n: " ".join(rng.choice(big) for _ in range(n))
    shared, hot = [text(n) for n in (19, 20, 21, 45)], text(30)
    docs = [(k, " ".join([text(rng.randint(0, 40)), rng.choice(shared), text(rng.randint(0, 10)), hot if k % 3 else "", text(5)])) for k in range(60)]
    docs += [(100, docs[0][1]), (101, "\n".join([hot] * 9)), (102, None), (103, ""), (104, text(15)), (None, hot), (105, text(60)), (105, docs[1][1])]
    df = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, g string").repartition(3)
    got = {}
    for r in suffix.repeated_passages(df, min_words=20, gram=10).collect():
        assert r.end_word - r.start_word >= 20 and r.ref_doc != r.doc_id
        got.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    seen = windows([(k, t) for k, t in docs if k is not None], 20)
    for k, t in docs[:61] + [docs[61]]:
        w = t.split()
        cover = {p for i in range(len(w) - 19) if len(seen[tuple(w[i:i + 20])]) > 1 for p in range(i, i + 20)}
        assert cover == {p for a, b in got.get(k, []) for p in range(a, b)}
    assert not {102, 103, 104, None} & set(got)
    assert suffix.repeated_passages(df.limit(0)).count() == 0


def test_passages_around_a_hot_gram_are_all_found(spark):
    rng = random.Random(8)
    big = [f"w{k}" for k in range(5000)]
    text = lambda n: " ".join(rng.choice(big) for _ in range(n))
    hot, before = text(10), [text(6) for _ in range(20)]
    # Pairs that share words before the hot ones and go on differently, among many others.
    docs = [(k, " ".join([text(15), before[k // 2] if k < 40 else text(6), hot, text(4) if k >= 40 else f"x{k // 2} y z v", text(15)])) for k in range(300)]
    docs = [(k, t.replace(f"x{k // 2} ", f"{'am'[k % 2]}{k} ").replace("y z v", text(3))) for k, t in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {}
    for r in suffix.repeated_passages(df, min_words=16, gram=8).collect():
        assert r.ref_doc == r.doc_id ^ 1
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert got == {k: set(range(15, 31)) for k in range(40)}


# --- decontamination ------------------------------------------------------------------------

def edit_search(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        cur = [i + 1]
        for k, x in enumerate(t):
            cur.append(min(prev[k] + (c != x), prev[k + 1] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def edited(x, n):
    x = list(x)
    for _ in range(n):
        k, r = random.randrange(len(x)), random.random()
        if r < .4:
            x[k] = random.choice("abcdefgh")
        elif r < .7:
            x.insert(k, random.choice("abcdefgh"))
        elif len(x) > 1:
            del x[k]
    return "".join(x)


def test_matcher_against_edit_distance():
    hits = 0
    for _ in range(120):
        items = [(k, prose(random.randint(1, 20))) for k in range(4)]
        t = " ".join([prose(20), *(edited(x, random.randint(0, int(len(x) * .13))) + " " + prose(8) for _, x in items if random.random() < .6)])
        got = {x[0]: x for x in decontam.Matcher(items, .1).leaks(t)}
        n = decontam.normal(t)
        for k, x in items:
            x = decontam.normal(x)
            budget, d = int(.1 * len(x)), edit_search(x, n)
            want = d if (budget and d <= budget) or (not budget and f" {x} " in f" {n} ") else None
            assert (got[k][1] if k in got else None) == want
            hits += want is not None
            if want is not None:
                assert edit_search(x, decontam.normal(t[got[k][2]:got[k][3]])) <= want + 1
    assert hits > 100


def test_a_repeated_phrase_does_not_hide_the_start_of_a_passage():
    rng = random.Random(11)
    part = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    phrase = part(22)
    item = phrase + part(38) + phrase + part(118)  # 200 characters, 20 edits, pieces of 9 or 10
    cuts = decontam.pieces(item, 20)
    for order in ((0, 2), (2, 0)):
        x = list(item)
        for at, piece in cuts[:6]:  # two edits in each of the first pieces
            x[at + 1] = x[at + len(piece) - 2] = "z"
        x[58] = "z"
        edits = sum(a != b for a, b in zip(item, x))
        t = " ".join([part(300)] * order[0] + ["".join(x)] + [part(300)] * order[1])
        assert edits <= 20 and edit_search(item, t) == edits
        assert [r[:2] for r in decontam.Matcher([(1, item)], .1).leaks(t)] == [(1, edits)]


def test_leaks_and_odd_rows(spark):
    item = prose(30)
    docs = [(1, prose(50) + " " + item + " " + prose(5)), (2, item.upper().replace(" ", ",\n ")), (3, prose(40)), (4, None), (5, ""), (None, item), (1, item)]
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (None, item), (10, "!!")], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id or -1) for r in decontam.find_leaks(df, bench).collect())
    assert got == sorted((d, i) for d in (1, 1, 2, -1) for i in (7, -1))
    assert [r.doc_id for r in decontam.drop_leaks(df, bench, block_chars=100).orderBy("doc_id").collect()] == [3, 4, 5]
    assert decontam.drop_leaks(df, bench.limit(0)).count() == 7 and decontam.find_leaks(df.limit(0), bench).count() == 0


# --- personal data --------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                    or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


FRAGMENTS = ["a@b.c", "x.y@d-e.fr", "@", ".", "..", "1.2.3.4", "256.1.1.1", "001.02.3.4", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111111",
             " ", "-", "  ", "+1 (428) 555-5743", "+", "(", ")", "é", "ö\n", "😀", "\t", "_", "%", "a", "b@c", "٣", "0", "9", "a@b.c.@d.e"]


def test_base_spans_against_python(spark):
    texts = [None, "", "a." * 40_000, "1" * 60_000, "1 " * 30_000, "a@b" + ".a" * 20_000, "+1" + "-" * 30_000, "@" * 1000]
    texts += ["".join(random.choice(FRAGMENTS) for _ in range(random.randint(1, 25))) for _ in range(600)]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "1.2.3.4", "x")], "doc_id long, text string, base string")
    rows = pii.report(df, pii.Model()).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = base_spans("1.2.3.4" if r.doc_id is None else texts[r.doc_id])
        assert r.spans == want and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(f"{k}:") for k in pii.KINDS]


def test_trees_add_spans_and_keep_base_ones(spark):
    rng = random.Random(1)

    def card(ok):
        d = "".join(rng.choice("0123456789") for _ in range(15))
        return next(d + c for c in "0123456789" if luhn(d + c) == ok)
    rows = []
    for k in range(400):
        rows.append((k, rng.choice([f"so {rng.choice(WORDS)}@{rng.choice(WORDS)}.example.com now", f"so {card(True)} paid", f"so {card(False)} sold", f"from 10.{k % 250}.3.4 port",
                                    f"since {k}.4.5.6 and 999.1.1.{k}", f"so +1 (4{k % 90 + 10}) 555-{1000 + k}", "on 2024-05-06 or 1/2/2003", "see x@y or 1.2.3"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.train(docs)
    assert {"email", "card"} <= set(model.thresholds)
    c = card(True)
    texts = ["a (at) b (dot) com", ".".join(c[k:k + 4] for k in range(0, 16, 4)), "on 2024-05-06", "u@v.example.com"]
    odd = spark.createDataFrame(list(enumerate(texts)) + [(9, None)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(odd, model).collect()}
    assert got == {0: "email:0:18", 1: "card:0:19", 2: "", 3: "email:0:15", 9: ""}
    assert {r.doc_id: r.text for r in pii.redact(odd, model).collect()} == {0: "[EMAIL]", 1: "[CARD]", 2: texts[2], 3: "[EMAIL]", 9: None}
    assert pii.train(docs.limit(0)).trees == [] and pii.report(docs.limit(0), model).count() == 0


def test_a_span_goes_only_for_one_that_is_added(spark, monkeypatch):
    """A better than B better than C, A-B and B-C overlapping: A and C are added."""
    def places(df, text, used):
        found = [("A", 0, 10), ("B", 8, 20), ("C", 18, 30)]
        spot = F.array(*[F.struct(F.lit(h).alias("hit"), F.lit(a).alias("start"), F.lit(b).alias("end")) for h, a, b in found])
        for k, n in enumerate(used):
            df = df.withColumn(n, spot if k == 0 and n.startswith("_other") else F.filter(spot, lambda s: F.lit(False)))
        return df

    class Model:
        thresholds = {pii.OTHER[0][0]: .1}

        def score(self, hit):
            return F.when(hit == "A", .9).when(hit == "B", .8).otherwise(.7)
    monkeypatch.setattr(pii, "_with_places", places)
    monkeypatch.setattr(pii, "_passes", lambda kind, hit: F.lit(True))
    monkeypatch.setattr(pii, "_context", lambda text, s: ())
    monkeypatch.setattr(pii, "features", lambda kind, hit: hit)
    df = spark.createDataFrame([(1, "x" * 40)], "doc_id long, text string")
    assert [(s["start"], s["end"]) for s in pii.find(df, Model()).first().spans] == [(0, 10), (18, 30)]


def test_passages_are_cut_but_once(spark):
    shared = " ".join(f"s{k}" for k in range(30))
    docs = [(1, f"a b {shared} c"), (2, f"d\n{shared}\te f"), (3, "g h"), (4, None), (None, shared)]
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, _doc int")
    out = suffix.without_passages(df, suffix.repeated_passages(df, min_words=20, gram=10))
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted(
        [("1", docs[0][1]), ("2", "d\n\te f"), ("3", "g h"), ("4", "None"), ("None", shared)])
