"""Written-out and regrouped personal data: the trees decide, on forms that no base pattern finds."""

import random

import pytest
from pyspark.sql import functions as F

from tenure.llm import pii

WORDS = "amber brook cedar delta ember flint grove heath inlet juniper knoll larch meadow north opal".split()


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def card(rng, ok=True):
    d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(d + c for c in "0123456789" if luhn(d + c) == ok)


def said(rng, n=6):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def number(rng):
    return f"{rng.randint(201, 989)}", f"{rng.randint(201, 989)}", f"{rng.randint(0, 9999):04d}"


def corpus(spark, rng, n=500):
    rows = []
    for k in range(n):
        a, b, c = number(rng)
        bits = [f"{rng.choice(WORDS)}.{k}@{rng.choice(WORDS)}.example.com", f"10.{k % 250}.{rng.randint(0, 255)}.4", card(rng), card(rng, False),
                f"+1 ({a}) {b}-{c}", "2024-05-06", f"token = \"{rng.getrandbits(160):040x}\"", f"commit {rng.getrandbits(160):040x}"]
        rng.shuffle(bits)
        rows.append((k, f" {said(rng)} ".join([""] + bits[:4] + [""])))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(corpus(spark, random.Random(7)))


def planted(rng):
    """(text, span or None) in forms other than the base ones."""
    c, bad, (x, y, z) = card(rng), card(rng, False), number(rng)
    u, d = rng.choice(WORDS), rng.choice(WORDS)
    good = [("email", f"{u} (at) {d} (dot) org"), ("email", f"{u}[at]{d}.com"), ("email", f"{u} at {d} dot com"), ("ip", f"10[.]{rng.randint(0, 255)}[.]3[.]4"),
            ("ip", f"172 dot 16 dot {rng.randint(0, 255)} dot 9"), ("card", "/".join(c[k:k + 4] for k in range(0, 16, 4))), ("card", "  ".join(c[k:k + 4] for k in range(0, 16, 4))),
            ("phone", f"({x}) {y}-{z}"), ("phone", f"{x}-{y}-{z}"), ("phone", f"{x}.{y}.{z}"), ("secret", f"AKIAX{rng.getrandbits(60):015X}")]
    bad_ones = [f"order no. {x}-{y}-{z}", f"invoice #{x} {y} {z}", f"20{x[:2]}-05-06", f"19{x[:2]}-20{y[:2]}", "/".join(bad[k:k + 4] for k in range(0, 16, 4)),
                f"{u} @ {d}. The", f"in version 10[.]{x[0]}[.]3[.]4", f"commit {rng.getrandbits(160):040x}"]
    if rng.random() < .5:
        return rng.choice(good)
    return None, rng.choice(bad_ones)


def test_forms_are_found_by_the_trees_alone(spark, model):
    rng = random.Random(8)
    assert set(model.thresholds) == set(pii.EVERY)
    rows, want = [], set()
    for k in range(600):
        kind, form = planted(rng)
        lead = said(rng) + " "
        rows.append((k, f"{lead}{form} {said(rng)}"))
        if kind:
            want.add((k, f"{kind}:{len(lead)}:{len(lead) + len(form)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, s) for r in pii.report(docs, model).collect() for s in (r.spans + "," + r.secrets).split(",") if s}
    missed, wrong = want - got, got - want
    text = dict(rows)
    shown = [(s, text[k]) for k, s in sorted(missed | wrong)[:8]]
    assert len(want & got) >= .95 * len(want), shown
    assert len(want & got) >= .95 * len(got), shown
    assert pii.report(docs, pii.Model()).filter((F.col("spans") != "") | (F.col("secrets") != "")).count() == 0  # none is a base form


def test_a_number_in_a_joined_run_is_found(spark, model):
    """The base pattern takes two numbers and a space for one and drops them: the trees give them back."""
    rng = random.Random(3)
    a, b = card(rng), card(rng)
    texts = [f"amber {a} {b} brook", "delta +1 (663) 555-6869 10.0.0.7 larch"]
    rows = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert rows[0].spans == "card:6:22,card:23:39" and rows[0].n_card == 0 and rows[0].n_added == 2
    assert rows[1].spans == "ip:24:32,phone:6:23" and rows[1].n_ip == 1


def test_places_of_many_matches(spark):
    """Matches are placed in blocks: every count around a square gives each place once."""
    texts = [" ".join(["1.2.3.4"] * n) for n in (0, 1, 2, 3, 4, 5, 8, 9, 10, 16, 17, 1000)]
    rows = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), pii.Model()).collect()
    for r in rows:
        n = len(texts[r.doc_id].split())
        assert r.spans == ",".join(f"ip:{8 * k}:{8 * k + 7}" for k in range(n))


def test_every_match_is_learnt_from(spark, monkeypatch):
    rows = [(i, f"Write to u{i}@host{i % 7}.org or call +49 30 {1000000 + 7 * i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, examples = [], pii.examples
    monkeypatch.setattr(pii, "examples", lambda found: seen.append({r.kind: r["count"] for r in found.groupBy("kind").count().collect()}) or examples(found))
    model = pii.train(docs, rounds=1, depth=2)
    assert [(x["email"], x["phone"]) for x in seen] == [(900, 900)] and len(model.trees) == 1  # about 400 of each before
