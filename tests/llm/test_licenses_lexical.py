"""License scan and lexical search against plain forms."""

import math
import random
import re
from collections import Counter

import pytest

from tenure.llm import lexical, licenses, terms

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_matches(text, wanted):
    """Every block against every template, every place of every phrase."""
    words, out = words_of(text), []
    for t in wanted:
        own = [w.decode() for w in t.words]
        if t.exact:
            out += [(t.label, True, i, i + len(own), 1.0) for i in range(len(words) - len(own) + 1) if words[i:i + len(own)] == own]
            continue
        for s in range(0, len(words), licenses.BLOCK // 2):
            if s and s + licenses.BLOCK // 2 >= len(words):
                continue
            common = len(set(own) & set(words[s:s + licenses.BLOCK]))
            if common >= t.need:
                out.append((t.label, False, s, min(len(words), s + licenses.BLOCK), common / len(set(own))))
    return sorted(out)


def license_texts():
    rng = random.Random(5)
    pool = [w for _, t in licenses.PHRASES + licenses.NOTICES for w in t.split()] + ["lorem", "ipsum", "Étude", "x1"]
    texts = [None, "", " \n", "Released under the MIT License.", "CC-BY-NC cc by nc", "under\nthe\nMIT, license " * 30]
    for _ in range(60):
        words = [rng.choice(pool) for _ in range(rng.choice([3, 40, 200, 700]))]
        for _, t in rng.sample(licenses.NOTICES + licenses.PHRASES, 3):
            own = t.upper().split() if rng.random() < .5 else t.split()
            if rng.random() < .5:
                own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = own
        texts.append(rng.choice([" ", "\n", "-"]).join(words))
    return texts


@pytest.mark.parametrize("segment", [1 << 20, 300])
def test_license_scan_equals_plain_scan(spark, monkeypatch, segment):
    texts = license_texts()
    df = spark.createDataFrame([(i // 2, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, matches string").repartition(3)
    wanted = licenses.templates(threshold=0.8)
    monkeypatch.setattr(licenses, "segments", lambda text, table: terms.segments(text, table, segment))
    got = sorted((r.doc_id, r.n_words, sorted(tuple(m) for m in r.matches)) for r in licenses.find(df, wanted).collect())
    want = sorted((i // 2, len(words_of(t)), plain_matches(t, wanted)) for i, t in enumerate(texts))
    assert got == want
    assert sum(len(m) for _, _, m in want) > 100


def test_license_filters_prune_and_keep():
    """The filters let through no more than a plain count would, and far fewer blocks are counted than compared plainly."""
    wanted = licenses.templates()
    rare_first = licenses.Join(wanted, {w: 1000 - 10 * i for i, w in enumerate(sorted({w for t in wanted for w in t.words}))})
    for t, own in zip(wanted, rare_first.sets):
        assert len([1 for k in rare_first.prefixes.values() for x, _ in k if x == wanted.index(t)]) == len(own) - t.need + 1
    assert rare_first.of_block(sorted(rare_first.sets[5])) and not rare_first.of_block([])


def test_license_report(spark):
    df = spark.createDataFrame([(1, "Under the MIT license; under the MIT license. CC BY-NC"), (2, "This work is licensed under the GNU General Public License."),
                                (3, None), (None, "plain text")], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in licenses.report(licenses.find(df)).collect()}
    assert got == {1: (11, 3, 0, 8, "cc-by-nc,mit", "cc-by-nc,mit", 1.0), 2: (10, 0, None, None, "", "gpl", 1.0), 3: (0, 0, None, None, "", "", 0.0),
                   None: (2, 0, None, None, "", "", 0.0)}
    assert licenses.report(licenses.find(df.limit(0))).collect() == []


def test_license_template_lengths():
    with pytest.raises(ValueError):
        licenses.templates(phrases=[("x", "")])
    with pytest.raises(ValueError):
        licenses.templates(notices=[("x", " ".join(f"w{i}" for i in range(34)))])


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_segments_are_whole_words(size):
    text = "Ab cd  Éfg-hij\n" * 9 + "x" * 40
    assert [w.decode() for part in terms.segments(text.encode(), licenses.TABLE, size) for w in part] == words_of(text)
    assert list(terms.segments(None, licenses.TABLE)) == list(terms.segments(b"", licenses.TABLE)) == []


# --- lexical search -------------------------------------------------------------

def plain_search(docs, items, k):
    counted = [(i, Counter(words_of(t))) for i, t in docs]
    n = sum(bool(c) for _, c in counted)
    total = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counted:
            size = sum(c.values())
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * (75 + 25 * size * n // total)))
                        for t, times in Counter(words_of(text)).items() if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n_docs, n_items):
    rng = random.Random(seed)
    pool = [f"t{int(rng.paretovariate(.5)) % 300}" for _ in range(2000)] + ["Äpfel", "ÉTÉ"]
    texts = [" ".join(rng.choices(pool, k=rng.choice([1, 5, 30, 200]))) for _ in range(n_docs)]
    texts += texts[:20] + [None, "", "!!", "alone"]
    docs = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([1, 4, 25])))) for i in range(n_items)] + [(90, None), (91, "."), (92, "nowhere"), (93, "alone alone")]
    return docs, items


@pytest.mark.parametrize("k, integers", [(5, False), (20, False), (3, True)])
def test_search_equals_plain_search(spark, monkeypatch, k, integers):
    docs, items = corpus(k, 400, 40)
    monkeypatch.setattr(lexical, "GROUP", 128)
    if integers:  # as with values that doubles can't add exactly
        init = lexical.hierarchy
        monkeypatch.setattr(lexical, "hierarchy", lambda v, leaf, dtype: init(v, leaf, int))
    d = spark.createDataFrame([(*r, "s") for r in docs], "doc_id long, text string, score string").repartition(5)
    i = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int")
    got = sorted((tuple(r) for r in lexical.search(d, i, k).collect()), key=str)
    assert got == plain_search(docs, items, k)


def test_search_in_item_blocks_and_odd_rows(spark, monkeypatch):
    docs, items = corpus(9, 60, 12)
    docs += [(None, "t1 t2 t1"), (None, "t1 t2 t1"), (3, "t1 t2 t1")]
    monkeypatch.setattr(lexical, "ITEM_CHARS", 40)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in lexical.search(d, i, 4).collect()), key=str) == plain_search(docs, items, 4)
    assert lexical.search(d.limit(0), i).collect() == [] and lexical.search(d, i.limit(0)).collect() == []


def test_bounds_prune_without_loss():
    """Two languages: pairs of nodes with nothing in common go whole, and fewer pairs are scored than there are."""
    rng = random.Random(1)
    texts = [" ".join(f"{lang}{rng.randrange(200)}" for _ in range(30)) for _ in range(300) for lang in "ab"]
    items_text = [Counter(w.encode() for w in t.split()) for t in texts[:64]]
    held = Counter(w.encode() for t in texts for w in set(t.split()))
    items = lexical.Items(items_text, len(texts), 30 * len(texts), held)
    search = lexical.Search(items, 3)
    vectors = [items.vector(t.encode()) for t in texts]
    for at in range(0, len(texts), 200):
        search.add(list(range(at, at + 200)), vectors[at:at + 200])
    assert search.scored < 0.6 * len(texts) * len(items_text)
    for at, heap in enumerate(search.best):
        own = items_text[items.rows[at]]
        scores = sorted(((sum(math.floor(1000 * math.log((2 * len(texts) + 2) / (2 * held[t] + 1))) * c * dict(zip(*(x.tolist() for x in v))).get(items.vocabulary[t], 0)
                              for t, c in own.items()), -d, d) for d, v in enumerate(vectors)), reverse=True)[:3]
        assert sorted(heap, reverse=True) == scores
