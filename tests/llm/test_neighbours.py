import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tenure.llm import components, embeddings, simhash

random.seed(9)


def components_of(nodes, linked):
    label = dict(zip(nodes, nodes))
    while True:
        new = {a: min([label[a]] + [label[b] for b in linked[a]]) for a in nodes}
        if new == label:
            return label
        label = new


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 200)] + [(300, 500), (301, 500), (302, 500), (7, 7), (None, 3), (900, 901), (901, 900)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {300: 300, 301: 300, 302: 300, 500: 300, 900: 900, 901: 900}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- SimHash --------------------------------------------------------------------------------

def plain_fingerprint(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bits, leaf", [(0, 4), (2, 4), (2, 4096), (5, 16)])
def test_trie_pairs_against_all_pairs(bits, leaf):
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    v = np.unique(np.concatenate([seeds] + [seeds ^ (np.uint64(1) << rng.integers(0, 64, 12, dtype=np.uint64)) for _ in range(9)]))
    got = {(i, j) for a, b in simhash.trie_pairs(v, (0, len(v)), (0, len(v)), 63, bits, leaf) for i, j in zip(a.tolist(), b.tolist())}
    assert got == {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if (int(v[i]) ^ int(v[j])).bit_count() <= bits}
    m = len(v) // 2
    got = {(i, j) for a, b in simhash.trie_pairs(v, (0, m), (m, len(v)), 63, bits, leaf) for i, j in zip(a.tolist(), b.tolist())}
    assert got == {(i, j) for i in range(m) for j in range(m, len(v)) if (int(v[i]) ^ int(v[j])).bit_count() <= bits}


@pytest.mark.parametrize("limit", [100_000, 5])
def test_links_connect_as_all_pairs_do(spark, limit):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1, 1 << 63]
    fps = set(base)
    for x in base[:6]:  # chains and dense groups, with one block the same in many
        for _ in range(40):
            fps.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps |= {base[0] ^ k for k in range(40)}
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash.trie_links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), 2, limit).collect()
    ids = [signed(x) for x in fps]
    for a, b in links:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    near = {signed(x): [signed(y) for y in fps if (x ^ y).bit_count() <= 2] for x in fps}
    own = {x: [] for x in ids}
    for a, b in links:
        own[a].append(b)
        own[b].append(a)
    assert components_of(ids, own) == components_of(ids, near)


def test_classes_against_brute_force(spark):
    words = [f"w{k}" for k in range(300)]
    docs = []
    for k in range(60):
        t = [random.choice(words) for _ in range(120)]
        docs.append((3 * k, " ".join(t)))
        for j in range(k % 3):
            t2 = list(t)
            t2[random.randrange(120)] = "changed"
            docs.append((3 * k + 1 + j, " ".join(t2).upper()))
    docs += [(500, None), (501, ""), (502, " \t"), (503, "one"), (504, "ONE two"), (505, docs[0][1]), (None, docs[0][1]), (None, "nowhere else"), (505, "other text here"), (506, "x y z " * 9000)]
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, fp int")
    got = simhash.classes(df, bits=6).collect()
    fps = {t: plain_fingerprint(t) for _, t in docs}
    assert sorted((r.doc_id is None, r.doc_id, r.fingerprint) for r in got if r.doc_id is not None) == sorted((False, k, f"{fps[t]:016x}") for k, t in docs if k is not None)
    with_id = {fps[t] for k, t in docs if k is not None}
    root = components_of(sorted(with_id), {x: [y for y in with_id if (x ^ y).bit_count() <= 6] for x in with_id})
    lowest = {}
    for k, t in docs:
        if k is not None:
            lowest[root[fps[t]]] = min(k, lowest.get(root[fps[t]], k))
    want = sorted((str(k), f"{fps[t]:016x}", str(lowest.get(root.get(fps[t])))) for k, t in docs)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    kept = [r.doc_id for r in simhash.keep_one(df, bits=6).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(set(lowest.values())) and kept.count(None) == 2
    assert simhash.classes(df.limit(0)).count() == 0


# --- embeddings -----------------------------------------------------------------------------

def test_forest_spans_the_links():
    rng = np.random.default_rng(3)
    for _ in range(50):
        m = rng.random((rng.integers(1, 12), rng.integers(1, 12))) < 0.15
        edges = embeddings.forest(m)
        assert all(m[i, j] for i, j in edges)
        nodes = [("r", i) for i in range(m.shape[0])] + [("c", j) for j in range(m.shape[1])]
        near, own = {x: [] for x in nodes}, {x: [] for x in nodes}
        for target, pairs in ((near, zip(*np.nonzero(m))), (own, edges)):
            for i, j in pairs:
                target[("r", int(i))].append(("c", int(j)))
                target[("c", int(j))].append(("r", int(i)))
        assert components_of(nodes, near) == components_of(nodes, own)
        assert len(edges) == len(nodes) - len(set(components_of(nodes, near).values()))


@pytest.mark.parametrize("per_cell, block", [(2048, 2048), (20, 7)])
def test_links_against_all_pairs(spark, per_cell, block):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(12, 16))
    x = np.concatenate([c + rng.normal(size=(15, 16)) * s for c, s in zip(centre, np.linspace(.05, .6, 12))] + [rng.normal(size=(40, 16))]).astype(np.float32)
    rows = [(int(k), v.tolist(), 0) for k, v in enumerate(x)]
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 0), (901, rows[0][1], 0), (902, [v * 2 for v in rows[0][1]], 0)]
    odd = [(950, None, 0), (951, [], 0), (952, [0.0] * 16, 0), (953, [float("nan")] * 16, 0), (954, [None] + [1.0] * 15, 0), (955, [float("inf")] + [1.0] * 15, 0), (956, rows[0][1][:8], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n int").repartition(3)
    got = embeddings.near_duplicates(df, per_cell=per_cell, block=block).collect()
    v = np.array([r[1] for r in rows], float)
    v /= np.sqrt((v * v).sum(1))[:, None]
    m = v @ v.T >= 0.9
    np.fill_diagonal(m, False)
    label = components_of(list(range(len(rows))), {i: np.flatnonzero(m[i]).tolist() for i in range(len(rows))})
    low = {}
    for i, r in enumerate(rows):
        low[label[i]] = min(r[0], low.get(label[i], r[0]))
    want = sorted((r[0], int(m[i].sum()), low[label[i]], r[0] == low[label[i]]) for i, r in enumerate(rows))
    want += [(k, 0, k, True) for k, _, _ in odd if k is not None]
    assert sorted(tuple(r) for r in got if r.vec_id is not None) == sorted(want)
    assert [tuple(r) for r in got if r.vec_id is None] == [(None, 0, None, True)]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
