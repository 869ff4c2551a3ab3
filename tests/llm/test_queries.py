"""Registered queries against their SQL, and the pipeline against a plain-Python form."""

import os
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pytest
from test_neighbours import components_of, plain_fingerprint
from test_text import edit_search

import corpus_pipeline
from tenure.llm import decontam, packing, quality
from tenure.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(str(r[k]) for k in order) for r in rows))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())


def test_numbered_queries():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "packing"]


def strip_key(x):
    return x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def plain_pipeline(docs, items, weights):
    """{doc_id: text} after the first four stages."""
    # 1. one document at a time, as a plain sum over its features
    kept = {}
    for k, t in docs.items():
        _, feature, value = quality.sparse_rows([t.encode()], 18)
        margin = weights[-1] + sum(weights[f] * v for f, v in zip(feature.tolist(), value.tolist()))
        if 1 / (1 + np.exp(-margin)) >= 0.3:
            kept[k] = t
    # 2. repeated lines
    holders = {}
    for k, t in kept.items():
        for x in t.split("\n"):
            if len(strip_key(x)) >= 40:
                holders.setdefault(strip_key(x), set()).add(k)
    hot = {x: max(v) for x, v in holders.items() if len(v) >= 5}
    kept = {k: "\n".join(x for x in t.split("\n") if hot.get(strip_key(x), k) == k) for k, t in kept.items()}
    # 3. near duplicates, all pairs
    fps = {k: plain_fingerprint(t) for k, t in kept.items()}
    label = components_of(sorted(fps), {a: [b for b in fps if (fps[a] ^ fps[b]).bit_count() <= 2] for a in fps})
    kept = {k: t for k, t in kept.items() if label[k] == k}
    # 4. benchmark items within a tenth of their characters
    out = {}
    for k, t in kept.items():
        n = decontam.normal(t)
        if not any(x[:12] in n or x[-12:] in n or x[len(x) // 2:][:12] in n for x in items) or not any(
                edit_search(x, n) <= int(.1 * len(x)) for x in items):
            out[k] = t
    return out


def test_pipeline_against_plain_python(spark, tmp_path):
    import pyarrow.parquet as pq
    source = "/root/testdata/sf0.001"
    table = pq.read_table(f"{source}/documents.parquet")
    short = [len(t) < 4000 for t in table["text"].to_pylist()]  # the plain edit distance is slow
    table = table.filter(short)
    pq.write_table(table, tmp_path / "documents.parquet")
    for t in ("labels", "benchmark"):
        shutil.copy(f"{source}/{t}.parquet", tmp_path / f"{t}.parquet")
    docs = dict(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))
    items = [decontam.normal(x) for x in pq.read_table(tmp_path / "benchmark.parquet")["text"].to_pylist()]
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    weights = quality.fit(frame, spark.read.parquet(str(tmp_path / "labels.parquet")))
    want = plain_pipeline(docs, items, weights)
    assert 0 < len(want) < len(docs)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ref, _ = packing.tokenizers(packing.TOKENIZER, packing.RANKS)
    length = {k: len(ref.encode(t, add_special_tokens=False).ids) + 1 for k, t in want.items()}
    got = {}
    for r in pieces:
        assert r.doc_tokens == length[r.doc_id]
        got.setdefault(r.doc_id, []).append((r.start, r.length))
    assert set(got) == set(want)
    for k, spans in got.items():
        assert [a for a, _ in sorted(spans)] == np.cumsum([0] + [n for _, n in sorted(spans)])[:-1].tolist() and sum(n for _, n in spans) == length[k]


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    rows = [(1, None, "x", 0.1), (None, "no id here", "y", 0.2), (2, "", "z", 0.3), (3, "plain words in a line " * 30, "x", 0.4), (3, "plain words in a line " * 30, "x", 0.4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for frame in (docs, docs.limit(0)):
        at = frame
        for name, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, str(tmp_path))
            if name != "packing":
                assert at.columns == docs.columns
        ids = sorted({str(r.doc_id) for r in at.collect()})
        assert ids == ([] if frame is not docs else ["1", "3", "None"])  # 2 has the fingerprint of 1


def test_rest_works_without_this_part(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; assert 'cohort_retention' in e.queries() and not [k for k in e.queries() if k.startswith('op') and k[2].isdigit() or k == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
