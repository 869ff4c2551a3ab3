import base64
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenure.llm import html, packing, warc

PAGES = "page_id long, url string, html string, _digest string"


# --- WARC -----------------------------------------------------------------------------------

def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], PAGES)


def test_roundtrip_against_brute_force(spark):
    rows = [(k, f"http://h/{k}", ["same", None, "", "ünï" * 50, "x" * 200_000, f"own {k}"][k % 6]) for k in range(60)]
    got = {r.page_id: r for r in warc.roundtrip(spark, pages(spark, rows)).collect()}
    assert len(got) == 60
    first = {}
    for k, _, h in rows:
        first.setdefault((h or "").encode(), k)
    for k, _, h in rows:
        b = (h or "").encode()
        r = got[k]
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[b] == k else ("revisit", first[b]))


def test_min_payload_nulls_and_repeats(spark):
    rows = [(1, None, "aa"), (2, "u\r\nWARC-Type: x", "aa"), (None, "u", "aa"), (None, "u", "only"), (None, "u", "only"), (7, "u", "bbbb"), (7, "u", "bbbb"), (8, "u", "bbbb")]
    df = pages(spark, rows)
    index = warc.write_archives(df, min_payload=3)
    got = sorted((r.record_id, r.record_type, r.refers_to or "") for r in warc.read_archives(index).collect())
    assert got == sorted([("1", "response", ""), ("2", "response", ""), ("null", "response", ""), ("null", "response", ""), ("null", "response", ""),
                          ("7", "response", ""), ("7", "response", ""), ("8", "revisit", "7")])
    got = sorted((r.record_id, r.record_type) for r in warc.read_archives(warc.write_archives(df)).collect())
    assert got.count(("null", "revisit")) == 1 and ("2", "revisit") in got


def test_random_access_and_many_frames(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k}</p>" * (k + 1)) for k in range(100)]
    index = warc.write_archives(pages(spark, rows), frame_bytes=2000, bundle_bytes=4000)
    idx = index.collect()
    assert len(idx) == 100 and len({r.bundle for r in idx}) > 4 and max(r.frame for r in idx) > 0
    for r in idx[::7]:
        rec = warc.read_record(r.bundle, r.frame_offset, r.frame, r.offset)
        assert rec["record_id"] == r.record_id and rec["payload"].decode() == rows[int(r.record_id)][2]


def test_empty_table(spark):
    assert warc.roundtrip(spark, pages(spark, [])).count() == 0


# --- HTML -----------------------------------------------------------------------------------

@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("a < b", "a < b"), ("<p>one<p>t&eacute;<b>w</b>o&nbsp; x", "one téwo x"),
    ("<nav>menu</nav><article><h1>T</h1><p>a<br>b</p></article><footer>f", "T a b"),
    ("<article>x<div class='ad big'>buy<div>in</div></div>y<div id=comments><p>c</div></article>tail", "x y"),
    ("<body class=has-sidebar><p>k<script>'</p>'</script>eep</p><form>q<input></form><p hidden>no</p>", "keep"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"), ("<!-- <p>x</p> --><p>y", "y"),
    ("<article class='post has-sidebar'><p>a</p><section id=comments><article class=comment>no</article></section></article>"
     "<article class='comment-body'>bad</article>", "a"),
    ("<div class='page with-sidebar'><div class=siteHeader>h</div><p>b</p><ins class=adsbygoogle>x</ins></div>", "b"),
    ("<div role=main><p>m</p><aside>s</aside></div><p>out</p>", "m"),
])
def test_blocks(page, text):
    assert " ".join(html.core(html.blocks(page))) == text


def test_slugs_and_longer_names_inside_an_article_are_text():
    page = ("<article><h2 id=related-work>r</h2><section id=discussion><p id=notice-period>n</p></section><h2 id=search>s</h2>"
            "<p id=copyright-law>c</p><div class='review-summary tags-of-old'>t</div><div class=share>no</div><div id=comments>no</div>"
            "<div role=search>no</div></article>")
    assert " ".join(html.core(html.blocks(page))) == "r n s c t"


def test_common_rows_is_a_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(0, 12)), rng.integers(0, 5, rng.integers(0, 12))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        got = html.common_rows(a, b)
        assert got.sum() == t[-1, -1]
        rest = iter(b.tolist())
        assert all(x in rest for x in a[got].tolist())  # in order, hence a subsequence of b


def test_differencing_by_nearest_url(spark):
    stock = "<div><p>Home of things</p>{}<p>All rights reserved, 2001</p></div>"
    rows = [(k, f"http://Host.example/a/{k:03d}?q={k}", stock.format(f"<p>Text {k}</p><p>More {k}</p><p>End {k}</p>")) for k in range(40)]
    rows += [(100, "http://alone.example/x", stock.format("<p>one</p>")), (101, None, stock.format("<p>two</p>")), (102, "http://host.example/b", None),
             (103, "http://copy.example/1", stock.format("<p>same</p>")), (104, "http://copy.example/2", stock.format("<p>same</p>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("run", F.lit(1))
    got = {r.page_id: r.text for r in html.extract(df, run=8).collect()}
    for k in range(40):
        assert got[k] == f"Text {k} More {k} End {k}"
    whole = "Home of things {} All rights reserved, 2001"
    assert got[100] == whole.format("one") and got[101] == whole.format("two") and got[102] == ""
    assert got[103] == got[104] == whole.format("same")  # copies keep their text
    assert got == {r.page_id: r.text for r in html.extract(df, run=512).collect()}  # whatever the cut


def test_short_pages_and_copies_on_a_template_heavy_host(spark):
    stock = "".join(f"<div>menu {k}</div>" for k in range(6)) + "{}" + "".join(f"<div>foot {k}</div>" for k in range(4))
    page = lambda *own: stock.format("".join(f"<p>{x}</p>" for x in own))
    three = [(f"a {k}", f"b {k}", f"c {k}") for k in range(12)]
    rows = [(k, f"http://short.example/{k:03d}", page(*own)) for k, own in enumerate(three)]
    # A page between copies of itself, and a hot group of copies between two others.
    rows += [(100 + k, f"http://hot.example/m{k:03d}", page("same one", "same two")) for k in range(30)]
    rows += [(200, "http://hot.example/a", page("first")), (201, "http://hot.example/z", page("last"))]
    # Versions of one page that differ in a line keep their text.
    text = [f"line {k}" for k in range(20)]
    rows += [(300 + k, f"http://versions.example/m{k}", page(*text, f"seen {k}")) for k in range(2)]
    rows += [(310 + k, f"http://versions.example/{c}", page(f"own {c}")) for k, c in enumerate("abcxyz")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for run in (4, 8, 512):
        got = {r.page_id: r.text for r in html.extract(df, run=run).collect()}
        assert [got[k] for k in range(12)] == [" ".join(x) for x in three]
        assert {got[100 + k] for k in range(30)} == {"same one same two"} and (got[200], got[201]) == ("first", "last")
        assert [got[300 + k] for k in range(2)] == [" ".join([*text, f"seen {k}"]) for k in range(2)]
        assert [got[310 + k] for k in range(6)] == [f"own {c}" for c in "abcxyz"]


def test_null_and_repeated_ids(spark):
    rows = [(None, "http://h/1", "<p>a</p>"), (5, "http://h/2", "<p>b</p>"), (5, "http://h/2", "<p>b</p>")]
    got = sorted(r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == ["a", "b", "b"]
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- packing --------------------------------------------------------------------------------

TRICKY = ["plain text", "<|endoftext|> inside", "tab\tand  spaces\n\n x", "emoji 😀 ünï ½ ²", "a" * 3000, " " * 900 + "x", "नमस्ते दुनिया", "x­ y\x1cz", "Ω≈ç√ don't I'LL we've"]


@pytest.mark.parametrize("text", TRICKY)
def test_encoding_equals_the_reference_tokenizer(text):
    ref, _ = packing.tokenizers(packing.TOKENIZER, packing.RANKS)
    assert packing.encode(text).tolist() == ref.encode(text, add_special_tokens=False).ids


def test_pack_is_a_partition_without_padding(spark):
    rng = np.random.default_rng(2)
    docs = [(k, " ".join(["w"] * int(n)), "x") for k, n in enumerate(rng.integers(0, 900, 300))]
    docs += [(1000, "long " * 9000, "x"), (1001, None, "x"), (1002, "", "x"), (None, "no id", "x"), (1003, TRICKY[1], "x"), (1003, TRICKY[1], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, start string").repartition(3)
    rows = packing.pack(df, with_ids=True, window=20_000).collect()
    ref, _ = packing.tokenizers(packing.TOKENIZER, packing.RANKS)
    want = {k: [*ref.encode(t or "", add_special_tokens=False).ids, 1] for k, t, _ in docs}
    by_doc, by_seq = {}, {}
    for r in rows:
        assert r.ids == want[r.doc_id][r.start:r.start + r.length] and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length, r.tier, r.step_group))
    for k, spans in by_doc.items():
        times = 2 if k == 1003 else 1
        assert sum(n for _, n in spans) == times * len(want[k])
    steps = {}
    for spans in by_seq.values():
        at = 0
        for off, n, tier, step in sorted(spans):
            assert off == at
            at += n
        assert at == tier and at & (at - 1) == 0 and at <= 2048  # a power of two: no padding
        if step is not None:
            steps.setdefault((step, tier), []).append(at)
    assert all(sum(x) <= 1 << 16 for x in steps.values())
    assert packing.pack(df.limit(0)).count() == 0
