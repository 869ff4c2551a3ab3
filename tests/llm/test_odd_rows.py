"""Rows that share an id but not a text, and columns with the operators' own names."""

from tenure.llm import pii, quality, simhash, suffix


def words(k, n=40):
    return " ".join(f"w{k}x{i}" for i in range(n))


def test_keep_one_decides_by_id_and_text(spark):
    a, b, c, d = (words(k) for k in "abcd")
    df = spark.createDataFrame([(1, a, "m"), (2, a, "n"), (2, b, "o"), (3, c, "p"), (3, d, "q"), (4, d, "r"), (None, a, "s"), (3, c, "p")],
                               "doc_id long, text string, key string")
    got = sorted((str(r.doc_id), r.text, r.key) for r in simhash.keep_one(df).collect())
    assert got == sorted([("1", a, "m"), ("2", b, "o"), ("3", c, "p"), ("3", d, "q"), ("None", a, "s")])


def test_passages_of_unclear_ids_stay(spark):
    shared = words("s", 60)
    rows = [(1, shared + " " + words("a")), (2, shared + " " + words("b")), (2, words("c", 120)), (3, words("d") + " " + shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in suffix.without_passages(df, suffix.repeated_passages(df, min_words=20, gram=10)).collect()}
    assert got == {rows[0], rows[1], rows[2], (3, words("d") + " ")}


def test_redact_passes_clashing_columns(spark):
    plain = spark.createDataFrame([(i, f"mail a{i}@b.co and 10.0.0.{i}, order 4111 1111 1111 1111") for i in range(40)], "doc_id long, text string")
    model = pii.train(plain)
    df = spark.createDataFrame([(1, "to a@b.co", "u", "v", "w", 5)], "doc_id long, text string, _t string, spans string, base string, _b int")
    assert [tuple(r) for r in pii.redact(df, model).collect()] == [(1, "to [EMAIL]", "u", "v", "w", 5)]
    found = pii.find(df, model, spans_col="found").first()
    assert (found._t, found.spans, found._b, len(found.found)) == ("u", "v", 5, 1)


def test_training_rows_are_bounded(spark):
    """An id with very many texts gives no more rows than the bound."""
    ids = [i for i in range(200)]
    docs = spark.createDataFrame([(i % 50, words(i, 12)) for i in ids] + [(7, words(9)) for _ in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    seen = []
    import numpy as np
    real = quality.ftrl

    def count(rows, labels, bits, *args, **kwargs):
        w = np.zeros((1 << bits) + 1)
        w[:len(rows)] = 1.0
        return w
    quality.ftrl = count
    try:
        seen = quality.fit(docs, labels, max_rows=16)
    finally:
        quality.ftrl = real
    assert 0 < seen.sum() <= 16
