"""License scans: an exact set-similarity join of text blocks with license templates.

A document's words are cut into blocks of ``BLOCK`` words that overlap by half,
so every run of up to ``BLOCK // 2 + 1`` words lies inside a block.  A block
matches a template if it holds at least ``threshold`` of the template's distinct
words.  Which blocks to look at follows from one order of all words, rarest
first, by the number of documents of the whole corpus that hold them:

* prefix filter: if ``need`` of a template's ``n`` words must be in a block, the
  rarest ``n - need + 1`` words of the template and the rarest ``m - need + 1``
  template words of the block share one;
* length filter: a block with fewer than ``need`` template words can't match;
* positional filter: a shared word at places i and j of the two orders leaves at
  most ``min(n - i, m - j)`` words in common.

What passes is counted word by word.  Templates that are phrases need all their
words (``need = n``) and are then compared word by word with the block: their
matches are the places where the words stand consecutively.

The templates are few and given by the caller, so tasks take them whole;
documents are read twice, for the word counts and for the join, and never moved.

Defined results for odd input: a null or empty text has no words and no matches;
rows that share an id are separate rows; a long text is read in segments, so what
is held beside it is bounded; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import small_batches
from tenure.llm.terms import segments, word_table

#: Words of a block; the next block begins half a block later.
BLOCK = 64
#: Share of a template's words that a block must hold.
THRESHOLD = 0.9

# Phrases whose exact places count, and the labels they stand for.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# Characteristic sentences of public licenses and notices.
NOTICES = [
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "creative commons attribution noncommercial license"),
    ("cc-by-sa", "creative commons attribution sharealike license"),
    ("gpl", "licensed under the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

MATCHES = "array<struct<label:string,exact:boolean,start:bigint,end:bigint,containment:double>>"
#: Bytes that separate words here: all ASCII but digits and letters.
SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))
TABLE = word_table(SEPARATORS)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    need: int       # distinct words that a block must hold
    exact: bool     # the words must stand consecutively


def templates(phrases=PHRASES, notices=NOTICES, threshold: float = THRESHOLD) -> list[Template]:
    """The templates of (label, text) lists; texts are cut into words like documents."""
    out = []
    for exact, pairs in ((True, phrases), (False, notices)):
        for label, text in pairs:
            words = tuple(text.encode().translate(TABLE).split())
            if not 0 < len(words) <= BLOCK // 2 + 1:
                raise ValueError(f"a template needs 1 to {BLOCK // 2 + 1} words: {text!r}")
            n = len(set(words))
            out.append(Template(label, words, n if exact else max(1, -int(-threshold * n // 1)), exact))
    return out


def word_counts(documents: DataFrame, words: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """Documents of the whole table that hold each of ``words``."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        seen = Counter()
        for b in batches:
            for text in b.column(0).cast(pa.binary()).to_pylist():
                found = set()
                for part in segments(text, TABLE):
                    found |= words.intersection(part)
                seen.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
    rows = documents.select(F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL").transform(small_batches)
    counted = rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counted.collect()}  # a row per word of the templates


class Join:
    """The templates in word order, and the join of one text's blocks with them."""

    def __init__(self, all_templates: list[Template], counts: dict[bytes, int]):
        self.templates = all_templates
        words = sorted({w for t in all_templates for w in t.words}, key=lambda w: (counts.get(w, 0), w))
        self.order = {w: i for i, w in enumerate(words)}
        self.sets = [frozenset(self.order[w] for w in t.words) for t in all_templates]
        self.prefixes: dict[int, list[tuple[int, int]]] = {}  # word -> (template, place in its order)
        for k, (t, own) in enumerate(zip(all_templates, self.sets)):
            for i, w in enumerate(sorted(own)[:len(own) - t.need + 1]):
                self.prefixes.setdefault(w, []).append((k, i))
        self.rare = frozenset(w for w, i in self.order.items() if i in self.prefixes)

    def of_block(self, block: list[int]) -> list[tuple[int, int]]:
        """(template, words in common) of a block's distinct template words in order."""
        m, candidates = len(block), set()
        for j, w in enumerate(block):
            for k, i in self.prefixes.get(w, ()):
                need, n = self.templates[k].need, len(self.sets[k])
                if k not in candidates and m >= need and j <= m - need and min(n - i, m - j) >= need:
                    candidates.add(k)
        found = ((k, len(self.sets[k].intersection(block))) for k in sorted(candidates))
        return [(k, common) for k, common in found if common >= self.templates[k].need]

    def of_words(self, words: list[bytes], base: int, last: bool, places: set, out: list) -> int:
        """Match the blocks of ``words``, of which the first is the text's word number
        ``base``; returns how many words are done (not those of blocks that may go on)."""
        half, n = BLOCK // 2, len(words)
        end = n if last else max(0, (n - BLOCK) // half + 1) * half  # starts of the blocks to match lie before it
        if self.rare.isdisjoint(words):
            return end
        hits = [(i, self.order[w]) for i, w in enumerate(words) if w in self.order]
        at = [i for i, _ in hits]
        starts = sorted({s for i, w in hits if w in self.prefixes for s in (i // half * half, i // half * half - half)
                         if 0 <= s < end and (base + s == 0 or not last or s + half < n)})
        for s in starts:
            inside = hits[bisect_left(at, s):bisect_left(at, s + BLOCK)]
            for k, common in self.of_block(sorted({w for _, w in inside})):
                t = self.templates[k]
                if not t.exact:
                    out.append((t.label, False, base + s, base + min(n, s + BLOCK), common / len(self.sets[k])))
                    continue
                size, first = len(t.words), self.order[t.words[0]]
                for i, w in inside:
                    if w == first and i + size <= s + BLOCK and (k, base + i) not in places and tuple(words[i:i + size]) == t.words:
                        places.add((k, base + i))
                        out.append((t.label, True, base + i, base + i + size, 1.0))
        return end

    def of_text(self, text: bytes | None) -> tuple[int, list]:
        """(number of words, matches) of a whole text."""
        out: list = []
        held, base, places = [], 0, set()
        for part in segments(text, TABLE):
            held += part
            done = self.of_words(held, base, False, places, out)
            base, held = base + done, held[done:]
        self.of_words(held, base, True, places, out)
        return base + len(held), out


def find(documents: DataFrame, all_templates: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, matches): every block of every text that meets a template.

    A match is (label, exact, start, end, containment): words ``start`` to
    ``end`` (exclusive) hold that share of the template's words; for phrases they
    are the phrase, and each place counts once."""
    wanted = templates() if all_templates is None else all_templates
    join = Join(wanted, word_counts(documents, {w for t in wanted for w in t.words}, text_col))

    def run(batches) -> Iterator:
        import pyarrow as pa
        item = pa.struct([("label", pa.string()), ("exact", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())])
        names = [f.name for f in item]
        for b in batches:
            counts, found = [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                n, matches = join.of_text(text)
                counts.append(n)
                found.append([dict(zip(names, m)) for m in matches])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(item))],
                                             names=["doc_id", "n_words", "matches"])
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(small_batches)
    return rows.mapInArrow(run, f"doc_id {documents.schema[id_col].dataType.simpleString()}, n_words long, matches {MATCHES}")


def report(found: DataFrame) -> DataFrame:
    """One row per document of :func:`find`: its phrases' places, its labels and the best containment."""
    places = F.filter("matches", lambda m: m["exact"])

    def joined(matches):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")
    start = F.transform(places, lambda m: m["start"])
    return found.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"), joined(places).alias("base_labels"), joined(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("score"))


def sql(all_templates: list[Template] | None = None) -> str:
    """DuckDB SQL of :func:`report` over ``documents``: every block against every template."""
    wanted = templates() if all_templates is None else all_templates
    rows = ", ".join(f"({k}, '{t.label}', {t.need}, {t.exact}, {i}, '{w.decode()}')" for k, t in enumerate(wanted) for i, w in enumerate(t.words))
    half = BLOCK // 2
    return f"""WITH t(k, label, need, exact, i, word) AS (VALUES {rows}),
w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
u AS MATERIALIZED (SELECT doc_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM w),
h AS (SELECT u.doc_id, u.n, u.pos, t.* FROM u JOIN t USING (word)),
places AS (SELECT doc_id, k, label, pos - i AS start FROM h WHERE exact GROUP BY doc_id, k, label, pos - i
    HAVING count(*) = (SELECT count(*) FROM t x WHERE x.k = h.k)),
b AS (SELECT *, unnest([pos // {half}, pos // {half} - 1]) AS block FROM h WHERE NOT exact),
found AS (SELECT doc_id, k, label, count(DISTINCT word) / (SELECT count(DISTINCT word) FROM t x WHERE x.k = b.k) AS containment FROM b
    WHERE block >= 0 AND (block = 0 OR {half} * block + {half} < n) GROUP BY doc_id, k, label, need, block HAVING count(DISTINCT word) >= need),
p AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
    FROM places GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(containment) AS score
    FROM (SELECT doc_id, label, containment FROM found UNION ALL SELECT doc_id, label, 1.0 FROM places) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN l USING (doc_id)"""
