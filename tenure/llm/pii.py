"""Personal data: candidate generators, boosted trees, calibrated thresholds.

Everything runs on DataFrame functions; rows are never shuffled or exploded on
the main path.

* Generators are patterns of high recall; their matches may overlap.  The four
  base patterns also decide by rule (IP parts, card check digit, phone length),
  and what passes is always kept.
* The other patterns are wide: written-out and spaced addresses, IPs with
  masked dots, any run of 7 to 19 digits with separators, whole words of
  digits (a base run that joins two numbers fails as one), credentials.
* Every match becomes a candidate with format features (digits, separators,
  groups, check digit, largest part) and context features (characters and
  key words before and after it).
* Gradient-boosted trees learn from examples that the corpus gives: base
  matches that pass, in their own form and rewritten into others, in their
  contexts, are positive.  Negative are base matches that fail, look-alikes
  (addresses without a domain, dotted numbers of other lengths, dates), the
  same numbers with a wrong check digit or part, regrouped as years, dates or
  thousands, or placed after words such as "order no." and "version".
  Credentials are positive after an assignment to a name like "token" or with
  a known beginning, and negative elsewhere, also behind "commit" or "sha1".
* Training takes the examples of all documents and matches.  Equal rows of
  features become one row with their number, so that the fit grows with the
  different rows only; what is frequent weighs less, so that ``train_spans``
  matches' weight is shared by the kinds and labels.
* A quarter of the documents is held back to calibrate: each kind's threshold
  lies midway between the lowest score with a precision of at least
  ``precision`` from there up and the next score below (and at 0.5 or more).
* Candidates of the other patterns above their kind's threshold are added,
  unless they overlap a base span of any kind or a better added one.

The trees are turned into nested SQL conditions and evaluated inside array
functions, so scoring is one pass.

Patterns are written so that matching is linear: a run is entered only at its
first character (or where the last match ended) and repeated groups are
possessive, which changes no match.

Defined results for odd input: a null text is empty; no matches give zero
counts and empty lists; a null id stays null (and isn't learnt from); repeated
rows are treated one by one; without both classes among the training
candidates nothing is added to the base spans; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import cut, free_name

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans that only the trees find: listed after the others.
EVERY = KINDS + ("secret",)

# The base patterns in linear form.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: (kind, pattern) of further candidates: decided by the trees.
OTHER = (
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++(?: ?[(\[{]at[)\]}] ?| at )[a-z0-9-]++"
              r"(?:(?:\.| ?[(\[{]dot[)\]}] ?| dot )[a-z0-9-]++)++"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?@ ?[A-Za-z0-9-]++(?: ?\. ?[A-Za-z0-9-]++)++"),
    ("ip", r"(?i)(?<![0-9.])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)| \. | ?[(\[]dot[)\]] ?| dot )[0-9]{1,3}+){3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[./_ -]{1,3}[0-9]{4}){3}(?:[./_ -]{1,3}[0-9]{1,3})?(?![0-9])"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{16,19}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9+])\+[0-9]{1,3} ?\([0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"),
    ("phone", r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ ./-])[0-9]{3}[ ./-][0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9])00[1-9][0-9]{0,2}[ .-][0-9][ ().0-9-]{5,14}[0-9](?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z.+-])[0-9]{2,5}(?:[ ./-][0-9]{2,5}){1,4}(?![0-9A-Za-z])"),
    ("secret", r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*[0-9])(?=[0-9_+/=-]*[A-Za-z])[A-Za-z0-9_+/=-]{16,}+"),
)
#: (kind, pattern) of look-alikes: negative examples.
DECOY = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?!\.?[A-Za-z0-9-])"),
    ("ip", r"(?<![0-9.])[0-9]++\.[0-9]++\.[0-9]++(?![0-9.])|(?<![0-9.])[0-9]++(?:\.[0-9]++){4,}+"),
    ("phone", r"(?<![0-9])[12][0-9]{3}[-./][0-9]{1,2}[-./][0-9]{1,2}(?![0-9])|(?<![0-9])[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{2,4}(?![0-9])"),
)
PART_255 = "^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"

SPAN = "array<struct<start:int,end:int,hit:string>>"


# --- matches and their places ---------------------------------------------------------------

def _worth(kind: str, pattern: str, text: Column, digit: Column) -> Column:
    """A cheap test without which the pattern doesn't match."""
    if kind != "email":
        return digit
    return text.contains("@") if "@" in pattern else text.rlike(r"(?i)[(\[{]at[)\]}]|\sdot\s|[(\[{]dot[)\]}]")


def _locate(hits: Column, parts: Column) -> Column:
    """Places of the matches: texts between them and matches take turns.

    Appending copies an array, so n matches are placed in about sqrt(n) blocks of as many.
    """
    n = F.size(hits)
    block = F.ceil(F.sqrt(n)).cast("int")

    def one(acc, k):
        start = acc["pos"] + F.length(F.get(parts, k))
        hit = F.get(hits, k)
        end = start + F.length(hit)
        return F.struct(end.alias("pos"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), hit.alias("hit"))).alias("out"))

    def some(acc, b):
        at = F.coalesce(F.get(acc, F.size(acc) - 1)["pos"], F.lit(0))
        return F.array_append(acc, F.aggregate(F.sequence(b * block, F.least((b + 1) * block, n) - 1),
                                               F.struct(at.alias("pos"), F.array().cast(SPAN).alias("out")), one))
    blocks = F.aggregate(F.sequence(F.lit(0), F.ceil(n / block).cast("int") - 1), F.array().cast(f"array<struct<pos:int,out:{SPAN}>>"), some)
    return F.when(n > 0, F.flatten(F.transform(blocks, lambda b: b["out"]))).otherwise(F.array().cast(SPAN))


def _with_places(df: DataFrame, text: str, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds for every name an array of (start, end, hit) of the (kind, pattern)'s matches in column ``text``."""
    col, none = F.col(text), F.array().cast("array<string>")
    digit = free_name(df, "_digit")
    df = df.withColumn(digit, col.rlike("[0-9]"))
    df = df.withColumns({f"h_{n}": F.when(_worth(kind, p, col, F.col(digit)), F.regexp_extract_all(col, F.lit(p), F.lit(0))).otherwise(none)
                         for n, (kind, p) in patterns.items()})
    df = df.withColumns({f"p_{n}": F.when(F.size(f"h_{n}") > 0, F.split(col, p, -1)).otherwise(none)
                         for n, (_, p) in patterns.items()})
    return df.withColumns({n: _locate(F.col(f"h_{n}"), F.col(f"p_{n}")) for n in patterns}) \
        .drop(digit, *[f"{x}_{n}" for n in patterns for x in "hp"])


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right (digits as text, at least one)."""
    turned = F.reverse(digits)

    def add(acc, k):
        d = F.substring(turned, k, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(k % 2 == 1, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _passes(kind: str, hit: Column) -> Column:
    """The base rule of a kind."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(hit, "[.]"), lambda x: x.rlike(PART_255))
    n = F.length(_digits(hit))
    if kind == "phone":
        return n.between(8, 15)
    return F.when(n.between(16, 19), _luhn(_digits(hit))).otherwise(F.lit(False))


# --- features -------------------------------------------------------------------------------

#: Words that announce a kind, looked for before a match (any case).
HINTS = {
    "email": "mail|contact|write|correo|courriel",
    "ip": r"\bip\b|host|server|address|addr",
    "card": "card|visa|master|credit|debit|karte|tarjeta|carte",
    "phone": r"phone|tel\b|tel\.|call|mobile|fax|telefon|telefono",
    "secret": r"token|secret|passw(?:or)?d|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|bearer|credential",
}
#: Words before numbers that are no personal data, and how well-known credentials begin.
AGAINST = (r"(?:\b(?:version|v|order|invoice|isbn|serial|build|release|id|article|part|page|commit|sha-?[0-9]*|md5|checksum|digest|hash|etag|uuid"
           r"|no|nr)|#)[ .:=#\"']*$")
ASSIGNED = rf"(?:{HINTS['secret']})[\"']?\s*(?:[:=]|=>|\bis\b|\s)\s*[\"']?$"
KNOWN_SECRET = r"^(?:AKIA[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{36,}$|sk-[A-Za-z0-9_-]{20,}$|xox[abprs]-)"
DATE = (r"^(?:(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:(?:19|20)[0-9]{2}|[0-9]{2})"
        r"|(?:19|20)[0-9]{2}[-/ ](?:19|20)[0-9]{2})$")


def features(kind: Column, hit: Column, before: Column, after: Column) -> list[Column]:
    """Format and context features of a candidate, as doubles; a format feature is 0 for kinds that it says nothing about."""
    email, ip, card, phone, secret = (kind == k for k in EVERY)
    number = card | phone
    digits = _digits(hit)
    n_digits = F.length(digits)
    hinted = F.lit(False)
    for k in EVERY:
        hinted = hinted | ((kind == k) & before.rlike("(?i)" + HINTS[k]))
    groups = F.filter(F.split(hit, "[^0-9]+"), lambda x: x != "")
    widest = F.aggregate(groups, F.lit(0), lambda a, x: F.greatest(a, F.length(x)))
    narrow = F.aggregate(groups, F.lit(99), lambda a, x: F.least(a, F.length(x)))
    kinds = F.array_distinct(F.split(F.regexp_replace(hit, "[0-9]", ""), ""))
    return [F.when(of, x.cast("double")).otherwise(F.lit(0.0)) for of, x in (
        *[(F.lit(True), x) for x in (email, ip, card, phone, secret)],
        (email, hit.rlike("(?i)@|[(\\[{]at[)\\]}]")), (email, hit.rlike("(?i)(?:[.]|[(\\[{ ]dot[)\\]} ]) ?[a-z]{2,}$")),
        (email, hit.rlike("[^ ][.] ")), (email, hit.rlike("[(\\[{]|(?i: dot )")),
        (ip, F.size(groups)), (ip, F.forall(groups, lambda x: x.rlike(PART_255))),
        (card, n_digits.between(16, 19) & _luhn(digits)), (phone, hit.startswith("+") | hit.startswith("00")), (phone, hit.rlike(r"\(")),
        (phone, hit.rlike(DATE)), (phone, hit.startswith("0") | hit.startswith("(0")), (phone, F.length(F.get(groups, F.lit(0)))),
        (phone, F.length(F.get(groups, F.size(groups) - 1))),
        (number, n_digits), (number, F.size(groups)), (number, widest), (number, narrow), (number, hit.rlike("[ ().-]")), (number, F.size(kinds)),
        (secret, F.length(hit)), (secret, n_digits), (secret, hit.rlike(KNOWN_SECRET)), (secret, before.rlike("(?i)" + ASSIGNED)),
        (F.lit(True), before.rlike("[A-Za-z0-9]$")), (F.lit(True), after.rlike("^[A-Za-z0-9]")), (F.lit(True), before.rlike("[-./:=\"'#]$")),
        (F.lit(True), hinted), (F.lit(True), before.rlike("(?i)" + AGAINST)))]


N_FEATURES = 33


# --- examples -------------------------------------------------------------------------------

def _grouped(digits: Column, size: int, mark: str) -> Column:
    return F.regexp_replace(digits, f"([0-9]{{{size}}})(?=[0-9])", f"$1{mark}")


def _forms(kind: str, hit: Column) -> list[Column]:
    """A passing base match of the kind in other forms (null if it has no such form)."""
    digits = _digits(hit)
    if kind == "email":
        user, domain = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1)
        return [F.concat(user, F.lit(at), F.replace(domain, F.lit("."), F.lit(dot)))
                for at, dot in ((" (at) ", " (dot) "), ("[at]", "."), ("{at}", "{dot}"), (" at ", " dot "), (" AT ", " DOT "), (" @ ", " . "), (" @ ", "."))]
    if kind == "ip":
        return [F.replace(hit, F.lit("."), F.lit(dot)) for dot in ("[.]", "(.)", " . ", " dot ", "[dot]")]
    if kind == "card":
        return [digits, *[_grouped(digits, 4, mark) for mark in (".", "/", "_", "  ", " - ")]]
    ten = F.when(F.length(digits) >= 10, F.right(digits, F.lit(10)))
    a, b, c = F.substring(ten, 1, 3), F.substring(ten, 4, 3), F.substring(ten, 7, 4)
    return [F.concat(F.lit("+1 ("), a, F.lit(") "), b, F.lit("-"), c), F.concat(F.lit("("), a, F.lit(") "), b, F.lit("-"), c),
            *[F.concat_ws(mark, a, b, c) for mark in ("-", ".", " ", "/")],
            F.concat(F.lit("0049 "), F.substring(ten, 1, 3), F.lit(" "), F.substring(ten, 4, 7)),
            F.concat(F.lit("0"), F.substring(ten, 1, 1), F.lit(" "), _grouped(F.substring(ten, 3, 8), 2, " ")),
            F.concat(F.lit("0"), F.substring(ten, 1, 3), F.lit("/"), F.substring(ten, 4, 6))]


def _spoiled(kind: str, hit: Column) -> list[tuple[Column, str | None]]:
    """(look-alike made of a passing base match, what stands before it or None for its own context)."""
    digits = _digits(hit)
    if kind == "email":
        user, word = F.substring_index(hit, "@", 1), F.substring_index(F.substring_index(hit, "@", -1), ".", 1)
        return [(F.concat(user, F.lit(" @ "), word, F.lit(". The")), None), (F.concat(user, F.lit(" @ 5. "), word), None),
                (F.concat(user, F.lit(" at "), word, F.lit(".5")), None)]
    if kind == "ip":
        wrong = F.concat(F.lit("3"), F.right(F.lpad(F.substring_index(hit, ".", 1), 2, "0"), F.lit(2)), F.lit("."), F.substring_index(hit, ".", -3))
        return [(f, None) for f in _forms(kind, wrong)] + [(f, "in version ") for f in _forms(kind, hit)[:3]]
    if kind == "card":
        wrong = F.concat(F.left(digits, F.length(digits) - 1), ((F.right(digits, F.lit(1)).cast("int") + 3) % 10).cast("string"))
        return [(f, None) for f in _forms(kind, wrong)] + [(f, "order no. ") for f in _forms(kind, wrong)[:2]]
    before = ("order no. ", "invoice #", "version ", "isbn ", "serial: ", "part nr. ")
    numbers = [(f, before[k % len(before)]) for k, f in enumerate(_forms(kind, hit)[1:])]
    long = F.rpad(digits, 16, "5049")  # more digits than a phone number has
    numbers += [(_grouped(long, 4, mark), None) for mark in (" ", "/", ".", "-")] + [(_grouped(long, 5, " "), None)]
    d = F.right(digits, F.lit(8))
    pair = [F.substring(d, k, 2) for k in (1, 3, 5, 7)]
    month, day = [F.lpad((F.pmod(x.cast("int"), F.lit(n)) + 1).cast("string"), 2, "0") for x, n in ((pair[0], 12), (pair[1], 28))]
    return numbers + [(x, None) for x in (
        F.concat(F.lit("19"), pair[0], F.lit("-20"), pair[1]), F.concat(F.lit("20"), pair[2], F.lit("-"), month, F.lit("-"), day),
        F.concat(day, F.lit("."), month, F.lit(".20"), pair[2]), F.concat(day, F.lit("/"), month, F.lit("/"), pair[3]),
        F.concat(F.substring(d, 1, 2), F.lit(" "), F.substring(d, 3, 3), F.lit(" "), F.substring(d, 6, 3)),
        F.concat_ws(".", pair[0], pair[1], pair[2]), F.concat_ws("-", pair[0], pair[1]), F.concat_ws("/", F.substring(d, 1, 3), F.substring(d, 4, 3)),
        F.concat_ws(" ", F.substring(d, 1, 4), F.substring(d, 5, 4)))]


def _context(text: Column, s: Column) -> tuple[Column, Column]:
    first = F.greatest(s["start"] - 24, F.lit(0))
    return F.substring(text, first + 1, s["start"] - first), F.substring(text, s["end"] + 1, F.lit(8))


# --- trees ----------------------------------------------------------------------------------

@dataclass
class Model:
    """Boosted trees as nested conditions, and a threshold for every kind."""
    trees: list[tuple[float, object]] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, x: list[Column]) -> Column:
        margin = F.lit(0.0)
        for weight, tree in self.trees:
            margin = margin + F.lit(weight) * _condition(tree, x)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))


def _condition(node, x: list[Column]) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    feature, cutoff, low, high = node
    return F.when(x[feature] <= cutoff, _condition(low, x)).otherwise(_condition(high, x))


def _parse_tree(text: str):
    """A fitted tree's printed form as (feature, cut-off, low branch, high branch) or a leaf's value."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines()[1:] if x.strip()]

    def node(k: int):
        depth, line = lines[k]
        if m := re.match(r"Predict: (\S+)", line):
            return float(m.group(1)), k + 1
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        low, k = node(k + 1)
        if not lines[k][1].startswith("Else"):
            raise ValueError(f"unexpected line in a tree: {lines[k]}")
        high, k = node(k + 1)
        return (int(m.group(1)), float(m.group(2)), low, high), k
    return node(0)[0]


EXAMPLE = "array<struct<y:double,hit:string,before:string,after:string>>"


def matches(documents: DataFrame) -> DataFrame:
    """What examples are made of, one row each: (doc_id, kind, base, y, start, hit, before, after)."""
    patterns = {f"base_{k}": (k, BASE[k]) for k in KINDS} | {f"decoy_{k}": (kind, p) for k, (kind, p) in enumerate(DECOY)}
    patterns |= {f"other_{k}": (kind, p) for k, (kind, p) in enumerate(OTHER) if kind == "secret"}
    df = _with_places(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL"),
                      "text", patterns)
    def labelled(kind: str, base: bool):
        return lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), (_passes(kind, s["hit"]) if base else F.lit(False)).alias("y"),
                                  s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"))
    every = F.concat(*[F.transform(n, labelled(kind, n.startswith("base"))) for n, (kind, _) in patterns.items()])
    one = df.select("doc_id", "text", F.explode(every).alias("c"))
    before, after = _context(F.col("text"), F.col("c"))
    secret = (F.col("c.kind") == "secret") & (before.rlike("(?i)" + ASSIGNED) | F.col("c.hit").rlike(KNOWN_SECRET))
    return one.select("doc_id", "c.kind", "c.base", (F.col("c.y") | secret).alias("y"), "c.start", "c.hit", before.alias("before"), after.alias("after"))


def examples(found: DataFrame) -> DataFrame:
    """Labelled examples with features f0, f1, ...: the matches, and those that pass in other forms and contexts.
    ``of`` is the label of the match that an example is made of."""
    kind, hit, before, after = (F.col(c) for c in ("kind", "hit", "before", "after"))

    def example(y: float, form: Column, lead: str | None = None) -> Column:
        return F.struct(F.lit(y).alias("y"), form.alias("hit"), (before if lead is None else F.lit(lead)).alias("before"), after.alias("after"))
    made = F.array().cast(EXAMPLE)
    for k in KINDS:
        of = [example(1.0, f) for f in _forms(k, hit)] + [example(0.0, f, lead) for f, lead in _spoiled(k, hit)]
        made = F.when((kind == k) & F.col("base"), F.array(*of)).otherwise(made)
    plain = F.rpad(F.regexp_replace(hit, "[^A-Za-z0-9]", "7"), 36, "Q7x3")
    tokens = [example(1.0, f, "and ") for f in (F.concat(F.lit("AKIA"), F.upper(F.left(plain, F.lit(16)))), F.concat(F.lit("ghp_"), plain))]
    tokens += [example(0.0, hit, lead) for lead in ("commit ", "sha1: ", "checksum=", "see /files/")]
    made = F.when(kind == "secret", F.array(*tokens)).otherwise(made)
    own = F.array(F.struct(F.col("y").cast("double").alias("y"), hit.alias("hit"), before.alias("before"), after.alias("after")))
    every = F.filter(F.concat(own, F.when(F.col("y"), made).otherwise(F.array().cast(EXAMPLE))), lambda e: e["hit"].isNotNull())
    one = found.select("doc_id", "start", "kind", F.col("y").alias("of"), F.posexplode(every).alias("form", "e"))
    x = features(F.col("kind"), F.col("e.hit"), F.col("e.before"), F.col("e.after"))
    return one.select("doc_id", "start", "kind", "of", "form", "e.y", *[f.alias(f"f{k}") for k, f in enumerate(x)])


def _distinct_examples(found: DataFrame) -> DataFrame:
    """Different rows (kind, of, y, held, f0, f1, ...) of all examples, and the number ``n`` of each; a quarter of the documents is held back."""
    names = ["kind", "of", "y", "held", *[f"f{k}" for k in range(N_FEATURES)]]
    held = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)) == 0
    rows = examples(found).withColumn("held", held).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    return cut(rows.coalesce(8).sortWithinPartitions(*names))  # few rows, which the fit reads many times


#: Up to this number squared Spark ML takes the cut-offs it tries from all rows, and every value of a feature with fewer values is one.
MAX_BINS = 512


def train(documents: DataFrame, train_spans: int = 4_000, precision: float = 0.99, rounds: int = 12, depth: int = 5) -> Model:
    """Fit trees and thresholds on examples made of all matches in all documents; those of a kind and
    label weigh as much as its share of ``train_spans`` matches at most."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    found = cut(matches(documents.filter("doc_id IS NOT NULL")))
    rows = _distinct_examples(found)
    weight = F.lit(0.0)
    for r in found.groupBy("kind", "y").agg(F.count(F.lit(1)).alias("n")).collect():
        share = min(1.0, train_spans / 2 / len(EVERY) / r.n)
        weight = F.when((F.col("kind") == r.kind) & (F.col("of") == r.y), share).otherwise(weight)
    rows = rows.withColumn("weight", F.col("n") * weight)
    classes = {(r.y, r.held) for r in rows.groupBy("y", "held").count().collect()}
    if not {(0.0, False), (1.0, False)} <= classes:
        return Model()
    names = [f"f{k}" for k in range(N_FEATURES)]
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(rows.filter("NOT held"))
    fitted = GBTClassifier(featuresCol="features", labelCol="y", weightCol="weight", maxIter=rounds, maxDepth=depth, maxBins=MAX_BINS, stepSize=0.3, seed=11,
                           cacheNodeIds=False, checkpointInterval=-1).fit(assembled.select("features", "y", "weight"))
    model = Model([(w, _parse_tree(t.toDebugString)) for w, t in zip(fitted.treeWeights, fitted.trees)])
    held = rows.filter("held").select("kind", "y", "weight", F.round(model.score([F.col(n) for n in names]), 4).alias("score"))
    # Scores of a few trees take few values: one row per kind and value.
    counts = held.groupBy("kind", "score").agg(F.sum(F.col("y") * F.col("weight")).alias("pos"), F.sum("weight").alias("n")).collect()
    for kind in EVERY:
        pos = n = 0.0
        lowest, below = None, 0.0  # accepted down to, and the next score seen under it
        for r in sorted((r for r in counts if r.kind == kind), key=lambda r: -r.score):
            pos, n = pos + r.pos, n + r.n
            if pos / n >= precision and r.score >= 0.5:
                lowest, below = r.score, 0.0
            elif lowest is not None:
                below = max(below, r.score)
        if lowest is not None:
            model.thresholds[kind] = max(0.5, (lowest + below) / 2)
    return model


# --- the operator ---------------------------------------------------------------------------

FOUND = "array<struct<kind:int,start:int,end:int>>"


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def find(documents: DataFrame, model: Model, text_col: str = "text", base_col: str = "base", spans_col: str = "spans") -> DataFrame:
    """``documents`` with two more columns: arrays of (kind number, start, end) in order, of the
    base spans and of all.  A column that already has one of their names is replaced."""
    own = documents.columns
    out = _find(documents.toDF(*[f"c{i}" for i in range(len(own))]), model, f"c{own.index(text_col)}")
    taken = {base_col.lower(), spans_col.lower()}
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own) if c.lower() not in taken],
                      F.col("base").alias(base_col), F.col("spans").alias(spans_col))


def _find(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """As :func:`find`, for a table whose columns clash with none used on the way."""
    keep = documents.columns
    df = documents.withColumn("_t", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = _with_places(df, "_t", {f"_base_{k}": (k, BASE[k]) for k in KINDS})

    def plain(k: int):
        return lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))

    def passing(kind: str):
        return lambda s: _passes(kind, s["hit"])
    df = df.withColumn("_b", F.concat(*[F.transform(F.filter(f"_base_{kind}", passing(kind)), plain(k)) for k, kind in enumerate(KINDS)]))
    used = {f"_other_{k}": (kind, p) for k, (kind, p) in enumerate(OTHER) if kind in model.thresholds}
    added = F.array().cast(FOUND)
    if used:
        df = _with_places(df, "_t", used)
        def candidate(kind: str):
            return lambda s: F.struct(F.lit(EVERY.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"))
        names, cutoffs = F.array(*[F.lit(k) for k in EVERY]), F.array(*[F.lit(float(model.thresholds.get(k, 2.0))) for k in EVERY])
        every = F.concat(*[F.transform(n, candidate(kind)) for n, (kind, _) in used.items()])
        # What overlaps a base span can't be added (a credential may hold a number) and isn't scored.
        df = df.withColumn("_free", F.filter(every, lambda s: (s["kind"] >= len(KINDS)) | ~F.exists(F.col("_b"), lambda b: _overlap(s, b))))
        df = df.withColumn("_scored", F.transform("_free", lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            model.score(features(F.get(names, s["kind"]), s["hit"], *_context(F.col("_t"), s))).alias("score"))))
        df = df.withColumn("_open", F.filter("_scored", lambda s: s["score"] >= F.get(cutoffs, s["kind"])))
        # Best first; a candidate goes only if it overlaps one already added.
        ranked = F.array_sort(F.transform("_open", lambda s: F.struct((-s["score"]).alias("rank"), s["start"].alias("start"), s["kind"].alias("kind"),
                                                                      (-s["end"]).alias("back"), s["end"].alias("end"))))
        df = df.withColumn("_new", F.aggregate(ranked, F.array().cast(FOUND), lambda acc, s: F.when(
            F.exists(acc, lambda o: _overlap(s, o)), acc).otherwise(F.array_append(acc, F.struct(
                s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))).cast(FOUND)))
        added = F.col("_new")
    return df.select(*keep, F.col("_b").alias("base"), F.array_sort(F.concat(F.col("_b"), added)).alias("spans"))


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in EVERY])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``documents`` with every span (overlapping ones joined) replaced by its first kind in brackets.
    All other columns pass unchanged, whatever their names."""
    own = documents.columns
    at = f"c{own.index(text_col)}"
    found = _find(documents.toDF(*[f"c{i}" for i in range(len(own))]), model, at)
    text = F.col(at).cast("string")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in EVERY])
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        new = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(new, F.concat(acc["out"], gap, F.get(names, s["kind"]))).otherwise(acc["out"]).alias("out"))
    done = F.aggregate(order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return found.withColumn(at, F.when(F.size("spans") > 0, done).otherwise(text)).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)])


def report(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (of these four kinds), n_added, n_secret, secrets."""
    found = _find(documents.select("doc_id", "text"), model)

    def of(k: int):
        return lambda s: s["kind"] == k
    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    personal = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    secrets = F.filter("spans", lambda s: s["kind"] >= len(KINDS))
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(personal).alias("spans"),
                        (F.size(personal) - F.size("base")).cast("long").alias("n_added"), F.size(secrets).cast("long").alias("n_secret"),
                        _listed(secrets).alias("secrets"))
