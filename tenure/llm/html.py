"""Main text of HTML pages by nearest-URL page differencing.

Every page is cut into blocks: a small tokenizer follows open elements and
ends a block at every block-level tag.  A block is dropped at once if it stands
in an element that is never main text (menus, headers, footers, sidebars,
forms, scripts, styles) or in one whose class, id or role names a menu, notice,
advert, comment list or the like.  If the page marks its article (article,
main, or such a role or class), the blocks within are its core; else all
blocks left are candidates.

Pages of one host that have the same blocks are taken as one page; the different
pages are ordered by URL path.  Each page's blocks are aligned with those of its
``near`` nearest different pages on both sides by longest common subsequence.
What at least half of those pages share (two of them, if there are two) is stock
text and deleted, whatever its part of the page.  What fewer share is deleted
too, unless one page holds over half of what the stock text leaves: that page is
another version of this one.  A page never loses all its blocks.  A page with a
marked article is only a neighbour: its text is the article, from which
nothing is deleted, as sites repeat sentences that belong to the text.

A page is decided on block hashes alone: the narrow table of hashes is put in
order, cut into runs of ``run`` pages that overlap by ``near`` pages at each
end, and each run is one task's unit, however large its host is.

Defined results for odd input: null or empty html gives an empty text; a null
URL is a page without neighbours; pages with equal URLs are ordered by id, and
repeated rows are one page (but nothing is deleted from pages whose id repeats); a null id is a page of its own;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import cut, small_batches

# Element names of HTML, and words that sites use in class, id and role.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
                  "section summary table tbody td tfoot th thead title tr ul".split())
NEVER = frozenset("nav header footer aside form menu dialog button select textarea label fieldset option iframe object noscript "
                  "template svg canvas audio video head title map datalist".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE_ROLES = frozenset(("main", "article"))
ARTICLE_NAMES = frozenset("article article-body articlebody article-content post post-body post-content entry entry-content "
                          "main main-content maincontent content story story-body".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar "
                       "tablist tooltip status".split())
DROP_NAMES = frozenset("ad ads adsbygoogle adv advert adverts advertisement advertisements advertising adsense adbox banner banners breadcrumb "
                       "breadcrumbs comment comments commentlist cookie cookies consent disclaimer footer form gdpr header masthead "
                       "menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination "
                       "paywall popup promo promoted promotion related recommended replies reply respond responses reviews search "
                       "share sharing sidebar sidebars skip social sponsor sponsored sponsors subscribe subscription tags "
                       "toolbar topbar widget widgets disqus discussion legal copyright aside".split())
#: Those that also make an article element something else, such as a reader's comment.
NOT_ARTICLE = frozenset("ad ads advert advertisement comment comments promo promoted related replies reply response responses review "
                        "reviews sponsored teaser".split())
#: A name with one of these tells what the element goes with, not what it is ("has-sidebar").
ABOUT = frozenset("has no not with without".split())
#: Elements whose ids are slugs of their titles.
TITLED = frozenset("h1 h2 h3 h4 h5 h6 hgroup section".split())
#: Elements that a new element of the listed names ends, as their end tags may be left out.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "tbody", "tfoot")),
    "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option", "optgroup")),
}

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _role(name: str, attrs: str, inside: bool) -> int:
    """0: plain, 1: starts an article, 2: never main text.

    Inside a marked article only a whole class name tells, or a whole id of an
    element that is no heading or section: ids there are often slugs of titles.
    """
    if name in NEVER:
        return 2
    kind = 1 if name in ("article", "main") else 0
    if attrs and ("=" in attrs or "hidden" in attrs):
        for m in _ATTR.finditer(attrs):
            key, raw = m.group(1).lower(), (m.group(2) or "").strip("\"'")
            value = raw.lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _HIDDEN.search(value)):
                return 2
            if key == "role":
                if value in DROP_ROLES:
                    return 2
                if value in ARTICLE_ROLES:
                    kind = 1
            elif key in ("class", "id") and name not in ("body", "html"):
                marked = kind == 1 or any(w in ARTICLE_NAMES for w in value.split())
                drop = NOT_ARTICLE if marked else DROP_NAMES
                for w in raw.split():
                    if inside:
                        if w.lower() in drop and (key == "class" or name not in TITLED):
                            return 2
                        continue
                    parts = {x.lower() for x in _PART.findall(w)}
                    if parts & drop and not parts & ABOUT:
                        return 2
                kind = int(marked)
    return kind


def blocks(html: str | None) -> list[tuple[bool, str]]:
    """(inside a marked article, text) of every block that may be main text, in page order."""
    if not html:
        return []
    out: list[tuple[bool, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements with their role
    opened: Counter = Counter()
    dropped = articles = 0  # open elements of role 2 and 1
    pos = 0
    scan, size = _MARK.search, len(html)

    def end_block() -> None:
        if text:
            s = " ".join(unescape("".join(text)).split())
            text.clear()
            if s:
                out.append((articles > 0, s))

    def close(k: int) -> None:
        nonlocal dropped, articles
        for name, role in stack[k:]:
            opened[name] -= 1
            dropped -= role == 2
            articles -= role == 1
        del stack[k:]

    while pos < size:
        m = scan(html, pos)
        if m is None:
            if not dropped:
                text.append(html[pos:])
            break
        if m.start() > pos and not dropped:
            text.append(html[pos:m.start()])
        pos = m.end()
        name = m.group(2)
        if name is None:
            if html.startswith("<![CDATA[", m.start()) and not dropped:
                text.append(html[m.start() + 9:m.end()].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name, attrs = name.lower(), m.group(3)
        if m.group(1):
            if name in BLOCK:
                end_block()
            for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[k][0] == name:
                    if name in BLOCK or not any(x in BLOCK for x, _ in stack[k + 1:]):
                        close(k)
                    break
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK:
            end_block()
        if name in RAW and not attrs.endswith("/"):
            stop = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(html, pos)
            pos = stop.end() if stop else size
            continue
        if name in VOID or attrs.endswith("/") and name not in BLOCK:
            continue
        for k in range(len(stack) - 1, -1, -1):  # end tags left out
            ends = CLOSED_BY.get(stack[k][0])
            if ends and name in ends:
                close(k)
                break
            if stack[k][0] in BLOCK and not ends:
                break
        role = _role(name, attrs, articles > 0)
        stack.append((name, role))
        opened[name] += 1
        dropped += role == 2
        articles += role == 1
    end_block()
    return out


def core(found: list[tuple[bool, str]]) -> list[str]:
    """The blocks of the marked article, or else all candidates."""
    return [t for inside, t in found if inside] or [t for _, t in found]


def common_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which entries of ``a`` belong to a longest common subsequence of ``a`` and ``b``."""
    keep = np.zeros(len(a), bool)
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        keep[lo] = True
        lo += 1
    ha, hb = len(a), len(b)
    while ha > lo and hb > lo and a[ha - 1] == b[hb - 1]:
        ha, hb = ha - 1, hb - 1
        keep[ha] = True
    ia, ib = np.flatnonzero(np.isin(a[lo:ha], b[lo:hb])) + lo, np.flatnonzero(np.isin(b[lo:hb], a[lo:ha])) + lo
    if not len(ia) or not len(ib):
        return keep
    x, y = a[ia], b[ib]
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x)):
        step = np.where(y == x[i], table[i, :-1] + 1, table[i, 1:])
        table[i + 1, 1:] = np.maximum.accumulate(step)
    i, j = len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1] and table[i, j] == table[i - 1, j - 1] + 1:
            keep[ia[i - 1]] = True
            i, j = i - 1, j - 1
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return keep


def deletions(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Block numbers of a page to delete, given the block hashes of the nearest different pages of its host.

    Shared with at least half of them (two at least, if there are two): stock
    text.  Shared with fewer: stock of a part of the site, unless one of them
    holds over half of what the stock text leaves; that one is another version
    of the page.  A step that would leave nothing is left out.
    """
    shared = [common_rows(own, other) for other in others]
    held = np.sum(shared, axis=0) if shared else np.zeros(len(own), int)
    gone = held >= min(len(others), max(2, len(others) / 2)) if shared else np.zeros(len(own), bool)
    if shared and gone.all():
        gone = held == len(others)
    if gone.all():
        gone = np.zeros(len(own), bool)
    rest = ~gone
    more = gone.copy()
    for x in shared:
        if (x & rest).sum() * 2 <= rest.sum():
            more |= x
    return np.flatnonzero(gone if more.all() else more)


def _hashes(texts: list[str]) -> list[int]:
    from xxhash import xxh3_64_intdigest
    return [xxh3_64_intdigest(t.encode("utf-8", "replace")) - (1 << 63) for t in texts]


def _outline(batches) -> Iterator:
    import pyarrow as pa
    for batch in batches:
        marks, hashes = [], []
        for html in batch.column(3):
            found = blocks(html.as_py())
            marks.append(any(inside for inside, _ in found))
            hashes.append(_hashes([t for _, t in found]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(marks, pa.bool_()),
                                          pa.array(hashes, pa.list_(pa.int64()))], names=["id", "host", "path", "marked", "hashes"])


def _differ(run: int, near: int):
    def diff(batches) -> Iterator:
        """Rows sorted by (run, place): each page of its own run against ``near`` pages before and after it."""
        import pyarrow as pa
        window: deque = deque([None] * near, 2 * near + 1)  # its middle is decided

        def decide() -> list[tuple]:
            row = window[near] if len(window) > 2 * near else None
            if row is None or row[3] or row[1] // run != row[0]:
                return []  # a marked article, or a border page of another run
            others = [x[4] for k, x in enumerate(window) if k != near and x is not None and x[0] == row[0] and x[2] == row[2]]
            gone = deletions(row[4], others)
            return [(row[2], row[5], gone.tolist())] if len(gone) else []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                                               pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["host", "digest", "gone"])
        for batch in batches:
            rows = []
            for *row, hashes, digest in zip(*(batch.column(k).to_pylist() for k in range(6))):
                window.append((*row, np.array(hashes, np.int64), digest))
                rows += decide()
            yield batch_of(rows)
        rows = []
        for _ in range(near):
            window.append(None)
            rows += decide()
        yield batch_of(rows)
    return diff


def _texts(batches) -> Iterator:
    import pyarrow as pa
    for batch in batches:
        out = []
        for html, gone in zip(batch.column(2), batch.column(3).to_pylist()):
            texts = core(blocks(html.as_py()))
            if gone:
                drop = set(gone)
                texts = [t for k, t in enumerate(texts) if k not in drop]
            out.append(" ".join(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = 512,
            near: int = 4) -> DataFrame:
    """(page_id, url, text) of every page."""
    from tenure.functions.ordering import GIDX, global_order
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    host = F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    path = F.regexp_extract("url", r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    outline = cut(rows.filter("id IS NOT NULL AND url IS NOT NULL AND html IS NOT NULL")
                  .select("id", F.lower(host).alias("host"), path.alias("path"), "html")
                  .transform(small_batches).mapInArrow(_outline, "id long, host string, path string, marked boolean, hashes array<long>"))
    # Pages of a host with the same blocks are one page, which stands where the first of them does.
    outline = outline.withColumn("digest", F.xxhash64("marked", "hashes"))
    different = outline.groupBy("host", "digest").agg(F.min(F.struct("path", "id", "marked", "hashes")).alias("page")).select("host", "digest", "page.*")
    placed = global_order(different, ["host", "path", "id", "digest"])
    place = F.col(GIDX)
    # A page also goes to the runs before or after its own if it stands near their border.
    runs = F.sequence(F.floor((place - near) / run), F.floor((place + near) / run))
    spread = placed.select(F.explode(runs).alias("run"), place.alias("place"), "host", "marked", "hashes", "digest")
    gone = cut(spread.repartition("run").sortWithinPartitions("run", "place").transform(small_batches)
               .mapInArrow(_differ(run, near), "host string, digest long, gone array<int>"))
    gone = outline.filter("NOT marked").select("id", "host", "digest").join(gone, ["host", "digest"]).select("id", "gone")
    # Repeated ids: their pages share what is deleted only if they are one row each; else nothing is.
    gone = gone.groupBy("id").agg(F.first("gone").alias("gone"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    joined = rows.join(cut(gone), "id", "left").select("id", "url", "html", "gone")
    return (joined.transform(small_batches).mapInArrow(_texts, "id long, url string, text string")
            .select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
