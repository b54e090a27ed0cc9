"""Main text of web pages by markup and nearest-URL page differencing.

Pages are ordered by host and URL path. Each page is paired with the neighbour on its host whose
path is nearest (longest common beginning). The text lines of both are aligned by their longest
common subsequence, and lines that they share are deleted: menus, notices and other furniture that
a site repeats without marking it up.

Differencing runs on every page, and what the neighbour doesn't share stays, inside of an
``article`` element or not. As a check after it, shared lines inside an article are spared: pages
of one site do repeat sentences of their articles (licences, quotations), and deleting those would
lose main text. Elements that name themselves as furniture (navigation, forms, adverts, comments,
...) go in any case. A pair that shares more than ``COPY_SHARE`` of the page's text, and of its
article's if it has one, is a copy and says nothing about furniture; then the neighbour on the
other side takes its place. A page without such a pair is reduced to its article if that holds most
of its text, and else kept whole.

The pages are dealt by ranges of (host, path, page_id), so a host with a third of all pages spreads
over many tasks. The pages on either side of each cut go to both ranges, where the foreign one only
serves as a neighbour: texts don't depend on the number of ranges or on where the cuts fall.

Edge cases: null or empty html gives an empty text; a null URL is a host of its own without pairs;
malformed markup is read leniently and never fails; the fallback content of objects, media and the
like is read as text; repeated rows are returned each; pages with
one path are ordered by page_id, then by html; an empty table gives an empty result; other columns
are never read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, texts_of

SCHEMA = "page_id long, url string, text string, n_chars long"
COPY_SHARE = 0.6

# HTML's vocabulary.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
ENDS_P = BLOCK - frozenset("br body html head title option optgroup".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp template svg".split())
FURNITURE = frozenset("nav footer aside form header menu dialog button select datalist label input fieldset".split())
# An end tag may be left out before one of these.
SIBLINGS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
SCOPES = frozenset("ul ol dl table select div section article main body".split())
# Words by which classes, ids and roles name furniture.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promos promotion cookie cookies "
    "consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login sidebar sidenav widget widgets menu "
    "menus nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus reply replies respond share sharing social "
    "related recommended recommendations pagination pager search searchbox toolbar skip masthead topbar header contentinfo complementary "
    "alert alertdialog dialog form hidden sr".split()
)
#: An article or main element is furniture by these alone.
NAMED_ARTICLE = frozenset("ad ads advert advertisement sponsor sponsored promo comment comments reply replies related recommended".split())
# Inside an article only whole class names count: these, and the words above.
COMPOUND = frozenset(
    "ad-slot ad-unit ad-container ad-box comment-list comment-form comment-section comments-section comments-area share-buttons share-bar "
    "social-share social-links related-posts related-articles newsletter-signup newsletter-form cookie-notice cookie-banner".split()
)
MAIN_ROLES = frozenset("main article".split())

# A tag's quoted values may hold ">". Possessive, so a quote that never closes fails at once.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")


class Line:
    __slots__ = ("text", "article")

    def __init__(self, text: str, article: bool):
        self.text, self.article = text, article


def _named(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element's attributes call it furniture, and whether they call it the article.

    Attributes are read one by one, so neither a value nor a longer name passes for one of them.
    ``inside``: of an article, where only whole class names count.
    """
    main = False
    if "=" not in attributes and "hidden" not in attributes:
        return False, False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, False
        elif name in ("class", "id", "role"):
            words = {w.lower() for w in (value.split() if inside else SPLIT.split(value))}
            if words & (NAMED_ARTICLE if tag in MAIN_ROLES else NAMED) or inside and words & COMPOUND:
                if tag not in ("body", "html"):
                    return True, False
            main = main or name == "role" and bool(words & MAIN_ROLES)
    return False, main


def lines_of(html: str | None) -> list[Line]:
    """The blocks of a page that aren't marked as furniture, in page order."""
    html = html or ""
    out: list[Line] = []
    buffer: list[str] = []
    # Open elements: (tag, furniture at or above it, article at or above it).
    stack: list[tuple[str, bool, bool]] = []
    opened: Counter[str] = Counter()  # so that a stray end tag costs nothing
    dropped = inside = False

    def close_block() -> None:
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.append(Line(text, inside))

    def pop_to(depth: int) -> None:
        nonlocal dropped, inside
        for tag, _, _ in stack[depth:]:
            opened[tag] -= 1
        del stack[depth:]
        _, dropped, inside = stack[-1] if stack else ("", False, False)

    at, end = 0, len(html)
    while at < end:
        m = TAG.search(html, at)
        if m is None:
            if not dropped:
                buffer.append(html[at:])
            break
        if not dropped and m.start() > at:
            buffer.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if tag in BLOCK:
            close_block()
        if closing:
            if opened[tag]:
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                if any(t in BLOCK for t, _, _ in stack[depth:]):
                    close_block()
                pop_to(depth)
            continue
        if tag in RAW and not attributes.endswith("/"):
            found = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = found.end() if found else end
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in ENDS_P and opened["p"] or tag in SIBLINGS:
            ends = SIBLINGS.get(tag, frozenset()) | (frozenset(["p"]) if tag in ENDS_P else frozenset())
            depth = len(stack) - 1
            while depth >= 0 and stack[depth][0] not in SCOPES:
                if stack[depth][0] in ends:
                    close_block()
                    pop_to(depth)
                    if tag not in SIBLINGS:
                        break
                depth -= 1
        furniture, main = _named(tag, attributes, inside)
        if tag in FURNITURE and not (tag == "header" and inside):
            furniture = True
        close = tag in BLOCK or furniture
        if close:
            close_block()
        stack.append((tag, dropped or furniture, inside or (tag == "article" or main) and not furniture))
        opened[tag] += 1
        _, dropped, inside = stack[-1]
    close_block()
    return out


def common_lines(a: list, b: list) -> list[bool]:
    """Which items of ``a`` lie on a longest common subsequence with ``b``.

    Lengths come from bit vectors, a machine word for every 64 items, and the path from halving
    ``a`` again and again, so memory stays linear in the items however long the pages are.
    """
    there, mine = set(b), set(a)
    keep_a = [i for i, x in enumerate(a) if x in there]
    out = [False] * len(a)
    hits = _lcs([a[i] for i in keep_a], [x for x in b if x in mine])
    for i, hit in zip(keep_a, hits, strict=True):
        out[i] = hit
    return out


def _prefix_lengths(a: list, b: list) -> list[int]:
    """Length of the longest common subsequence of ``a`` and each prefix of ``b``."""
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    zeros = [c == "0" for c in reversed(f"{v:0{len(b)}b}")] if b else []
    return [0, *accumulate(zeros)]


def _lcs(a: list, b: list) -> list[bool]:
    out = [False] * len(a)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        s, e, t, f = todo.pop()
        while s < e and t < f and a[s] == b[t]:
            out[s] = True
            s, t = s + 1, t + 1
        while s < e and t < f and a[e - 1] == b[f - 1]:
            out[e - 1] = True
            e, f = e - 1, f - 1
        if s == e or t == f:
            continue
        if e - s == 1:
            out[s] = a[s] in b[t:f]
            continue
        mid = (s + e) // 2
        left = _prefix_lengths(a[s:mid], b[t:f])
        right = _prefix_lengths(a[mid:e][::-1], b[t:f][::-1])[::-1]
        cut = max(range(len(left)), key=lambda k: left[k] + right[k])
        todo += [(s, mid, t, t + cut), (mid, e, t + cut, f)]
    return out


def main_text(lines: list[Line], *neighbours: list[Line] | None) -> str:
    """Lines in page order, without the undeclared furniture that the first neighbour shares that isn't a copy."""
    for other in neighbours:
        if other:
            shared = common_lines([x.text for x in lines], [x.text for x in other])
            if not _copied(lines, shared):
                return " ".join([x.text for x, s in zip(lines, shared, strict=True) if x.article or not s])
    article = [x.text for x in lines if x.article]
    if 2 * sum(map(len, article)) > sum(len(x.text) for x in lines):
        return " ".join(article)
    return " ".join([x.text for x in lines])


def _copied(lines: list[Line], shared: list[bool]) -> bool:
    """Whether too much is shared, of the page and of its article, for the rest to be another page."""
    both = list(zip(lines, shared, strict=True))
    for part in (both, [(x, s) for x, s in both if x.article]):
        total, lost = sum(len(x.text) for x, _ in part), sum(len(x.text) for x, s in part if s)
        if part and lost <= COPY_SHARE * total:
            return False
    return True


def nearest(path: str, before: str | None, after: str | None) -> bool:
    """Whether the page before shares a longer beginning of its path than the one after."""

    def shared(other: str) -> int:
        n = min(len(path), len(other))
        return next((i for i in range(n) if path[i] != other[i]), n)

    return after is None or before is not None and shared(before) >= shared(after)


def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages sorted by range, host and path, each against its nearest neighbour; holds three pages' lines.

    Rows that aren't the range's own are neighbours only and give no result.
    """
    before = here = None
    done: list[tuple] = []

    def settle(page, left, right):
        page_id, url, place, path, lines, own = page
        if not own:
            return
        # A neighbour is of the same range and host.
        left = left if left and place[1] is not None and left[2] == place else None
        right = right if right and place[1] is not None and right[2] == place else None
        both = (left, right) if left and nearest(path, left[3], right and right[3]) else (right, left)
        text = main_text(lines, *[n and n[4] for n in both])
        done.append((page_id, url, text, len(text)))

    def flush() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
        columns = [pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    for batch in batches:
        for row in zip(*[batch.column(i) for i in range(7)], strict=True):
            page_id, url, html, host, path, part, own = (x.as_py() for x in row)
            new = (page_id, url, (part, host), path, lines_of(html), own)
            if here:
                settle(here, before, new)
            before, here = here, new
            if len(done) >= 1000:
                yield flush()
    if here:
        settle(here, before, None)
    if done:
        yield flush()


ORDER = ("host", "path", "page_id")
#: Bytes of html for each range, about.
RANGE_BYTES = 64 << 20
#: Keys drawn for each range to find the cuts: what the driver holds grows with the ranges only.
DRAWN = 20


def sortable(host: str | None, path: str | None, page_id: int | None) -> tuple:
    """A key that Python orders as Spark orders (host, path, page_id): nulls first, text by code points."""
    return (host is not None, host or "", path is not None, path or "", page_id is not None, page_id or 0)


def cuts(keys: DataFrame, ranges: int, total: int) -> list[tuple]:
    """At most ``ranges`` - 1 sorted keys, each the first of a range, from keys drawn by their hash."""
    share = min(1.0, DRAWN * ranges / max(total, 1))
    drawn = F.pmod(F.xxhash64(*ORDER), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)
    found = sorted(sortable(*r) for r in keys.filter(drawn).distinct().collect())
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []


def deal(keyed: DataFrame, ranges: int, total: int) -> DataFrame:
    """Adds ``range`` and ``own``; a page at a cut also has a row for the range beyond it, not its own."""
    spark = keyed.sparkSession
    keys = keyed.select(*ORDER)
    bounds = spark.sparkContext.broadcast(cuts(keys, ranges, total))  # at most a key for each range

    @F.arrow_udf("int")
    def place(host: pa.Array, path: pa.Array, page_id: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds.value, k) for k in _keys(host, path, page_id)], pa.int32())

    first = F.struct(*ORDER)
    ends = keys.withColumn("range", place(*ORDER)).groupBy("range").agg(F.min(first).alias("low"), F.max(first).alias("high"))
    ends = ends.orderBy("range").collect()  # a row for each range
    beyond: dict[tuple, list[int]] = {}
    for left, right in zip(ends, ends[1:], strict=False):
        beyond.setdefault(sortable(*left["high"]), []).append(right["range"])
        beyond.setdefault(sortable(*right["low"]), []).append(left["range"])
    others = spark.sparkContext.broadcast(beyond)  # two for each range at most

    @F.arrow_udf("array<int>")
    def places(host: pa.Array, path: pa.Array, page_id: pa.Array) -> pa.Array:
        found = [[bisect_right(bounds.value, k), *others.value.get(k, ())] for k in _keys(host, path, page_id)]
        return pa.array(found, pa.list_(pa.int32()))

    columns = keyed.columns
    dealt = keyed.select(*columns, F.posexplode(places(*ORDER)).alias("at", "range"))
    return dealt.select(*columns, "range", (F.col("at") == 0).alias("own"))


def _keys(*columns: pa.Array) -> Iterator[tuple]:
    return (sortable(*key) for key in zip(*[c.to_pylist() for c in columns], strict=True))


def extract(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    ``ranges`` defaults to the shuffle partitions, or more if the pages' bytes need more.
    """
    total, size = pages.agg(F.count(F.lit(1)), F.sum(F.octet_length("html"))).first()
    ranges = ranges or max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // RANGE_BYTES))
    rest = F.regexp_replace(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    keyed = pick(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long"),
        "url",
        "html",
        F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0)).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    dealt = deal(keyed, ranges, total).repartitionById(ranges, F.col("range"))
    return texts_of(dealt.sortWithinPartitions("range", *ORDER, "html"), "*").mapInArrow(difference, SCHEMA)
