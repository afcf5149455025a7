"""Main text of web pages: page structure, and differencing against the page with the nearest URL.

A page is cut into lines, one for each block. Lines in boilerplate elements (menus, headers, footers, sidebars,
notices, adverts, forms, comments) are dropped by their markup. Every page that has lines left is differenced: its list
is that of its unmarked lines (neither boilerplate nor in its article), or of all its lines where it leaves none
unmarked; pages of a host with lists of the same kind are ordered by path, then by the rest of the URL and the id; each
is paired with the nearest page before or after it whose list differs, that whose URL shares the longer beginning; the
two lists are aligned by longest common subsequence, and shared lines are deleted.

Then markup checks what was deleted: lines inside the page's article (or main) element are put back, for near copies,
quotations and licence texts stand there on many pages, and differencing would delete what it should find. Within an
article or main element only whole classes mark boilerplate. Articles are taken alone when they hold half of the main
element's text or more; else the main element is taken. On a page whose lines are all in its list, that is judged by
the lines which differencing left, so that cards which a host repeats don't pass for the story; when they are less than
a quarter of the text (near copies), by all of them. Unmarked lines are kept where a paired page shows that they are the
page's own.

Defined cases: null or empty html gives an empty text; unclosed elements end with the page, and a paragraph or list
item where the next block begins; a null URL, or one without ``://``, has an empty host and path, and such pages are
each other's pairs; pages with equal lists (re-crawls, copies) are never each other's pair; of equal lists under one
host and path, the smallest URL and then id (a null id is the smallest) stands for all; a page without a pair keeps its
unmarked lines if it has no article or main text, and drops them if it has; repeated rows give equal texts; an empty table gives an empty result; extra columns of any name are kept, and ``text`` and ``n_chars`` replace
columns of those names.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterable, Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.llm.columns import as_row, row_columns
from siftstone.llm.url_filters import url_parts
from siftstone.session import shared_dir

#: Fixed lists of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()) | frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg object canvas".split())
DROPPED = RAW | frozenset("head nav footer aside form button select option dialog menu audio video map datalist fieldset".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
CLOSED_BY_SAME = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"]), "option": frozenset(["select"])}
#: Words in class and id that mark boilerplate, and roles that do.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices alert notification sidebar sidebars aside rail menu menus nav navbar navigation navigator breadcrumb breadcrumbs share sharing social related recommended recommendations comment comments commentlist disqus respond replies newsletter subscribe subscription signup popup modal overlay footer masthead header topbar toolbar widget widgets pagination pager skip login paywall copyright".split()
)
#: Marks that pages also give to what surrounds the article, and those that an article gives to its own head.
LAYOUT = frozenset("sidebar sidebars aside rail header masthead banner topbar toolbar menu menus nav navbar navigation footer widget widgets overlay".split())
HEADS = frozenset("header masthead banner".split())
#: Words that a class in an article may have besides marks and still be a mark as a whole (``ad-slot``, ``comment-list``).
PLACES = frozenset("slot unit box block container wrapper wrap inner outer area list section zone space placement holder frame panel bar strip left right top bottom mobile desktop buttons button icons icon links link posts articles stories items item form x".split())
#: Elements of an article whose class never marks boilerplate, besides the inline ones.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'<>/]+)")
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Line(NamedTuple):
    """A block's text; ``main`` is 2 in an article element, 1 in a main element, else 0."""

    text: str
    main: int


def _marks(tag: str, name: str, value: str, main: int) -> frozenset[str]:
    """Marks in a class or id. In an article or main element ids and the classes of headings and inline elements have none,
    for these are anchors and highlighting, and a class counts only when it is a mark as a whole."""
    split = lambda text: frozenset(_NAME.findall(_CAMEL.sub("-", text).lower()))
    if not main:
        return MARKS & split(unescape(value))
    if name == "id" or tag in HEADINGS or tag in INLINE:
        return frozenset()
    found: frozenset[str] = frozenset()
    for words in map(split, unescape(value).split()):
        marks = (words & MARKS) - HEADS
        if words - PLACES - HEADS <= marks:
            found |= marks
    return found


def _boilerplate(tag: str, attributes: str, main: int) -> int:
    """2 for an element that is boilerplate, 1 for one that is unless an article stands in it, else 0."""
    if tag in DROPPED or (tag == "header" and not main):
        return 2
    if not attributes or attributes.isspace():
        return 0
    for name, a, b, c, bare in _ATTRIBUTE.findall(attributes):
        name, value = (name or bare).lower(), a or b or c
        if name in ("class", "id"):
            if tag not in ("body", "html"):
                marks = _marks(tag, name, value, main)
                if marks and tag not in ("main", "article"):
                    return 1 if marks <= LAYOUT else 2
                if marks - LAYOUT:
                    return 2
        elif name == "role":
            if value.lower() in ROLES:
                return 2
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return 2
    return 0


def lines_of(html: str | None) -> list[Line]:
    """Lines of a page in order, without those in boilerplate elements."""
    if not html:
        return []
    lines: list[Line] = []
    block: list[str] = []
    stack: list[tuple[str, int, int]] = []  # (tag, dropped, main)
    dropped = main = 0
    at, end = 0, len(html)

    def flush() -> None:
        text = " ".join(unescape("".join(block)).split())
        if text:
            lines.append(Line(text, main))
        block.clear()

    def pop_to(depth: int) -> None:
        nonlocal dropped, main
        if any(t not in INLINE for t, _, _ in stack[depth:]):
            flush()
        del stack[depth:]
        dropped, main = (stack[-1][1], stack[-1][2]) if stack else (0, 0)

    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            if not dropped:
                block.append(html[at:])
            break
        if not dropped and m.start() > at:
            block.append(html[at : m.start()])
        at = m.end()
        closing, tag = m.group(1), m.group(2)
        if tag is None:
            if m.group().startswith("<![CDATA[") and not dropped:
                block.append(m.group()[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if closing:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if depth is not None:
                pop_to(depth)
            elif tag not in INLINE and not dropped:
                flush()
            continue
        attributes = m.group(3)
        if tag in VOID:
            if tag in ("br", "hr") and not dropped:
                flush()
            continue
        if tag in CLOSES_P:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p"), None)
            if depth is not None:
                pop_to(depth)
        if tag in CLOSED_BY_SAME:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if stack[k][0] in CLOSED_BY_SAME[tag]:
                    break
        if tag == "body" and stack and any(t == "head" for t, _, _ in stack):
            pop_to(next(k for k, (t, _, _) in enumerate(stack) if t == "head"))
        if tag not in INLINE and not dropped:
            flush()
        if attributes.rstrip().endswith("/") and tag in RAW:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(html, at)
            at = close.end() if close else end
            continue
        own = _boilerplate(tag, attributes, main)
        level = 2 if tag == "article" or "articleBody" in attributes else 1 if tag == "main" or "role=\"main\"" in attributes else 0
        dropped = own if dropped == 1 and level and not own else max(dropped, own)
        main = max(main, level)
        stack.append((tag, dropped, main))
    if not dropped:
        flush()
    return lines


def line_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def common(a: list[int], b: list[int]) -> list[bool]:
    """Which items of ``a`` are in a longest common subsequence with ``b``.

    Equal ends are matched first; in between, lines that the other page lacks are left out, and the rest is aligned by
    Hunt and Szymanski's method, in time of the matches times the logarithm of the lines.
    """
    out = [False] * len(a)
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        out[first] = True
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        out[-1 - last] = True
        last += 1
    there, here = set(b[first : len(b) - last]), set(a[first : len(a) - last])
    left = [k for k in range(first, len(a) - last) if a[k] in there]
    right = [x for x in b[first : len(b) - last] if x in here]
    if not left or not right:
        return out
    places: dict[int, list[int]] = {}
    for j, x in enumerate(right):
        places.setdefault(x, []).append(j)
    tops: list[int] = []
    links: list[tuple[int, tuple | None]] = []
    chain: tuple | None
    for k in left:
        for j in reversed(places[a[k]]):
            at = bisect.bisect_left(tops, j)
            chain = (k, links[at - 1] if at else None)
            if at == len(tops):
                tops.append(j)
                links.append(chain)
            else:
                tops[at] = j
                links[at] = chain
    chain = links[-1]
    while chain:
        out[chain[0]] = True
        chain = chain[1]
    return out


def is_marked(lines: list[Line]) -> bool:
    """Whether a page leaves no line unmarked."""
    return all(line.main for line in lines)


def aligned(lines: list[Line]) -> list[int]:
    """Hashes of the lines that differencing aligns: the unmarked ones, or all of a page that has no such lines."""
    marked = is_marked(lines)
    return [line_hash(line.text) for line in lines if marked or not line.main]


def _sizes(lines: Iterable[Line]) -> list[int]:
    """Characters in all lines, in those of main and article elements, and in those of article elements."""
    sizes = [0, 0, 0]
    for line in lines:
        for level in range(line.main + 1):
            sizes[level] += len(line.text)
    return sizes


def joined_text(lines: list[Line], neighbour: list[int] | None) -> str:
    """Text of a page after differencing; ``neighbour`` has the hashes of the paired page's aligned lines, if any."""
    marked, sizes = is_marked(lines), _sizes(lines)
    shared = common(aligned(lines), neighbour) if neighbour else None
    if marked and shared:
        own = _sizes(line for line, s in zip(lines, shared, strict=True) if not s)
        sizes = own if NEAR_COPY * own[1] >= sizes[1] else sizes
    level = 2 if sizes[2] and 2 * sizes[2] >= sizes[1] else 1 if sizes[1] else 0
    gone = iter(shared if shared and not marked else [level > 0] * len(lines))
    return " ".join(line.text for line in lines if (line.main >= level if line.main else not next(gone)))


def main_text(html: str | None, neighbour: list[int] | None) -> str:
    return joined_text(lines_of(html), neighbour)


def _place(url: Column) -> Column:
    """What follows the host of a URL, query and fragment included; all of one without ``://``."""
    at = F.instr(url, "://")
    rest = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"(?s)^[^/?#]*(.*)$", 1)
    return F.coalesce(F.when(at > 0, rest).otherwise(url), F.lit(""))


def packed(lines: list[Line]) -> bytes:
    """Lines as they are shuffled, at half the size of Spark's own form; their texts hold no line feeds."""
    return zlib.compress("\n".join(f"{line.main}{line.text}" for line in lines).encode(), 1)


def unpacked(data: bytes) -> list[Line]:
    text = zlib.decompress(data).decode()
    return [Line(x[1:], int(x[0])) for x in text.split("\n")] if text else []


KEYS = T.StructType([T.StructField("marked", T.BooleanType()), T.StructField("plain", T.ArrayType(T.LongType()))])
#: A page whose own lines are less than one part in so many of its main text is a near copy of its pair.
NEAR_COPY = 4
#: Consecutive runs of pages that one task looks up together.
SPAN = 256


def _parsed(pages: DataFrame, whole: bool) -> DataFrame:
    """(host, path, marked, plain, same) of each page: its kind of list, the list and its hash.

    With ``whole`` also (row, lines), the other columns of ``pages`` and the packed lines; else (place, page_id). Pages are
    parsed for each, because hashes alone are a small part of what keeping the lines for both would write.
    """
    host, path = url_parts(F.col("url"))
    further = [as_row(pages, REPLACED).alias("row")] if whole else [_place(F.col("url")).alias("place"), F.col("page_id").cast("long").alias("page_id")]
    given = pages.select(host.alias("host"), path.alias("path"), *further, F.col("html").cast("string").alias("html"))
    n = len(given.columns) - 1
    kept = T.StructType([*given.schema.fields[:n], *KEYS.fields, *([T.StructField("lines", T.BinaryType())] if whole else [])])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages_ = [lines_of(h) for h in b.column(n).to_pylist()]
            columns = [pa.array([is_marked(p) for p in pages_], pa.bool_()), pa.array([aligned(p) for p in pages_], pa.list_(pa.int64()))]
            if whole:
                columns.append(pa.array([packed(p) for p in pages_], pa.binary()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(n)), *columns], names=kept.names)

    return given.mapInArrow(run, kept).withColumn("same", F.xxhash64("marked", "plain"))


def _paired(pages: DataFrame) -> DataFrame:
    """(host, path, same, neighbour): for each list of lines of a host and path, the paired page's.

    ``pages`` has host, path, place, page_id, ``marked``, the list ``plain`` and ``same``, the hash of both. Pages are
    ranked over all hosts by one range sort, marked ones apart; consecutive pages of a host with equal lists (copies,
    re-crawls) are one run, so that the next run always differs. Runs are looked up within spans of consecutive ranks, each of which also holds the run before and
    after it; so a host or a path of any size is spread over many tasks.
    """
    one = pages.groupBy("host", "marked", "path", "same").agg(F.min(F.struct("place", "page_id", "plain")).alias("first")).select("host", "marked", "path", "same", "first.*")
    size = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["host", "marked", "path", "place", "page_id", "same"]
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = one.repartitionByRange(size, *order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "at": at}).checkpoint()
    # one row for each partition
    own, parts, within = F.struct("host", "marked", "same"), Window.orderBy("part"), Window.partitionBy("part").orderBy("at")
    ends = ordered.groupBy("part").agg(F.max_by(own, "at").alias("last")).withColumn("prior", F.lag("last").over(parts)).select("part", "prior")
    new = ~own.eqNullSafe(F.coalesce(F.lag(own).over(within), F.col("prior")))
    begun = ordered.join(F.broadcast(ends), "part").withColumn("new", new.cast("long"))
    before = F.coalesce(F.sum("n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = begun.groupBy("part").agg(F.sum("new").alias("n")).withColumn("before", before).select("part", "before")
    ranked = begun.withColumn("in", F.sum("new").over(within)).join(F.broadcast(sizes), "part").withColumn("rank", F.col("in") + F.col("before"))
    place = F.struct("path", "place")
    ends = [F.min(place)["place"].alias("low"), F.max(place)["place"].alias("high")]
    runs = ranked.groupBy("rank").agg(F.first(F.struct("host", "marked")).alias("site"), *ends, F.first("plain").alias("plain"))
    span = F.floor(F.col("rank") / SPAN)
    also = F.when(F.col("rank") % SPAN == 0, span - 1).when(F.col("rank") % SPAN == SPAN - 1, span + 1)
    in_spans = runs.withColumn("own", span).withColumn("span", F.explode(F.array_compact(F.array(span, also))))
    w = Window.partitionBy("span").orderBy("rank")
    seen = lambda end: F.struct("site", F.col(end).alias("place"), "plain")
    near = in_spans.withColumns({"b": F.lag(seen("high")).over(w), "a": F.lead(seen("low")).over(w)}).where("span = own").select("rank", "b", "a")
    alike = lambda other: F.when(F.col(other)["site"] == F.struct("host", "marked"), shared_length(F.col("place"), F.col(other)["place"])).otherwise(-1)
    both = ranked.select("host", "marked", "path", "place", "same", "rank").join(near, "rank").withColumns({"to_b": alike("b"), "to_a": alike("a")})
    chosen = F.when(F.col("to_b") >= F.col("to_a"), F.col("b")["plain"]).otherwise(F.col("a")["plain"])
    return both.where("greatest(to_b, to_a) >= 0").select("host", "path", "same", chosen.alias("neighbour"))


def shared_length(a: Column, b: Column) -> Column:
    """Length of the common beginning of two strings, bit by bit from the highest: a few comparisons of any length."""
    n = F.least(F.length(a), F.length(b))
    bits = F.array(*[F.lit(1 << k) for k in reversed(range(30))])
    fits = lambda k: (k <= n) & (F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))
    return F.coalesce(F.aggregate(bits, F.lit(0), lambda held, bit: F.when(fits(held + bit), held + bit).otherwise(held)), F.lit(0))


REPLACED = ("html", "text", "n_chars")


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html, ...) with ``text`` and ``n_chars`` in place of ``html``.

    Every page with lines is paired and aligned; hashes of lines are paired first, and the lines are shuffled once.
    """
    shared_dir(pages.sparkSession)
    pairs = _paired(_parsed(pages, whole=False).where(F.size("plain") > 0))
    # pages without lines have nothing to align; they get keys of their own, so that they don't all meet in one task
    same = F.when(F.size("plain") > 0, F.col("same")).otherwise(F.monotonically_increasing_id())
    parsed = _parsed(pages, whole=True).withColumn("same", same)
    joined = parsed.join(pairs, ["host", "path", "same"], "left").select("row", "lines", "neighbour")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [joined_text(unpacked(lines), n) for lines, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    done = joined.mapInArrow(run, T.StructType([joined.schema["row"], T.StructField("text", T.StringType())]))
    return done.select(*row_columns(pages, REPLACED), F.col("text"), F.length("text").cast("long").alias("n_chars"))
