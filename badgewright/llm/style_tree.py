"""Main text of web pages by a site style tree.

1. Every page is parsed into elements, by a scanner that only moves forward: its time and memory grow with the page, however its
   quotes and elements are nested. An element's style is the path of tags, classes and ids
   to it, kept as a hash of the parent's and its own label. Per page and style: its presentation (the styles of its children, equal neighbours as one) and its
   content (the text under it).
2. The pages of a host are merged: per host and style, the different pages that have it, the
   entropy of their presentations and the entropy of their contents, both as a share of the largest
   possible. Exact copies of a page count once. What is the same on every page of a site is
   unimportant; what differs on every page is important; a style is as important as the larger of its two entropies says.
   Inside an article the share of pages without the style's most frequent text says it instead, and pages with the
   same article count once: what a few values fill is part of the article, what one text fills is not.
3. One or two pages say little: an expected importance by tag counts as much as ``PRIOR_PAGES`` pages.
4. Block-level branches of low importance are removed from each page, and the text of what is left is
   returned in blocks. Inline elements stay with their block, headings of an article stay with it even where all
   articles of a site have them. A page with an article or main element is reduced to it first.
5. Where a tag or a whole class, id or role name says that a branch is no main text (navigation, adverts, readers'
   comments, which differ on every page), it goes too, unless it holds the page's only article or main element, or most of the
   text that is not of low importance.

Statistics are sums over (host, style, content); a host with most of the pages is spread over all
tasks, and pages get the low styles back by a salted join on (host, style).

Defined results: a null or empty html has an empty text; a page without a url has an empty host; text outside
any element is content of the body; unclosed elements end with what surrounds them; equal rows are judged alike.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from badgewright.llm.shared import record_batch, salted_join, slices, prepare_workers
from badgewright.sources.files import materialised

PRIOR_PAGES = 4
LEAST_IMPORTANCE = 0.5
EXPECTED = 0.75

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r">|=\s*+[\"']")
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Tags that are never part of the main text, and tags that usually are.
UNWANTED = frozenset("nav footer aside form button select input script style textarea noscript iframe template svg menu".split())
WANTED = frozenset("article main".split())
# These stay unwanted however much text they hold.
NEVER = UNWANTED - {"form", "aside"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNWANTED_NAMES = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies footer header menu "
    "modal nav navbar navigation newsletter notice notices pagination popup promo promotion related share sharing sidebar "
    "social sponsor sponsored subscribe toolbar widget ad-banner ad-container ad-slot comment-list comments-area cookie-banner "
    "page-footer page-header related-articles related-posts share-buttons side-bar site-footer site-header social-share".split()
)
# An open element that a start tag ends, and the elements that keep it open.
_ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd dt", ("dl",)), "dd": ("dd dt", ("dl",)), "tr": ("tr td th", ("table",))}
_ENDS |= {"td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}


@dataclass(slots=True)
class Element:
    """``label``: tag, classes and ids; ``path``: hash of the labels down to it; ``inside``: path of the outermost article or main
    element that it is or lies in."""

    tag: str
    label: str = "body"
    path: int = 0
    inside: int | None = None
    children: list[Element | str] = field(default_factory=list)
    whole_names: frozenset[str] = frozenset()

    @property
    def prior(self) -> float:
        """Expected importance of the style, 0 if it is listed as no main text."""
        if self.listed:
            return 0.0
        return 1.0 if self.tag in WANTED or self.tag == "body" else EXPECTED

    @property
    def listed(self) -> bool:
        """Whether tag or a whole name say that the branch is no main text. A name on an inline element says nothing."""
        if self.tag in UNWANTED:
            return True
        if self.tag not in BLOCKS or self.tag == "main":
            return False
        named = self.whole_names & UNWANTED_NAMES
        if self.tag in HEADINGS or self.inside is not None:
            return bool(named - {"header"})
        return bool(named) or self.tag == "header"

    @property
    def wanted(self) -> bool:
        return self.tag in WANTED and not self.listed


class Stack:
    """The open elements of a page, and where the last one of each tag stands among them."""

    def __init__(self, root: Element):
        self.elements = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    @property
    def top(self) -> Element:
        return self.elements[-1]

    def push(self, element: Element) -> None:
        place = len(self.elements)
        self.places.setdefault(element.tag, []).append(place)
        if element.tag in BLOCKS and element.tag != "p":
            self.blocks.append(place)
        self.elements.append(element)

    def last(self, tags: Iterable[str]) -> int:
        """The place of the last open element with one of the tags, 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def end(self, tags: Iterable[str], keeper: int = 0) -> None:
        """Close the last element with one of the tags, with all that is open in it, unless ``keeper`` stands above it."""
        place = self.last(tags)
        if place > keeper:
            while len(self.elements) > place:
                gone = self.elements.pop()
                self.places[gone.tag].pop()
                if self.blocks and self.blocks[-1] == len(self.elements):
                    self.blocks.pop()


def parse(html: str) -> Element:
    """The body of a page; comments, scripts, styles and the head are left out.

    Every search goes on from where the last one ended. A quote that never ends ends with its tag, and quotes no longer count from
    there on; a tag that never ends is text.
    """
    root = Element("body")
    stack, at, seen = Stack(root), 0, 0
    last, quotes, head = html.rfind(">"), True, True

    def text_to(end: int) -> None:
        if end > at:
            stack.top.children.append(html[at:end])

    while (start := html.find("<", seen)) >= 0:
        if html.startswith("<!--", start):
            text_to(start)
            end = html.find("-->", start + 4)
            at = seen = end + 3 if end >= 0 else len(html)
            continue
        if start > last:
            break
        kind = html[start + 1]
        if kind in "!?":
            text_to(start)
            at = seen = html.index(">", start) + 1
            continue
        name = _NAME.match(html, start + 1 + (kind == "/"))
        if name is None:
            seen = start + 1
            continue
        text_to(start)
        tag = name[0].lower()
        if kind == "/":
            at = seen = html.index(">", name.end()) + 1
            if tag not in ("html", "body"):
                stack.end((tag,))
            continue
        end, place = -1, name.end()
        while quotes:
            stop = _STOP.search(html, place)
            if stop is None:
                quotes = False
            elif stop[0] == ">":
                end = stop.start()
                break
            else:
                place = html.find(stop[0][-1], stop.end()) + 1
                quotes = place > 0
        end = end if end >= 0 else html.index(">", name.end())
        inside = html[name.end() : end]
        at = seen = end + 1
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = seen = close.end() if close else len(html)
            continue
        if tag == "head":
            close = re.compile(r"</head\s*>|<body", re.I).search(html, at) if head else None
            head = close is not None
            if close is not None:
                at = seen = close.end() if close[0][1] == "/" else close.start()
            continue
        if tag in BLOCKS:
            stack.end(("p",), stack.blocks[-1] if stack.blocks else 0)
        if tag in _ENDS:
            stack.end(_ENDS[tag][0].split(), stack.last(_ENDS[tag][1]))
        if tag in ("html", "body"):
            continue
        values = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(inside)]
        names = sorted({w for _, v in values for w in re.split(r"[\s_-]+", v.lower()) if w})
        label, above = ".".join((tag, *names)), stack.top
        path = _hash(f"{above.path}>{label}")
        outermost = above.inside if above.inside is not None else path if tag in WANTED else None
        element = Element(tag, label, path, outermost, [], frozenset(w for _, v in values for w in v.lower().split()))
        above.children.append(element)
        if tag not in VOID and not inside.rstrip().endswith("/"):
            stack.push(element)
    text_to(len(html))
    return root


def walk(element: Element) -> Iterator[Element]:
    stack = [element]
    while stack:
        here = stack.pop()
        yield here
        stack += [c for c in reversed(here.children) if isinstance(c, Element)]


def wanted_below(top: Element, through: bool) -> list[Element]:
    """The outermost article or main elements from ``top`` on; ``through``: also in branches listed as no main text."""
    found: list[Element] = []
    stack = [top]
    while stack:
        here = stack.pop()
        if here.wanted:
            found.append(here)
        elif through or not here.listed:
            stack += [c for c in reversed(here.children) if isinstance(c, Element)]
    return found


def content_root(body: Element) -> list[Element]:
    """The outermost article or main elements, or the body."""
    return wanted_below(body, False) or [body]


def main_parts(body: Element, low: frozenset[int] | set[int] = frozenset()) -> tuple[list[Element], set[int]]:
    """The elements that a page is reduced to, and the ids of the listed branches below them that go."""
    length: dict[int, int] = {}
    holds: dict[int, bool] = {}
    for here in reversed(list(walk(body))):
        kids = [c for c in here.children if isinstance(c, Element)]
        own = sum(len(c.strip()) for c in here.children if isinstance(c, str))
        length[id(here)] = own + sum(length[id(c)] for c in kids) if here.path not in low else 0
        holds[id(here)] = here.wanted or any(holds[id(c)] for c in kids)
    roots = content_root(body)
    if roots[0] is body:
        inside = wanted_below(body, True)
        roots = inside if 2 * sum(length[id(x)] for x in inside) > length[id(body)] else [body]
    total = sum(length[id(x)] for x in roots)
    gone: set[int] = set()
    for root in roots:
        kids = [c for c in root.children if isinstance(c, Element)]
        only = root.tag != "article" and not any(wanted_below(c, False) for c in kids)
        stack = kids
        while stack:
            here = stack.pop()
            spared = (only and holds[id(here)]) or (here.tag not in NEVER and 2 * length[id(here)] > total)
            if here.listed and not spared:
                gone.add(id(here))
            else:
                stack += [c for c in here.children if isinstance(c, Element)]
    return roots, gone


def blocks(roots: list[Element], low: frozenset[int] | set[int], gone: set[int] | frozenset[int] = frozenset()) -> list[str]:
    """Texts of the blocks under ``roots``, without branches whose style is in ``low`` and those in ``gone``."""
    out: list[str] = []
    text: list[str] = []

    def flush() -> None:
        block = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
        text.clear()
        if block:
            out.append(block)

    stack: list[Element | str | None] = []
    for root in reversed(roots):
        stack += [None, *reversed(root.children), None]
    while stack:
        here = stack.pop()
        if here is None:
            flush()
        elif isinstance(here, str):
            text.append(here)
        elif here.tag == "br":
            text.append(" ")
        elif here.path not in low and id(here) not in gone:
            if here.tag in BLOCKS:
                flush()
                stack.append(None)
            stack += reversed(here.children)
    flush()
    return out


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def host_of(url: str | None) -> str:
    match = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return match[1].lower() if match else ""


# Texts are told apart by polynomials over the hashes of their pieces, so that those of an element follow from its children's.
_PRIME, _BASE = 2**61 - 1, 0x1F3D5B79A2C4E681


def styles(body: Element) -> list[tuple[int, str, float, int | None, int, int]]:
    """Path, tag, prior, article, presentation and content of every style of a page."""
    order = list(walk(body))
    text: dict[int, tuple[int, int]] = {}
    for here in reversed(order):
        value, power = 0, 1
        for child in here.children:
            if isinstance(child, str):
                words = child.split()
                more, by = (_hash(" ".join(words)) % _PRIME, _BASE) if words else (0, 1)
            else:
                more, by = text[id(child)]
            value, power = (value * by + more) % _PRIME, power * by % _PRIME
        text[id(here)] = value, power
    by_path: dict[int, tuple[Element, list[str], list[str]]] = {}
    for here in order:
        _, shapes, contents = by_path.setdefault(here.path, (here, [], []))
        labels = [c.label if isinstance(c, Element) else "#" for c in here.children if not isinstance(c, str) or c.strip()]
        shapes.append(" ".join(a for a, b in zip(labels, [None, *labels], strict=False) if a != b))
        contents.append(str(text[id(here)][0]))
    return [
        (path, e.tag, e.prior, e.inside, _hash("\0".join(sorted(set(shapes)))), _hash(" ".join(contents)))
        for path, (e, shapes, contents) in by_path.items()
    ]


def _survey(schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("page", "twin", "url", "html"))
            for page, twin, url, html in zip(*columns, strict=True):
                host = host_of(url)
                found = styles(parse(html))
                whole = _hash("\0".join(sorted(f"{p} {s} {c}" for p, _, _, _, s, c in found)))
                contents = {p: c for p, _, _, _, _, c in found}
                for path, tag, prior, article, shape, content in found:
                    # An article's headings are never judged.
                    if tag in BLOCKS and not (tag in HEADINGS and article is not None):
                        same = whole if article is None else contents[article]
                        rows.append((page, twin, _hash(f"{host}\0{path}"), path, prior, article is not None, same, shape, content))
            yield record_batch(list(zip(*rows, strict=True)) if rows else [[]] * 9, schema)

    return run


def _extract(schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = []
            for html, low in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True):
                removed = set(low or ())
                roots, gone = main_parts(parse(html), removed)
                texts.append("\n".join(blocks(roots, removed, gone)))
            given = [batch.column(f.name) for f in schema if f.name not in ("text", "n_chars")]
            yield record_batch([*given, texts, np.array([len(t) for t in texts])], schema)

    return run


def entropy_share(rows: DataFrame, feature: str, name: str) -> DataFrame:
    """(style, pages, name, top): entropy of a feature over the pages of a style, as a share of the largest
    possible, and the share of its most frequent value."""
    counts = rows.groupBy("style", feature).agg(F.count(F.lit(1)).alias("n"))
    held = F.sum(F.col("n") * F.log("n")).alias("held")
    sums = counts.groupBy("style").agg(F.sum("n").alias("pages"), held, (F.max("n") / F.sum("n")).alias("top"))
    most = F.log("pages")
    share = F.when(F.col("pages") > 1, (most - F.col("held") / F.col("pages")) / most).otherwise(F.lit(1.0))
    return sums.select("style", "pages", share.alias(name), "top")


def style_importance(survey: DataFrame, prior_pages: float = PRIOR_PAGES) -> DataFrame:
    """(style, importance) of every host's styles, from written rows of pages and styles."""
    # Of pages that count as one, the same one whatever the order they arrive in.
    one = F.min(F.struct("prior", "inside", "shape", "content")).alias("one")
    distinct = materialised(survey.groupBy("style", "whole").agg(one).select("style", "whole", "one.*"), "page-styles")
    shape, content = entropy_share(distinct, "shape", "by_shape"), entropy_share(distinct, "content", "by_content")
    prior = distinct.groupBy("style").agg(F.max("prior").alias("prior"), F.max("inside").alias("inside"))
    both = content.join(shape.drop("pages", "top"), "style").join(prior, "style")
    seen = F.when(F.col("inside"), 1 - F.col("top")).otherwise(F.greatest("by_shape", "by_content")) * F.col("pages")
    # Lists are applied page by page: entropy judges a listed style like any other.
    expected = F.when(F.col("prior") > 0, F.col("prior")).otherwise(EXPECTED)
    blended = (seen + expected * prior_pages) / (F.col("pages") + prior_pages)
    return both.select("style", blended.alias("importance"))


def extract_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least: float = LEAST_IMPORTANCE,
    prior_pages: float = PRIOR_PAGES,
) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    prepare_workers(pages.sparkSession)
    state = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )
    # What tells two rows of one page id apart.
    key = [F.coalesce("page_id", F.lit(2**63 - 1)).alias("page"), F.xxhash64("url", "html").alias("twin")]
    state = state.select("*", *key)
    schema = StructType.fromDDL(
        "page bigint, twin bigint, style bigint, path bigint, prior double, inside boolean, whole bigint, shape bigint, content bigint"
    )
    survey = state.select("page", "twin", "url", "html").mapInArrow(_survey(to_arrow_schema(schema)), schema)
    survey = materialised(survey, "site-styles")
    low = style_importance(survey, prior_pages).where(F.col("importance") < least)
    hit = salted_join(survey.select("page", "twin", "style", "path"), materialised(low, "low-styles"), "style", "page")
    lows = hit.groupBy("page", "twin").agg(F.collect_set("path").alias("low"))
    joined = state.join(lows, ["page", "twin"], "left").select("page_id", "url", "html", "low")
    out = StructType.fromDDL("page_id bigint, url string, text string, n_chars bigint")
    return joined.mapInArrow(_extract(to_arrow_schema(out)), out)
