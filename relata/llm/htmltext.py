"""Operator 4 - main text of web pages from streaming standard-library parser events.

1. The parser's events are cut into lines at block boundaries.
2. A line's text-to-tag ratio is its characters per tag since the line before, times a weight: 1 in plain elements, 0 in menus,
   sidebars, page headers and footers, dialogs and hidden elements, FORM in forms, NAMED where a class name or id means
   boilerplate ("ad", "cookie-notice", "reader-comments"), and NAMED outside <article>, <main> and role=main where these hold a tenth of the text.
3. The logarithms of the ratios are smoothed by a Gaussian, each weighted element by itself, so that an advert among paragraphs
   isn't lifted by them.
4. Two-means on the levels gives the threshold. Lines at or above it are content; weights alone exclude nothing that has text
   enough, but for a weight of 0.

The contract wants the article whole, and "Be." is a paragraph. So lines below the threshold are filled in where content lines of
the same weight stand around them: in the marked articles, if one of them has content; else beside content in the same container (or in lists,
tables and quotes beside it), and headings right before a kept line.

Defined results: null or empty html gives an empty text; a page without content gives an empty text; unclosed tags, stray end tags
and broken declarations never raise; <br> is white space; text in <script>, <style>, <template> and the head is dropped, that of
embedded objects and controls (SILENT) only where they are closed. Rows pass one by one, repeated rows too; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from relata.llm.common import lean, load, slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("script style template head title".split())
SILENT = frozenset("noscript svg iframe object canvas audio video select textarea datalist".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta noscript script style template title".split())
CHROME = frozenset("nav footer aside menu dialog".split())
CHROME_ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog menu menubar toolbar".split())
CHROME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promos "
    "promotion recommended related respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
PAGE_NAMES = frozenset("header alert".split())  # boilerplate only outside an article
PLAIN_NAMES = frozenset(
    "area article articles bar big block body bottom box btn button buttons card cards col column component container content feed fixed flex form grid group holder "
    "icon icons inner item items large layout left link links list main mini module outer page panel post posts primary reader region right row secondary section "
    "site slot small space sticky stories story strip text the top unit user wrap wrapper zone".split()
)
NO_NAMES = frozenset("has hide is no non not show with without".split())  # "has-sidebar" is no sidebar
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
FLOW = frozenset("blockquote dd dl dt figcaption figure hgroup li ol table tbody td tfoot th thead tr ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
FORM, NAMED = 0.05, 0.002
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class _Box:
    """A block element and the one around it; the page's own has none. ``best``: largest weight of content lines right inside."""

    __slots__ = ("tag", "up", "best")

    def __init__(self, tag: str, up: _Box | None):
        self.tag, self.up, self.best = tag, up, 0.0


class _Place:
    """What holds at a point of the page: weight, number of the innermost weighted element, article (0: none) and the weight it has,
    block, and the silent elements that are open."""

    __slots__ = ("tag", "weight", "mark", "home", "box", "silent")

    def __init__(self, tag: str, weight: float, mark: int, home: int, box: _Box, silent: tuple[int, ...]):
        self.tag, self.weight, self.mark, self.home, self.box, self.silent = tag, weight, mark, home, box, silent


class _Line:
    __slots__ = ("text", "tags", "weight", "mark", "home", "heading", "box", "silent")

    def __init__(self, text: str, tags: int, at: _Place, heading: bool, box: _Box, silent: tuple[int, ...]):
        self.text, self.tags, self.heading, self.box, self.silent = text, tags, heading, box, silent
        self.weight, self.mark, self.home = at.weight, at.mark, at.home


def named(value: str, names: frozenset[str]) -> bool:
    """Whether one of the names in a class or id attribute means boilerplate: its last word does, or one of its words, beside plain ones
    only ("reader-comments", "ad-slot-2"; not "social-contract", "has-sidebar")."""
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if names.isdisjoint(words) or not NO_NAMES.isdisjoint(words):
            continue
        if words[-1] in names or all(len(w) == 1 or w in names or w in PLAIN_NAMES for w in words):
            return True
    return False


class Events(HTMLParser):
    """Collects lines with tag counts and places. ``found`` holds the places of open tags by name, so that end tags take constant time."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.stack: list[_Place] = [_Place("", 1.0, 0, 0, _Box("", None), ())]
        self.found: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.closed: set[int] = set()
        self.articles = self.marks = self.silences = self.tags = 0
        self.parts: list[tuple[str, _Place]] = []

    def flush(self) -> None:
        if not self.parts:
            return
        said = [(t, p) for t, p in self.parts if self.closed.isdisjoint(p.silent)]
        self.parts.clear()
        text = " ".join("".join(t for t, _ in said).split())
        if text:
            places = [p for t, p in said if not t.isspace()]
            at = max(places, key=lambda p: p.weight)
            silent = at.silent if all(p.silent for p in places) else ()
            self.lines.append(_Line(text, max(self.tags, 1), at, any(p.tag in HEADING for p in self.stack[-6:]), at.box, silent))
            self.tags = 0

    def _weight(self, tag: str, attrs: list[tuple[str, str | None]], home: int) -> float:
        if tag in CHROME or tag == "header" and not home:
            return 0.0
        weight = FORM if tag == "form" else 1.0
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return 0.0
            if not value:
                continue
            if name == "role" and value.strip().lower() in CHROME_ROLES or name == "style" and "display:none" in value.replace(" ", "").lower():
                return 0.0
            if name in ("class", "id") and tag not in ("body", "html", "main") and named(value, CHROME_NAMES if home else CHROME_NAMES | PAGE_NAMES):
                weight = NAMED
        return weight

    def _push(self, place: _Place) -> None:
        self.found.setdefault(place.tag, []).append(len(self.stack))
        if place.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(place)

    def _cut(self, at: int) -> None:
        """Close all tags from a place on."""
        for place in self.stack[at:]:
            self.found[place.tag].pop()
        del self.stack[at:]
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if self.found.get("head") and tag not in HEAD_ONLY and tag not in ("head", "html"):  # </head> may be left out
            self._cut(self.found["head"][-1])
        if tag in BLOCK:
            self.flush()
            self._imply_end(tag)
        if tag in VOID:
            if tag == "br":
                self.parts.append((" ", self.stack[-1]))
            return
        top = self.stack[-1]
        own, mark, weight, home = self._weight(tag, attrs, top.home), top.mark, top.weight, top.home
        marked = tag in ("article", "main") or any(n == "role" and (v or "").strip().lower() == "main" for n, v in attrs)
        if marked and not home and own == 1.0 and (weight == 1.0 or self._in_form()):
            self.articles += 1
            self.marks += 1
            weight, home, mark = 1.0, self.articles, self.marks
        elif own < 1.0:
            self.marks += 1
            weight, mark = weight * own, self.marks
        silent = top.silent
        if tag in SILENT or tag in DROPPED:
            self.silences += 1
            silent = (*silent, self.silences)
            if tag in DROPPED:
                self.closed.add(self.silences)
        self._push(_Place(tag, weight, mark, home, _Box(tag, top.box) if tag in BLOCK else top.box, silent))

    def _in_form(self) -> bool:
        """Whether nothing but forms lowers the weight here."""
        depth = len(self.found.get("form", ()))
        return depth > 0 and math.isclose(self.stack[-1].weight, FORM**depth)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "li"):
            self.handle_endtag(tag)

    def _imply_end(self, tag: str) -> None:
        """A block start closes an open paragraph, and a list item or cell its open sibling."""
        ends = (*ENDS.get(tag, ()), "p")
        while self.blocks and self.stack[self.blocks[-1]].tag in ends:
            self._cut(self.blocks[-1])

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append((" ", self.stack[-1]))
            return
        if tag in BLOCK:
            self.flush()
        if not self.found.get(tag):
            return
        at = self.found[tag][-1]
        if tag not in BLOCK and tag not in SILENT and self.blocks and self.blocks[-1] > at:  # a stray inline end tag closes no block
            return
        if tag in SILENT:
            self.closed.add(self.stack[at].silent[-1])
        self._cut(at)

    def set_cdata_mode(self, elem: str, **kw: bool) -> None:
        """Scripts and styles alone are raw text: an unclosed <iframe> or <textarea> hides no markup."""
        if elem in ("script", "style"):
            super().set_cdata_mode(elem, **kw)

    def handle_data(self, data: str) -> None:
        self.parts.append((data, self.stack[-1]))


def parse(html: str) -> list[_Line]:
    """Lines of a page; a declaration that the parser rejects is taken as text."""
    for source in (html, html.replace("<![", "&lt;![")):
        events = Events()
        try:
            events.feed(source)
            events.close()
        except AssertionError:
            continue
        events.flush()
        return [x for x in events.lines if events.closed.isdisjoint(x.silent)]
    return []


def in_articles(lines: list[_Line]) -> bool:
    """Whether the marked articles hold a tenth of the weighted text."""
    inside = sum(len(x.text) * x.weight for x in lines if x.home)
    return inside > 0 and 10 * inside >= sum(len(x.text) * x.weight for x in lines)


def ratios(lines: list[_Line], marked: bool) -> list[float]:
    """Weighted characters per tag; marked: text outside articles weighs less."""
    return [len(x.text) / x.tags * x.weight * (NAMED if marked and not x.home else 1.0) for x in lines]


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian means, over three standard deviations to each side."""
    r = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-r, r + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - r), min(len(values), i + r + 1)
        w = kernel[lo - i + r : hi - i + r]
        out.append(sum(a * b for a, b in zip(w, values[lo:hi])) / sum(w))
    return out


def levels(lines: list[_Line], marked: bool, sigma: float = 1.0) -> list[float]:
    """Smoothed logarithms of the ratios, each weighted element (mark) by itself."""
    raw = [math.log1p(x) for x in ratios(lines, marked)]
    by: dict[int, list[int]] = {}
    for i, x in enumerate(lines):
        by.setdefault(x.mark, []).append(i)
    out = raw[:]
    for at in by.values():
        for i, y in zip(at, smoothed([raw[i] for i in at], sigma)):
            out[i] = y
    return out


def threshold(values: list[float]) -> float:
    """Boundary of one-dimensional two-means, from the extremes; equal values: that value."""
    low, high = min(values), max(values)
    for _ in range(32):
        cut = (low + high) / 2
        a, b = [x for x in values if x < cut], [x for x in values if x >= cut]
        if not a or not b:
            break
        new = (sum(a) / len(a), sum(b) / len(b))
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _container(x: _Line) -> _Box:
    """The element around a line's own; headings stand for the element that they are in."""
    return x.box.up or x.box


def chosen(lines: list[_Line], sigma: float = 1.0) -> list[_Line]:
    """Content lines by the threshold, and those that belong to them."""
    if not lines:
        return []
    marked = in_articles(lines)
    level = levels(lines, marked, sigma)
    cut = threshold(level)
    keep = [x.weight > 0 and y >= cut for x, y in zip(lines, level)]
    content = [x for x, k in zip(lines, keep) if k]
    for x in content:
        box = _container(x)
        box.best = max(box.best, x.weight)
    known: dict[_Box, float] = {}

    def best(box: _Box) -> float:
        """The weight of content beside: in the element, or around it if it is a list, a table or a quote."""
        path = []
        while box not in known and not box.best and box.tag in FLOW and box.up:
            path.append(box)
            box = box.up
        found = known.get(box, box.best)
        for b in path:
            known[b] = found
        return found

    for i, x in enumerate(lines):
        if not keep[i] and x.weight:
            keep[i] = bool(content) and x.home > 0 and x.weight == 1.0 if marked else 0 < best(_container(x)) <= x.weight
    for i in range(len(lines) - 2, -1, -1):
        if keep[i + 1] and lines[i].heading and not marked and lines[i].weight >= lines[i + 1].weight:
            keep[i] = True
    return [x for x, k in zip(lines, keep) if k]


def main_text(html: str | None, sigma: float = 1.0) -> str:
    return "\n".join(x.text for x in chosen(parse(html), sigma)) if html else ""


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", sigma: float = 1.0) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    kept = pages.select(page_id, url, html).toDF("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, col in slices(batch, "html"):
                texts = [main_text(x.as_py(), sigma) for x in col]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    types = dict(kept.dtypes)
    return kept.mapInArrow(lean(run), f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))
