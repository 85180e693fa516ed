"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser is fed the page and its events make lines: the text of one block
and the number of tags in it. The text-to-tag ratios of the lines are smoothed by a Gaussian
and split by a threshold; lines above it are content, and they cluster in the regions of the page
that are its article. Structure corrects this in two ways. A short paragraph is as much
part of an article as a long one, so the home of a content line (its outermost article or main
element, or else the innermost division of the page) is kept whole; a home without content lines
is not. And elements that are no article whatever they hold are taken out: by tag, and by a word in their
class, id or role, unless they hold the article.

Every step is linear in the page: open tags are counted for each scope, and all that is known of
elements is summed once, from the innermost outwards.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_texts, map_texts, whole_text

# Elements by what they mean for text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video select option textarea button datalist".split())
BOILERPLATE = frozenset("nav aside footer form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article main section div body html".split())
CELLS = frozenset("td th".split())
ARTICLES = frozenset("article main".split())
#: An open paragraph or item is looked for up to the nearest of these.
SCOPES = CONTAINERS | CELLS | frozenset("ul ol dl table blockquote".split())
# Open blocks that the start of a block ends; any other block ends a paragraph.
ENDED_BY = {
    "li": ("p", "li"),
    "dt": ("p", "dt", "dd"),
    "dd": ("p", "dt", "dd"),
    "tr": ("p", "tr"),
}
# Words of class, id and role that name what is not the article.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies"
    " consent disqus disclaimer footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo"
    " related search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
# Those of them that name what readers have written.
READERS = frozenset("comment comments disqus".split())
SIGMA, REACH = 1.0, 3
_SPLIT, _TAG = re.compile(r"[^a-z0-9]+"), re.compile(r"<[A-Za-z/!?]")


class Element:
    __slots__ = ("content", "kept", "lines", "names", "out", "parent", "silent", "tag", "whole", "within")

    def __init__(self, tag: str, parent: Element | None, labels: tuple[str, ...] = (), out: bool = False):
        self.tag, self.parent = tag, parent
        self.whole = frozenset(labels) & NAMED
        self.names = self.whole | (frozenset(w for x in labels for w in _SPLIT.split(x)) & NAMED)
        self.silent = tag in SILENT or (parent is not None and parent.silent)
        self.within = tag in ARTICLES or (parent is not None and parent.within)
        self.out = out or (parent is not None and parent.out)  # by its tag, or hidden
        self.content, self.lines, self.kept = 0, 0, False


class Lines(HTMLParser):
    """Lines of a page, (text, tags, element), and its elements from outer to inner."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, Element]] = []
        self.open = [Element("html", None)]
        self.elements = list(self.open)
        self.scopes, self.all = [Counter()], Counter()  # open tags, of each scope and of the page
        self.held: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text and not self.open[-1].silent:
                self.lines.append((text, self.tags, self.open[-1]))
            self.held = []
            self.tags = 0

    def push(self, e: Element) -> None:
        self.open.append(e)
        self.elements.append(e)
        self.scopes[-1][e.tag] += 1
        self.all[e.tag] += 1
        if e.tag in SCOPES:
            self.scopes.append(Counter())

    def pop(self) -> str:
        e = self.open.pop()
        if e.tag in SCOPES:
            self.scopes.pop()
        self.scopes[-1][e.tag] -= 1
        self.all[e.tag] -= 1
        return e.tag

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            if tag in CELLS or tag == "tr":
                self.end_cell()
            for ended in ENDED_BY.get(tag, ("p",)):
                while self.scopes[-1][ended]:
                    self.pop()
        self.tags += 1
        if tag in VOID:
            if tag in ("br", "hr", "img"):
                self.held.append(" ")
            return
        labels = tuple(w for k, v in attrs if v and k in ("class", "id", "role") for w in v.lower().split())
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
        out = hidden or tag in BOILERPLATE or (tag == "header" and not self.open[-1].within)
        self.push(Element(tag, self.open[-1], () if tag in ("html", "body") else labels, out))

    def end_cell(self) -> None:
        """A cell or row ends the open cell of its own table."""
        table = self.scopes[-2:-1]
        if table and (table[0]["td"] or table[0]["th"]):
            while self.pop() not in CELLS:
                pass

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if (self.all if tag in BLOCKS else self.scopes[-1])[tag]:  # what is inline closes no division
            while self.pop() != tag:
                pass

    def parse_comment(self, i, report=1):
        """A comment without an end reaches to the end of the page, as browsers have it."""
        end = super().parse_comment(i, report)
        return end if end >= 0 else len(self.rawdata)

    def handle_data(self, data):
        if not self.open[-1].silent:
            self.held.append(data)


def smoothed(x: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    within = np.convolve(np.ones(len(x)), kernel)[REACH : REACH + len(x)]  # at the ends, the weight of the lines there are
    return np.convolve(x, kernel)[REACH : REACH + len(x)] / within


def content_lines(lines: list[tuple[str, int, Element]]) -> np.ndarray:
    """Which lines lie in clusters whose smoothed text-to-tag ratio reaches the threshold.

    That is one standard deviation of all ratios, or the highest smoothed one if it is less.
    """
    ratio = np.array([len(t) / max(1, n) for t, n, _ in lines])
    smooth = smoothed(ratio)
    return smooth >= min(ratio.std(), smooth.max())


def homes(elements: list[Element]) -> dict[Element, Element]:
    """Of each element its outermost article or main element, or else its innermost division; a cell is one if it has several lines."""
    out: dict[Element, Element] = {}
    for e in elements:
        if e.within:
            out[e] = out[e.parent] if e.parent.within else e
        else:
            own = e.parent is None or e.tag in CONTAINERS or (e.tag in CELLS and e.lines > 1)
            out[e] = e if own else out[e.parent]
    return out


def weigh(page: Lines, content: np.ndarray) -> None:
    """Sets of each element how many characters of content lines it holds, and how many lines outside cells within it."""
    for (text, _, e), good in zip(page.lines, content.tolist(), strict=True):
        e.lines += 1
        e.content += len(text) * (good and not e.out)
    for e in reversed(page.elements[1:]):
        e.parent.content += e.content
        e.parent.lines += e.lines * (e.tag not in CELLS)


def correct(elements: list[Element]) -> None:
    """Sets ``kept``: false for what is out by its tag or by a word in its class, id or role.

    The article is the outermost article or main element that holds most content, if possible
    one that readers have not written. No word takes out what holds it, nor another article unless
    the word stands by itself. Without such an element no word takes out what holds more
    than half of the content, but readers' words do if there is any other content.
    """
    readers: dict[Element, bool] = {}
    best, most = None, (False, 0)
    for e in elements:
        readers[e] = bool(e.whole & READERS) or (e.parent is not None and readers[e.parent])
        if e.tag in ARTICLES and not e.parent.within and e.content and (not readers[e], e.content) > most:
            best, most = e, (not readers[e], e.content)
    ways = set()
    while best is not None:
        ways.add(best)
        best = best.parent
    total = elements[0].content
    for e in elements:
        e.kept = not e.out and (e.parent is None or e.parent.kept)
        if not e.names or e in ways:
            continue
        if e.names & READERS and e.tag not in ARTICLES:
            spared = not ways and e.content == total
        elif e.whole:
            spared = not ways and 2 * e.content > total
        else:
            spared = 2 * e.content > total or (e.tag in ARTICLES and e.content > 0)
        e.kept = e.kept and spared


def extract(html: str) -> str:
    """The article's blocks in page order, one a line; empty if there are none."""
    page = Lines()
    cut = _TAG.search(html, html.rfind(">") + 1)
    if cut:
        html = html[: cut.start()]  # the page is cut off inside a tag
    page.feed(html)
    page.close()
    page.flush()
    lines = page.lines
    if not lines:
        return ""
    content = content_lines(lines)
    weigh(page, content)
    correct(page.elements)
    home = homes(page.elements)
    chosen = {home[e] for (_, _, e), good in zip(lines, content.tolist(), strict=True) if good and e.kept}
    return "\n".join(text for text, _, e in lines if e.kept and home[e] in chosen)


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``id_col``, the columns in ``keep``, ``text``.

    A kept column named ``text``, or as ``id_col``, comes back as ``text_in`` and so on. Null and empty
    pages, and pages without an article, give an empty text. Very long pages are parsed whole, in time
    proportional to their length. Repeated rows and null ids are kept as they are; an empty table gives an
    empty result. Nothing is shuffled.
    """
    carried = [F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)]
    rows = pages.select(F.col(id_col).alias("_id"), *carried, whole_text(html_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrow_texts(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([extract(t) for t in texts], pa.string())], [*batch.schema.names[:-1], "text"])

    schema = ", ".join(f"{n} {k}" for n, k in rows.dtypes[:-1])
    out = map_texts(rows, run, f"{schema}, text string")
    names = [f"{c}_in" if c in (id_col, "text") else c for c in keep]
    return out.select(F.col("_id").alias(id_col), *(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)), "text")
