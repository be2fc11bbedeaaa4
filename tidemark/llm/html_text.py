"""Main text of HTML pages (operator 4): parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser streams events. They make lines, one a block element, each with its text, its number of
tags and the region (article, main or nearest container) it is in; what stands in menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles or reader comments makes no line. The text-to-tag ratio of each line, smoothed
with a Gaussian window over its neighbours, is compared with a threshold from the page's own spread: lines above it
are content. Regions that hold such a line are the main text, with all their lines, short ones too; outside article and
main elements the line's own ratio counts too. Marks in a class, id or role say nothing on an element with most of the text.

Inside a block white space becomes one space; blocks are joined by a line end. Nulls: null html is empty and gives an
empty text; null page_id and url stay null. Repeated rows give equal texts; an empty table gives an empty result;
broken or cut markup is read as far as it goes; further columns are ignored.
"""

from __future__ import annotations

import collections
import functools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a line where they begin and where they end.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that hold no main text.
APART = frozenset("aside button canvas datalist dialog footer form head header iframe menu nav noscript object script select style svg template textarea title video audio".split())
REGION = frozenset("article main".split())
CONTAINER = frozenset("body blockquote div section table td".split())
_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Words of class, id and role names that mark what is not main text; fixed values.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsbygoogle sponsor sponsored promo promotion banner menu menubar nav navbar navigation "
    "navlinks breadcrumb breadcrumbs sidebar side aside footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup login paywall share sharing social related recommended recommendations comment comments commentlist "
    "respond disqus reply replies widget pagination pager skip search searchbox complementary contentinfo".split()
)
#: Those that mark a container whatever stands beside them in the name.
STRONG = frozenset(
    "ads adv advert adverts advertisement advertising adbox adsbygoogle sponsored promo menu menubar nav navbar navigation navlinks breadcrumb breadcrumbs "
    "sidebar footer masthead topbar toolbar cookie cookies consent gdpr newsletter subscribe signup login paywall commentlist respond disqus pagination pager searchbox".split()
)
#: Words that say nothing beside a mark: "comment-list" is marked, "comments-on-method" is not.
NEUTRAL = frozenset(
    "site page main section area zone box block list item items wrapper wrap container inner outer content body row col column left right top bottom bar form "
    "post posts article articles story stories news link links button buttons icon icons media text title heading group thread count slot unit panel card js".split()
)
#: Elements that are text themselves: only a name that says nothing else marks them.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt dl figure figcaption caption td th tr code em strong b i span a q cite mark small sub sup".split())
#: Spread of the smoothing window, in lines; share of the standard deviation that makes the threshold; share of a page's text that no mark takes out.
SIGMA, SPREAD, MOST = 1.5, 0.5, 0.75
_window = np.exp(-(np.arange(-4, 5) ** 2) / (2 * SIGMA**2))


def is_apart(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """2 for what is never main text, 1 for what a class, id or role marks, else 0."""
    if tag in APART:
        return 2
    marked = 0
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return 2
        if name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return 2
        if name in ("class", "id", "role") and value and tag not in ("html", "body", "article", "main"):
            if any(is_mark(word, tag) for word in value.split()):
                marked = 1
    return marked


@functools.lru_cache(10_000)
def is_mark(name: str, tag: str) -> bool:
    """Does one class, id or role name mark its element?"""
    words = [part.lower() for part in _parts.findall(name[:200]) if not part.isdigit()]
    found = [word in MARKS for word in words]
    if any(found) and all(mark or word in NEUTRAL for mark, word in zip(found, words, strict=True)):
        return True
    return tag not in TEXTUAL and any(word in STRONG for word in words)


class Lines(HTMLParser):
    """``lines``: (text, tags, region, whether the region is an article or main element)."""

    def __init__(self, plain: frozenset[int] = frozenset()):
        """``plain``: numbers of elements whose marks say nothing; ``marked`` has the characters right inside each of the others."""
        super().__init__(convert_charrefs=True)
        self.plain, self.marked, self.number, self.kept = plain, {}, 0, 0
        #: Of each marked element the marked element around it, 0 for none.
        self.around: dict[int, int] = {}
        self.stack: list[tuple[str, int, int, bool, int]] = [("", 0, 0, False, 0)]
        #: Where the open blocks are in the stack, and how many elements of each name are open: nothing is searched for in vain.
        self.blocks: list[int] = []
        self.open: collections.Counter[str] = collections.Counter()
        self.lines: list[tuple[str, int, int, bool]] = []
        self.text: list[str] = []
        self.tags = self.regions = 0

    def cut(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                _, _, region, main, _ = self.stack[-1]
                self.lines.append((text, self.tags, region, main))
                self.tags = 0
            self.text = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
            return
        apart = self.stack[-1][1]
        if tag in BLOCK:
            self.cut()
            if self.blocks and self.stack[self.blocks[-1]][0] == "p":  # a block ends a paragraph that is open in the same container
                self.shut(self.blocks[-1])
            apart = self.stack[-1][1]
        if not apart:
            self.tags += 1
        if tag in VOID:
            return
        _, _, region, main, owner = self.stack[-1]
        if tag in REGION and not main or tag in CONTAINER and not main:
            self.regions += 1
            region, main = self.regions, tag in REGION
        self.number += 1
        own = is_apart(tag, attrs) if apart < 2 else 0
        if own == 1 and self.number in self.plain:
            own = 0
        if own == 1:
            self.around[self.number] = owner
            owner = self.number
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.open[tag] += 1
        self.stack.append((tag, max(apart, own), region, main, owner))

    def shut(self, i: int) -> None:
        """Close the elements from place ``i`` on; each is looked at once in its life."""
        while len(self.stack) > i:
            tag = self.stack.pop()[0]
            self.open[tag] -= 1
            if self.blocks and self.blocks[-1] == len(self.stack):
                self.blocks.pop()

    def handle_endtag(self, tag):
        if tag in VOID or not self.open[tag]:
            return
        i = len(self.stack) - 1
        while self.stack[i][0] != tag:
            i -= 1
        if tag in BLOCK:
            self.cut()
        if not self.stack[i][1]:
            self.tags += 1
        self.shut(i)

    def handle_data(self, data):
        apart = self.stack[-1][1]
        if not apart:
            self.text.append(data)
            self.kept += len(data.strip())
        elif apart == 1:
            owner = self.stack[-1][4]
            self.marked[owner] = self.marked.get(owner, 0) + len(data.strip())

    def finish(self) -> list[tuple[str, int, int, bool]]:
        self.close()
        self.cut()
        return self.lines


def content_lines(ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are above the threshold after smoothing, and which of these are by themselves."""
    weight = np.convolve(np.ones(len(ratio)), _window, "full")[4:-4]
    smooth = np.convolve(ratio, _window, "full")[4:-4] / weight
    least = min(smooth.max(), SPREAD * smooth.std())
    return smooth >= least, (smooth >= least) & (ratio >= least)


def lines_of(html: str) -> list[tuple[str, int, int, bool]]:
    """Two passes at most: the second without the marks of elements that hold most of the text."""
    first = Lines()
    first.feed(html)
    lines, inside = first.finish(), dict(first.marked)
    total = first.kept + sum(inside.values())
    for number in sorted(first.around, reverse=True):  # what is inside has a larger number
        if around := first.around[number]:
            inside[around] = inside.get(around, 0) + inside.get(number, 0)
    if not (plain := frozenset(x for x, n in inside.items() if n > MOST * total)):
        return lines
    again = Lines(plain)
    again.feed(html)
    return again.finish()


def main_text(html: str | None) -> str:
    if not html:
        return ""
    lines = lines_of(html)
    if not lines:
        return ""
    lengths, tags = np.array([len(x[0]) for x in lines], float), np.array([x[1] for x in lines], float)
    regions = np.array([x[2] for x in lines])
    smooth, own = content_lines(lengths / np.maximum(tags, 1))
    mass = np.bincount(regions, lengths * smooth)
    mains = np.zeros(len(mass), bool)
    mains[[x[2] for x in lines if x[3]]] = True
    if (mass[mains] > 0).any():  # an article or main element that is content leaves no doubt about what stands outside
        chosen = mains & (mass > 0)
    else:
        chosen = np.bincount(regions, own, len(mass)) > 0
        chosen[mass.argmax()] = True
    return "\n".join(x[0] for x in lines if chosen[x[2]])


def extract(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html, ...)`` to ``(page_id, url, text, n_chars)``; no shuffle, one page in memory at a time."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(each, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
