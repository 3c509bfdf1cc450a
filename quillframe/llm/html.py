"""Main text of web pages from streaming parser events.

The standard library's parser yields events; block elements cut the page into lines, each with
its text, its number of tags and how much of it is in links. The text-to-tag ratios are smoothed
with a Gaussian; the lines at or above the threshold (the standard deviation) are high, and decide
on every page: the region is that which holds most text in high lines. Regions are the article
and main elements, and what is in none. An article or main element that is chosen is taken with
its headings and short lines; elsewhere it goes from the first to the last line that is high by
itself, with what else their common container holds directly or in parts with such a line.
Runs of low lines that are nothing but links are menus, and left out.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BLOCKS = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold the article.
OUTSIDE = frozenset("nav header footer aside form script style noscript template iframe object svg math button select textarea dialog menu head title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words in a class or id.
NAMES = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Elements that hold blocks of a text; the others are blocks themselves.
HOLDERS = frozenset("article body center details div dl figure html main ol section table tbody td tr ul".split())
#: Containers within more than so many others count as the last of these.
DEEP = 200


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, bool, tuple[int, ...]]] = []  # tag, outside the article, region, outside by names only, holders
        self.lines: list[tuple[str, int, bool, int, tuple[int, ...], bool]] = []  # text, tags, outside, region, holders, all in links
        self.count: dict[str, int] = {}  # open elements by tag
        self.plain = False  # whether the line has text outside of links
        self.holders = 0
        self.parts: list[str] = []
        self.tags = 0
        self.regions = 0

    def _where(self) -> tuple[bool, int]:
        return (self.open[-1][1], self.open[-1][2]) if self.open else (False, 0)

    def _cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, *self._where(), self.open[-1][4] if self.open else (), not self.plain))
            self.tags = 0
        self.parts = []
        self.plain = False

    def _outside(self, tag: str, attrs: list, region: int) -> bool:
        """Whether the element is outside by its tag or role."""
        return tag in OUTSIDE and not (tag == "header" and region) or any(k == "role" and v and v.lower() in ROLES for k, v in attrs)

    def _named(self, tag: str, attrs: list, region: int) -> bool:
        """Whether a whole name in class or id is one of ``NAMES``; it doesn't count on an element that opens a region."""
        if tag in ("html", "body") or tag in ("article", "main") and not region:
            return False
        return any(k in ("class", "id") and v and not NAMES.isdisjoint(v.lower().split()) for k, v in attrs)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        outside, region = self._where()
        leaves, named = self._outside(tag, attrs, region), self._named(tag, attrs, region)
        by_name = not leaves and (self.open[-1][3] if outside else named)
        leaves = leaves or named
        if tag in BLOCKS or leaves != outside:
            self._cut()
        self.tags += 1
        if tag in VOID:
            return
        if tag in ("p", "li") and self.open and self.open[-1][0] == tag:
            self._close(len(self.open) - 1)
            outside, region = self._where()
        if tag in ("article", "main") and not region and by_name:  # the names of its ancestors don't count
            outside = by_name = False
        if tag in ("article", "main") and not region and not outside and not leaves:
            self.regions += 1
            region = self.regions
        holders = self.open[-1][4] if self.open else ()
        if tag in HOLDERS and len(holders) < DEEP:
            self.holders += 1
            holders = (*holders, self.holders)
        self.open.append((tag, outside or leaves, region, by_name, holders))
        self.count[tag] = self.count.get(tag, 0) + 1

    def _close(self, at: int) -> None:
        for element in self.open[at:]:
            self.count[element[0]] -= 1
        del self.open[at:]

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._cut()
        self.tags += 1

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), -1) if self.count.get(tag) else -1  # looks at what it closes only
        if tag in BLOCKS or at >= 0 and self.open[at][1]:
            self._cut()
        self.tags += 1
        if at >= 0:
            self._close(at)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if not self.plain and not self.count.get("a") and not data.isspace():
            self.plain = True

    def finish(self) -> list[tuple[str, int, bool, int, tuple[int, ...], bool]]:
        self.close()
        self._cut()
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float, radius: int) -> np.ndarray:
    at = np.arange(-radius, radius + 1)
    kernel = np.exp(-(at**2) / (2 * sigma**2))
    return np.convolve(np.pad(ratios, radius), kernel / kernel.sum(), "valid")


def main_text(html: str, sigma: float = 1.0, radius: int = 2) -> str:
    """The article of one page, its blocks joined by line feeds; empty if there is none."""
    page = _Page()
    page.feed(html)
    lines = page.finish()
    inside = [k for k, x in enumerate(lines) if not x[2]]
    if not inside:
        return ""
    size = np.array([len(x[0]) for x in lines], float)
    ratio = np.where([x[2] for x in lines], 0.0, size / np.maximum(1, [x[1] for x in lines]))
    smooth = smoothed(ratio, sigma, radius)
    threshold = smooth.std()
    high = smooth >= threshold
    mass: dict[int, float] = {}
    for k in inside:
        mass[lines[k][3]] = mass.get(lines[k][3], 0.0) + (size[k] if high[k] else 0.0)
    best = max(mass, key=lambda r: (mass[r], r > 0, -r))
    chosen = [k for k in inside if lines[k][3] == best]
    if best == 0:  # no element says where the article is
        # smoothing lifts the neighbours of long lines, so the lines that are high themselves say which container it is
        peaks = [k for k in chosen if high[k] and ratio[k] >= threshold] or [k for k in chosen if high[k]]
        if not peaks:
            return ""
        common = os.path.commonprefix([lines[k][4] for k in peaks])
        deep = len(common)
        parts = {lines[k][4][: deep + 1] for k in peaks} | {common}
        chosen = [k for k in chosen if peaks[0] <= k <= peaks[-1] or lines[k][4][: deep + 1] in parts]
    menu = {k for a, b in zip(chosen, chosen[1:]) if max(ratio[a], ratio[b]) < threshold and lines[a][5] and lines[b][5] for k in (a, b)}
    return "\n".join(lines[k][0] for k in chosen if k not in menu)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for each row, from the whole page.

    A null or empty page, or one without an article, has the empty text. Unclosed elements end
    with their parent. Repeated rows stay repeated; an empty table gives an empty result; other
    columns are not read.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
