"""HTML extraction: text-to-tag ratios of lines from the standard library's parser events.

The parser's events are folded into lines, one for each block of text, as they come; a line keeps its text, the tags
that opened since the line before and the container that it stands in. Lines of menus, headers, footers, sidebars,
adverts, forms, notices and reader comments, which their containers give away, count as lines without text. The
logarithms of the lines' ratios of characters to tags are smoothed by a Gaussian and parted into two clusters; lines
of the upper one are dense.

A region is the lines of one container (the whole of an article; neighbouring containers of a line each are one).
Its weight is the sum of the smoothed ratios of its dense lines. The weights are parted into two clusters likewise,
and the regions of the upper one hold the content, so that a footer's or an advert's lone line, which may be as
dense as a paragraph, falls behind a text of several. Dense regions of an article or main element go before others.
Of a content region the dense lines are kept, and runs of other lines that are short (headings, brief paragraphs
beside long ones) or plain (under two tags a line); long runs of lines with links or marks are left out.

Defined cases: a null or empty page has no text; a page whose text is all in excluded containers neither; equal
ratios or weights (a page of one line, regions alike) are all in the upper cluster; tags that are never closed end
with the container around them, and an article ends excluded containers left open; pages of any length are read
whole, in memory in proportion to the page; repeated rows are extracted each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftgraph.llm.cluster import map_arrow

#: Elements whose text is never content.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video select datalist textarea button".split())
#: Of these, those that a block ends if they were left open.
SOFT = frozenset("head select datalist button".split())
EXCLUDED = frozenset("nav footer aside form menu dialog".split())
CONTAINERS = frozenset("body div section article main nav aside header footer form ul ol dl table figure blockquote details fieldset menu dialog address center".split())
MAIN = frozenset(["article", "main"])
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre hr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class and id attributes that mark a container as no content.
MARKED = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promos?|banners?|sidebars?|side|menus?|nav(?:bar|igation)?|breadcrumbs?|footers?|masthead|top-?bar|toolbar|site-header|page-header|cookies?|consent|notices?|notifications?|alerts?|popups?|modal|overlay|newsletter|subscribe|signup|login|comments?|commentlist|replies|disqus|respond|social|share|sharing|related|recommended|widgets?|pagination|pager|skip-link|complementary|contentinfo|search(?:box|form)?|dialog)(?:$|[\s_-])", re.I)
SPREAD = np.exp(-0.5 * np.arange(-2, 3) ** 2.0)
#: Lines of a run that isn't dense, within a content region, that are kept whatever their tags are; and the mean
#: number of tags from which a longer run is left out (an entry of a list of links has two).
SHORT_RUN, MANY_TAGS = 4, 2.0


class Lines(HTMLParser):
    """Lines of one page: texts, tags, regions, and whether they are excluded or in an article."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.regions: list[int] = []
        self.main: list[bool] = []
        self.excluded: list[bool] = []
        self.stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # name, region, excluded, in an article
        self.parts: list[str] = []
        self.opened, self.n_regions, self.silent = 0, 1, ""
        self.around: list[int] = [0, 0]  # the region around each region

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                _, region, excluded, main = self.stack[-1]
                self.texts.append(text)
                self.tags.append(max(self.opened, 1))
                self.regions.append(region)
                self.excluded.append(excluded)
                self.main.append(main)
                self.opened = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.opened += 1
        if self.silent:
            if tag in MAIN or tag == "body" or self.silent in SOFT and tag in BLOCKS:
                self.silent = ""
            else:
                return
        if tag in SILENT:
            if tag not in INLINE:
                self.flush()
            self.silent = tag
            return
        if tag in INLINE:
            return
        self.flush()
        if tag in CONTAINERS:
            _, region, excluded, main = self.stack[-1]
            if tag in MAIN:
                excluded, main = False, True
            marks = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
            if tag in EXCLUDED or any(k == "hidden" for k, _ in attrs) or tag == "header" and not main or marks and tag not in MAIN and tag != "body" and MARKED.search(marks):
                excluded = True
            if excluded or not main or tag in MAIN:
                self.n_regions += 1
                self.around.append(region)
                region = self.n_regions
            self.stack.append((tag, region, excluded, main))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID or tag in INLINE:
            self.opened += 1
            if tag not in INLINE:
                self.flush()
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag == self.silent or tag in ("head", "html"):
                self.silent = ""
            return
        if tag in INLINE:
            return
        self.flush()
        if tag in CONTAINERS:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] == tag:
                    del self.stack[i:]
                    break

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)


def events(html: str) -> Lines:
    lines = Lines()
    lines.feed(html)
    lines.close()
    lines.flush()
    return lines


def smooth(ratios: np.ndarray) -> np.ndarray:
    """Gaussian means over neighbours, with the weights that fall on lines of the page."""
    wide = np.convolve(ratios, SPREAD, "full")[2:-2]
    return wide / np.convolve(np.ones(len(ratios)), SPREAD, "full")[2:-2]


def threshold(values: np.ndarray) -> float:
    """Middle of the centres of two clusters (Lloyd's steps from the least and the greatest value)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(20):
        upper = values >= (low + high) / 2
        if upper.all() or not upper.any():
            break
        now = float(values[~upper].mean()), float(values[upper].mean())
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2


def joined(lines: Lines) -> list[int]:
    """The region of each line, in which neighbouring containers of one line each, side by side, are one region."""
    sizes = Counter(lines.regions)
    out: list[int] = []
    for i, region in enumerate(lines.regions):
        last = lines.regions[i - 1] if i else region
        beside = last != region and lines.around[last] == lines.around[region] and lines.excluded[i - 1] == lines.excluded[i] and lines.main[i - 1] == lines.main[i]
        out.append(out[-1] if beside and sizes[last] == sizes[region] == 1 else region)
    return out


def content(lines: Lines) -> np.ndarray:
    """Which lines of a page are content."""
    excluded = np.array(lines.excluded, bool)
    if excluded.all():
        return ~excluded
    ratios = np.array([0.0 if out else np.log1p(len(t) / n) for t, n, out in zip(lines.texts, lines.tags, lines.excluded, strict=True)])
    smoothed = smooth(ratios)
    dense = (smoothed >= threshold(smoothed)) & ~excluded
    regions, tags, main = np.array(joined(lines)), np.array(lines.tags), np.array(lines.main)
    if not dense.any():
        return dense
    if (dense & main).any():
        dense &= main
    names = np.unique(regions[dense])
    weights = np.bincount(np.searchsorted(names, regions[dense]), smoothed[dense])
    chosen = names[weights >= threshold(weights)]
    at = np.flatnonzero(np.isin(regions, chosen) & ~excluded)
    at = at[np.argsort(regions[at], kind="stable")]
    kept = np.zeros(len(dense), bool)
    for run in np.split(at, np.flatnonzero((np.diff(regions[at]) != 0) | (np.diff(dense[at].astype(int)) != 0)) + 1):
        kept[run] = dense[run[0]] or len(run) <= SHORT_RUN or tags[run].mean() < MANY_TAGS
    return kept


def extract(html: str | None) -> str:
    """The main text of a page: its content blocks in page order, joined by one space."""
    lines = events(html or "")
    return " ".join(t for t, kept in zip(lines.texts, content(lines).tolist(), strict=True) if kept)


def with_main_text(pages: DataFrame, name: str = "text", column: str = "html") -> DataFrame:
    """``pages`` with the main text of ``column``."""

    def run(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 64):
            rows = batch.slice(at, 64)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([extract(x.as_py()) for x in rows.column(column)], pa.string())], names=[*rows.schema.names, name])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema), f"`{name}` string"])
    return map_arrow(pages, run, fields)
