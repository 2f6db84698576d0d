"""Main text of web pages by smoothed text-to-tag ratios.

The standard library's parser streams a page's events once. Block elements cut it into lines, each
with its text and its count of tags; what is never text for a reader (scripts, controls of forms,
hidden parts) makes no line. The ratios of text to tags are smoothed along the page by a Gaussian,
weighed down where the elements around a line are named or meant for something else (a menu, an
advert, a footer, reader comments, ...), and split in two clusters. Content regions are grown around
all lines of the high cluster; the short lines of a region stay with it, unless they weigh less than
the region itself. All sums go up or down the tree once, so a page costs time in proportion to its
length, however deep it is nested.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.llm.words import arrow_map

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section select "
    "summary table tbody tfoot thead tr ul".split()
)
SPACING = frozenset("br td th img wbr".split())
#: Elements without text for a reader.
PASSED = frozenset(
    "script style noscript template head title button select textarea label option iframe object svg "
    "math canvas audio video dialog".split()
)
CONTENT = frozenset(("article", "main"))
#: What elements weigh, at most: a line has the least weight of the elements around it.
MEANT = {"nav": 0.02, "menu": 0.02, "footer": 0.05, "aside": 0.05, "header": 0.05}
BESIDE, COMPOUND, WITHIN, CLUTTER, MILD = 0.99, 0.2, 0.6, 0.05, 0.8
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words in a class or id that name what is no article text; the second kind may also name a part of one.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav "
    "navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies "
    "consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended comment comments replies reply respond "
    "disqus pagination pager widget toolbar skip".split()
)
MILD_NAMES = frozenset(("discussion",))
_MARKERS = frozenset(("has", "no", "with", "without", "is", "js"))
#: A start tag of the key closes an open element of the values.
_CLOSES = {t: frozenset(("p",)) for t in BLOCK - {"body", "html"}} | {
    "li": frozenset(("li", "p")),
    "dt": frozenset(("dt", "dd", "p")),
    "dd": frozenset(("dt", "dd", "p")),
    "tr": frozenset(("tr", "td", "th", "p")),
    "td": frozenset(("td", "th", "p")),
    "th": frozenset(("td", "th", "p")),
    "option": frozenset(("option",)),
}
_SCOPE = frozenset("html body article main section div table ul ol dl td th nav aside header footer form".split())


def _name_weight(value: str, inside: bool) -> float:
    """What the words of a class and id weigh; a compound name counts less, inside content even less."""
    weight = 1.0
    for name in value.lower().split():
        parts = re.split(r"[-_:]+", name)
        if name in NAMES:
            weight = min(weight, CLUTTER)
        elif name in MILD_NAMES:
            weight = min(weight, MILD if inside else COMPOUND)
        elif parts[0] not in _MARKERS and (parts[0] in NAMES or parts[-1] in NAMES):
            weight = min(weight, WITHIN if inside else COMPOUND)
    return weight


@dataclass
class _Element:
    tag: str
    number: int
    passed: bool
    content: bool


@dataclass
class Line:
    """One block of a page: the element it is in, its text pieces, and its tags."""

    element: int
    pieces: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0
    text: str = ""


class PageLines(HTMLParser):
    """Collects the lines of a page, and per element its parent, tag, weight and kind.

    Elements are numbered in page order from 1, so a parent has a smaller number; 0 is the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[_Element] = []
        self.open: Counter[str] = Counter()
        self.lines: list[Line] = []
        self.tag = [""]
        self.parent = [0]
        self.weight = [1.0]
        self.content = [False]
        self.waiting = 0
        self.line: Line | None = None

    def end_line(self) -> None:
        if self.line is not None:
            self.line.text = " ".join("".join(self.line.pieces).split())
            if self.line.text:
                self.lines.append(self.line)
            else:
                self.waiting += self.line.tags
        self.line = None

    def close_from(self, i: int) -> None:
        for e in self.stack[i:]:
            self.open[e.tag] -= 1
        del self.stack[i:]

    def handle_starttag(self, tag: str, attributes) -> None:
        closes = _CLOSES.get(tag)
        if closes and any(self.open[t] for t in closes):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].tag in closes:
                    self.close_from(i)
                    break
                if self.stack[i].tag in _SCOPE:
                    break
        if tag in BLOCK:
            self.end_line()
        elif tag in SPACING:
            self.handle_data(" ")
        self.note_tag()
        if tag in VOID:
            return
        above = self.stack[-1] if self.stack else _Element("", 0, False, False)
        named = dict(attributes)
        passed = above.passed or tag in PASSED or self.is_hidden(named)
        content = above.content or tag in CONTENT or (named.get("role") or "").lower() == "main"
        self.parent.append(above.number)
        self.tag.append(tag)
        self.content.append(content)
        self.weight.append(min(self.weight[above.number], self.own_weight(tag, named, above.content)))
        self.stack.append(_Element(tag, len(self.parent) - 1, passed, content))
        self.open[tag] += 1

    @staticmethod
    def is_hidden(attributes: dict) -> bool:
        if "hidden" in attributes or attributes.get("aria-hidden") == "true":
            return True
        return "display:none" in re.sub(r"\s", "", attributes.get("style") or "").lower()

    @staticmethod
    def own_weight(tag: str, attributes: dict, inside: bool) -> float:
        if tag in ("html", "body", "main"):
            return 1.0
        if tag == "header" and inside:  # the heading of an article, whatever it is called
            return 1.0
        weight = MEANT.get(tag, 1.0)
        if (attributes.get("role") or "").lower() in ROLES:
            weight = min(weight, CLUTTER)
        names = f"{attributes.get('class') or ''} {attributes.get('id') or ''}"
        return min(weight, _name_weight(names, inside)) if not names.isspace() else weight

    def handle_startendtag(self, tag: str, attributes) -> None:
        self.handle_starttag(tag, attributes)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                self.note_tag()
                self.close_from(i)
                return

    def note_tag(self) -> None:
        if self.line is not None:
            self.line.tags += 1
        else:
            self.waiting += 1

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1].passed:
            return
        if self.line is None:
            block = self.stack[-1].number if self.stack else 0
            while block and self.tag[block] not in BLOCK:
                block = self.parent[block]
            self.line = Line(block, tags=self.waiting)
            self.waiting = 0
        self.line.pieces.append(data)
        if self.open["a"]:
            self.line.linked += len(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """`<![` opens a comment up to the next `>`, as in browsers; the base class fails on unknown names."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; the page's ends are repeated."""
    reach = int(np.ceil(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.concatenate([np.full(reach, ratios[0]), ratios, np.full(reach, ratios[-1])])
    return np.convolve(padded, weights / weights.sum(), "valid")


def high_cluster(values: np.ndarray) -> np.ndarray:
    """Which values belong to the upper of two clusters, by the threshold halfway between their means."""
    threshold = (values.min() + values.max()) / 2
    for _ in range(50):
        high = values >= threshold
        if high.all():
            break
        following = (values[high].mean() + values[~high].mean()) / 2
        if following == threshold:
            break
        threshold = following
    return values >= threshold


GROWTH = 0.25
LEAST = 1.0


def _form_weights(page: PageLines, sizes: np.ndarray) -> None:
    """A form that holds most of a page's text is the page; any other is no article text."""
    held = np.zeros(len(page.parent))
    np.add.at(held, [x.element for x in page.lines], sizes)
    for e in range(len(held) - 1, 0, -1):
        held[page.parent[e]] += held[e]
    for e in range(1, len(held)):
        own = CLUTTER if page.tag[e] == "form" and held[e] < 0.5 * held[0] else 1.0
        page.weight[e] = min(page.weight[e], own, page.weight[page.parent[e]])


def _regions(page: PageLines, sizes: np.ndarray, high: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The least weight among the regions around each element, infinite where there is none.

    A region starts at the element that holds a high line's block, and at the outermost article or
    main element around it. It grows to the element above while that adds little low text for the
    high text there; the whole body is a region only if its high lines are all in one place.
    """
    n, parent = len(page.parent), page.parent
    rich, poor, lines = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    marked = np.zeros(n, bool)
    outer = [0] * n
    for e in range(1, n):
        outer[e] = outer[parent[e]] or (e if page.content[e] else 0)
    for line, size, good, weight in zip(page.lines, sizes, high, weights, strict=True):
        lines[line.element] += 1
        if good:
            rich[line.element] += size
            marked[parent[line.element] if lines[line.element] == 1 else line.element] = True
            marked[outer[line.element]] |= bool(outer[line.element])
        elif weight == 1.0 and 2 * line.linked <= size:
            poor[line.element] += size
    for e in range(n - 1, 0, -1):
        for sums in (rich, poor, lines):
            sums[parent[e]] += sums[e]
    top = np.array([page.tag[e] in ("", "html", "body") for e in range(n)])
    for e in range(n - 1, 0, -1):
        up = parent[e]
        if marked[e] and not marked[up]:
            little = poor[up] - poor[e] <= GROWTH * rich[up]
            marked[up] = (not top[up] and little) or (lines[e] == 1 and rich[e] == rich[0])
    least = np.full(n, np.inf)
    for e in range(n):
        least[e] = min(least[parent[e]], page.weight[e] if marked[e] else np.inf)
    return least


def main_lines(html: str) -> list[str]:
    """The lines of the content regions, in page order."""
    page = PageLines()
    page.feed(html)
    page.close()
    page.end_line()
    lines = page.lines
    if not lines:
        return []
    sizes = np.array([float(len(x.text)) for x in lines])
    _form_weights(page, sizes)
    weights = np.array([page.weight[x.element] for x in lines])
    inside = np.array([page.content[x.element] for x in lines])
    if (inside & (weights == 1.0)).any():  # only what is long stays beside an article
        weights = np.where(inside, weights, np.minimum(weights, BESIDE))
    ratios = sizes / np.array([max(1, x.tags) for x in lines])
    values = smoothed(ratios) * weights
    high = high_cluster(values) & ((weights == 1.0) | (values >= LEAST))
    around = _regions(page, sizes, high, weights)
    return [
        x.text
        for x, size, good, weight in zip(lines, sizes, high, weights, strict=True)
        if good or (weight >= around[x.element] and (page.content[x.element] or 2 * x.linked <= size))
    ]


EXTRACTED = "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint"


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks) for every page, from its whole html.

    Character references are decoded, white space inside a block is one space, and blocks are joined
    by an empty line. A null, empty or textless page has an empty text. Broken markup is read as far
    as it goes; what stands after an unclosed element counts as inside it. Other columns are ignored.
    """

    def extract(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            found = [main_lines(html or "") for html in part.column(2).to_pylist()]
            texts = ["\n\n".join(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([len(x) for x in found], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars", "n_blocks"],
            )

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    return rows.mapInArrow(arrow_map(extract), EXTRACTED)
