"""Main text of HTML pages by text-to-tag ratios.

The standard library's parser streams events that become lines: a line ends where a block begins or ends. A line's
ratio is its characters outside links by its tags. The ratios are smoothed with a Gaussian and split in two clusters; the
upper one says where the content is. Elements are a prior only: menus, forms and the like never count, ``article`` and
``main`` need less of the upper cluster to be chosen, and where there is neither, the innermost section that holds
the upper cluster is. Of the region so chosen short lines stay as well; blocks whose names may mark furniture, lists of
links and what lies round the region stay only with lines of the upper cluster.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Elements by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title iframe object svg math canvas audio video select button textarea datalist option optgroup".split())
FURNITURE = frozenset("nav footer aside form menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words in class and id names that mark furniture: of these kinds a page's text is no part ...
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|sponsored|banner|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|"
    r"header|masthead|topbar|footer|bottombar|sidebar|comment|comments|commentlist|disqus|respond|replies|cookie|cookies|consent|gdpr|notice|notices|"
    r"popup|modal|newsletter|subscribe|signup|login)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: ... and of these it may be: their ratios decide.
PERHAPS = re.compile(
    r"(?:^|[\s_-])(?:sponsor|promo|promotion|foot|side|aside|widget|widgets|discussion|alert|overlay|share|sharing|social|related|recommended|copyright|legal|skip|pagination|pager|toolbar)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Names that win over both where they stand in one attribute, as in "article-header": the article's own parts ...
OWN = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main)(?:$|[\s_-])", re.IGNORECASE)
#: ... but for these, whatever stands beside them.
NEVER = re.compile(r"(?:^|[\s_-])(?:comment|comments|sidebar|footer)(?:$|[\s_-])", re.IGNORECASE)
_COMMENTS = re.compile(r"(?:^|[\s_-])comments?(?:$|[\s_-])", re.IGNORECASE)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("article main section div td body".split())
#: Open elements that a new one ends (those of the same kind up to the nearest element that holds them).
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
ENDS_P = BLOCKS - {"br", "html", "head", "body", "title", "option", "optgroup", "tbody", "thead", "tfoot", "tr", "td", "th", "li", "dd", "dt", "caption", "legend"}
#: Standard deviation of the smoothing, in lines.
SIGMA = 1.0
#: An article or main element is chosen if it holds this share of the upper cluster's ratios; any other section needs the larger one.
MARKED_SHARE, SHARE = 0.2, 0.8


class Line(NamedTuple):
    text: str
    tags: int
    linked: int
    furniture: bool
    perhaps: bool
    section: int
    heading: bool


class _Lines(HTMLParser):
    """Collects the lines of a page, and its sections as a tree."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, bool, int]] = []  # name, hidden, furniture, perhaps furniture, section
        self.parents: list[int] = [-1]  # section 0 is the page
        self.kinds: list[str] = ["page"]
        self.in_article: list[bool] = [False]  # for each section: it is an article or main, or lies in one
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags = self.linked = self.links = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            _, _, furniture, perhaps, section = self.open[-1] if self.open else ("", False, False, False, 0)
            heading = any(name in HEADINGS for name, *_ in self.open[-4:])
            self.lines.append(Line(text, self.tags, self.linked, furniture, perhaps, section, heading))
            self.tags = self.linked = 0
        self.text = []

    def close_to(self, k: int) -> None:
        for name, *_ in self.open[k:]:
            self.links -= name == "a"
        del self.open[k:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        if tag in VOID:
            return
        if tag in ENDS_P:
            self._end_nearest({"p"}, SECTIONS | {"li", "table", "blockquote", "button", "form", "header", "footer", "nav", "aside"})
        if tag in ENDS:
            self._end_nearest(*ENDS[tag])
        _, hidden, furniture, perhaps, section = self.open[-1] if self.open else ("", False, False, False, 0)
        own = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden", "style")}
        in_article = self.in_article[section]
        names = f"{own.get('class', '')} {own.get('id', '')}"
        if tag in ("html", "body", "article", "main"):
            marked, maybe = _COMMENTS.search(names), None
        else:
            marked = NEVER.search(names) or not OWN.search(names) and NAMES.search(names)
            maybe = not OWN.search(names) and PERHAPS.search(names)
        furniture = furniture or tag in FURNITURE or tag == "header" and not in_article or own.get("role", "").lower() in ROLES or bool(marked)
        hidden = hidden or tag in HIDDEN or "hidden" in own or own.get("aria-hidden") == "true" or _UNSEEN.search(own.get("style", "")) is not None
        if tag in SECTIONS:
            self.parents.append(section)
            self.kinds.append(tag)
            self.in_article.append(in_article or tag in ("article", "main"))
            section = len(self.parents) - 1
        self.links += tag == "a"
        self.open.append((tag, hidden, furniture, perhaps or bool(maybe), section))

    def _end_nearest(self, kinds: set[str], within: set[str] | frozenset[str]) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in kinds:
                return self.close_to(k)
            if self.open[k][0] in within:
                return None

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do: the slash says nothing

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                return self.close_to(k)
            if self.open[k][0] in ("article", "main", "table", "body") and tag not in ("article", "main", "table", "body", "html", "div", "section"):
                return None

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][1]:
            return
        self.text.append(data)
        if self.links:
            self.linked += len(data)


def _two_means(values: np.ndarray) -> float:
    """The threshold between two clusters of numbers."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        upper = values > cut
        if not upper.any() or upper.all():
            return cut
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _smooth(values: np.ndarray) -> np.ndarray:
    reach = max(1, math.ceil(3 * SIGMA))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel, "full")[reach : reach + len(values)]
    return np.convolve(values, kernel, "full")[reach : reach + len(values)] / weight


def main_text(html: str) -> str:
    """The article of a page: its blocks in page order, joined by blanks; empty if there is none."""
    page = _Lines()
    page.feed(html)
    page.close()
    page.end_line()
    lines = page.lines
    free = np.array([not line.furniture for line in lines], bool)
    if not free.any():
        return ""
    ratio = np.array([max(0, len(line.text) - line.linked) / max(1, line.tags) if ok else 0.0 for line, ok in zip(lines, free)])
    smooth = _smooth(ratio)
    links = np.array([2 * line.linked > len(line.text) for line in lines], bool)
    upper = (smooth > _two_means(smooth)) & free & ~links if smooth.max() > smooth.min() else free
    if not upper.any():
        upper = free
    inside, beside = _region(page, lines, free, upper, links, smooth)
    kept = free & (inside | beside & (upper | np.array([line.heading for line in lines], bool)))
    kept &= upper | ~np.array([line.perhaps for line in lines], bool)
    return " ".join(line.text for line, ok in zip(lines, kept) if ok)


def _region(page: _Lines, lines: list[Line], free: np.ndarray, upper: np.ndarray, links: np.ndarray, smooth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines of the region that the upper cluster chooses, lines of the element that holds it)."""
    n = len(page.parents)
    mass, nested = [0.0] * n, [False] * n
    for line, chosen, weight in zip(lines, upper, smooth.tolist()):
        mass[line.section] += weight if chosen else 0
    for s in range(n - 1, 0, -1):  # a section comes after the one that holds it
        mass[page.parents[s]] += mass[s]
    for s in range(1, n):
        nested[s] = nested[page.parents[s]] or page.kinds[page.parents[s]] == "article"

    def under(roots: set[int]) -> np.ndarray:
        known = [False] * n
        for s in range(n):
            known[s] = s in roots or s > 0 and known[page.parents[s]]
        return np.array([known[line.section] for line in lines], bool)

    nothing = np.zeros(len(lines), bool)
    marked = [s for s in range(n) if page.kinds[s] in ("article", "main") and not nested[s]]
    articles = [s for s in marked if page.kinds[s] == "article"] or marked
    best = max(articles, key=lambda s: mass[s], default=0)
    if best and mass[best] > 0 and mass[best] >= MARKED_SHARE * mass[0]:
        # all parts of the article that stand side by side; and of what holds them what the ratios, or a heading, tell
        parts = {s for s in articles if page.parents[s] == page.parents[best]}
        around = best
        while around > 0 and page.kinds[around] != "main":
            around = page.parents[around]
        return under(parts), under({around}) if around > 0 else nothing
    root = _densest(page, lines, free, mass)
    inside = under({root}) & free & (upper | ~links)
    if page.kinds[root] in ("page", "body"):
        # nothing holds the text together: it goes from the first to the last line of the upper cluster, and on both sides
        # as far as plain lines of the same section, or headings, stand next to it
        places = np.flatnonzero(upper)
        first, last = int(places[0]), int(places[-1])
        while first > 0 and inside[first - 1] and (lines[first - 1].heading or lines[first - 1].section == lines[first].section):
            first -= 1
        while last + 1 < len(lines) and inside[last + 1] and lines[last + 1].section == lines[last].section:
            last += 1
        inside[:first] = inside[last + 1 :] = False
    return inside, nothing


def _densest(page: _Lines, lines: list[Line], free: np.ndarray, mass: list[float]) -> int:
    """The innermost section with most of the upper cluster; not further in where only headings would be left outside."""
    children: dict[int, list[int]] = {}
    for s in range(1, len(mass)):
        if mass[s] >= SHARE * mass[0]:
            children.setdefault(page.parents[s], []).append(s)
    chain = [0]
    while own := children.get(chain[-1]):
        chain.append(own[0])
    depth = {s: k for k, s in enumerate(chain)}
    at = [0] * len(mass)  # how far in along the chain a section lies
    for s in range(1, len(mass)):
        at[s] = depth.get(s, at[page.parents[s]])
    outside: list[list[bool]] = [[] for _ in chain]
    for line, ok in zip(lines, free):
        if ok:
            outside[at[line.section]].append(line.heading)
    for k, found in enumerate(outside[:-1]):
        if found and all(found):
            return chain[k]
    return chain[-1]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page from its whole HTML; null or empty HTML gives an empty text.

    Repeated rows give repeated rows; other columns are not carried. No shuffle.
    """
    types = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [main_text(h) if h else "" for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, text string, n_chars long")
