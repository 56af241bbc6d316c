"""Main text of web pages by tag-path ratios.

A page is scanned into blocks: runs of text between block-level tags, each with its root-to-leaf
path of tags. For each path, text length and punctuation are summed over the page and divided by
its number of blocks (a path that carries articles has long, punctuated blocks; menus have short
ones). The two ratios, taken block by block, are smoothed along the page with a Gaussian and fused
by their geometric mean; a path's score is the mean over its blocks, and paths above a threshold
that follows the page's own spread are content paths. The smallest element that holds all of them,
or the <article> or <main> around it, is the article, and all its blocks belong to it, so titles,
leads, short paragraphs, lists and further sections stay. If only the body holds them all, the
article is each of the body's elements with a content block and what stands between them.
Blocks inside elements that never hold the article (menus, footers, forms, adverts, comments ...)
are out whatever their ratio.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
_STOP = re.compile(r"[<>\"']")
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

# fixed values: element names by role
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas select option datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
OUTSIDE = frozenset("nav footer aside form button head menu dialog fieldset script style noscript template".split())
INSIDE = frozenset("article main".split())
ROOTS = frozenset("html body".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
# fixed values: words of class and id names, and roles, that mark what isn't the article
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo comment comments reply replies disqus "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side rail widget footer masthead "
    "cookie cookies consent notice notices alert popup modal newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations outbrain taboola pagination pager tags toolbar copyright legal disclaimer "
    "contentinfo complementary search skip".split()
)
# of these, words that an article's own parts may bear too: inside an article their paths' scores decide
WEAK = frozenset("side rail notice notices alert legal disclaimer copyright share related search skip social tags complementary".split())
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？¿¡]")
_SPACES = re.compile(r"[\s ]+")


def _marked(attributes: str) -> int:
    """2 if a name says that an element isn't the article, 1 if it may, else 0."""
    if "hidden" in attributes.split() or 'aria-hidden="true"' in attributes:
        return 2
    found = 0
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            words = {w.lower() for w in _SPLIT.split(a or b or c)} & NOT_ARTICLE
            if words:
                found = max(found, 1 if words <= WEAK else 2)
    return found


class Block:
    """Text between block-level tags: the number of its path and of the innermost element, and what that is marked."""

    __slots__ = ("text", "path", "element", "name", "outside")

    def __init__(self, text: str, path: int, element: int, name: str, outside: int):
        self.text, self.path, self.element, self.name, self.outside = text, path, element, name, outside


class Page:
    """Blocks in page order, and the block-level elements but html and body; element 0 is the body.

    Tags that aren't closed or opened in order are repaired as browsers do. Each character is read a
    bounded number of times, whatever the nesting: paths are numbered, an element knows its parent,
    and the places of open elements are kept by name.
    """

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.parent, self.top, self.names = [0], [0], ["body"]
        self.first, self.end = [0], [0]  # an element's blocks
        self.paths: dict[tuple[int, str], int] = {}
        #: of each open element: name; inside an article, mark of it or one around it; number, path
        self.stack: list[tuple[str, bool, int, int, int]] = []
        self.open: dict[str, list[int]] = {}
        self.solid: list[int] = []  # places in the stack that aren't inline
        self.held: list[str] = []
        self._scan(page)
        self.flush()
        self._close(0)
        self.end[0] = len(self.blocks)

    def flush(self) -> None:
        if self.held:
            text = _SPACES.sub(" ", html.unescape("".join(self.held))).strip()
            self.held.clear()
            if text:
                _, _, mark, element, path = self.stack[-1] if self.stack else ("", False, 0, 0, 0)
                name = self.stack[self.solid[-1]][0] if self.solid else ""
                self.blocks.append(Block(text, path, element, name, mark))

    def _close(self, upto: int) -> None:
        """Closes the elements from a place in the stack on."""
        stack = self.stack
        if upto < len(stack) and ((self.solid and self.solid[-1] >= upto) or stack[-1][2] != (stack[upto - 1][2] if upto else 0)):
            self.flush()
        while len(stack) > upto:
            name, _, _, element, _ = stack.pop()
            self.open[name].pop()
            if self.solid and self.solid[-1] == len(stack):
                self.solid.pop()
                self.end[element] = len(self.blocks)

    def _last(self, *names: str) -> int:
        """The place of the innermost open element of these names, -1 for none."""
        return max((self.open[n][-1] for n in names if self.open.get(n)), default=-1)

    def _push(self, name: str, inside: bool, mark: int) -> None:
        _, _, _, element, path = self.stack[-1] if self.stack else ("", False, 0, 0, 0)
        self.open.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.solid.append(len(self.stack))
            path = self.paths.setdefault((path, name), len(self.paths) + 1)
            if name not in ROOTS:
                self.parent.append(element)
                element = len(self.parent) - 1
                self.top.append(self.top[self.parent[element]] or element)
                self.names.append(name)
                self.first.append(len(self.blocks))
                self.end.append(len(self.blocks))
        self.stack.append((name, inside, mark, element, path))

    def _tag(self, page: str, at: int) -> int:
        """The place of the > that ends the tag whose attributes begin at `at`; -1 if none does before the next <."""
        while m := _STOP.search(page, at):
            if m[0] == ">":
                return m.start()
            if m[0] == "<":
                return -1
            at = page.find(m[0], m.end()) + 1
            if not at:
                return -1
        return -1

    def _scan(self, page: str) -> None:
        at, end = 0, len(page)
        while at < end:
            start = page.find("<", at)
            if start < 0:
                self.held.append(page[at:])
                return
            if start > at:
                self.held.append(page[at:start])
            if m := _OTHER.match(page, start):
                at = m.end()
                continue
            m = _NAME.match(page, start)
            stop = self._tag(page, m.end()) if m else -1
            if stop < 0:
                self.held.append("<")
                at = start + 1
                continue
            at = stop + 1
            name, attributes = m[2].lower(), page[m.end() : stop]
            if m[1]:
                self._end_tag(name)
            else:
                at = self._start_tag(name, attributes, page, at)

    def _end_tag(self, name: str) -> None:
        found = self._last(name)
        if found >= 0:
            # an inline end tag doesn't close the block it stands in
            if name not in INLINE or not self.solid or self.solid[-1] < found:
                self._close(found)
        elif name not in INLINE:
            self.flush()

    def _start_tag(self, name: str, attributes: str, page: str, at: int) -> int:
        """Opens the element; where to read on."""
        if name in ("svg", "math") and attributes.rstrip().endswith("/"):
            return at  # foreign elements end with such a tag; of others the slash means nothing
        if name in RAW:
            stop = _raw_end(name).search(page, at)
            if name not in ("svg", "math", "canvas", "object"):
                self.flush()
            return stop.end() if stop else len(page)
        if name == "br":
            self.held.append(" ")
            return at
        if name in VOID:
            if name == "hr":
                self.flush()
            return at
        if name not in INLINE:
            self.flush()
            if name in CLOSES_P:
                k = self._last("p")
                if k >= 0 and self._last("td", "th", "button", "object", "caption", "table") < k:
                    self._close(k)
            if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                k = self._last(*{"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,)))
                if k > self._last("ul", "ol", "dl", "table", "tbody", "thead"):
                    self._close(k)
        inside, outside = self.stack[-1][1:3] if self.stack else (False, 0)
        mark = 2 if name in OUTSIDE or (name == "header" and not inside) else 0
        if not mark and attributes and name not in ("body", "html", "article", "main"):
            mark = _marked(attributes)
            if mark == 1 and not inside:
                mark = 2
        if mark > outside and name in INLINE:
            self.flush()
        if not attributes.rstrip().endswith("/") or name not in ("path", "use"):
            self._push(name, inside or name in INSIDE, max(outside, mark))
        return at

    def around(self, blocks: np.ndarray) -> int:
        """The innermost element that holds all these blocks, 0 for the body."""
        lo, hi = int(blocks[0]), int(blocks[-1])
        element = self.blocks[lo].element
        while element and self.end[element] <= hi:
            element = self.parent[element]
        return element


@lru_cache(64)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\s*>", re.I)


def _smooth(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.convolve(x, kernel)[reach : reach + len(x)]
    return padded / np.convolve(np.ones(len(x)), kernel)[reach : reach + len(x)]


def path_scores(found: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Each block's fused tag-path ratio: text and punctuation a block on its path, smoothed; then the mean of its path."""
    _, path = np.unique([b.path for b in found], return_inverse=True)
    blocks = np.bincount(path)
    text = np.bincount(path, [len(b.text) for b in found]) / blocks
    marks = np.bincount(path, [len(_PUNCTUATION.findall(b.text)) for b in found]) / blocks
    fused = np.sqrt(_smooth(text[path]) * (_smooth(marks[path]) + 0.1))
    return fused, (np.bincount(path, fused) / blocks)[path]


def main_text(page: str) -> str:
    """The article's blocks, joined by one space."""
    p = Page(page)
    found = p.blocks
    mark = np.array([b.outside for b in found], np.int8)
    if not (mark == 0).any():
        return ""
    scores, of_path = path_scores(found)
    threshold = min(scores.std(), 0.5 * of_path[mark == 0].max())
    own = (mark == 0) | ((mark == 1) & (of_path >= threshold))  # a weak mark yields to the path's score
    content = np.flatnonzero(own & (of_path >= threshold))
    article = _article(p, content)
    if article:
        return " ".join(found[k].text for k in range(p.first[article], p.end[article]) if own[k])
    # the article's blocks stand right in the body
    headings = {"h1", "h2", "h3", "h4", "h5", "h6"}
    tops = {p.top[found[k].element] for k in content} - {0}
    keep = [content[0] <= k <= content[-1] or p.top[b.element] in tops for k, b in enumerate(found)]
    for k in range(len(found) - 2, -1, -1):
        keep[k] = keep[k] or (keep[k + 1] and found[k].name in headings)
    return " ".join(b.text for k, b in enumerate(found) if keep[k] and own[k])


def _article(page: Page, content: np.ndarray) -> int:
    """The article's element, 0 for the body."""
    shared = page.around(content)
    if shared and all(page.blocks[k].element == shared for k in range(page.first[shared], page.end[shared])):
        shared = page.parent[shared]  # it is but the block itself: a paragraph is no article
    element = shared
    while element:
        if page.names[element] in INSIDE:
            return element
        element = page.parent[element]
    return shared


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars), a row for each row of pages.

    A null or empty html gives an empty text. Character references are decoded, white space inside
    a block is one space. Markup of any length and nesting is scanned whole, in one pass. Extra
    columns are left out; repeated rows give equal rows; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)[id_col]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
