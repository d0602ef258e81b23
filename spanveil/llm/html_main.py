"""Main text of HTML pages by tag-path ratios.

A page's text falls on root-to-leaf tag paths. Each path gets two ratios: text length per node and
punctuation per node. Both are smoothed along the page over the neighbouring paths' nodes, fused into one
value, and the nodes of paths above a threshold are content, wherever they stand: no tag name makes an article.
Links weigh nothing. Elements that by tag or role are navigation, header, footer, sidebar, notice or advert weigh nothing
either; forms, and those that are so by class or id only, are taken back if they hold half of the page's text or more in
several blocks or below a heading, as wrappers named for what stands beside them do. Names count as whole words, with
words of layout at most, and only on elements that lay out a page.

Thin blocks are added where they belong to content nodes: within the deepest element that holds nine tenths of the
content, the nearest element around a block that holds any content decides. If that is mostly content, a heading in it
is added, and so is any block that stands directly in it beside content. Tables, lists and the like that stand in it are added
whole if they are no list of links; a paragraph of links is, if it stands between two blocks of content.

A null or empty page has an empty text. Broken markup never fails: unclosed elements end with their
parents, stray end tags are ignored, an unended tag or comment runs to the end, what can't stand in a head ends it.
Pages of any size and depth take time in proportion to their length. Repeated rows give repeated results; other columns
are kept, and those named like the added ones are replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, lean, without

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math textarea title object select canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
OUTSIDE = frozenset("nav footer aside button dialog menu head".split())
#: Start tags that end an open element of the listed names, up to the nearest of the stop names.
ENDS = {
    **dict.fromkeys("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure details".split(), ({"p"}, {"div", "section", "article", "td", "th", "li", "blockquote", "body", "table"})),
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
#: A class or id of these words, alone or with words of layout, names what stands beside an article; other words make it a name of something else.
HINT = re.compile(r"ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pager|pagination|popup|promo\w*|related|replies|respond|share|sharing|sidebar|skip|social|sponsor\w*|subscribe|toolbar|widget", re.I)
LAYOUT = frozenset("a area article articles b bar block bottom box button buttons c col column container content footer form global group header icons inner item items layout left legal like link links list main map mobile outer page panel post posts primary region right row secondary section site stories sticky sub tools top topic topics top wrap wrapper".split())
WORDS = re.compile(r"[_\-]+|(?<=[a-z])(?=[A-Z])|[0-9]+")
NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog".split())
#: What may stand in a head; anything else ends it.
IN_HEAD = RAW | VOID | {"head", "html"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | {"p", "li", "td"}
#: What stands in an article as a whole, with its short cells and items.
PARTS = frozenset("table ul ol dl figure blockquote pre details".split())
#: Elements whose names say what they are about, not where they stand.
NAMED_FOR_TEXT = LEAVES | PARTS - {"ul", "ol"} | {"html", "body", "article", "main", "dt", "dd", "th"}
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？؟،]")
SPACE = re.compile(r"\s+")


class Block:
    """Text between two block boundaries, with the node it stands in and that node's tag path."""

    __slots__ = ("linked", "node", "outside", "path", "text")

    def __init__(self, text: str, node: int, path: int, outside: bool, linked: int):
        self.text, self.node, self.path, self.outside, self.linked = text, node, path, outside, linked

    @property
    def own(self) -> int:
        return max(0, len(self.text) - self.linked)


class Page:
    """The blocks of a page in order, and its elements: tag, parent (a smaller number), tag path, and whether a name marks it
    as outside. Element 0 is the page; inline tags are none."""

    def __init__(self, page: str):
        self.tags, self.parents, self.paths, self.named = ["#page"], [0], [0], [False]
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, str]] = []  # name, mark: "", "tag" or "name"
        self.elements = [0]  # the open ones that are not inline
        self.open, self.marked, self.in_link = defaultdict(list), Counter(), 0  # places of each name in the stack
        self.buffer: list[str] = []
        self.linked, self.path_ids = 0, {}
        self._read(page)

    def _push(self, name: str, mark: str) -> None:
        if name not in INLINE:
            above = self.elements[-1]
            self.elements.append(len(self.tags))
            self.tags.append(name)
            self.parents.append(above)
            self.paths.append(self.path_ids.setdefault((self.paths[above], name), len(self.path_ids) + 1))
            self.named.append(mark == "name")
        self.stack.append((name, mark))
        self.open[name].append(len(self.stack) - 1)
        self.marked[mark] += 1
        self.in_link += name == "a"

    def _pop(self) -> str:
        name, mark = self.stack.pop()
        if name not in INLINE:
            self.elements.pop()
        self.open[name].pop()
        self.marked[mark] -= 1
        self.in_link -= name == "a"
        return name

    def _flush(self) -> None:
        if self.buffer:
            text = SPACE.sub(" ", "".join(self.buffer)).strip()
            if text:
                node = self.elements[-1]
                self.blocks.append(Block(text, node, self.paths[node], self.marked["tag"] > 0, self.linked))
            self.buffer.clear()
        self.linked = 0

    def _add(self, text: str) -> None:
        if text:
            self.buffer.append(html.unescape(text))
            self.linked += len(text) if self.in_link else 0

    def _close_before(self, name: str) -> None:
        """Ends what a start tag of that name ends: a paragraph, an item, a head."""
        if self.open["head"] and name not in IN_HEAD:
            while self._pop() != "head":
                pass
        closes, stops = ENDS.get(name, ((), ()))
        last = lambda names: max((self.open[x][-1] for x in names if self.open[x]), default=-1)
        while (k := last(closes)) > last(stops):
            while len(self.stack) > k:
                self._pop()

    def _read(self, page: str) -> None:
        at, end, unclosed = 0, len(page), set()
        while at < end:
            found = TAG.search(page, at)
            if not found:
                self._add(page[at:])
                break
            self._add(page[at : found.start()])
            at = found.end() if found.end() > found.start() else found.start() + 1
            name = (found[2] or "").lower()
            if not name:
                continue
            if found[1]:
                if self.open[name]:
                    if name not in INLINE:
                        self._flush()
                    while self._pop() != name:
                        pass
                elif name in ("p", "br"):
                    self._flush()
                continue
            attributes = found[3]
            if name in RAW:
                empty = name in ("svg", "math") and attributes.rstrip().endswith("/")
                close = None if empty or name in unclosed else re.compile(rf"</{name}\s*>", re.I).search(page, at)
                if close:
                    at = close.end()
                elif name in ("script", "style", "textarea", "title"):
                    at = end
                elif not empty:
                    unclosed.add(name)
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    self._flush()
                continue
            if name not in INLINE:
                self._flush()
                self._close_before(name)
            self._push(name, self._mark(name, attributes))
        self._flush()

    def _mark(self, name: str, attributes: str) -> str:
        named = [next(filter(None, m), "") for m in NAMES.findall(attributes)] if "=" in attributes else []
        if name in OUTSIDE or (attributes and HIDDEN.search(attributes)) or any(x.lower() in ROLES for x in named) or (name == "header" and not self.open["article"]):
            return "tag"
        if name in ("form", "fieldset"):
            return "name"
        return "name" if name not in NAMED_FOR_TEXT and any(map(beside, named)) else ""


def beside(names: str) -> bool:
    """Whether one of the names, words between blanks, is of something beside an article."""
    for name in names.split():
        words = [w for w in WORDS.split(name) if w]
        if any(HINT.fullmatch(w) for w in words) and all(HINT.fullmatch(w) or w.lower() in LAYOUT for w in words):
            return True
    return False


def smooth(values: list[float], radius: int = 2) -> list[float]:
    """Means over a window with Gaussian weights, renormalised at both ends."""
    weights = [math.exp(-(d * d) / (2 * (radius / 2) ** 2)) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        near = [(values[i + d], weights[d + radius]) for d in range(-radius, radius + 1) if 0 <= i + d < len(values)]
        out.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    return out


def inside(page: Page) -> list[bool]:
    """Which blocks may be content: those in no element that is outside, marks by name taken back where they hold half of the text."""
    n = len(page.tags)
    held, count, closed = [0] * n, [0] * n, [False] * n
    for b in page.blocks:
        if not b.outside:
            held[b.node] += b.own
            count[b.node] += 3 if page.tags[b.node] in ("h1", "h2") else 1
    for e in range(n - 1, 0, -1):
        held[page.parents[e]] += held[e]
        count[page.parents[e]] += count[e]
    for e in range(1, n):
        closed[e] = closed[page.parents[e]] or (page.named[e] and not (2 * held[e] >= held[0] and count[e] >= 3))
    # A title's wrapper may be named header, but a first heading is no page header.
    return [not b.outside and (page.tags[b.node] == "h1" or not closed[b.node]) for b in page.blocks]


def content_blocks(page: Page) -> list[bool]:
    """Which blocks are content, by the fused and smoothed ratios of their paths."""
    blocks, may = page.blocks, inside(page)
    text, marks, nodes = defaultdict(int), defaultdict(int), defaultdict(int)
    for b, m in zip(blocks, may, strict=True):
        if m:
            text[b.path] += b.own
            marks[b.path] += len(PUNCTUATION.findall(b.text)) if b.linked * 2 < len(b.text) else 0
            nodes[b.path] += 1
    lengths = smooth([text[b.path] / nodes[b.path] if m else 0.0 for b, m in zip(blocks, may, strict=True)])
    points = smooth([marks[b.path] / nodes[b.path] if m else 0.0 for b, m in zip(blocks, may, strict=True)])
    by_path = defaultdict(list)
    for b, m, x, y in zip(blocks, may, lengths, points, strict=True):
        if m:
            by_path[b.path].append(math.sqrt(x * (1 + y)))
    value = {p: sum(v) / len(v) for p, v in by_path.items()}
    total = sum(text.values())
    if not total:
        return [False] * len(blocks)
    mean = sum(value[p] * text[p] for p in value) / total  # by characters: long paths set the level
    chosen = [m and value[b.path] >= 0.5 * mean and b.own * 2 >= len(b.text) for b, m in zip(blocks, may, strict=True)]
    return with_thin(page, may, chosen)


def with_thin(page: Page, may: list[bool], chosen: list[bool]) -> list[bool]:
    """The chosen blocks and the headings and thin blocks that belong to them."""
    n = len(page.tags)
    content, every, blocks_in = [0] * n, [0] * n, [0] * n
    for b, m, c in zip(page.blocks, may, chosen, strict=True):
        if m:
            every[b.node] += b.own
            content[b.node] += b.own if c else 0
            blocks_in[b.node] += c
    direct = [0] * n  # chosen blocks that stand in the element itself or in a child that holds nothing deeper
    for e in range(n - 1, 0, -1):
        up = page.parents[e]
        content[up] += content[e]
        every[up] += every[e]
        direct[up] += blocks_in[e] > 0
    total, root = content[0], 0
    for e in range(1, n):  # parents come first: the deepest element with nine tenths of the content
        if page.parents[e] == root and 10 * content[e] >= 9 * total and page.tags[e] not in LEAVES:
            root = e
    within = [e >= root for e in range(n)]
    for e in range(1, n):
        within[e] = e == root or (e > root and within[page.parents[e]])
    nearest = [0] * n
    for e in range(1, n):
        nearest[e] = e if content[e] else nearest[page.parents[e]]
    part, sizes, first, last = parts_of(page, content), defaultdict(lambda: [0, 0]), {}, {}
    for i, (b, m, c) in enumerate(zip(page.blocks, may, chosen, strict=True)):
        if m:
            sizes[part[b.node]][0] += b.own
            sizes[part[b.node]][1] += len(b.text)
        if c:
            for e in (b.node, page.parents[b.node]):
                first.setdefault(e, i)
                last[e] = i
    out = []
    for i, (b, m, c) in enumerate(zip(page.blocks, may, chosen, strict=True)):
        e, tag, p = nearest[b.node], page.tags[b.node], part[b.node]
        if m and not c and within[b.node] and 2 * content[e] >= every[e]:
            beside_it = e in (b.node, page.parents[b.node]) and direct[e] > 0
            if b.own * 2 >= len(b.text):
                c = tag in HEADINGS or (beside_it and tag != "div")
            elif tag == "p":
                c = beside_it and first.get(e, i) < i < last.get(e, i)
            if not c and p:
                c = direct[page.parents[p]] > 0 and 2 * sizes[p][0] >= sizes[p][1]
        out.append(c)
    return out


def parts_of(page: Page, content: list[int]) -> list[int]:
    """For each element the part (table, list, ...) that it is in or is, the outermost below an element with content; 0: none."""
    part = [0] * len(page.tags)
    for e in range(1, len(page.tags)):
        up = page.parents[e]
        part[e] = part[up] or (e if page.tags[e] in PARTS and content[up] else 0)
    return part


def main_text(page: str | None) -> str:
    if not page:
        return ""
    read = Page(page)
    return " ".join(b.text for b, keep in zip(read.blocks, content_blocks(read), strict=True) if keep)


def _extract(names: list[str], html_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(html_at).to_pylist()]
            kept = [c for i, c in enumerate(batch.columns) if i != html_at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*[n for i, n in enumerate(names) if i != html_at], "text", "n_chars"])

    return run


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with html replaced by text (its main text) and n_chars (code points)."""
    pages = without(pages, "text", "n_chars")
    schema = T.StructType([*[f for f in pages.schema.fields if f.name != html_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.mapInArrow(lean(_extract(pages.columns, pages.columns.index(html_col))), schema)


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(documents(spark, sf_dir, "pages").select(F.col("page_id"), F.col("url"), F.col("html")))
