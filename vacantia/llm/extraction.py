"""Operator 9: main text of web pages by a minimum cut.

A page becomes a row of text blocks. A classifier gives each block costs for being content or not: what its nearest telling
ancestor says (tag, role, class or id) and a logistic model of its text, trained here on blocks whose ancestors tell.
The costs are the capacities from source and to sink; neighbouring blocks, and neighbours below one parent, are tied by
capacities that fall with their distance in the document tree. The maximum flow gives the cut of least cost.

Tags and roles say what they say. Names are weaker: a class that speaks of the layout ('has-sidebar', 'ad-free') says
nothing, inside an article only names of foreign matter count, and on a page without article tags a name that may stand for layout does not
speak for the element that holds most of the running text. Where marked content holds most of it, what lies beside with no sign of its own
is taken for foreign.

Pages are cut into tags and text by one linear pattern, and elements know their parent only, so time and memory follow the
page's length whatever it holds.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.texts import slices

# Names that tell content from the rest.
RAW = set("script style textarea title iframe noframes noembed xmp".split())
DROPPED = RAW | set("noscript template object svg canvas head select audio video".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
OTHER_TAGS = set("nav header footer aside form menu button dialog".split())
CONTENT_TAGS = set("article main".split())
OTHER_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
FOREIGN_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent breadcrumb breadcrumbs comment comments reply "
    "replies respond discussion share sharing social related recommended pagination pager subscribe newsletter signup login popup modal overlay copyright".split()
)
PLACE_NAMES = set("banner notice alert menu nav navbar navigation sidebar aside footer header masthead widget toolbar".split())
# These never stand for the layout of what holds the article.
CERTAIN_NAMES = set("cookie cookies consent comment comments reply replies respond discussion breadcrumb breadcrumbs pagination copyright".split())
CONTENT_NAMES = set("article content post entry story main".split())
LAYOUT_WORDS = set(
    "has have no not non with without is are free hide hides hidden show shows enable enabled disable disabled support supports layout wrap wrapper wrapped container "
    "outer inner grid row col column columns theme template".split()
)

TELLING = {True: 3.0, False: -6.0}
BESIDE = -4.0
MOST = 0.5
ADJACENT, RELATED = 0.4, 0.8
SCALE = 1000
SAMPLE_PAGES = 400
# Used where a sample has no blocks of both kinds: bias, log words, link share, sentence end, comma share.
DEFAULT_WEIGHTS = (-2.0, 0.8, -4.0, 1.0, 0.5)

# Attributes up to the end of a tag; quotes count as values after '=' alone. A tag that never ends takes the rest.
_ATTRIBUTES = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?|["'])*+"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:-->|\Z))|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>{_ATTRIBUTES})(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_NAMING = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*|[0-9]+")


@dataclass
class Block:
    """Text of a page between two block tags. `step`: how many elements end and begin between it and the block before."""

    text: str
    linked: int
    element: int
    parent: int
    step: int
    telling: bool | None = None
    beside: bool = False

    def features(self) -> list[float]:
        words = self.text.count(" ") + 1
        return [1.0, math.log(words), self.linked / max(len(self.text), 1), float(self.text[-1] in ".!?…\"'”»:"), min(1.0, self.text.count(",") / words)]

    @property
    def running(self) -> int:
        """Characters of running text."""
        return len(self.text) - self.linked if self.text.count(" ") >= 4 else 0


@dataclass
class Element:
    tag: str
    parent: int
    rest: str
    running: int = 0
    telling: bool | None = None
    inside: bool = False


def named(names: str, inside: bool) -> tuple[bool | None, bool]:
    """What class and id names say (True content, False not, None nothing), and whether for certain."""
    words: set[str] = set()
    for name in names.split():
        parts = {w.lower() for w in _WORDS.findall(name)}
        if not parts & LAYOUT_WORDS:
            words |= parts
    if found := words & (FOREIGN_NAMES if inside else FOREIGN_NAMES | PLACE_NAMES):
        return False, bool(found & CERTAIN_NAMES)
    return (True, False) if words & CONTENT_NAMES else (None, False)


def told(element: Element, inside: bool, share: float) -> bool | None:
    """What an element itself says of its text. `inside`: it lies in content; `share`: its part of the running text, where the page has no article."""
    tag = element.tag
    if tag in OTHER_TAGS and not (inside and tag == "header"):
        return False
    given = {name.lower(): value.strip("\"'") for name, value in _NAMING.findall(element.rest)}
    role = given.get("role", "").lower()
    if role in OTHER_ROLES and not (inside and role in ("alert", "banner")):
        return False
    says, certain = (None, False) if tag in ("body", "html") else named(f"{given.get('class', '')} {given.get('id', '')}", inside)
    if says is False and (certain or share <= MOST):
        return False
    return True if says or tag in CONTENT_TAGS or role in ("main", "article") else None


class Page:
    """Text blocks of a page in their order, and its elements, parents before children."""

    def __init__(self, html: str) -> None:
        self.blocks: list[Block] = []
        self.elements = [Element("", 0, "")]
        self.open = [0]
        self.open_tags: Counter[str] = Counter()
        self.lowest = 1
        self.depth_before = 1
        self.parts: list[str] = []
        self.linked = self.links = 0
        self.dropped: list[str] = []
        self.endless: set[str] = set()
        self.read(html)
        self.flush()
        self.judge()

    def read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            token = _TOKEN.search(html, at)
            self.data(html[at : token.start() if token else end])
            if token is None:
                return
            at = token.end()
            if token["tag"] is None:
                continue
            tag, closed = token["tag"].lower(), token["rest"].endswith("/")
            if token["end"]:
                self.end(tag)
            elif tag in RAW and not closed:
                ends = None if tag in self.endless else re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(html, at)
                if not self.dropped and tag == "title":
                    self.flush()
                if ends:
                    at = ends.end()
                elif tag in ("script", "style"):
                    return
                else:
                    self.endless.add(tag)
            elif not (closed and tag in DROPPED):
                self.start(tag, token["rest"])

    def data(self, text: str) -> None:
        if text and not self.dropped:
            text = references.unescape(text)
            self.parts.append(text)
            if self.links:
                self.linked += len(text.strip())

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            depth = len(self.open)
            step = self.depth_before + depth - 2 * self.lowest if self.blocks else 0
            self.blocks.append(Block(text, min(self.linked, len(text)), self.open[-1], self.elements[self.open[-1]].parent, step))
            self.lowest = self.depth_before = depth
        self.parts, self.linked, self.links = [], 0, 0

    def close_last(self) -> None:
        self.open_tags[self.elements[self.open.pop()].tag] -= 1
        self.lowest = min(self.lowest, len(self.open))

    def start(self, tag: str, rest: str) -> None:
        if self.dropped:
            if tag == "body" and self.dropped == ["head"]:
                self.dropped.clear()
            else:
                self.dropped += [tag] if tag == self.dropped[-1] else []
                return
        if tag in DROPPED:
            if tag == "head":
                self.flush()
            self.dropped.append(tag)
        elif tag == "a":
            self.links += 1
        elif tag in ("br", "img", "input"):
            self.parts.append(" ")
        elif tag not in INLINE and tag != "wbr":
            self.flush()
            if self.elements[self.open[-1]].tag == "p":
                self.close_last()
            if tag not in VOID:
                self.elements.append(Element(tag, self.open[-1], rest))
                self.open.append(len(self.elements) - 1)
                self.open_tags[tag] += 1

    def end(self, tag: str) -> None:
        if self.dropped:
            if tag == self.dropped[-1]:
                self.dropped.pop()
        elif tag == "a":
            self.links = max(0, self.links - 1)
        elif tag not in INLINE and tag not in VOID:
            self.flush()
            while self.open_tags[tag]:
                last = self.elements[self.open[-1]].tag
                self.close_last()
                if last == tag:
                    break

    def judge(self) -> None:
        """Running text of each element, from the leaves; then what each says, from the root."""
        for block in self.blocks:
            self.elements[block.element].running += block.running
        for element in reversed(self.elements[1:]):
            self.elements[element.parent].running += element.running
        total = max(self.elements[0].running, 1)
        marks = any(e.tag in CONTENT_TAGS for e in self.elements)
        for element in self.elements[1:]:
            above = self.elements[element.parent]
            says = told(element, above.inside, 0.0 if marks else element.running / total)
            element.telling = above.telling if says is None else says
            element.inside = above.inside or says is True
        for block in self.blocks:
            block.telling = self.elements[block.element].telling
        marked = sum(b.running for b in self.blocks if b.telling)
        unmarked = sum(b.running for b in self.blocks if b.telling is None)
        for block in self.blocks:
            block.beside = block.telling is None and marked > unmarked


def blocks_of(html: str) -> list[Block]:
    return Page(html).blocks


# ---- minimum cut ----


def source_side(to_source: list[int], to_sink: list[int], ties: list[tuple[int, int, int]]) -> list[bool]:
    """Nodes on the source's side of a minimum cut (the smallest such side), by blocking flows in level graphs.

    `to_source` and `to_sink` are terminal capacities, `ties` are (node, node, capacity) in both directions.
    """
    n = len(to_source)
    rest = [a - b for a, b in zip(to_source, to_sink, strict=True)]  # the flow straight through each node
    heads: list[list[int]] = [[] for _ in range(n)]
    target: list[int] = []
    room: list[int] = []
    for a, b, capacity in ties:
        heads[a].append(len(target))
        heads[b].append(len(target) + 1)
        target += [b, a]
        room += [capacity, capacity]
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if rest[i] > 0)
        for i in queue:
            level[i] = 0
        starts = list(queue)
        reached = False
        while queue:
            i = queue.popleft()
            if rest[i] < 0:
                reached = True
                continue
            for e in heads[i]:
                if room[e] and level[target[e]] < 0:
                    level[target[e]] = level[i] + 1
                    queue.append(target[e])
        if not reached:
            return [x >= 0 for x in level]
        at = [0] * n
        for start in starts:
            path: list[int] = []
            node = start
            while rest[start] > 0:
                if rest[node] < 0:
                    flow = min(rest[start], -rest[node], *(room[e] for e in path))
                    rest[start] -= flow
                    rest[node] += flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    path, node = [], start
                    continue
                while at[node] < len(heads[node]):
                    e = heads[node][at[node]]
                    if room[e] and level[target[e]] == level[node] + 1:
                        path.append(e)
                        node = target[e]
                        break
                    at[node] += 1
                else:
                    if not path:
                        break
                    node = target[path.pop() ^ 1]
                    at[node] += 1


def ties_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Each block with the next one, and with the next one of the same parent."""
    out, last = [], {}
    for i, block in enumerate(blocks):
        if i:
            out.append((i - 1, i, round(SCALE * (ADJACENT + RELATED / (1 + block.step)))))
        if (before := last.get(block.parent)) is not None and before < i - 1:
            out.append((before, i, round(SCALE * RELATED / (1 if blocks[before].element == block.element else 3))))
        last[block.parent] = i
    return out


def main_blocks(blocks: list[Block], weights: Iterable[float]) -> list[str]:
    weights = list(weights)
    scores = [sum(w * x for w, x in zip(weights, b.features(), strict=True)) + (BESIDE if b.beside else TELLING.get(b.telling, 0.0)) for b in blocks]
    # Cost of calling a block other (cut from the source) or content: -log of the probability of the contrary.
    costs = [(round(SCALE * (max(s, 0.0) + math.log1p(math.exp(-abs(s))))), round(SCALE * (max(-s, 0.0) + math.log1p(math.exp(-abs(s)))))) for s in scores]
    side = source_side([a for a, _ in costs], [b for _, b in costs], ties_of(blocks))
    return [b.text for b, content in zip(blocks, side, strict=True) if content]


def trained(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> tuple[float, ...]:
    """Weights of the text model, from the telling blocks of the `sample_pages` pages whose hashed ids are smallest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            rows = [[*b.features(), float(b.telling)] for html in batch.column("html").to_pylist() for b in blocks_of(html or "") if b.telling is not None]
            yield pa.RecordBatch.from_arrays([pa.array([sum(1 for _ in rows)]), pa.array([rows], pa.list_(pa.list_(pa.float64())))], ["n", "rows"])

    ids = [r[0] for r in pages.where("page_id IS NOT NULL").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages).collect()]
    sample = pages.where(F.col("page_id").isin(ids)).select("html")
    data = [x for r in sample.mapInArrow(run, "n long, rows array<array<double>>").collect() for x in r.rows]
    if not data or len({x[-1] for x in data}) < 2:
        return DEFAULT_WEIGHTS
    table = np.array(sorted(data))
    x, y = table[:, :-1], table[:, -1]
    weights = np.zeros(x.shape[1])
    for _ in range(25):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (y - p) - weights
        weights = weights + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1]), slope)
    return tuple(float(w) for w in np.round(weights, 6))


def main_text(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    `text` holds the content blocks in page order, joined by line feeds, white space inside a block as one space; it is
    empty for a null or empty page and one without content. A tag that never ends takes the rest of its page with it, as
    in a browser; nesting of any depth is followed. Repeated rows give equal texts; other columns are left out; an
    empty table gives an empty result.
    """
    weights = trained(pages, sample_pages)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = ["\n".join(main_blocks(blocks_of(html or ""), weights)) for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
