"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A linear classifier scores a block by its own words, links and tag, and a container (an
element whose tag, class or role says what it is for) by that alone. What a wrong label would cost, the logistic loss of a score,
becomes capacities to the two terminals; a container's count for each of its blocks. Edges between a block and its container, and
between blocks that are near each other on the page and in the tree, carry what it costs to label the two unlike. The maximum
flow's cut is the cheapest labelling: it takes prose out of a box of comments, and a short line into an article.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rankweave.llm.common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody "
    "td tfoot th thead tr ul".split())
#: Elements whose text is never shown as text.
SILENT = frozenset("head script style noscript template iframe object svg math canvas audio video textarea select option button title".split())
#: An opening tag ends an open element of these kinds, up to the nearest element that scopes them.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table body html article section div main".split())
END_P = BLOCK - {"body", "html", "head", "caption", "option", "optgroup", "legend", "tbody", "td", "tfoot", "th", "thead", "tr", "summary", "figcaption"}
BAD, GOOD = -3.5, 2.0  # scores of containers
TAG_CUES = dict.fromkeys(["nav", "footer", "aside", "form", "menu", "dialog", "fieldset"], BAD) | {"article": GOOD, "main": GOOD / 2}
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations sidebar widget widgets "
    "menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments commentlist disqus reply replies respond discussion search "
    "pagination pager toolbar copyright legal disclaimer skip outbrain taboola".split())
GOOD_WORDS = frozenset("article content main post story entry body text prose".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
BOILER_TEXT = re.compile(r"©|\b(?:all rights reserved|cookies?|newsletter|subscribe|sign up|log in|advertisement|sponsored|privacy policy)\b", re.I)
IN_HEAD = frozenset("base link meta title style script noscript template".split())
ENDS_SENTENCE = re.compile(r"[.!?:;…。！？][\"'»”’)\]]*$")
BLOCK_TAGS = {"p": 1.5, "blockquote": 1.0, "pre": 1.0, "h1": 1.2, "h2": 1.2, "h3": 1.2, "h4": 1.0, "h5": 1.0, "h6": 1.0, "li": -0.5, "td": -0.5, "th": -0.5}
SMOOTH_CONTAINER, SMOOTH_SIBLING, SMOOTH_COUSIN, SMOOTH_ADJACENT = 3.5, 0.4, 0.2, 0.1
UNIT = 1000  # capacities are whole numbers of 1 / UNIT


class _Blocks(HTMLParser):
    """Text blocks of a page: (text, words, words in links, tag, container, parent, grandparent), and the scores of the containers;
    the first of these stands for the page and says nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [("", 0, 0, False, False)]  # tag, innermost container, number, silent, in an article
        self.containers = [0.0]
        self.open: Counter[str] = Counter()
        self.n, self.silent, self.links = 0, 0, 0
        self.blocks: list[tuple] = []
        self.text: list[str] = []
        self.linked = 0

    def _flush(self):
        words = "".join(self.text).split()
        if words:
            hold = [x for x in self.stack[-12:] if x[0] in BLOCK or not x[0]] or self.stack[:1]
            leaf = hold[-1]
            up = [x[2] for x in hold[-3:-1]][::-1] + [0, 0]
            self.blocks.append((" ".join(words), len(words), min(self.linked, len(words)), leaf[0], self.stack[-1][1], up[0], up[1]))
        self.text, self.linked = [], 0

    def _pop(self):
        tag, _, _, silent, _ = self.stack.pop()
        self.open[tag] -= 1
        self.silent -= silent
        self.links -= tag == "a"

    def _close_to(self, kinds):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in kinds:
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i][0] in SCOPE:
                return

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
            return
        if tag in BLOCK:
            self._flush()
        if tag in VOID:
            return
        if tag not in IN_HEAD and self.stack[-1][0] == "head":
            self._pop()  # its end tag may be left out
        if tag in END_P and self.open["p"]:
            self._close_to({"p"})
        if tag in ENDS:
            self._close_to(ENDS[tag])
        inside, article = self.stack[-1][1], self.stack[-1][4] or tag == "article"
        cue = TAG_CUES.get(tag, 0.0)
        if tag == "header" and not article:
            cue += BAD
        silent = tag in SILENT
        for name, value in attrs:
            if name in ("class", "id"):
                names = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value or "").lower()))
                if names & BAD_WORDS and tag not in ("html", "body", "article", "main"):
                    cue += BAD
                elif names & GOOD_WORDS and tag not in ("html", "body"):
                    cue += GOOD / 2
            elif name == "role":
                cue += BAD if value in BAD_ROLES else GOOD if value in ("main", "article") else 0.0
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value or ""):
                silent = True
        self.n += 1
        if cue < 0 or cue > 0 and self.containers[inside] >= 0:  # what is inside a box of something else stays so
            inside = len(self.containers)
            self.containers.append(max(2 * BAD, min(2 * GOOD, cue)))
        self.stack.append((tag, inside, self.n, silent, article))
        self.open[tag] += 1
        self.silent += silent
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._flush()
        if not self.open[tag]:
            return
        while True:
            last = self.stack[-1][0]
            self._pop()
            if last == tag:
                return

    def handle_data(self, data):
        if self.silent:
            return
        self.text.append(data)
        if self.links:
            self.linked += len(data.split())

    def close(self):
        super().close()
        self._flush()


def score(block: tuple) -> float:
    """The classifier of blocks: above 0 where the block by itself is more likely main text."""
    text, words, linked, tag = block[:4]
    s = -1.5 + 0.6 * min(math.log1p(words), 4.0) + BLOCK_TAGS.get(tag, 0.0) - 4.0 * linked / words
    s += 0.7 if ENDS_SENTENCE.search(text) else 0.0
    return s - (2.0 if words < 30 and BOILER_TEXT.search(text) else 0.0)


class MaxFlow:
    """Dinic's algorithm on whole-number capacities."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.cap: list[int] = []
        self.at: list[list[int]] = [[] for _ in range(n)]

    def edge(self, u: int, v: int, there: int, back: int = 0) -> None:
        for a, b, c in ((u, v, there), (v, u, back)):
            self.at[a].append(len(self.to))
            self.to.append(b)
            self.cap.append(c)

    def _levels(self, s: int, t: int) -> list[int] | None:
        level = [-1] * len(self.at)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in self.at[u]:
                if self.cap[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[u] + 1
                    queue.append(self.to[e])
        return level if level[t] >= 0 else None

    def run(self, s: int, t: int) -> int:
        total = 0
        while (level := self._levels(s, t)) is not None:
            first = [0] * len(self.at)
            path: list[int] = []
            u = s
            while True:
                if u == t:
                    least = min(self.cap[e] for e in path)
                    total += least
                    for e in path:
                        self.cap[e] -= least
                        self.cap[e ^ 1] += least
                    k = next(i for i, e in enumerate(path) if not self.cap[e])
                    u = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                edges = self.at[u]
                while first[u] < len(edges):
                    e = edges[first[u]]
                    if self.cap[e] and level[self.to[e]] == level[u] + 1:
                        break
                    first[u] += 1
                if first[u] < len(edges):
                    path.append(edges[first[u]])
                    u = self.to[path[-1]]
                elif path:
                    u = self.to[path.pop() ^ 1]
                    first[u] += 1
                else:
                    break
        return total

    def side(self, s: int) -> set[int]:
        """The source's side of the minimum cut."""
        seen, todo = {s}, [s]
        while todo:
            for e in self.at[todo.pop()]:
                if self.cap[e] and self.to[e] not in seen:
                    seen.add(self.to[e])
                    todo.append(self.to[e])
        return seen


def links(blocks: list[tuple]) -> dict[tuple[int, int], float]:
    """Smoothness edges: the next block on the page, and the last one before it with the same parent and grandparent."""
    edges: dict[tuple[int, int], float] = {}
    parents: dict[int, int] = {}
    grand: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges[i - 1, i] = SMOOTH_ADJACENT
        for seen, key, weight in ((parents, b[5], SMOOTH_SIBLING), (grand, b[6], SMOOTH_COUSIN)):
            if key and key in seen:
                edges[seen[key], i] = max(edges.get((seen[key], i), 0.0), weight)
            seen[key] = i
    return edges


def _loss(x: float) -> int:
    return round(UNIT * (math.log1p(math.exp(-abs(x))) + max(x, 0.0)))


def label(scores: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """True where the minimum cut says main text."""
    n = len(scores)
    flow = MaxFlow(n + 2)
    for i, s in enumerate(scores):
        content, boiler = _loss(s), _loss(-s)  # lost by calling it boilerplate, by calling it content
        both = min(content, boiler)
        if content > both:
            flow.edge(n, i, content - both)
        if boiler > both:
            flow.edge(i, n + 1, boiler - both)
    for (u, v), w in edges.items():
        flow.edge(u, v, c := round(UNIT * w), c)
    flow.run(n, n + 1)
    side = flow.side(n)
    return [i in side for i in range(n)]


def parsed(html: str) -> tuple[list[tuple], list[float]]:
    """The blocks of a page and the scores of its containers."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    return parser.blocks, parser.containers


def graph(blocks: list[tuple], containers: list[float]) -> tuple[list[float], dict[tuple[int, int], float]]:
    """Scores and edges of all nodes: the blocks, then the containers that hold any."""
    held = Counter(b[4] for b in blocks)
    node = {c: len(blocks) + k for k, c in enumerate(c for c in held if containers[c])}
    edges = links(blocks)
    edges |= {(i, node[b[4]]): SMOOTH_CONTAINER for i, b in enumerate(blocks) if b[4] in node}
    return [*map(score, blocks), *(containers[c] * held[c] for c in node)], edges


def extract(html: str | None) -> str:
    """The main text of a page: its blocks, white space inside them single, joined by line breaks."""
    if not html:
        return ""
    blocks, containers = parsed(html)
    keep = label(*graph(blocks, containers))
    return "\n".join(b[0] for b, k in zip(blocks, keep, strict=False) if k)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col``, with ``text`` (empty where the html is null, empty or all boilerplate) and
    ``n_chars``, its code points; input columns of these names are replaced. Each row on its own."""
    kept = [f for f in pages.schema.fields if f.name not in ("text", "n_chars", html_col)]
    keep_at, at = [pages.columns.index(f.name) for f in kept], pages.columns.index(html_col)
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column(at).to_pylist()]
            cols = [batch.column(i) for i in keep_at] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*(f.name for f in kept), "text", "n_chars"])

    return pages.mapInArrow(run, schema)


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
