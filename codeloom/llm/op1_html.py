"""Operator 1: main text of web pages by minimum-cut labelling.

A page is read into text blocks, each with its place in the element tree.  A linear classifier over
structure (section elements, class and id words, link density, length, sentence marks, the article
element if the page has one) gives each block the cost of calling it content and the cost of calling
it boilerplate: the capacities to the two terminals.  Their difference is held within ``BOUND``.
Neighbours in page order, blocks of the same parent and blocks of the same section are joined by
smoothness edges, weak across sections, which add up to more than ``BOUND`` where a block is well
surrounded: so the minimum cut, which separates content from boilerplate, may overrule any single
block's classification.  Class words are one feature of several: they weigh much where the whole name
is of such words, little where it has others too, and nothing on article and main elements but for
those of comments.  Only text that a browser does not show is left out before.

Before max-flow, a block whose terminal difference is at least the sum of its edges keeps that label
in some minimum cut, so it is fixed and its edges become terminal capacity of its neighbours; most
pages are solved by that alone, and the rest by augmenting paths on what is left.

Null, empty or text-free html: an empty text.  Unclosed elements, comments and tags are read as
browsers do.  Repeated pages are extracted each for itself; other columns pass through and ``text``
and ``n_chars`` replace input columns of these names.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from codeloom.llm import common

# Names of HTML elements, and words that mark boilerplate in class and id attributes.
RAW = ["script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "textarea", "title", "select"]
BLOCKS = ["address", "article", "aside", "blockquote", "body", "center", "caption", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"]
CLOSES_P = ["address", "article", "aside", "blockquote", "center", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"]
NEVER = ["head", "nav", "footer", "aside", "form", "menu", "dialog", "button"]
MARKS = ["ad", "ads", "adslot", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pager", "pagination", "popup", "promo", "recommended", "related", "replies", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget"]
LAYOUT = ["area", "bar", "block", "body", "bottom", "box", "button", "buttons", "card", "col", "column", "container", "content", "entry", "fixed", "form", "global", "group", "heading", "holder", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "post", "posts", "primary", "right", "row", "secondary", "section", "site", "slot", "small", "sticky", "stories", "text", "thread", "title", "top", "wrap", "wrapper"]
COMMENTS = ["comment", "comments", "commentlist", "disqus", "replies"]
ROLES = ["navigation", "complementary", "banner", "contentinfo", "search", "alert", "dialog", "menu", "menubar"]

_TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*)"
    rf"|<({'|'.join(RAW)})\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[a-zA-Z/!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:^|[\s/\"'])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_BLOCKS, _CLOSES_P, _NEVER, _MARKS, _LAYOUT, _COMMENTS, _ROLES = map(frozenset, (BLOCKS, CLOSES_P, NEVER, MARKS, LAYOUT, COMMENTS, ROLES))
# Weights of the classifier, the bound of its sum, and the capacities of the smoothness edges.
WEIGHTS = {"length": 80, "tag": 50, "sentence": 30, "article": 100, "outside": -180, "element": -230, "named": -300, "partly": -70, "links": -220, "short": -60}
BOUND = 250
PARENT, SECTION, ACROSS = 80, 40, 5  # the next block of the page, or the next one of the same parent or section
SAME = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",)}


def named(value: str) -> tuple[bool, bool, bool]:
    """Whether a class or id names boilerplate as a whole, in part, and whether it names comments."""
    whole = partly = comments = False
    for name in value.split():
        words = {w.lower() for w in _WORDS.findall(name)}
        if words & _MARKS:
            only = words <= _MARKS | _LAYOUT
            whole, partly, comments = whole or only, partly or not only, comments or (only and bool(words & _COMMENTS))
    return whole, partly, comments


class Node:
    """A block element: what it and its ancestors say, and its section."""

    __slots__ = ("above", "article", "element", "hidden", "named", "partly", "section", "tag")

    def __init__(self, tag: str, above: Node | None, attrs: str):
        self.tag, self.above = tag, above or self
        for name in ("article", "element", "hidden", "named", "partly"):
            setattr(self, name, getattr(above, name) if above else False)
        self.section = above.section if above else self
        main = tag in ("article", "main")
        if tag in _NEVER or (tag == "header" and not self.article):
            self.element, self.section = True, self
        elif main or tag in ("section", "body"):
            self.article, self.section = self.article or main, self
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id") and tag not in ("html", "body"):
                whole, partly, comments = named(value)
                whole |= not self.article and {w.lower() for w in _WORDS.findall(value)} == {"header"}
                if comments if main else whole:
                    self.named, self.element, self.section = True, self.element or comments, self
                elif not main:
                    self.partly = self.partly or partly
            elif name == "role" and value.strip().lower() in _ROLES:
                self.element, self.section = True, self
            elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                self.hidden = True


def read_blocks(page: str) -> list[tuple[str, Node, float]]:
    """Text, container and share of link text of each block, in page order."""
    root = Node("html", None, "")
    stack, out = [root], []
    parts: list[str] = []
    linked, links, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text and not stack[-1].hidden:
                out.append((text, stack[-1], min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        closing = m[2]
        if tag in _BLOCKS or tag == "button":
            flush()
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
            else:
                if tag in ("html", "hr"):
                    continue
                if tag in _CLOSES_P and stack[-1].tag == "p":
                    stack.pop()
                elif tag == "body" and stack[-1].tag == "head":
                    stack.pop()
                elif tag in SAME:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag in SAME[tag]:
                            break
                        if stack[k].tag == tag or (tag in ("dd", "dt") and stack[k].tag in ("dd", "dt")) or (tag in ("td", "th") and stack[k].tag in ("td", "th")):
                            del stack[k:]
                            break
                if not m[4].endswith("/"):
                    stack.append(Node(tag, stack[-1], m[4]))
            links = 0
        elif tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def leaning(text: str, node: Node, links: float, article: bool) -> int:
    """Cost of calling a block boilerplate less that of calling it content, within ``BOUND``.
    ``article``: whether the page has an article element with text."""
    w = WEIGHTS
    score = w["length"] * min(len(text), 400) // 400
    score += w["tag"] * (node.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "td", "dd", "figcaption"))
    score += w["sentence"] * (text[-1] in ".!?:;…。！？\"'»)”")
    score += w["article"] if node.article else w["outside"] * article
    score += w["element"] * node.element + w["named"] * node.named + w["partly"] * node.partly
    score += int(w["links"] * links * (1 - min(len(text), 100) / 125))  # a long link is hardly a menu's
    score += w["short"] * (len(text) < 25 and not node.article)
    return max(-BOUND, min(BOUND, score))


def leanings(blocks: list[tuple[str, Node, float]]) -> list[int]:
    article = any(node.article and not (node.element or node.named) for _, node, _ in blocks)
    return [leaning(*b, article) for b in blocks]


def smoothness(blocks: list[tuple[str, Node, float]]) -> list[tuple[int, int, int]]:
    """Edges to the next block of the page, of the parent and of the section, where these differ."""
    edges, parents, sections = [], {}, {}
    for i, (_, node, _) in enumerate(blocks):
        near = {}
        if i:
            near[i - 1] = SECTION if node.section is blocks[i - 1][1].section else ACROSS
        if (j := sections.get(id(node.section))) is not None:
            near[j] = SECTION
        if (j := parents.get(id(node.above))) is not None and blocks[j][1].section is node.section:
            near[j] = PARENT
        edges += [(j, i, c) for j, c in near.items()]
        sections[id(node.section)] = parents[id(node.above)] = i
    return edges


def minimum_cut(lean: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie on the content side of a minimum cut; ties go to boilerplate."""
    n = len(lean)
    lean, near = list(lean), [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0) + w
        near[j][i] = near[j].get(i, 0) + w
    label: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if label[i] is None and abs(lean[i]) >= sum(near[i].values()):
            label[i] = lean[i] > 0
            for j, w in near[i].items():
                lean[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        inside = _max_flow(left, lean, near)
        for i in left:
            label[i] = i in inside
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], lean: list[int], near: list[dict[int, int]]) -> set[int]:
    """Shortest augmenting paths; the nodes still reached from the source."""
    source, sink = -1, -2
    room: dict[int, dict[int, int]] = {i: dict(near[i]) for i in nodes} | {source: {}, sink: {}}
    for i in nodes:
        if lean[i] > 0:
            room[source][i] = lean[i]
            room[i][source] = 0
        else:
            room[i][sink] = -lean[i]
            room[sink][i] = 0
    while True:
        before, queue = {source: source}, deque([source])
        while queue and sink not in before:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > 0 and v not in before:
                    before[v] = u
                    queue.append(v)
        if sink not in before:
            return set(before) - {source}
        path, v = [], sink
        while v != source:
            path.append((before[v], v))
            v = before[v]
        least = min(room[u][v] for u, v in path)
        for u, v in path:
            room[u][v] -= least
            room[v][u] = room[v].get(u, 0) + least


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = read_blocks(page)
    keep = minimum_cut(leanings(blocks), smoothness(blocks))
    return " ".join(b[0] for b, k in zip(blocks, keep, strict=True) if k)


def extract_text(df: DataFrame, html: str = "html") -> DataFrame:
    """Drops ``html`` and adds ``text`` and ``n_chars``."""
    new = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    others = [f for f in df.schema.fields if f.name not in (html, "text", "n_chars")]
    schema = T.StructType(others + new)

    def run(batches):
        for batch in batches:
            texts = [main_text(page) for page in batch.column(batch.schema.names.index(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(f.name)) for f in others), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return df.mapInArrow(run, schema)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
