"""Main text of web pages by minimum cut.

A page is read into blocks of text with what stands above them in the document tree, in time linear in its length. A
logistic classifier gives each block the log odds of being content; they are its capacity from the source, or to the sink
if below 0. Blocks are joined by smoothness edges to the next one, and to the next one under the same parent, that weigh
more the closer they stand in the tree, on the same scale as the log odds. The minimum cut of that graph labels all
blocks at once, and the source's side is the content.

The classifier is fitted here, on the bounded set of pages that _page_samples makes by rule; its features are link
density, length, sentence shape, headings, place in the page, and what elements and names above a block say. What an
element says counts the less the larger its share of the page's text is: what holds most of a page is a wrapper, whatever
it is called, so no article is lost through one ancestor's name or a form around the whole page.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlework.llm import _page_samples

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
# Elements of HTML by what they do
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_ENDED_BY = {"p": {"p", "div", "ul", "ol", "dl", "table", "section", "article", "aside", "header", "footer", "nav", "form", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "main", "hr", "address", "details", "fieldset"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "table", "div", "section", "article", "main", "body", "aside", "nav", "footer", "header", "td", "th", "blockquote", "figure", "form", "dl", "select"}
_NOISE_TAGS = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "svg", "object", "canvas", "audio", "video", "fieldset", "input", "label", "head", "map", "datalist"}
_NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "tablist"}
_MAIN_ROLES = {"main", "article"}
_NOISE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "adslot", "banner", "sponsor", "sponsored", "promo", "promotion", "promoted", "sidebar", "rail", "widget", "widgets", "menu",
    "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "crumbs", "footer", "foot", "footnav", "header", "masthead", "topbar", "comment", "comments", "respond", "reply", "replies", "disqus", "cookie", "cookies", "consent",
    "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "trending", "popular",
    "pagination", "pager", "toolbar", "skip", "copyright", "legal", "disclaimer", "paywall", "outbrain", "taboola", "tags", "tagcloud", "toc", "form", "search", "feedback", "discussion", "links", "pullout",
}
_MAIN_WORDS = {"article", "articlebody", "content", "entry", "post", "story", "main", "body", "text", "maincontent", "postcontent", "hentry"}
#: Words that turn the next one of a name into a remark on the layout.
_LAYOUT = {"no", "with", "without", "has", "hide", "left", "right", "one", "two"}
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Weight of a smoothness edge between neighbours, in log odds, and steps in the tree beyond which it weighs no less.
SMOOTH, SAME_PARENT, FAR = 3.0, 1.5, 8
#: Log odds are kept within these bounds, so that neighbours can outvote a block.
SURE = 8.0
_UNIT = 1000


class _Node:
    __slots__ = ("tag", "up", "depth", "says", "size", "noise", "name", "main", "named", "link", "head", "hidden")

    def __init__(self, tag: str, up: _Node | None, attributes: str):
        self.tag, self.up, self.size = tag, up, 0
        self.depth = up.depth + 1 if up else 0
        self.link, self.head = (up.link or tag == "a", up.head or tag[0] == "h" and tag[1:].isdigit()) if up else (False, False)
        self.hidden = up.hidden if up else False
        noise, name, main, named = tag in _NOISE_TAGS or tag == "header", False, tag in ("article", "main"), False
        if attributes and up:
            names, role = [], ""
            for key, value in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), value.strip("\"'")
                if key in ("class", "id"):
                    names += value.split()
                elif key == "role":
                    role = value.lower()
                elif key == "itemprop":
                    main |= value.lower() == "articlebody"
                elif key == "style":
                    self.hidden |= "display:none" in value.lower().replace(" ", "")
                else:
                    self.hidden |= key == "hidden" or value.lower() == "true"
            noise |= role in _NOISE_ROLES
            main |= role in _MAIN_ROLES
            for one in names:
                words = [w.lower() for w in _WORDS.findall(one)]
                said = [w for before, w in zip(["", *words], words) if before not in _LAYOUT]
                name |= any(w in _NOISE_WORDS for w in said) or one.lower() in _NOISE_WORDS
                named |= any(w in _MAIN_WORDS for w in said) or one.lower() in _MAIN_WORDS
        self.says = (noise, name, main, named and not name)
        self.noise = self.name = self.main = self.named = 0.0


class Block:
    """Text between block-level elements."""

    __slots__ = ("text", "node", "linked", "size", "head")

    def __init__(self, text: str, node: _Node, linked: int, size: int, head: bool):
        self.text, self.node, self.linked, self.size, self.head = text, node, linked, size, head


class _Tree:
    """The open elements while a page is read. Each element is opened and closed once, so all of it takes linear time."""

    def __init__(self):
        self.root = _Node("#", None, "")
        self.stack, self.nodes = [self.root], [self.root]
        self.open: dict[str, int] = {}
        self.scopes: list[dict[str, int]] = [{}]  # in each scope, the open elements that others end

    def pop(self) -> None:
        tag = self.stack.pop().tag
        self.open[tag] -= 1
        if tag in _SCOPE:
            self.scopes.pop()
        if tag in _ENDED_BY:
            self.scopes[-1][tag] -= 1

    def push(self, tag: str, attributes: str) -> None:
        here = self.scopes[-1]
        while any(n and tag in _ENDED_BY[x] for x, n in here.items()):
            self.pop()
        node = _Node(tag, self.stack[-1], attributes)
        self.nodes.append(node)
        self.stack.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag in _ENDED_BY:
            here[tag] = here.get(tag, 0) + 1
        if tag in _SCOPE:
            self.scopes.append({})

    def close(self, tag: str) -> None:
        if self.open.get(tag):
            while self.stack[-1].tag != tag:
                self.pop()
            self.pop()

    def restart(self) -> None:
        while len(self.stack) > 1:
            self.pop()


def _tag_end(page: str, at: int, gone: dict[str, bool]) -> int:
    """Where the tag's ``>`` is, quoted ones left out; a quote that is never closed counts as none. -1: nowhere."""
    i = at
    while True:
        end = page.find(">", i)
        if end < 0:
            return -1
        quotes = [k for k in (page.find(q, i, end) for q in "\"'") if k >= 0]
        if not quotes:
            return end
        first = min(quotes)
        quote = page[first]
        close = -1 if gone[quote] else page.find(quote, first + 1)
        if close < 0:
            gone[quote] = True
            i = first + 1
        else:
            i = close + 1


def parsed(page: str) -> tuple[list[Block], list[_Node]]:
    """The blocks of a page in its order, without those that hold no visible text, and all its elements, parents first."""
    out: list[Block] = []
    tree = _Tree()
    parts: list[str] = []
    linked = size = 0
    head = False
    home = tree.root

    def flush():
        nonlocal linked, size, head
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text and not home.hidden:
            out.append(Block(text, home, linked, size, head))
        parts.clear()
        linked = size = 0
        head = False

    def take(text: str):
        nonlocal linked, size, head, home
        if not text:
            return
        text, node = html.unescape(text), tree.stack[-1]
        if not parts or not size:
            home = node
        parts.append(text)
        n = len(text.strip())
        size += n
        linked += n if node.link else 0
        head |= node.head

    at, end = 0, len(page)
    gone = {'"': False, "'": False}
    while at < end:
        start = page.find("<", at)
        if start < 0:
            take(page[at:])
            break
        if page.startswith("<!--", start):
            take(page[at:start])
            stop = page.find("-->", start + 4)
            at = end if stop < 0 else stop + 3
            continue
        closing = page.startswith("</", start)
        m = _NAME.match(page, start + 1 + closing)
        if not m and page[start + 1 : start + 2] not in ("!", "?", "/"):  # no tag
            take(page[at : start + 1])
            at = start + 1
            continue
        take(page[at:start])
        stop = _tag_end(page, m.end(), gone) if m else page.find(">", start)
        if stop < 0:  # a tag that never ends
            break
        at = stop + 1
        if not m:
            continue
        tag, attributes = m[0].lower(), page[m.end() : stop]
        if tag not in _INLINE:
            flush()
        if closing:
            tree.close(tag)
        elif tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
        elif tag not in _VOID:
            if tag == "body":  # ends a head that was left open
                tree.restart()
            if not attributes.endswith("/") or tag in _INLINE or tag in _SCOPE:
                tree.push(tag, attributes)
    flush()
    return out, tree.nodes


#: Columns of features(), in order.
FEATURES = ("one", "link share", "words", "short", "heading", "sentence", "noise element", "noise name", "main element", "main name", "beside main", "nothing said", "nothing said, prose")


def features(found: list[Block], nodes: list[_Node]) -> np.ndarray:
    """A row for each block."""
    for b in found:
        b.node.size += len(b.text)
    for node in reversed(nodes[1:]):
        node.up.size += node.size
    whole = max(nodes[0].size, 1)
    for node in nodes:  # parents first
        up, own = node.up, 1 - node.size / whole  # of a wrapper, next to nothing
        old = (up.noise, up.name, up.main, up.named) if up else (0.0,) * 4
        noise, name, main, named = node.says
        inside = old[2] > 0 and node.tag == "header"  # of an article: its title
        node.noise = max(old[0], own if noise and not inside else 0.0)
        node.name = max(old[1], own if name else 0.0)
        node.main = max(old[2], 1.0 if main else 0.0)
        node.named = max(old[3], 1.0 if named else 0.0)
        if main and old[0] + old[1] > 0 and node.size > 0.5 * up.size:  # an article that fills what seemed noise
            node.noise = node.name = 0.0
    has_main = any(b.node.main and b.node.noise + b.node.name < 0.5 for b in found)
    rows = []
    for b in found:
        n, node = max(b.text.count(" ") + 1, len(b.text.encode()) // 8), b.node  # scripts without blanks have words too
        share = b.linked / b.size if b.size else 0.0
        said = n >= 4 and b.text[-1] in ".!?:;\u3002\u201d\"')"
        plain = not (node.noise or node.name or node.main or node.named)
        rows.append((1.0, share, min(math.log(n), 5.0), n < 4, b.head, said, node.noise, node.name, node.main, node.named, has_main and not node.main, plain, plain and said and n > 8))
    return np.array(rows, np.float64).reshape(len(found), len(FEATURES))


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    edges, last = [], {}
    for i, b in enumerate(found):
        up = b.node.up or b.node
        if i:
            edges.append((i - 1, i, SMOOTH / (1 + _apart(found[i - 1].node, b.node))))
        if last.get(id(up), i - 1) < i - 1:  # the nearest earlier block under the same parent
            edges.append((last[id(up)], i, SAME_PARENT))
        last[id(up)] = i
    return edges


def _apart(a: _Node, b: _Node) -> int:
    """Steps between two nodes in the tree, FAR at most."""
    n = 0
    while a is not b and n < FAR:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        n += 1
    return n


@lru_cache(maxsize=1)
def classifier() -> np.ndarray:
    """Weights of FEATURES: logistic regression with a ridge, by Newton's method, on the sample pages."""
    rows, labels = [], []
    for page in _page_samples.pages():
        found, nodes = parsed(page)
        labels += [b.text.startswith(_page_samples.MARK) for b in found]
        rows.append(features(found, nodes))
    x, y = np.concatenate(rows), np.array(labels, np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (p - y) + w)
    return w


def log_odds(found: list[Block], nodes: list[_Node]) -> list[float]:
    return np.clip(features(found, nodes) @ classifier(), -SURE, SURE).tolist()


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which vertices a minimum cut leaves with the source. A vertex's score is its capacity from the source, or to the sink if below 0."""
    n = len(scores)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, s in enumerate(scores):
        if s > 0:
            edge(source, i, round(s * _UNIT), 0)
        elif s < 0:
            edge(i, sink, round(-s * _UNIT), 0)
    for a, b, w in edges:
        edge(a, b, round(w * _UNIT), round(w * _UNIT))
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:  # a blocking flow, without recursion
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if room[e] == 0)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if room[e] > 0 and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(out[a][turn[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                turn[a] += 1
            else:
                break


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by one space."""
    found, nodes = parsed(page or "")
    if not found:
        return ""
    return " ".join(b.text for b, kept in zip(found, min_cut(log_odds(found, nodes), smoothness(found))) if kept)


def main_texts(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per row: page_id, url, text; a page that is null, empty or has no content gives an empty text.

    Character references are decoded, white space inside a block is one space, blocks are joined in page order by one
    space. The whole page is read. Ids and urls may be null or repeat: every row has its result.
    """

    def extract(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([main_text(x) for x in batch.column(2).to_pylist()], pa.string())], [page_id, url, "text"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (page_id, url)]
    return pages.select(page_id, url, F.col(page).cast("string")).mapInArrow(extract, f"`{page_id}` {kinds[0]}, `{url}` {kinds[1]}, text string")
