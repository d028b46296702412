"""Main text of web pages by minimum-cut labelling.

A page is parsed to blocks of text.  A small classifier (a sum of evidence: where the block
stands, what its containers are called, how much of it is links, how long it is) gives each
block a cost of being content and a cost of being boilerplate; these become its capacities
to the two terminals.  Blocks that follow one another, and blocks of the same container,
are joined by smoothness edges.  The minimum cut, found by maximum flow, is the labelling
of least total cost.  A block whose own costs outweigh all its edges has the same label in
every minimum cut, so it joins its terminal first; what is left is a small graph.

Defined results: a null or empty page has the empty text.  Markup that is never closed or
never opened is taken as browsers do, as far as text is concerned.  A page without blocks of
content has the empty text.  Nothing is cut off.  Repeated rows stay; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

# Fixed values of HTML: elements without content, those whose content is no text, those
# that stand in a line, and those whose start closes an open paragraph or item.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = r"script|style|noscript|template|textarea|svg|iframe|canvas|select|title"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark object q s samp small span strike strong sub sup time tt u var wbr img "
    "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace semantics annotation".split()
)
CLOSED_BY_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# What containers are and are called. Weights are costs in thousandths. Hard evidence holds for
# all that is inside; soft evidence ends at an article or main part within it, as pages that
# wrap everything in a form or name a column after its layout have.
HARD_TAGS = {"nav": 6000, "footer": 6000, "aside": 5500, "menu": 6000, "button": 6000, "dialog": 6000, "head": 9000}
SOFT_TAGS = {"form": 5500, "header": 4500, "fieldset": 5000}
CONTENT_TAGS = {"article": 3500, "main": 2500}
BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal newsletter subscribe signup login nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar side widget related recommend recommended recommendations share sharing social footer foot masthead topbar toolbar pagination pager copyright legal tag tags toc skip".split()
)
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
CONTENT_NAMES = frozenset("article content entry main post story body text".split())
COMMENT_NAMES = frozenset("comment comments reply replies discussion disqus".split())
# Class names that tell of a state or a lack, as `no-sidebar` or `comments-open`.
STATE_NAMES = re.compile(r"^(?:no|not|has|is|with|without|hide|show)[-_]|[-_](?:open|opened|closed|enabled|disabled|active|inactive|on|off|none|false|true)$")

_TOKENS = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<raw>{RAW})(?=[\s/>])(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|(?P<text>[^<]+|<)", re.S | re.I)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


@dataclass(slots=True)
class Block:
    text: str
    links: int  # characters inside links
    tag: str
    inside: tuple  # the containers' own evidence (content, soft, hard), outermost first
    parent: int


@dataclass(slots=True)
class _Open:
    tag: str
    evidence: tuple[int, int, int]
    number: int


NOTHING = (0, 0, 0)


def _evidence(tag: str, attrs: str) -> tuple[int, int, int]:
    """Evidence that a container gives, in thousandths: for content, and soft and hard evidence against it.

    The classes of `html` and `body` tell of the whole page, not of a part, and don't count.
    """
    content, soft, hard = CONTENT_TAGS.get(tag, 0), SOFT_TAGS.get(tag, 0), HARD_TAGS.get(tag, 0)
    for name, *value in _ATTR.findall(attrs) if attrs else ():
        v, name = "".join(value).lower(), name.lower()
        if name in ("class", "id") and tag not in ("html", "body"):
            parts = {p for t in (v.split() if name == "class" else [v.strip()]) if not STATE_NAMES.search(t) for p in re.split(r"[-_\s]", t.rstrip("0123456789"))}
            if parts & COMMENT_NAMES:
                hard = max(hard, 7000)
            elif parts & BOILER_NAMES:
                soft = max(soft, 5500)
            elif parts & CONTENT_NAMES:
                content += 1500
        elif name == "role":
            content += 2500 if v in ("main", "article") else 0
            hard = max(hard, 5500 if v in BOILER_ROLES else 0)
        elif name == "hidden" or (name == "aria-hidden" and v == "true") or (name == "style" and re.search(r"display\s*:\s*none", v)):
            hard = max(hard, 7000)
    return content, soft, hard


def blocks(html: str) -> list[Block]:
    """The blocks of text of a page in their order."""
    out: list[Block] = []
    stack = [_Open("#", NOTHING, 0)]
    words: list[str] = []
    state = {"links": 0, "number": 0, "depth": 0}
    tag_of = ["#"]

    def end() -> None:
        if words:
            text = " ".join("".join(words).split())
            if text:
                inner = next((s for s in reversed(stack) if s.tag not in INLINE), stack[0])
                above = next((s for s in reversed(stack[:-1]) if s.tag not in INLINE and s is not inner), stack[0])
                out.append(Block(text, min(state["links"], len(text)), inner.tag, tuple(s.evidence for s in stack if s.evidence != NOTHING), above.number))
            words.clear()
            state["links"] = 0

    def close(to: int) -> None:
        for s in stack[to:]:
            state["depth"] -= s.tag == "a"
        del stack[to:]

    for m in _TOKENS.finditer(html):
        if (text := m["text"] or m["cdata"]) is not None:
            text = unescape(text) if "&" in text else text
            words.append(text)
            if state["depth"]:
                state["links"] += len(text.strip())
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag not in INLINE:
                end()
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            # An inline end doesn't close the blocks that were opened after it.
            if at and (tag not in INLINE or all(s.tag in INLINE for s in stack[at:])):
                close(at)
            elif at:
                state["depth"] -= stack[at].tag == "a"
                del stack[at]
            continue
        if tag == "br":
            words.append(" ")
        if tag in INLINE:
            if tag not in VOID and tag != "img":
                state["depth"] += tag == "a"
                state["number"] += 1
                stack.append(_Open(tag, _evidence(tag, m["attrs"]), state["number"]))
            continue
        end()
        if tag in VOID:
            continue
        if any(s.tag == "p" for s in stack[-4:]):
            close(max(i for i, s in enumerate(stack) if s.tag == "p"))
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in CLOSED_BY_SIBLING.get(tag, ()):
                close(i)
                break
            if stack[i].tag not in INLINE and stack[i].tag not in ("p",):
                break
        if not m["attrs"].rstrip().endswith("/") or tag in ("p", "div"):
            state["number"] += 1
            stack.append(_Open(tag, _evidence(tag, m["attrs"]), state["number"]))
    end()
    return out


def costs(b: Block) -> tuple[int, int]:
    """What it costs to call the block content, and to call it boilerplate."""
    # Soft evidence from outside the nearest article or main part weighs a quarter.
    near = max((i for i, (c, _, _) in enumerate(b.inside) if c >= 2500), default=0)
    e = sum(c for c, _, _ in b.inside) - sum(s // 4 for _, s, _ in b.inside[:near])
    worst = max((x for i, (_, s, h) in enumerate(b.inside) for x in (s if i >= near else 0, h)), default=0)
    if worst:
        e = min(e, 1500) - worst  # an article does not redeem the menu inside it
    n, density = len(b.text), b.links / max(1, len(b.text))
    e += min(2500, 25 * n) - 600
    e -= int(4000 * density) if density > 0.5 else 0
    if b.tag in HEADINGS:
        e += 800
    elif b.tag in ("p", "blockquote", "pre", "td", "dd"):
        e += 700
    elif b.tag == "li" and n < 40:
        e -= 400
    if b.text[-1] in ".!?:;\"”»…":
        e += 400
    if "©" in b.text[:40] or "all rights reserved" in b.text.lower()[:200]:
        e -= 2500
    return (max(0, -e), max(0, e))


ADJACENT, SAME_PARENT = 350, 450


def edges(page: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness between a block and the one before it, and the last one of the same container."""
    out, last = [], {}
    for i, b in enumerate(page):
        if i:
            out.append((i - 1, i, ADJACENT))
        if (j := last.get(b.parent)) is not None:
            out.append((j, i, SAME_PARENT))
        last[b.parent] = i
    return out


def minimum_cut(terminal: list[tuple[int, int]], smooth: list[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the content side. terminal: cost of content, cost of boilerplate."""
    n = len(terminal)
    pull, weight = [b - c for c, b in terminal], [0] * n
    around: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, b, w in smooth:
        weight[a] += w
        weight[b] += w
        around[a].append((b, w))
        around[b].append((a, w))
    label: list[bool | None] = [None] * n
    queue = deque(i for i in range(n) if abs(pull[i]) > weight[i])
    while queue:  # nodes that every minimum cut labels alike; their edges become terminal capacities
        i = queue.popleft()
        if label[i] is not None:
            continue
        label[i] = pull[i] > 0
        for j, w in around[i]:
            if label[j] is None:
                pull[j] += w if label[i] else -w
                weight[j] -= w
                if abs(pull[j]) > weight[j]:
                    queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        at = {i: k for k, i in enumerate(rest)}
        flow = MaxFlow(len(rest) + 2)
        s, t = len(rest), len(rest) + 1
        for i in rest:
            if pull[i] > 0:
                flow.add(s, at[i], pull[i], 0)
            elif pull[i] < 0:
                flow.add(at[i], t, -pull[i], 0)
            for j, w in around[i]:
                if label[j] is None and i < j:
                    flow.add(at[i], at[j], w, w)
        side = flow.run(s, t)
        for i in rest:
            label[i] = side[at[i]]
    return [bool(x) for x in label]


class MaxFlow:
    """Maximum flow by shortest augmenting levels."""

    def __init__(self, n: int) -> None:
        self.to: list[int] = []
        self.cap: list[int] = []
        self.of: list[list[int]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, forth: int, back: int) -> None:
        for x, y, c in ((a, b, forth), (b, a, back)):
            self.of[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)

    def _levels(self, s: int) -> list[int]:
        level = [-1] * len(self.of)
        level[s] = 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for e in self.of[x]:
                if self.cap[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def run(self, s: int, t: int) -> list[bool]:
        """Whether each node can be reached from s once the flow is at its maximum."""
        while (level := self._levels(s))[t] >= 0:
            at = [0] * len(self.of)
            path: list[int] = []
            x = s
            while True:
                if x == t:
                    low = min(self.cap[e] for e in path)
                    for e in path:
                        self.cap[e] -= low
                        self.cap[e ^ 1] += low
                    path, x = [], s
                while at[x] < len(self.of[x]):
                    e = self.of[x][at[x]]
                    if self.cap[e] and level[self.to[e]] == level[x] + 1:
                        path.append(e)
                        x = self.to[e]
                        break
                    at[x] += 1
                else:
                    if x == s:
                        break
                    x = self.to[path.pop() ^ 1]
                    at[x] += 1
        return [k >= 0 for k in level]


def main_text(html: str) -> str:
    """The content blocks of a page, joined by line ends."""
    page = blocks(html)
    if not page:
        return ""
    keep = minimum_cut([costs(b) for b in page], edges(page))
    return "\n".join(b.text for b, k in zip(page, keep) if k)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """The pages with their main text."""

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(main_text)

    return pages.withColumn(out_col, text_of(whole_text(html_col)))
