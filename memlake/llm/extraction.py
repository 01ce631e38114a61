"""HTML main text by minimum cut.

A page becomes a row of text blocks. A classifier's costs of calling a block
content or boilerplate are its terminal capacities; neighbours in the page and in
the tree (blocks under one parent, parents side by side) are joined by smoothness
edges. The minimum cut, found by maximum flow, labels all blocks at once. Blocks
whose own cost outweighs all their edges are settled beforehand, which leaves the
cut as it is and the flow network small.

Class names and the like are costs that the cut can outvote, not verdicts.

Scale: each page is on its own; reading it is linear in its length, the cut near
linear in its blocks; no shuffle.

Defined cases: null or empty html, or a page without content: an empty text.
Unclosed and stray tags, quotes and very deep or long pages are tolerated. Equal
costs go to content. Repeated rows are alike; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import arrow_batch

#: Attributes up to the tag's end or the page's: a quote opens a value only after "=". No part of it is read twice.
_ATTRIBUTES = r"((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)(?:>|\Z)"
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)" + _ATTRIBUTES + r"|<[!?][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: What these hold is no text, up to their end tag.
_SWALLOWED = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style template textarea svg iframe select".split()}
_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*\Z")
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Costs of the text right below an element; each block element on the way down takes _STEP off, an article _ARTICLE.
_OUTSIDE = {"head": 1000, "title": 1000} | dict.fromkeys("nav footer aside button menu dialog".split(), 120) | {"form": 50, "noscript": 50}
_NOISY, _NESTED, _HIDES, _STEP, _ARTICLE, _ABOUT = 70, 85, 120, 15, 40, 35
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: No start tag ends a paragraph outside these.
_SCOPES = frozenset("div section article main body td blockquote ul ol table".split())
#: Words of class, id and role names that mark what isn't the article.
_NOISE = frozenset("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent discuss discussion discussions disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted reactions recommended related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split())
#: A name that begins or ends so tells of a page's state: no-sidebar, comments-open.
_STATE_FIRST = frozenset("no not has have with without hide".split())
_STATE_LAST = frozenset("open closed enabled disabled on off".split())
_MAIN = frozenset("article content entry main post story body text".split())


class Block:
    __slots__ = ("text", "links", "noise", "main", "tag", "parent", "grand")

    def __init__(self, text, links, noise, main, tag, parent, grand):
        self.text, self.links, self.noise, self.main, self.tag, self.parent, self.grand = text, links, noise, main, tag, parent, grand


def _names(attributes: str) -> tuple[set[str], set[str], bool]:
    """Words of class, id and role names, those of them that may mark noise, and whether the element is hidden."""
    words, telling, hidden = set(), set(), False
    for a in _ATTRIBUTE.finditer(attributes):
        key, value = a.group(1).lower(), (a.group(2) or a.group(3) or a.group(4) or "").lower()
        if key in ("class", "id", "role", "aria-label"):
            for name in value.split():
                w = [x for x in re.split(r"[^a-z]+", name) if x]
                words.update(w)
                if w and w[0] not in _STATE_FIRST and w[-1] not in _STATE_LAST:
                    telling.update(w)
        elif key == "hidden":
            hidden = hidden or value != "false"
        elif key == "aria-hidden":
            hidden = hidden or value == "true"
        elif key == "style":
            hidden = hidden or bool(_NO_DISPLAY.search(value))
    return words, telling, hidden


class _Open:
    """The open elements: (name, id, cost of the noise above and at it, article above or at it). How often a name is open is known without a search."""

    def __init__(self):
        self.stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
        self.count: Counter[str] = Counter()

    def push(self, element: tuple[str, int, int, bool]) -> None:
        self.stack.append(element)
        self.count[element[0]] += 1

    def cut(self, k: int) -> None:
        for e in self.stack[k:]:
            self.count[e[0]] -= 1
        del self.stack[k:]

    def end(self, name: str) -> None:
        """An end tag: the innermost element of the name goes with all inside it; an inline one ends no block."""
        if not self.count[name]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == name:
                return self.cut(k)
            if name in _INLINE and self.stack[k][0] not in _INLINE:
                return

    def imply(self, name: str) -> None:
        """A start tag that ends open elements of its own accord, such as a paragraph's."""
        closes = _CLOSES.get(name, {"p"} if name in _ENDS_P else ())
        if not any(self.count[c] for c in closes):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            here = self.stack[k][0]
            if here in closes:
                return self.cut(k)
            if here not in _INLINE and name != "p" or here in _SCOPES:
                return

    def own(self) -> tuple[int, int, int]:
        """Places of the innermost block element, of the one around it, and of that around this."""
        k = len(self.stack) - 1
        while k and self.stack[k][0] in _INLINE:
            k -= 1
        return k, max(0, k - 1), max(0, k - 2)


def _entered(name: str, attributes: str, above: tuple[str, int, int, bool]) -> tuple[int, bool]:
    """Cost of the noise and whether an article is entered, inside a new element."""
    inline = name in _INLINE
    noise, main = above[2] if inline else max(0, above[2] - _STEP), above[3]
    new = _OUTSIDE.get(name, _NOISY if name == "header" and not main else 0)
    if attributes and ("=" in attributes or "hidden" in attributes):
        words, telling, hidden = _names(attributes)
        if name in ("html", "body"):
            main = main or bool(words & _MAIN and not words & _NOISE)
        elif hidden:
            new = max(new, _HIDES)
        elif telling & _NOISE:
            # an article's own names tell what it is about as well
            new = max(new, _ABOUT if name in ("article", "main") and words & _MAIN else _NOISY)
        elif words & _MAIN and not new and noise <= _OUTSIDE["form"] - _STEP:
            main = True
    if new:
        noise, main = max(noise, new, min(noise + new, _NESTED)), False
    if name in ("article", "main"):
        noise, main = max(0, noise - _ARTICLE), True
    return noise, main


def page_blocks(page: str) -> list[Block]:
    """All text blocks of a page, in order; time is linear in the page."""
    open_, out, parts = _Open(), [], []
    linked = n = at = 0
    endless: set[str] = set()

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                k, up, grand = open_.own()
                stack = open_.stack
                out.append(Block(text, linked, stack[-1][2], stack[-1][3], stack[k][0], stack[up][1], stack[grand][1]))
            parts.clear()
        linked = 0

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if open_.count["a"]:
                linked += m.start() - at
        at = m.end()
        if m.group(2) is None:
            continue
        name, attributes = m.group(2).lower(), m.group(3)
        closed = attributes[-9:].rstrip().endswith("/") and bool(_CLOSED.search(attributes))
        if name == "br":
            parts.append(" ")
            continue
        if name in _SWALLOWED:
            # an end tag that is nowhere is looked for once
            if not m.group(1) and not closed and name not in endless:
                if end := _SWALLOWED[name].search(page, at):
                    at = end.end()
                elif name in ("script", "style"):
                    at = len(page)
                else:
                    endless.add(name)
            continue
        inline = name in _INLINE
        if not inline:
            flush()
        if m.group(1):
            open_.end(name)
            continue
        if not inline:
            open_.imply(name)
        if name in _VOID:
            continue
        n += 1
        if closed and not inline:
            continue
        open_.push((name, n, *_entered(name, attributes, open_.stack[-1])))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def costs(b: Block) -> int:
    """The classifier: cost of calling the block boilerplate less that of calling it content."""
    score = (40 if b.main else 0) - b.noise
    words = len(b.text.split())
    if b.noise:  # long prose can outweigh it
        score += min(max(0, words - 40), 120) // 4
    score += min(words, 40) - 8
    if b.text[-1:] in ".!?…:;\"'»”)":
        score += 6
    if b.tag in ("p", "pre", "blockquote"):
        score += 8
    elif b.tag in ("h1", "h2", "h3", "h4"):
        score += 10
    elif b.tag in ("li", "td", "th"):
        score -= 2
    if b.links:
        score -= int(30 * min(1.0, b.links / max(1, len(b.text)))) * (1 if b.main else 2)
    return score


def edges(blocks: list[Block]) -> dict[tuple[int, int], int]:
    """Smoothness: page neighbours, and blocks that follow each other under one parent or grandparent."""
    out: dict[tuple[int, int], int] = {}

    def join(a: int, b: int, w: int):
        out[a, b] = out.get((a, b), 0) + w

    parents: dict[int, int] = {}
    grands: dict[int, int] = {}
    for k, b in enumerate(blocks):
        if k:
            join(k - 1, k, 3)
        if b.parent in parents:
            join(parents[b.parent], k, 6)
        elif b.grand in grands:
            join(grands[b.grand], k, 2)
        parents[b.parent] = grands[b.grand] = k
    return out


def minimum_cut(gain: list[int], smooth: dict[tuple[int, int], int]) -> list[bool]:
    """Labels that minimise: -gain where False is chosen for a positive gain (and the reverse), plus the weights of edges between unlike labels. Ties go to content."""
    n = len(gain)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (a, b), w in smooth.items():
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    gain, label = list(gain), [None] * n
    todo = deque(range(n))
    while todo:  # settle blocks that outweigh their edges
        k = todo.popleft()
        if label[k] is None and abs(gain[k]) > sum(near[k].values()):
            label[k] = gain[k] > 0
            for j, w in near[k].items():
                gain[j] += w if label[k] else -w
                near[j].pop(k)
                todo.append(j)
            near[k] = {}
    rest = [k for k in range(n) if label[k] is None]
    if rest:
        side = _flow(rest, gain, near)
        for k in rest:
            label[k] = k not in side
    return label


def _flow(nodes: list[int], gain: list[int], near: list[dict[int, int]]) -> set[int]:
    """Maximum flow by shortest augmenting paths in levels; the nodes that the source (content) can't keep."""
    s, t = -1, -2
    cap: dict[int, dict[int, int]] = {k: dict(near[k]) for k in nodes} | {s: {}, t: {}}
    for k in nodes:
        if gain[k] >= 0:
            cap[s][k], cap[k][s] = gain[k], 0
        else:
            cap[k][t], cap[t][k] = -gain[k], 0
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 0 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if t not in level:
            break
        # every node tries its arcs in turn and comes back to none that has been used up
        arcs, turn = {u: list(cap[u]) for u in level}, dict.fromkeys(level, 0)
        path = [s]
        while path:
            u = path[-1]
            if u == t:
                f = min(cap[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    cap[a][b] -= f
                    cap[b][a] = cap[b].get(a, 0) + f
                path = [s]
                continue
            while turn[u] < len(arcs[u]):
                v = arcs[u][turn[u]]
                if cap[u][v] > 0 and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
                turn[u] += 1
            else:
                path.pop()
                if path:
                    turn[path[-1]] += 1
    reach, queue = {t}, deque([t])  # what still flows to the sink is boilerplate
    while queue:
        v = queue.popleft()
        for u in cap[v]:
            if u not in reach and cap[u].get(v, 0) > 0:
                reach.add(u)
                queue.append(u)
    return reach


def main_text(page: str | None) -> str:
    found = page_blocks(page or "")
    keep = minimum_cut([costs(b) for b in found], edges(found))
    return "\n\n".join(b.text for b, k in zip(found, keep) if k)


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def extract(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            if texts:
                yield arrow_batch(_SCHEMA, b.column(0), b.column(1), texts, list(map(len, texts)))

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(extract, "page_id long, url string, text string, n_chars long")
