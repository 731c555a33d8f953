"""HTML extraction by minimum-cut labelling.

A page is cut into text blocks at block-level tags. A linear classifier on each block's surroundings, link share and
wording gives two costs, of calling it content and of calling it boilerplate; they are the capacities of its edges to
the two terminals. Neighbouring blocks are joined by smoothness edges, stronger where the blocks are close in the DOM
(the same parent, or a short way to the common ancestor), and blocks are also joined to the previous child of the same
parent. The minimum cut of source and sink is the labelling of least total cost.

A block whose terminal cost outweighs all its smoothness edges has that label in every minimum cut; such blocks are
fixed first and their edges become costs of their neighbours, and what stays open is solved by augmenting paths.

Tags are found and closed in time linear in the page. A block whose boilerplate is only hinted at by one of several words
of a class or id, or by an id alone, can be kept by its prose and by its neighbours.

Defined cases: null and empty html gives empty text; unclosed tags end with their parent or at the next block tag that
implies their end; a tag without any > behind it is text, and one whose quotes never end goes on to the next >; svg and
math may close themselves, and an unclosed svg, math, object, template or noscript hides nothing; an unclosed script,
style, textarea, title, iframe, xmp, noembed or noframes goes on to the page's end; a page without any content block gives
empty text; of labellings that tie the one with fewer content blocks is taken; very long pages are read whole; repeated
pages give repeated rows; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.common import mapped, slices

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"""\b(class|id|role|aria-hidden|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_PARTS = re.compile(r"[_-]+|(?<=[a-z])(?=[A-Z])")

_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")

#: Elements whose text is no page text, elements without end tags, elements that break text into blocks.
RAW = {"script", "style", "template", "noscript", "textarea", "title", "iframe", "svg", "math", "object", "xmp", "noembed", "noframes"}
#: Of these, the ones whose content is markup in itself; without an end tag the page goes on behind their start tag.
MARKUP = {"template", "noscript", "svg", "math", "object"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
SKIP = {"head", "button", "select", "option", "canvas", "audio", "video"}
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Costs by element, added for the block's ancestors; above zero speaks for content.
ELEMENT = {"article": 3.0, "main": 2.5, "p": 1.0, "h1": 1.0, "h2": 0.8, "h3": 0.6, "blockquote": 0.6, "pre": 0.6, "figcaption": 0.2, "nav": -9.0, "footer": -7.0, "header": -3.5, "aside": -8.0, "form": -8.0, "menu": -8.0, "dialog": -8.0, "fieldset": -6.0}
#: Words of class, id and role that name boilerplate or content, and words that say nothing beside them.
BAD = re.compile(r"ads?|advert\w*|sponsor\w*|adbox|adslot|contentinfo|complementary|promo\w*|banner|cookies?|consent|gdpr|notices?|sidebar\w*|side|menu|nav\w*|breadcrumbs?|footer|foot|header|masthead|topbar|toolbar|comments?|commentlist|disqus|replies|respond|related|recommend\w*|share|sharing|social|subscribe|newsletter|signup|login|popup|modal|overlay|widget|pagination|pager|copyright|legal|disclaimer|tags?|search", re.I)
GOOD = re.compile(r"article|content|entry|post|story|body|main|text", re.I)
NEUTRAL = set("section area list box block container wrapper wrap inner outer item items bar panel row col column site page top bottom left right user global primary secondary".split())
HEAD_WORDS = re.compile(r"(?<![a-z])(?:header|masthead)(?![a-z])", re.I)
WORDING = re.compile(r"cookie|©|&copy;|\bcopyright \d{4}|all rights reserved|privacy policy|terms of (?:use|service)|subscribe|sign up|log ?in|advertisement|sponsored", re.I)
_SEPARATORS = re.compile(r"[|·•»›]")


class Block:
    __slots__ = ("text", "node", "bias", "linked")

    def __init__(self, text: str, node: int, bias: float, linked: int):
        self.text, self.node, self.bias, self.linked = text, node, bias, linked


def _word(value: str) -> float:
    """What the words of a class, id or role speak for: -1 to 0 by the share that names boilerplate, else what names content."""
    worst, good = 0.0, False
    for token in value.split():
        parts = [p for p in _PARTS.split(token) if p and p.lower() not in NEUTRAL]
        if parts:
            worst = max(worst, sum(bool(BAD.fullmatch(p)) for p in parts) / len(parts))
            good = good or any(GOOD.fullmatch(p) for p in parts)
    return -worst if worst else 0.125 * good


def _named(attrs: str) -> float:
    total = 0.0
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):  # an id may only be where a link leads to
            total += (6.0 if key == "id" else 8.0) * _word(value)
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            total -= 12.0
    return total


def _self_closing(attrs: str) -> bool:
    """Whether a tag's attributes end in a slash that is not part of an unquoted value."""
    return attrs.endswith("/") and not re.search(r"=\s*[^\s\"'][^\s]*$", _QUOTED.sub('""', attrs))


class Tags:
    """The tags of a page, each found in time linear in the page's rest at most once: what cannot be found is remembered."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.quotes = {c: page.rfind(c) for c in "\"'"}
        self.lenient = False
        self.unended: set[str] = set()

    def end(self, at: int) -> int:
        """Where the tag whose attributes start at at has its >; quoted ones do not count unless there are no others."""
        if not self.lenient:
            p = at
            while (p := _PLAIN.match(self.page, p).end()) < len(self.page):
                c = self.page[p]
                if c == ">":
                    return p
                p = 1 + (self.page.find(c, p + 1) if p < self.quotes[c] else p)
            self.lenient = True
        return self.page.find(">", at)

    def skip(self, name: str, at: int) -> int | None:
        """Where the page goes on behind the end tag of a raw element; None if there is none."""
        if name in self.unended:
            return None
        tail = _RAW_END[name].search(self.page, at)
        if not tail:
            self.unended.add(name)
        return tail.end() if tail else None


class Tree:
    """The open elements, and the tree of the block-level ones met so far by number: parents and depths. Node 0 is the page."""

    def __init__(self):
        self.names: list[str] = []
        self.costs, self.skips, self.nodes = [0.0], [False], [0]  # by open element, those of the page itself first
        self.parent, self.depth = [0], [0]
        self.open: dict[str, list[int]] = {}
        self.blocks = [-1]
        self.links = self.hidden = 0

    def push(self, name: str, cost: float) -> None:
        self.open.setdefault(name, []).append(len(self.names))
        if name in INLINE:
            self.nodes.append(self.nodes[-1])
        else:
            self.blocks.append(len(self.names))
            self.parent.append(self.nodes[-1])
            self.depth.append(self.depth[self.nodes[-1]] + 1)
            self.nodes.append(len(self.parent) - 1)
        self.names.append(name)
        self.costs.append(self.costs[-1] + cost)
        self.skips.append(name in SKIP)
        self.links += name == "a"
        self.hidden += name in SKIP

    def close(self, to: int) -> None:
        while len(self.names) > to:
            name = self.names.pop()
            self.open[name].pop()
            if name not in INLINE:
                self.blocks.pop()
            self.costs.pop()
            self.nodes.pop()
            self.links -= name == "a"
            self.hidden -= self.skips.pop()

    def innermost(self, names) -> int:
        return max((self.open[n][-1] for n in names if self.open.get(n)), default=-1)

    def way(self, a: int, b: int, most: int = 4) -> int:
        """Steps between two nodes of the tree; more than most if it is more."""
        steps = 0
        while a != b and steps <= most:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
            steps += 1
        return steps


def blocks_of(page: str) -> tuple[list[Block], Tree]:
    """The text blocks in page order, with their innermost element and the sum of what their ancestors speak for."""
    out: list[Block] = []
    tree, tags = Tree(), Tags(page)
    parts: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text and not tree.hidden:
                out.append(Block(text, tree.nodes[-1], tree.costs[-1], linked))
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if not tree.hidden:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if tree.links:
                linked += len(text.strip())

    while at < len(page):
        start = page.find("<", at)
        if start != at:
            add(page[at : start if start >= 0 else len(page)])
            if start < 0:
                break
            at = start
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        m = _NAME.match(page, at)
        if at > tags.last or not (m or page[at + 1] in "!?"):  # a tag that never ends is text
            add("<")
            at += 1
            continue
        if not m:
            at = page.find(">", at) + 1
            continue
        end = tags.end(m.end())
        name, attrs, closing = m[1].lower(), page[m.end() : end], page[at + 1] == "/"
        at = end + 1
        if closing:
            if name not in INLINE:
                flush()
            depth = tree.innermost((name,))
            if depth >= 0 and not (name in INLINE and tree.blocks[-1] > depth):
                tree.close(depth)
            continue
        if name in RAW:
            if name in ("textarea", "title"):
                flush()
            if not (name in ("svg", "math") and _self_closing(attrs)):
                behind = tags.skip(name, at)
                if behind is not None or name not in MARKUP:
                    at = len(page) if behind is None else behind
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            flush()
            if name in CLOSES_P:  # these end an open paragraph, with what is open inside it
                depth = tree.innermost(("p",))
                if depth >= 0 and tree.blocks[-1] == depth:
                    tree.close(depth)
            if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
                depth = tree.innermost((*same, "ul", "ol", "dl", "table", "select"))
                if depth >= 0 and tree.names[depth] in same:
                    tree.close(depth)
        if name in VOID or attrs.endswith("/") and name in ("img", "input"):
            continue
        inside = bool(tree.open.get("article"))  # the article's own head holds its title
        own = 0.0 if inside and name == "header" else ELEMENT.get(name, 0.0)
        tree.push(name, own + (_named(HEAD_WORDS.sub("", attrs) if inside else attrs) if attrs else 0.0))
    flush()
    return out, tree


def costs(block: Block) -> float:
    """What calling the block boilerplate costs, less what calling it content costs."""
    text, n = block.text, len(block.text)
    share = block.linked / n
    punctuation = sum(text.count(c) for c in ".!?;:")
    score = block.bias - 0.5 - 6.0 * (share > 0.6) - 2.0 * share
    score += min(2.0, n / 120) + min(1.0, 0.4 * punctuation)
    if n < 200:
        score -= 1.5 * bool(WORDING.search(text))
        if block.bias <= 0:  # nothing but the wording to go by
            score -= min(3.0, 1.5 * len(_SEPARATORS.findall(text))) + 1.5 * (n < 60 and text[-1] not in ".!?:…\"'”»")
    return score


def closeness(way: int) -> float:
    """Smoothness of two blocks by the way between them in the DOM."""
    return 1.2 if way <= 2 else 0.6 if way <= 4 else 0.25


def minimum_cut(terminal: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels (true: the source's side) of least cost: -terminal[i] or terminal[i] by sign where the label differs, and each edge cut."""
    n = len(terminal)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    bias, label = list(terminal), [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(bias[i]) >= sum(near[i].values()):
            label[i] = bias[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                bias[j] += w if label[i] else -w
                todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    excess = {i: bias[i] for i in left}
    cut_off: set[int] = set()  # from here no way leads to the sink any more, nor will
    for i in left:  # push what the source can send along shortest ways to where the sink still takes
        while excess[i] > 1e-12 and i not in cut_off:
            came, todo = {i: None}, deque([i])
            goal = None
            while todo and goal is None:
                x = todo.popleft()
                for y, w in near[x].items():
                    if w > 1e-12 and y not in came and y not in cut_off:
                        came[y] = x
                        if excess[y] < -1e-12:
                            goal = y
                            break
                        todo.append(y)
            if goal is None:
                cut_off.update(came)
                break
            flow, y = min(excess[i], -excess[goal]), goal
            while came[y] is not None:
                flow, y = min(flow, near[came[y]][y]), came[y]
            y = goal
            while came[y] is not None:
                x = came[y]
                near[x][y] -= flow
                near[y][x] = near[y].get(x, 0.0) + flow
                y = x
            excess[i] -= flow
            excess[goal] += flow
    todo = deque(i for i in left if excess[i] > 1e-12)
    reach = set(todo)
    while todo:
        for y, w in near[todo.popleft()].items():
            if w > 1e-12 and y not in reach:
                reach.add(y)
                todo.append(y)
    return [bool(label[i]) if label[i] is not None else i in reach for i in range(n)]


def label_blocks(blocks: list[Block], tree: Tree) -> list[bool]:
    edges: dict[tuple[int, int], float] = {}
    previous: dict[int, int] = {}
    for k, b in enumerate(blocks):
        if k:
            edges[k - 1, k] = closeness(tree.way(blocks[k - 1].node, b.node))
        parent = tree.parent[b.node]
        if (j := previous.get(parent)) is not None and j != k - 1:
            edges[j, k] = 0.4
        previous[parent] = k
    return minimum_cut([costs(b) for b in blocks], edges)


def main_text(page: str) -> tuple[str, int, int]:
    """The content blocks joined by line ends; the number of blocks, and of those that are content."""
    blocks, tree = blocks_of(page)
    keep = [b.text for b, yes in zip(blocks, label_blocks(blocks, tree), strict=True) if yes]
    return "\n".join(keep), len(blocks), len(keep)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_content) for each page."""
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("text"))
    kinds = [src.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [main_text(x or "") for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([g[0] for g in got], pa.string()), pa.array([len(g[0]) for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_content"])

    return mapped(src, run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint, n_blocks bigint, n_content bigint")
