"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes a row of text blocks with their place in the document tree. A linear classifier turns what a block is
and where it stands into a cost of calling it boilerplate and a cost of
calling it content: the capacities from the source and to the sink. Neighbouring blocks and
blocks of the same parent are joined by smoothness edges, the stronger the nearer they are in the tree. The minimum
cut of this graph is the cheapest labelling; blocks on the source's side are content.

Elements may be marked by their tag, class, id or role as something else than the article. The cost of most such marks falls
with the share of the page's prose that they hold, since a layout's wrapper may carry any class. Reader comments are another matter: more
of them are no better evidence of an article, so an element marked as comments keeps its cost at any length, unless it holds the
page's main heading. Words of a class that tell a state (``comments-open``, ``has-sidebar``) mark nothing.

The weights are reasoned, not fitted: a sentence of 25 words in a paragraph must outweigh the bias of boilerplate (-1.5), a
mark (20) anything that a block and its edges can bring together (at most about 15), and a mark by name alone (4) about one sentence.

Everything is linear in the page but the flow: the tree is kept as parent pointers, marks are summed along
them, and the flow runs over level graphs.

Before the flow, blocks whose own costs outweigh all their edges are fixed and
passed on to their neighbours as costs, which leaves the cut as it is and mostly
leaves no graph.

Null and empty html have no text. Repeated rows get equal rows. White space
is what Unicode calls so; a line break inside a block counts as white space.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from sheafspark.llm.buffers import slices

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)"""
    r"""|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"""
    r"""|(?P<text>[^<]+|<)""",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")

# Elements whose content is raw text up to their close tag, or to the end of the page, and no text of it.
_RAW = {"script", "style", "title", "textarea", "iframe"}
# Elements with ordinary content that is no text of the page; without a close tag of their own they hold nothing.
_HIDDEN = {"svg", "object", "noscript", "select", "template", "annotation", "annotation-xml"}
# Formulas are text inside a line.
_MATH = {
    "math", "semantics", "maction", "menclose", "merror", "mfenced", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded",
    "mphantom", "mprescripts", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd",
    "mtext", "mtr", "munder", "munderover",
}
_OPTIONS = {"option", "optgroup"}
# Elements that end an open svg or select.
_BREAKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "div", "dl", "dt", "figure", "footer", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "li", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "label", "mark", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
    "u", "var", "wbr", "img", "br", *_MATH,
}
_OUTSIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "head", *_OPTIONS}
# Of these, and of elements with hints, how much of the text they hold decides.
_WRAPPERS = {"form", "fieldset"}
_CONTENT = {"article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_PROSE = {"p", "pre", "blockquote"}
# Costs of being outside: at most, in an article, and in a section of an article that only its id hints at.
_FULL, _IN_ARTICLE, _NAMED = 20.0, 12.0, 4.0
_CLOSED_BY_SAME = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
# Words that mark reader comments, and words that make a name tell a state instead of a part of the page.
_COMMENTS = {"comment", "comments", "commentlist", "disqus", "replies", "reply", "respond"}
_STATES = {
    "allow", "allowed", "closed", "count", "disabled", "disallowed", "enable", "enabled", "has", "hide", "hidden", "is", "no", "not", "off",
    "on", "open", "show", "with", "without",
}
# Words of class, id and role attributes of elements that are not the article.
_HINTS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs",
    "complementary", "consent", "contentinfo", "cookie", "cookies", "footer", "login", "masthead", "menu",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pagination", "pager", "popup", "promo",
    "promoted", "promotion", "related", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor",
    "sponsored", "subscribe", "toolbar", "widget", "widgets",
}


@dataclass
class Block:
    """Text of one block, the element it lies in, its innermost mark and article, and what the classifier looks at."""

    text: str
    node: int
    tag: str
    words: int
    link_share: float
    mark: int | None = None
    article: int | None = None
    outside: float = 0.0

    @property
    def inside(self) -> bool:
        return self.article is not None

    @property
    def prose(self) -> float:
        return self.words * (1 - self.link_share) if self.tag in _PROSE or self.words >= 10 else 0.0


@dataclass
class Mark:
    """An element that may not be of the article: its most cost, whether that is fixed, whether comments, mark and article around it."""

    cost: float
    fixed: bool
    comments: bool
    around: int | None
    article: int | None


@dataclass
class Page:
    """Blocks, marks and articles by number, and the tree of block elements as parents and depths."""

    blocks: list[Block]
    marks: dict[int, Mark]
    articles: dict[int, int | None]
    parent: dict[int, int | None]
    depth: dict[int, int]


def _outside_cost(tag: str, attrs: str, inside: bool) -> tuple[float, bool]:
    """(what an element costs at most that may begin something that is not the article, whether it is comments); 0 if it does not."""
    if tag in _OUTSIDE:
        return (_IN_ARTICLE if inside and tag in _WRAPPERS else _FULL), False
    if tag == "header" and not inside:
        return _FULL, False
    if tag in ("html", "body", "main") or tag in _HEADINGS or not attrs:
        return 0.0, False
    cost = 0.0
    for found in _NAMES.finditer(attrs):
        for name in (found[1] or found[2] or found[3] or "").lower().split():
            words = set(_SPLIT.split(name))
            if words & _STATES:
                continue
            if words & _COMMENTS:
                return _FULL, True
            if words & _HINTS:
                named = tag == "section" and found[0][:2].lower() == "id"
                cost = max(cost, _FULL if not inside else _NAMED if named else _IN_ARTICLE)
    return cost, False


def _sum_up(values: dict[int, float], around: dict[int, int | None]) -> None:
    """Adds what each element holds to the one around it; inner elements have larger numbers."""
    for k in sorted(values, reverse=True):
        outer = around[k]
        if outer is not None:
            values[outer] += values[k]


def weigh_marks(page: Page) -> None:
    """Sets what each block's marked elements cost it.

    The cost of a form or of an element with a hint falls with its share of the prose, of the article around it or else of the page
    without its comments; it stays whole if articles elsewhere hold prose. An article that opens below such an element
    and holds the page's prose is not touched by it. Comments cost all of it, however long they are, unless the
    page's main heading is among them: then the element is no more than one with a hint.
    """
    marks, around = page.marks, {k: m.around for k, m in page.marks.items()}
    headed = dict.fromkeys(marks, 0.0)
    for b in page.blocks:
        if b.mark is not None and b.tag == "h1":
            headed[b.mark] += 1
    _sum_up(headed, around)
    # Prose of comments counts for nothing but themselves.
    in_comments: dict[int | None, bool] = {None: False}
    for k in sorted(marks):
        in_comments[k] = in_comments[around[k]] or (marks[k].comments and not headed[k])
    held = dict.fromkeys(marks, 0.0)
    of_article = dict.fromkeys(page.articles, 0.0)
    core: dict[int | None, float] = defaultdict(float)
    whole_page = 0.0
    for b in page.blocks:
        if in_comments[b.mark]:
            continue
        whole_page += b.prose
        if b.mark is not None:
            held[b.mark] += b.prose
        if b.article is not None:
            of_article[b.article] += b.prose
            core[b.mark] += b.prose
    _sum_up(held, around)
    _sum_up(of_article, page.articles)
    # Down from the outermost marks: prose of articles around, and the largest costs, with and without those that inner articles escape.
    elsewhere: dict[int | None, float] = {None: core[None]}
    most: dict[int | None, float] = {None: 0.0}
    most_in_article: dict[int | None, float] = {None: 0.0}
    for k in sorted(marks):
        m = marks[k]
        whole = whole_page if m.article is None else of_article[m.article]
        others = elsewhere[m.around] if m.article is None else 0.0
        elsewhere[k] = elsewhere[m.around] + core[k]
        cost, escaped = m.cost, False
        if not (m.fixed or in_comments[k] or not whole or 10 * others > held[k]):
            cost = m.cost * (1 - held[k] / whole)
            escaped = m.article is None and 2 * held[k] >= whole
        most[k] = max(most[m.around], cost)
        most_in_article[k] = max(most_in_article[m.around], 0.0 if escaped else cost)
    for b in page.blocks:
        b.outside = most[b.mark] if b.article is None else most_in_article[b.mark]


def _raw_end(page: str, tag: str, at: int) -> int:
    end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
    return end.end() if end else len(page)


def _closes_itself(attrs: str) -> bool:
    return attrs.rstrip().endswith("/")


def hidden_ends(page: str, tag: str, at: int, around: set[str]) -> dict[int, int | None]:
    """Where hidden elements end: {end of the open tag: end of the close tag, or None without one}.

    Reads on from the element whose open tag ends at ``at`` until it is closed, or cannot be any more because an element
    around it is closed or a block begins that it cannot hold. The answers are for all of its tag on the way.
    """
    ends: dict[int, int | None] = {}
    stack = [(tag, at)]

    def drop(depth: int) -> None:
        ends.update({start: None for name, start in stack[depth:] if name == tag})
        del stack[depth:]

    size = len(page)
    while stack and at < size:
        token = _TOKEN.match(page, at)
        at = token.end()
        name = (token["tag"] or token["tag2"] or "").lower()
        if not name:
            continue
        if token["close"] or token["close2"]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                start = stack[depth][1]
                drop(depth + 1)
                stack.pop()
                if name == tag:
                    ends[start] = at
            elif name in around and name not in _INLINE:
                drop(0)
            continue
        if name in _VOID or _closes_itself(token["attrs"] or token["attrs2"] or ""):
            continue
        if name in _RAW:
            at = _raw_end(page, name, at)
        elif name in _BREAKS and tag in ("svg", "select") and not any(e[0] == "foreignobject" for e in stack):
            drop(0)
        else:
            stack.append((name, at))
    drop(0)
    return ends


def blocks_of(source: str) -> Page:
    """The text blocks of a page in page order, their marks weighed, and the tree they lie in."""
    found: list[Block] = []
    marks: dict[int, Mark] = {}
    articles: dict[int, int | None] = {}
    hidden: dict[int, int | None] = {}
    # Open elements: (tag, number, innermost mark, innermost article); a block ends where a block element begins or ends.
    stack: list[tuple[str, int, int | None, int | None]] = [("", 0, None, None)]
    # Places in the stack of those that are not inline, and how many of each tag are open.
    solid, open_tags = [0], Counter()
    parent: dict[int, int | None] = {0: None}
    depth: dict[int, int] = {0: 1}
    parts: list[str] = []
    linked = number = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = _SPACE.sub(" ", raw).strip()
            if text:
                tag, node, _, _ = stack[solid[-1]]
                share = min(1.0, linked / max(1, len(raw)))
                found.append(Block(text, node, tag, text.count(" ") + 1, share, stack[-1][2], stack[-1][3]))
            parts.clear()
        linked = 0

    def leave(at: int) -> None:
        for element in stack[at:]:
            open_tags[element[0]] -= 1
        del stack[at:]
        while solid[-1] >= at:
            solid.pop()

    at, size = 0, len(source)
    while at < size:
        token = _TOKEN.match(source, at)
        at = token.end()
        if (text := token["text"]) is not None:
            decoded = entities.unescape(text) if "&" in text else text
            parts.append(decoded)
            if open_tags["a"]:
                linked += len(decoded)
            continue
        tag = token["tag"] or token["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if token["close"] or token["close2"]:
            if tag not in _INLINE:
                flush()
            if open_tags[tag]:
                leave(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            continue
        if tag in _RAW:
            at = _raw_end(source, tag, at)
            continue
        attrs = token["attrs"] or token["attrs2"] or ""
        if tag in _HIDDEN:
            if not _closes_itself(attrs):
                if at not in hidden:
                    hidden.update(hidden_ends(source, tag, at, {"", *(name for name, n in open_tags.items() if n)}))
                at = hidden[at] or at
            continue
        if tag in _MATH and _closes_itself(attrs):
            continue
        if tag not in _INLINE:
            flush()
        elif tag in ("br", "img", "wbr"):
            if tag == "br":
                parts.append(" ")
            continue
        if tag in _VOID:
            continue
        if tag not in _INLINE:
            # An open paragraph ends at any block; list items and cells end at the next of their kind.
            while len(solid) > 1:
                name = stack[solid[-1]][0]
                if name in _OPTIONS and tag not in _OPTIONS:
                    leave(solid[-1])
                    continue
                if name == "p" or (name == tag and tag in _CLOSED_BY_SAME):
                    leave(solid[-1])
                break
        _, _, mark, article = stack[-1]
        number += 1
        cost, comments = _outside_cost(tag, attrs, article is not None)
        if cost:
            fixed = tag not in _WRAPPERS and (tag in _OUTSIDE or tag == "header")
            marks[number] = Mark(cost, fixed, comments, mark, article)
            mark = number
        if tag in _CONTENT:
            articles[number] = article
            article = number
        if tag not in _INLINE:
            outer = stack[solid[-1]][1]
            parent[number], depth[number] = outer, depth[outer] + 1
            solid.append(len(stack))
        stack.append((tag, number, mark, article))
        open_tags[tag] += 1
    flush()
    page = Page(found, marks, articles, parent, depth)
    weigh_marks(page)
    return page


def preference(block: Block) -> float:
    """The classifier: positive for content, negative for boilerplate."""
    score = -1.5 + min(block.words, 40) / 10
    score += 4.0 if block.inside else 0.0
    score += {"p": 1.0, "pre": 1.0, "blockquote": 1.0, "li": -0.5}.get(block.tag, 0.0)
    score += 1.0 if block.tag in _HEADINGS else 0.0
    score += 0.5 if block.text[-1] in ".!?…" else 0.0
    return score - 4.0 * block.link_share - block.outside


def smoothness(page: Page) -> list[tuple[int, int, float]]:
    """Edges between neighbours, the stronger the nearer they are in the tree, and between blocks of one parent."""
    edges, parent, depth = [], page.parent, page.depth
    last: dict[int | None, int] = {}
    for k, block in enumerate(page.blocks):
        if k:
            # Up from both to what they share; over a page these steps add up to the size of its tree.
            a, b = page.blocks[k - 1].node, block.node
            deeper = max(depth[a], depth[b])
            while a != b:
                if depth[a] >= depth[b]:
                    a = parent[a]
                else:
                    b = parent[b]
            edges.append((k - 1, k, 2.0 / (1 + deeper - depth[a])))
        outer = parent[block.node]
        if outer in last and last[outer] != k - 1:
            edges.append((last[outer], k, 0.5))
        last[outer] = k
    return edges


def min_cut(preferences: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The cheapest labelling: True for content. A block without preference either way is boilerplate."""
    n = len(preferences)
    lean = list(preferences)
    label: list[bool | None] = [None] * n
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    # Fix what no labelling of the others can turn, and hand its edges on as costs.
    waiting = deque(range(n))
    while waiting:
        a = waiting.popleft()
        if label[a] is not None or abs(lean[a]) <= sum(near[a].values()):
            continue
        label[a] = lean[a] > 0
        for b, w in near[a].items():
            lean[b] += w if label[a] else -w
            del near[b][a]
            waiting.append(b)
        near[a] = {}
    rest = [k for k in range(n) if label[k] is None]
    if rest:
        content = _reached_by_flow(rest, lean, near)
        for k in rest:
            label[k] = k in content
    return label


def _reached_by_flow(nodes: list[int], lean: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes on the source's side after a maximum flow, by blocking flows over level graphs, without recursion."""
    place = {k: i for i, k in enumerate(nodes)}
    source, sink = len(nodes), len(nodes) + 1
    heads: list[list[int]] = [[] for _ in range(len(nodes) + 2)]
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, there: float, back: float) -> None:
        heads[a].append(len(to))
        heads[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for k in nodes:
        if lean[k] > 0:
            join(source, place[k], lean[k], 0.0)
        elif lean[k] < 0:
            join(place[k], sink, -lean[k], 0.0)
        for other, w in near[k].items():
            if other > k:
                join(place[k], place[other], w, w)
    while True:
        level = [-1] * len(heads)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in heads[a]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return {k for k in nodes if level[place[k]] >= 0}
        tried = [0] * len(heads)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                # Go on from before the first edge that is full now.
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-12)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while tried[a] < len(heads[a]):
                e = heads[a][tried[a]]
                if room[e] > 1e-12 and level[to[e]] == level[a] + 1:
                    break
                tried[a] += 1
            if tried[a] < len(heads[a]):
                path.append(e)
                a = to[e]
            elif a == source:
                break
            else:
                e = path.pop()
                a = to[e ^ 1]
                tried[a] += 1


def main_text(page: str) -> str:
    tree = blocks_of(page)
    if not tree.blocks:
        return ""
    labels = min_cut([preference(b) for b in tree.blocks], smoothness(tree))
    return "\n\n".join(b.text for b, keep in zip(tree.blocks, labels) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "html"):
                texts = [main_text(h) if h else "" for h in rows.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
