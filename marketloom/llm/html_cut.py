"""Main text of web pages by a minimum cut between content and boilerplate.

A page becomes a row of text blocks. Each block has a classifier cost for either label, which become the capacities of
its edges to the source and the sink. Neighbouring blocks, and successive blocks in one container, are joined by
smoothness edges that weaken with their distance in the document tree. A maximum flow gives the labelling of least
total cost: a short paragraph among long ones stays, a lone long sentence in a link list goes.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, columns_of

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/><]*)|<[!?][^<>]*>""", re.S)
STOP = re.compile(r"""["'<>]""")
PLAIN = re.compile("[<>]")
VALUE = re.compile(r"""=\s*\Z""")
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""\bhidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
PARTS = re.compile(r"[a-z0-9]+")
# Fixed values of HTML: elements without an end tag, those whose text is not markup, and those inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup td th time tt u var wbr br img".split())
#: Elements that an opening one of the given kind ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html article section div main aside nav footer header form".split())
NEVER = frozenset("nav aside form button select menu dialog svg canvas object head fieldset datalist".split())
CONTENT = frozenset("article main".split())
#: Words of class, id or role that mark what is not the article.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies consent disqus disclaimer "
    "discussion feedback footer gdpr header legal login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion promoted reactions recommended related replies responses search share sharing "
    "sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
GOOD = frozenset("article articlebody content entry main post story body text".split())
#: Those of them that also name a place in the page's layout, which a word for content beside them makes doubtful.
LAYOUT = frozenset("banner banners header legal login masthead modal notice notices overlay recommended related search share sharing signup social toolbar topbar widget".split())
STRONG = 40.0  # cost of keeping what its element rules out: forms, menus, hidden parts
NOISY, DOUBTFUL = 16.0, 8.0  # cost of keeping what a word marks as no article, and what another word beside it marks as one
ACROSS = 0.25  # share of the smoothness between marked and unmarked neighbours
SMOOTH = 4.0  # capacity between neighbours in one container


FAR = 8  # steps up from a block after which its distance no longer counts


class Element:
    """An open element; block elements are linked to the block element above."""

    __slots__ = ("name", "ruled_out", "inside", "named", "paragraph", "block", "above", "noise")

    def __init__(self, name, ruled_out=False, inside=False, named=False, paragraph=0, above=None, noise=0.0):
        self.noise = noise
        self.name, self.ruled_out, self.inside, self.named = name, ruled_out, inside, named
        self.paragraph = paragraph  # place of the innermost open paragraph of this scope in the stack, 0 if none
        self.block = above if name in INLINE else self
        self.above = above


class Block:
    __slots__ = ("parts", "links", "letters", "place", "ruled_out", "inside", "named", "tag", "noise", "dense")

    def __init__(self, e: Element):
        self.noise, self.dense = e.noise, 0.0  # dense: share of link text in the container
        self.parts, self.links, self.letters = [], 0, 0
        self.place, self.ruled_out, self.inside, self.named, self.tag = e.block, e.ruled_out, e.inside, e.named, e.block.name


class Tags:
    """Finds where tags end. A quoted value ends at its closing quote however far that is; a quote without one is stray."""

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'"}
        self.quotes = True  # false once quotes have swallowed the rest of the page

    def end(self, at: int) -> int:
        """Place of the > that ends the tag whose name ends at ``at``, or -1 if it is no tag."""
        start = at
        while self.quotes:
            m = STOP.search(self.page, at)
            if m is None:
                self.quotes = False
            elif m[0] == ">":
                return m.start()
            elif m[0] == "<":
                break
            else:
                at = m.end()
                if self.last[m[0]] >= at and VALUE.search(self.page, max(start, at - 9), at - 1):
                    at = self.page.find(m[0], at) + 1
        m = PLAIN.search(self.page, start)  # no whole tag with its quotes: up to the next > if no < comes before
        return m.start() if m and m[0] == ">" else -1


def blocks(page: str) -> list[tuple[str, Block]]:
    """(text, block) of every non-empty block in page order; scripts, styles and comments have none."""
    out: list[tuple[str, Block]] = []
    stack = [Element("")]
    opened: dict[str, int] = {}
    current: Block | None = None
    at = 0

    def close() -> None:
        nonlocal current
        if current is not None:
            text = " ".join(html.unescape("".join(current.parts)).split())
            if text:
                out.append((text, current))
            current = None

    def add(raw: str) -> None:
        nonlocal current
        size = len(raw.strip())
        if current is None:
            if not size:
                return
            current = Block(stack[-1])
        current.parts.append(raw)
        current.letters += size
        if opened.get("a"):
            current.links += size

    def pop(upto: int) -> None:
        for e in stack[upto:]:
            opened[e.name] -= 1
        del stack[upto:]

    find, tags, skip = MARKUP.search, Tags(page), 0
    while True:
        m = find(page, skip or at)
        if m is None:
            add(page[at:])
            break
        name, stop = m[2], m.end() - 1 if m[2] is None else tags.end(m.end())
        if stop < 0:  # a less-than sign of the text
            skip = m.end()
            continue
        if m.start() > at:
            add(page[at : m.start()])
        at, skip = stop + 1, 0
        if name is None:
            continue
        name, inline = name.lower(), name.lower() in INLINE
        if m[1]:
            if not inline:
                close()
            if opened.get(name):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        pop(i)
                        break
                    if inline and stack[i].name not in INLINE:
                        break  # an inline end tag does not end blocks
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in ("td", "th", "br", "img"):
            if current is not None:
                current.parts.append(" ")
        elif not inline:
            close()
        if name in VOID:
            continue
        if not inline and stack[-1].paragraph:  # a block ends an open paragraph and what is inside it
            pop(stack[-1].paragraph)
        if name in ENDS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in ENDS[name]:
                    pop(i)
                    break
                if stack[i].name in SCOPES:
                    break
        attrs, up = page[m.end() : stop], stack[-1]
        ruled, named, noise = up.ruled_out, up.named, up.noise
        if attrs:
            words = {w for value in NAMED.findall(attrs) for w in PARTS.findall(value.lower())}
            own = bool(words & GOOD)
            # A body, main or article may be styled for its menu or comments without being one.
            if words & NOISE and name not in ("html", "body", "main") and not (own and name in CONTENT):
                noise = max(noise, DOUBTFUL if own and words & NOISE <= LAYOUT else NOISY)
            ruled = ruled or HIDDEN.search(attrs) is not None
            named = named or own
        ruled = ruled or name in NEVER or name == "footer" or name == "header" and not up.inside
        paragraph = len(stack) if name == "p" else 0 if name in SCOPES else up.paragraph
        stack.append(Element(name, ruled, up.inside or name in CONTENT, named, paragraph, up.block, noise))
        opened[name] = opened.get(name, 0) + 1
    close()
    sums: dict[int, list[int]] = {}
    for _, b in out:
        total = sums.setdefault(id(b.place.above), [0, 0])
        total[0] += b.links
        total[1] += b.letters
    for _, b in out:
        links, letters = sums[id(b.place.above)]
        b.dense = links / max(1, letters)
    return out


def cost(text: str, b: Block) -> float:
    """Log-odds of content: positive is the price of dropping the block, negative that of keeping it."""
    if b.ruled_out:
        return -STRONG
    words = text.count(" ") + 1
    density = b.links / max(1, b.letters)
    score = 1.2 * math.log1p(words) - 2.4 - 6.0 * density
    score += 6.0 * b.inside + 1.5 * b.named - 2.0 * b.dense - b.noise
    if b.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"):
        score += 1.0
    if text[-1] in ".!?\"'”»…。":
        score += 0.7
    return score


def distance(a: Element, b: Element) -> int:
    """Steps between two blocks' elements in the tree, as far as FAR steps up from each."""
    seen, up, x = {}, 0, a
    while x is not None and up <= FAR:
        seen[id(x)] = up
        x, up = x.above, up + 1
    down, x = 0, b
    while x is not None and down <= FAR:
        if id(x) in seen:
            return seen[id(x)] + down
        x, down = x.above, down + 1
    return 2 * FAR + 2


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block and the next one, and each block and the one before it in its container.

    What is ruled out is passed over. Blocks that a word marks are linked among each other, and unmarked ones over them;
    between the two kinds the links of neighbours are weaker.
    """
    out, before, last = [], {}, {}
    for i, b in enumerate(found):
        kind = (b.ruled_out, b.noise > 0)
        near = {before.get(kind), last.get((kind, id(b.place.above)))} - {None}
        out += [(j, i, SMOOTH / (1 + distance(found[j].place, b.place))) for j in sorted(near)]
        if i and not b.ruled_out and not found[i - 1].ruled_out and i - 1 not in near:
            out.append((i - 1, i, ACROSS * SMOOTH / (1 + distance(found[i - 1].place, b.place))))
        before[kind] = last[kind, id(b.place.above)] = i
    return out


def minimum_cut(costs: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least total cost, True on the source's side, by Dinic's maximum flow.

    Nodes with a positive cost are fed by the source, negative ones drain to the sink; a link costs its capacity if it is
    cut. Of equal cuts the one with the fewest nodes on the source's side is taken.
    """
    n, eps = len(costs), 1e-9
    supply, drain = [max(c, 0.0) for c in costs], [max(-c, 0.0) for c in costs]
    graph: list[list[int]] = [[] for _ in range(n)]
    to, cap = [], []
    for i, j, c in links:
        graph[i].append(len(to))
        to.append(j)
        cap.append(c)
        graph[j].append(len(to))
        to.append(i)
        cap.append(c)
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if supply[i] > eps)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            i = queue.popleft()
            if drain[i] > eps:
                reached = True
            for e in graph[i]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        nxt = [0] * n
        for s in range(n):
            while supply[s] > eps and level[s] == 0:
                path, i, found = [], s, False
                while True:
                    if drain[i] > eps:
                        found = True
                        break
                    while nxt[i] < len(graph[i]):
                        e = graph[i][nxt[i]]
                        if cap[e] > eps and level[to[e]] == level[i] + 1:
                            break
                        nxt[i] += 1
                    else:
                        if not path:
                            break
                        e = path.pop()
                        i = to[e ^ 1]
                        nxt[i] += 1
                        continue
                    path.append(e)
                    i = to[e]
                if not found:
                    break
                flow = min(supply[s], drain[i], *[cap[e] for e in path])
                supply[s] -= flow
                drain[i] -= flow
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow


def main_text(page: str | None) -> str:
    """Blocks of the content side in page order, joined by two line feeds; empty for a null page or one without content."""
    found = blocks(page or "")
    if not found:
        return ""
    keep = minimum_cut([cost(t, b) for t, b in found], edges([b for _, b in found]))
    return "\n\n".join(t for (t, _), k in zip(found, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, in one pass without a shuffle.

    A null page is empty. Null ids, repeated rows and pages of any length are kept; an empty table gives none.
    """
    rows = columns_of(pages, page_id=id_col, url=url_col, html=html_col)

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, bodies in batches(it, "page_id", "url", "html"):
            texts = [main_text(b) for b in bodies]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(scan, "page_id long, url string, text string, n_chars long")
