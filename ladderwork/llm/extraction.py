"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks at block-level tags.  A logistic cost, from the
block's ancestors and class names, its length, link share and punctuation,
gives each block a capacity to the content terminal and one to the boilerplate
terminal.  The weights are set by hand (`ExtractionParams`), not fitted; each
hint is bounded, names that only lay out a page yield to an article inside,
class names of html and body say nothing, and neither does any class or id
name that would take most of the page's text.  Where the cut keeps nothing,
the blocks outside furniture are the text.  Neighbouring blocks are joined by edges whose capacity grows with
what their DOM paths share.  Maximum flow separates content from boilerplate
at least cost.  Each page is handled by one call on one row; Spark deals the
rows out.

Defined results: null or empty html gives an empty text; a page of markup
only too; repeated pages give equal rows; null page_id or url stay null.
Extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderwork.llm.common import given_id, null_id

#: Elements whose text is never shown as text.
HIDDEN = frozenset("script style noscript template svg math head title iframe object canvas audio video map".split())
#: Elements that hold page furniture.
FURNITURE = frozenset("nav footer aside form menu dialog button select textarea label fieldset option header".split())
#: Elements that break a line.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section select summary "
    "table tbody td textarea tfoot th thead tr ul".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of class and id names that point at furniture that may also wrap or lay out a whole page.
LAYOUT_NAMES = re.compile(
    r"(?:^|[-_ ])(?:banner|breadcrumbs?|byline|footer|foot|header|masthead|menu|nav\w*|rss|sidebar|tags?|toolbar|widget)(?:$|[-_ ])", re.I
)
#: Parts of names that point at reader comments, adverts and notices.
OTHER_NAMES = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|comments?|cookies?|consent|copyright|disqus|modal|newsletter|notice|pagination|pager|popup|"
    r"promo\w*|related|replies|respond|share|sharing|signup|social|sponsor\w*|subscribe)(?:$|[-_ ])",
    re.I,
)
#: Names that tell a state of the page and not what an element holds.
STATE_NAMES = re.compile(r"(?:^|(?<= ))(?:(?:has|with|no|is|js)[-_]\S*|\S*[-_](?:enabled|disabled|open|closed|on|off))(?= |$)", re.I)
#: Parts of names that point at the article.
CONTENT_NAMES = re.compile(r"(?:^|[-_ ])(?:article|content|entry|main|post|story|text|body)(?:$|[-_ ])", re.I)
#: Elements that hold furniture wherever they stand; the others of FURNITURE may wrap the article.
ALWAYS = frozenset("nav footer aside menu dialog button select textarea label option".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

#: A quote opens a value only after an equals sign; an unquoted value ends at white space or the tag's end.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|=\s*[^\s\"'>][^\s>]*|[^>])*+)>", re.S
)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "title", "textarea", "noscript", "iframe")}


@dataclass
class Block:
    text: str
    node: int
    inside_article: bool
    furniture: int
    layout: int
    heading: bool
    link_chars: int


@dataclass(frozen=True)
class Marks:
    """What an element's own name, class and id say."""

    article: bool = False
    heading: bool = False
    #: an element that always holds furniture; a name that does
    element: bool = False
    named: bool = False
    #: an element or name that may also lay out a page
    layout: bool = False
    laid_by_name: bool = False


@dataclass
class Page:
    blocks: list[Block]
    #: parent and depth of each node; node 0 is the page
    parents: list[int]
    depths: list[int]

    def shared(self, a: int, b: int) -> int:
        """Depth of the nearest common ancestor."""
        while a != b:
            if self.depths[a] < self.depths[b]:
                a, b = b, a
            a = self.parents[a]
        return self.depths[a]


def _marks(name: str, named: str) -> Marks:
    """An element's own hints; class names of html and body say nothing."""
    named = STATE_NAMES.sub("", "" if name in ("html", "body") else named)
    other, laid = bool(OTHER_NAMES.search(named)), bool(LAYOUT_NAMES.search(named))
    article = name in ("article", "main") or bool(named and not laid and not other and name not in FURNITURE and CONTENT_NAMES.search(named))
    return Marks(article, name in HEADINGS, name in ALWAYS, other, name in FURNITURE and name not in ALWAYS, laid)


def _placed(page: Page, marks: list[Marks], names: list[str], p_share: float) -> Page:
    """The blocks with the hints of their ancestors.

    A name that would take more than `p_share` of the page's text outside
    furniture elements says nothing: furniture is the lesser part of a page.
    """
    under, always = [0] * len(marks), [False] * len(marks)
    for k in range(1, len(marks)):
        always[k] = always[page.parents[k]] or marks[k].element
    for b in page.blocks:
        if not always[b.node]:
            under[b.node] += len(b.text)
    for k in range(len(marks) - 1, 0, -1):
        under[page.parents[k]] += under[k]
    article, furniture, layout, heading = ([0] * len(marks) for _ in range(4))
    for k in range(1, len(marks)):
        m, up = marks[k], page.parents[k]
        heard = under[k] <= p_share * under[0]
        laid = m.layout or (m.laid_by_name and heard)
        if laid and article[up] and names[k] == "header":  # an article's own head holds its title
            laid = False
        article[k] = article[up] or m.article
        layout[k] = (0 if m.article else layout[up]) + laid
        furniture[k] = furniture[up] + (m.element or (m.named and heard))
        heading[k] = heading[up] or m.heading
    for b in page.blocks:
        b.inside_article, b.furniture, b.layout, b.heading = bool(article[b.node]), furniture[b.node], layout[b.node], bool(heading[b.node])
    return page


def page_of(html: str, most: float = 0.6) -> Page:
    """The page's blocks in order, with white space closed up and references decoded.

    most: the share of the page's text that a name may take for furniture.
    """
    out, parents, depths = [], [0], [0]
    marks, names = [Marks()], [""]
    stack = [("", 0, False)]  # name, node and whether what is inside is hidden
    open_names: dict[str, int] = {}
    words: list[str] = []
    links, at = 0, 0

    def flush() -> None:
        nonlocal links
        text = " ".join(html_lib.unescape("".join(words)).split())
        words.clear()
        if text:
            out.append(Block(text, stack[-1][1], False, 0, 0, False, min(links, len(text))))
        links = 0

    def pop() -> None:
        open_names[stack.pop()[0]] -= 1

    size, last = len(html), html.rfind(">")
    while at < size:
        m = _TOKEN.search(html, at) if at <= last else None
        piece = html[at : m.start()] if m else html[at:].partition("<!--")[0]
        if piece and not stack[-1][2]:
            words.append(piece)
            if open_names.get("a"):
                links += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in BLOCKS:
            flush()
        if closing:
            if open_names.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in VOID:
            continue
        if name in ("p", "li") and stack[-1][0] == name:  # an open one ends here
            pop()
        named = " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(m[3])) if m[3] else ""
        if not m[3].endswith("/") or name not in ("svg", "iframe", "object"):
            above = stack[-1]
            parents.append(above[1])
            depths.append(depths[above[1]] + 1)
            marks.append(_marks(name, named))
            names.append(name)
            stack.append((name, len(parents) - 1, above[2] or name in HIDDEN))
            open_names[name] = open_names.get(name, 0) + 1
        if name in _RAW_END:
            end = _RAW_END[name].search(html, at)
            if name != "textarea":
                at = end.start() if end else size
    flush()
    return _placed(Page(out, parents, depths), marks, names, most)


def blocks(html: str) -> list[Block]:
    return page_of(html).blocks


@dataclass(frozen=True)
class ExtractionParams:
    bias: float = -0.4
    article: float = 3.0
    #: furniture by its element or a strong name; by a name or element that may also lay out a page
    furniture: float = -6.0
    layout: float = -4.0
    heading: float = 0.8
    length: float = 0.5
    links: float = -4.0
    sentence: float = 0.6
    smooth: float = 0.35
    shared: float = 0.25
    #: a page with an article element has its text there
    outside: float = -3.5
    #: a page without one is text but for its furniture
    unmarked: float = 0.6
    #: share of a page's text that a class or id name may take for furniture
    most: float = 0.6


def costs(found: list[Block], p: ExtractionParams) -> list[float]:
    """Log-odds that a block is content; a hint counts once, however many ancestors give it."""
    marked = any(b.inside_article and not b.furniture and not b.layout for b in found)
    out = []
    for b in found:
        n = len(b.text)
        x = p.bias + p.length * log(1 + n / 20) + p.links * b.link_chars / n + p.sentence * (b.text[-1] in ".!?…:;\"”»)")
        x += p.heading * b.heading + (p.article if b.inside_article else p.outside if marked else p.unmarked)
        out.append(x + (p.furniture if b.furniture else p.layout if b.layout else 0.0))
    return out


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: |score| for a label against it, edge capacity for unlike ends.

    Maximum flow by shortest augmenting paths (Dinic) between the two
    terminals; what the source still reaches is content.
    """
    n = len(scores)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def edge(a: int, b: int, forth: float, back: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(forth)
        heads[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, s in enumerate(scores):
        edge(source, i, s, 0.0) if s > 0 else edge(i, sink, -s, 0.0)
    for a, b, c in edges:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for a in queue:
            for e in heads[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while tried[a] < len(heads[a]):
                e = heads[a][tried[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                tried[a] += 1
            if tried[a] < len(heads[a]):
                path.append(heads[a][tried[a]])
                a = to[path[-1]]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                tried[a] += 1
            else:
                break


def main_text(html: str | None, p: ExtractionParams = ExtractionParams()) -> str:
    page = page_of(html or "", p.most)
    found = page.blocks
    if not found:
        return ""
    edges = []
    for i, (x, y) in enumerate(zip(found, found[1:])):
        deep = max(page.depths[x.node], page.depths[y.node], 1)
        near = page.shared(x.node, y.node) / deep
        edges.append((i, i + 1, p.smooth * near + p.shared * (page.parents[x.node] == page.parents[y.node])))
    seen: dict[int, int] = {}
    for i, b in enumerate(found):  # the previous block under the same parent
        j = seen.get(page.parents[b.node])
        if j is not None and j < i - 1:
            edges.append((j, i, p.shared))
        seen[page.parents[b.node]] = i
    keep = min_cut(costs(found, p), edges)
    if not any(keep):  # a page has its text outside furniture, if there is any
        keep = [not b.furniture and not b.layout for b in found]
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extracted(pages: DataFrame, p: ExtractionParams = ExtractionParams()) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h, p) for h in batch["html"]]
            if texts:
                yield pd.DataFrame({"page_id": batch["page_id"].to_numpy(), "url": batch["url"], "text": texts, "n_chars": [*map(len, texts)]})

    out = pages.select(given_id("page_id"), "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
    return out.withColumn("page_id", null_id("page_id"))
