"""Main text of web pages by a minimum cut.

A page becomes a list of text blocks. A fixed logistic classifier gives each block a cost for either
label, which are the capacities of its edges to the two terminals. Neighbouring blocks, and blocks that
follow one another in one container, are joined by smoothness edges. The maximum flow cuts the graph
into content and boilerplate.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm import _text

#: Elements of HTML by their role in a page.
RAW = frozenset("script style noscript template textarea title svg math iframe object select option canvas audio video xmp noembed noframes plaintext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open paragraph are the block elements; these also end their own kind.
ENDS_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog button fieldset legend search label".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar warning widget".split()
)
CONTENT_WORDS = frozenset("article body content entry main post story text".split())

#: Parts of names that say what an element lacks or is around, not what it is.
ABOUT = frozenset("no has have with without hide is not show page single site".split())
#: Last parts of names that tell of a state or an arrangement, and what says that the word before is missing.
STATES, WITHOUT = frozenset("open closed enabled disabled on off layout wrapper wrap container grid columns".split()), "free"
#: Names of what readers write; what holds it stays boilerplate, however much it is.
READERS = frozenset("comment comments disqus reply replies respond".split())
#: Elements whose names tell of the page and not of a block.
WHOLE = frozenset("html body".split())

#: Weights of the classifier, in hundredths, and the smoothness of neighbours and of one container. Structure that
#: tells little is worth less than the edges beside a block, so that a block of doubtful kind goes with those around it.
BIAS, IN_ARTICLE, IN_MAIN, BOILERPLATE, WORDS, CONTENT, LINKS, PER_WORD, MOST_WORDS, HEADING = -90, 150, 100, -600, -600, 60, -200, 10, 300, -20
ADJACENT, CONTAINER, APART = 110, 90, 10
#: What a block outside an article is worth less, where the page has one.
OUTSIDE = -450

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


def tokens(page: str) -> Iterator[tuple[int, int, re.Match | None]]:
    """Start, end and match (None for text) of the tags and texts of a page in order; the caller may send a place to
    go on from. Comments and declarations are left out. A tag that never ends, as of a quote that is left open, is
    the last to be read with quotes: from there on tags end at the next ``>``, so no part is read over and over."""
    at, size, tag = 0, len(page), _TAG
    while at < size:
        if page[at] != "<":
            end = page.find("<", at)
            end = size if end < 0 else end
            yield at, end, None
            at = end
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            at = size if end < 0 else end + 1
            continue
        m = tag.match(page, at)
        if m is None and page[at + 1 : at + 2].isalpha() or m is None and page[at + 1 : at + 2] == "/" and page[at + 2 : at + 3].isalpha():
            tag = _LOOSE
            if page.find(">", at) < 0:
                return
            m = tag.match(page, at)
        if m is None:
            yield at, at + 1, None
            at += 1
            continue
        sent = yield at, m.end(), m
        at = m.end() if sent is None else sent


@dataclass
class Element:
    tag: str
    parent: Element | None
    article: bool = False
    main: bool = False
    own: int = 0
    readers: bool = False
    hidden: bool = False
    link: bool = False
    words: int = 0
    marked: bool = False
    whole: bool = False
    score: int = 0
    inside: bool = False
    outside: bool = False


@dataclass
class Block:
    container: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _named(value: str) -> tuple[int, bool]:
    """What a class or id tells of an element, and whether of what readers write."""
    words: set[str] = set()
    for part in value.split():
        own = _WORD.findall(part)
        if not own or own[0] in ABOUT or len(own) > 1 and own[-1] in STATES:
            continue
        words.update(w for w, after in zip(own, [*own[1:], ""]) if after != WITHOUT)
    return WORDS if words & BOILERPLATE_WORDS else CONTENT if words & CONTENT_WORDS else 0, bool(words & READERS)


def _open(tag: str, attributes: str, parent: Element | None) -> Element:
    e = Element(tag, parent)
    if parent:
        e.article, e.main, e.hidden, e.link = parent.article, parent.main, parent.hidden, parent.link
    e.marked, e.whole = tag in ("article", "main"), tag == "article"
    e.article |= tag == "article"
    e.main |= tag == "main"
    e.link |= tag == "a"
    e.hidden |= tag == "head"
    e.own += BOILERPLATE * (tag in BOILERPLATE_TAGS)
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id") and tag not in WHOLE:
                told, readers = _named(value)
                e.own += told
                e.readers |= readers
            elif name == "role":
                e.own += BOILERPLATE * (value in BOILERPLATE_ROLES)
                e.main |= value == "main"
                e.article |= value == "article"
                e.marked |= value in ("main", "article")
                e.whole |= value == "article"
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                e.hidden = True
    return e


def _weigh(elements: list[Element]) -> None:
    """Scores of elements (parents before what they hold) from their own marks and those around them. What is held against an
    element is dropped where it must be the frame of the text and no part beside it: it is the article or main part with the
    most words, or holds it, or holds over half the words of that part (of the page, if none is marked) and is not what
    readers write. Where an article has most of the text, what is in none is ``outside``."""
    for e in reversed(elements[1:]):
        e.parent.words += e.words
    best = max((e for e in elements if e.marked and e.words and not e.readers), key=lambda e: e.words, default=None)
    article = max((e.words for e in elements if e.whole and not e.readers), default=0)
    is_article = best is not None and 2 * article > best.words
    frame = set()
    e = best
    while e is not None:
        frame.add(id(e))
        e = e.parent
    whole = best or elements[0]
    for e in elements:
        e.inside = e is whole or e.parent is not None and e.parent.inside
        framing = id(e) in frame or e.inside and not e.readers and 2 * e.words > whole.words
        e.outside = is_article and not e.article
        e.score = (e.parent.score if e.parent else 0) + (max(0, e.own) if framing else e.own)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, without scripts, styles, comments and hidden parts. Open elements are found by
    their places by tag, so no tag makes the stack be searched."""
    top = Element("#root", None)
    stack, elements = [top], [top]
    places: dict[str, list[int]] = {}
    framed = [0]  # places of block elements, and of the root
    out: list[Block] = []
    now: Block | None = None

    def close(to: int) -> None:
        nonlocal now
        if framed[-1] >= to:
            now = None
        while framed[-1] >= to:
            framed.pop()
        for x in stack[to:]:
            places[x.tag].pop()
        del stack[to:]

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    size = len(page)
    read = tokens(page)
    sent = None
    while True:
        try:
            at, end, m = read.send(sent)
        except StopIteration:
            break
        sent = None
        if m is None:
            s = page[at:end]
            here = stack[-1]
            if here.hidden:
                continue
            if now is None:
                if s.isspace():
                    continue
                now = Block(stack[framed[-1]])
                out.append(now)
            s = html.unescape(s) if "&" in s else s
            now.parts.append(s)
            if here.link:
                now.linked += len(s)
            continue
        tag = m[2].lower()
        if m[1]:
            if places.get(tag):
                close(places[tag][-1])
            elif tag in BLOCK:
                now = None
            continue
        if tag in BLOCK:
            now = None
            if stack[framed[-1]].tag == "p":
                close(framed[-1])
        if tag in ENDS_OWN:
            own = last(ENDS_OWN[tag])
            if own > last(BARRIER.get(tag, ())):
                close(own)
        if tag in VOID:
            if tag in ("br", "hr") and now is not None:
                now.parts.append(" ")
            continue
        if tag in RAW:
            if not m[3].endswith("/") or tag not in ("svg", "math"):
                close_at = _ENDS[tag].search(page, end)
                sent = size if close_at is None else page.find(">", close_at.start()) + 1 or size
            continue
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            framed.append(len(stack))
        stack.append(_open(tag, m[3], stack[-1]))
        elements.append(stack[-1])
    for b in out:
        b.text = " ".join("".join(b.parts).split())
        b.container.words += b.text.count(" ") + 1 if b.text and 2 * b.linked <= len(b.text) else 0
    _weigh(elements)
    return [b for b in out if b.text]


def margin(b: Block) -> int:
    """The cost of calling a block boilerplate less that of calling it content (the classifier's
    log-odds in hundredths)."""
    e, words = b.container, b.text.count(" ") + 1
    links = min(1.0, b.linked / len(b.text))
    heading = HEADING * (e.tag[0] == "h" and e.tag[1:].isdigit())
    return BIAS + IN_ARTICLE * e.article + OUTSIDE * e.outside + IN_MAIN * e.main + e.score + heading + round(LINKS * links) + min(MOST_WORDS, PER_WORD * words)


def margins(found: list[Block]) -> list[int]:
    return [margin(b) for b in found]


def edges(found: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges: each block to the next, and to the next of its container."""
    out, last = [], {}
    for i, b in enumerate(found):
        home = id(b.container.parent)
        if i:
            near = found[i - 1].container
            out.append((i - 1, i, ADJACENT if near.parent is b.container.parent or near is b.container.parent else APART))
        if home in last and last[home] < i - 1:
            out.append((last[home], i, CONTAINER))
        last[home] = i
    return out


def minimum_cut(margins: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """For each node, whether it lies on the source's (content's) side of a minimum cut. A node whose
    own margin outweighs all its links keeps its sign in some minimum cut; such nodes are settled
    first and their links become margins of their neighbours. What is left goes through max-flow."""
    n = len(margins)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in links:
        near[a][b] = near[a].get(b, 0) + c
        near[b][a] = near[b].get(a, 0) + c
    margins, side = list(margins), [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if side[i] is None and abs(margins[i]) >= sum(near[i].values()):
            side[i] = margins[i] > 0
            for j, c in near[i].items():
                margins[j] += c if side[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if side[i] is None]
    if left:
        for i, kept in zip(left, _flow(left, margins, near), strict=True):
            side[i] = kept
    return side


def _flow(nodes: list[int], margins: list[int], near: list[dict[int, int]]) -> list[bool]:
    """Whether each node can still be reached from the source after a maximum flow: shortest paths are filled a level at a time,
    each edge that leads nowhere is tried once a round."""
    at = {i: k for k, i in enumerate(nodes)}
    source, sink = len(nodes), len(nodes) + 1
    edges: list[list[int]] = [[] for _ in range(sink + 1)]
    to, room = [], []

    def join(a: int, b: int, there: int, back: int) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            edges[x].append(len(to))
            to.append(y)
            room.append(c)

    for k, i in enumerate(nodes):
        join(*((source, k) if margins[i] > 0 else (k, sink)), abs(margins[i]), 0)
        for j, c in near[i].items():
            if k < at[j]:
                join(k, at[j], c, c)
    while True:
        level = [-1] * (sink + 1)
        level[source], queue = 0, deque([source])
        while queue:
            a = queue.popleft()
            for e in edges[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(len(nodes))]
        tried, path, a = [0] * (sink + 1), [], source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                full = next(k for k, e in enumerate(path) if not room[e])
                a = to[path[full] ^ 1]
                del path[full:]
                continue
            while tried[a] < len(edges[a]):
                e = edges[a][tried[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                tried[a] += 1
            else:
                if a == source:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    keep = minimum_cut(margins(found), edges(found))
    return " ".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages (page_id, url, html)``. Null and empty
    pages, and pages without content, have the empty text. Unclosed and stray tags are taken as browsers
    do; a page of any length is read whole. Repeated rows give a row each; other columns are ignored."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.chunks(batches, "html"):
            text = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(of, f"page_id {kind}, url string, text string, n_chars long")
