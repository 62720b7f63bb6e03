"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is read into blocks: runs of text between block-level tags, with the elements
around them. A linear classifier gives each block two costs, of being called content and
of being called boilerplate; they are the capacities of its edges to the two terminals.
Smoothness edges join neighbours in page order, the stronger the fewer elements lie
between them, and blocks that follow each other inside one element (DOM proximity), so
a short line between paragraphs goes with them. A maximum flow separates the terminals at
the least total cost; blocks on the source side are the main text.

Hints of elements (nav, footer, aside, a class such as "comments") count by the innermost
one that has any. Scripts, styles, forms' fields and hidden elements are never text.

Null and empty html give an empty text. Malformed markup is read as far as it goes: an
unclosed element ends with its parent, an unmatched end tag is skipped. Repeated rows
each get a row; null ids stay null. Nothing is shuffled.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import common

# Possessive, so that no page makes it go back: quotes count behind "=" alone.
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>\s*=\s*"[^"]*"|\s*=\s*'[^']*'|[^>])*+)>""", re.DOTALL
)
_UNFINISHED = re.compile(r"<[!?/a-zA-Z].*", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot"
    " th thead tr ul".split()
)
#: Elements whose content is no text of the page.
DROPPED = frozenset(
    "script style noscript template textarea select button svg canvas iframe object audio video head title option datalist".split()
)
#: Of these, what markup-like signs inside them mean is not looked at.
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open one of these ends where another of its group begins.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}
}

CONTENT_TAGS = frozenset({"article", "main"})
OTHER_TAGS = frozenset({"nav", "footer", "aside", "form", "header", "menu", "dialog", "search"})
CONTENT_WORDS = frozenset("article content post entry story main".split())
OTHER_WORDS = frozenset(
    "ad ads advert advertisement adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices"
    " alert popup modal overlay newsletter subscribe subscription signup signin login share sharing social related recommend"
    " recommended recommendations sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer header masthead"
    " comment comments disqus reply replies pagination pager toolbar search form contentinfo complementary disclaimer"
    " copyright legal".split()
)


@dataclass
class Element:
    tag: str
    hint: int  # 1 content, -1 other, 0 neither
    dropped: bool
    number: int


@dataclass
class Block:
    text: str
    link_chars: int
    tag: str
    path: tuple[int, ...]  # numbers of the elements around it, outermost first
    hint: int


def _hint(tag: str, attributes: str, inside_article: bool) -> tuple[int, bool]:
    """Hint of an element and whether it is hidden."""
    hint = 1 if tag in CONTENT_TAGS else -1 if tag in OTHER_TAGS else 0
    if tag == "header" and inside_article:
        hint = 0  # the article's own head
    hidden = False
    if attributes and tag not in ("html", "body"):
        words: set[str] = set()
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id", "role"):
                words.update(w.lower() for w in _WORD.findall(value))
            elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
        if words & OTHER_WORDS:
            hint = -1
        elif words & CONTENT_WORDS:
            hint = hint or 1
    return hint, hidden


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order, white space collapsed, character references decoded."""
    out: list[Block] = []
    stack: list[Element] = []
    parts: list[str] = []
    links = numbers = dropped = link_depth = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = "".join(parts)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                hint = next((e.hint for e in reversed(stack) if e.hint), 0)
                tag = next((e.tag for e in reversed(stack) if e.tag in BLOCK), "")
                out.append(Block(text, min(links, len(text)), tag, tuple(e.number for e in stack if e.tag in BLOCK), hint))
            parts.clear()
        links = 0

    def close(to: int) -> None:
        nonlocal dropped, link_depth
        for e in stack[to:]:
            dropped -= e.dropped
            link_depth -= e.tag == "a"
        del stack[to:]

    def text_until(end: int) -> None:
        nonlocal links
        piece = page[at:end]
        if piece and not dropped:
            parts.append(piece)
            if link_depth:
                links += len(piece)

    at, limit = 0, page.rfind(">") + 1
    while m := _MARKUP.search(page, at, limit):
        text_until(m.start())
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br" or tag in VOID and tag not in BLOCK:
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK and stack[i].tag != "p":
                    break  # an inline end tag does not end the blocks around it
            continue
        if tag == "hr":
            continue
        if tag in BLOCK and stack:  # a block ends an open paragraph and what is inside it
            ends = CLOSES.get(tag, ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p" or stack[i].tag in ends:
                    close(i)
                elif stack[i].tag in BLOCK:
                    break
        hint, hidden = _hint(tag, m[3], any(e.tag == "article" for e in stack))
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        numbers += 1
        gone = hidden or tag in DROPPED
        stack.append(Element(tag, hint, gone, numbers))
        dropped += gone
        link_depth += tag == "a"
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
    page = page[:limit] + _UNFINISHED.sub("", page[limit:])
    text_until(len(page))
    flush()
    return out


_LEGAL = re.compile(r"^(?:©|\(c\)|copyright\b)|all rights reserved", re.IGNORECASE)


def costs(block: Block) -> tuple[float, float]:
    """Costs of calling a block content and boilerplate."""
    text, n = block.text, len(block.text)
    score = 6.0 * block.hint
    score += min(n / 100, 3.0) - 1.0
    score -= 4.0 * block.link_chars / n
    if text[-1] in ".!?…»\"'”":
        score += 0.7
    if block.tag in ("h1", "h2", "h3"):
        score += 1.0
    elif block.tag in ("li", "td", "th", "dt"):
        score -= 0.5
    if _LEGAL.search(text):
        score -= 3.0
    return max(0.0, -score), max(0.0, score)


def edges(page_blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in order, and followers inside one element."""
    out = []
    last_in: dict[int, int] = {}
    for i, block in enumerate(page_blocks):
        if i:
            a, b = page_blocks[i - 1].path, block.path
            common_depth = 0
            for x, y in zip(a, b, strict=False):
                if x != y:
                    break
                common_depth += 1
            between = len(a) + len(b) - 2 * common_depth
            out.append((i - 1, i, 2.0 / (1 + between)))
        if len(block.path) >= 2:
            parent = block.path[-2]
            before = last_in.get(parent)
            if before is not None:
                out.append((before, i, 1.0))
            last_in[parent] = i
    return out


def min_cut(terminals: list[tuple[float, float]], links: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of a minimum cut: Dinic's algorithm.

    ``terminals``: costs of the source side (edge to the sink) and of the sink side (edge from
    the source). Among minimum cuts the one with the smallest source side is taken.
    """
    n = len(terminals)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def add(a: int, b: int, forth: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(forth)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, (as_source, as_sink) in enumerate(terminals):
        if as_sink > as_source:
            add(source, i, as_sink - as_source, 0.0)
        elif as_source > as_sink:
            add(i, sink, as_source - as_sink, 0.0)
    for a, b, w in links:
        add(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in head[v]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        place = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                least = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if room[e] <= tiny)
                v = to[path[k] ^ 1]
                del path[k:]
                continue
            while place[v] < len(head[v]):
                e = head[v][place[v]]
                if room[e] > tiny and level[to[e]] == level[v] + 1:
                    break
                place[v] += 1
            if place[v] < len(head[v]):
                path.append(head[v][place[v]])
                v = to[path[-1]]
            elif path:
                e = path.pop()
                v = to[e ^ 1]
                place[v] += 1
            else:
                break


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    kept = min_cut([costs(b) for b in found], edges(found))
    return "\n".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page row."""
    source = pages.select("page_id", F.col("url"), "html")
    return source.mapInArrow(_extractor, "page_id long, url string, text string, n_chars long")


def op1_html_cut(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
