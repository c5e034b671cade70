"""HTML extraction by classified text blocks (operator 4).

A page is read as a flat list of text blocks.  Each block has its number of
words and share of linked words, those of the blocks before and after it, and
where it stands: inside furniture (menus, footers, adverts, comments, forms by
element or class), inside an article or main element, in a heading.  A decision
tree, grown here from a small labelled table, says which blocks are main text.
A class or id is only a hint: an element that it marks as furniture is read as
any other if it holds most of the page's words and next to nothing, and no text
of an article, is kept outside it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "article", "heading")
#: Labelled blocks: FEATURES, then 1 for main text.
LABELLED = np.array(
    [
        # words links before   after  furn art head main
        [9, 0.0, 0, 0.0, 80, 0.0, 0, 1, 1, 1],
        [80, 0.0, 9, 0.0, 95, 0.0, 0, 1, 0, 1],
        [6, 0.0, 90, 0.0, 70, 0.1, 0, 1, 0, 1],
        [120, 0.1, 6, 0.0, 0, 0.0, 0, 1, 0, 1],
        [3, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1],
        [14, 0.3, 60, 0.0, 40, 0.1, 0, 1, 0, 1],
        [1, 0.0, 5, 0.0, 30, 0.0, 0, 1, 1, 1],
        [25, 0.6, 70, 0.1, 60, 0.0, 0, 1, 0, 1],
        [4, 1.0, 60, 0.0, 3, 1.0, 0, 1, 0, 0],
        [2, 1.0, 3, 1.0, 0, 0.0, 0, 1, 0, 0],
        [5, 1.0, 50, 0.0, 60, 0.0, 1, 1, 0, 0],
        [30, 0.0, 120, 0.0, 25, 0.0, 1, 1, 0, 0],
        [55, 0.1, 40, 0.0, 70, 0.0, 1, 1, 0, 0],
        [4, 0.0, 50, 0.0, 45, 0.0, 1, 1, 1, 0],
        [1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0],
        [2, 1.0, 1, 1.0, 9, 0.0, 1, 0, 0, 0],
        [12, 0.0, 2, 1.0, 8, 0.0, 1, 0, 0, 0],
        [9, 0.1, 80, 0.0, 0, 0.0, 1, 0, 0, 0],
        [45, 0.0, 60, 0.0, 50, 0.0, 1, 0, 0, 0],
        [70, 0.2, 9, 0.0, 20, 0.0, 1, 0, 0, 0],
        [5, 0.0, 4, 0.0, 60, 0.0, 1, 0, 1, 0],
        [3, 0.0, 2, 1.0, 4, 1.0, 1, 0, 1, 0],
        [60, 0.0, 8, 0.0, 75, 0.0, 0, 0, 0, 1],
        [75, 0.1, 60, 0.0, 40, 0.0, 0, 0, 0, 1],
        [28, 0.0, 70, 0.0, 3, 1.0, 0, 0, 0, 1],
        [22, 0.1, 8, 0.0, 50, 0.0, 0, 0, 0, 1],
        [40, 0.2, 1, 1.0, 6, 0.0, 0, 0, 0, 1],
        [8, 0.0, 2, 1.0, 60, 0.0, 0, 0, 1, 1],
        [5, 0.0, 70, 0.0, 55, 0.0, 0, 0, 1, 1],
        [7, 0.0, 65, 0.0, 45, 0.0, 0, 0, 0, 1],
        [12, 0.1, 40, 0.1, 30, 0.0, 0, 0, 0, 1],
        [16, 0.0, 22, 0.0, 1, 0.0, 0, 0, 0, 1],
        [15, 0.0, 20, 0.0, 4, 1.0, 0, 0, 0, 1],
        [18, 0.0, 19, 0.0, 0, 0.0, 0, 0, 0, 1],
        [6, 0.0, 2, 1.0, 3, 1.0, 0, 0, 1, 0],
        [4, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0],
        [8, 0.0, 3, 0.0, 4, 0.0, 0, 0, 0, 0],
        [9, 0.1, 60, 0.0, 0, 0.0, 0, 0, 0, 0],
        [3, 1.0, 4, 1.0, 60, 0.0, 0, 0, 0, 0],
        [10, 0.9, 50, 0.0, 40, 0.0, 0, 0, 0, 0],
        [35, 0.9, 8, 0.0, 30, 0.8, 0, 0, 0, 0],
        [50, 0.8, 2, 1.0, 3, 1.0, 0, 0, 0, 0],
        [20, 0.7, 30, 0.9, 9, 0.0, 0, 0, 0, 0],
        [2, 0.0, 0, 0.0, 5, 1.0, 0, 0, 1, 0],
        [5, 0.0, 9, 0.0, 4, 0.0, 0, 0, 0, 0],
    ]
)

_SKIP = {"script", "style", "noscript", "template", "head", "title", "select", "textarea", "svg", "iframe", "object", "canvas", "option", "button", "audio", "video"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"math", "mi", "mn", "mo", "mrow", "msup", "msub", "mfrac", "msqrt", "mtext", "semantics", "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog"}
_NAMES = set("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus footer legal login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related reply replies respond share sharing sidebar social sponsor sponsored subscribe subscription tags toolbar widget".split())
#: Beginnings and ends of class names that speak of a state or a topic of the element, not of what it is: has-sidebar, tag-legal, comments-open.
_STATES = set("has have with without no not is show shows hide hides tag tags category cat topic format supports".split())
_STATE_ENDS = set("open opened closed enabled disabled allowed on off".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_WHITE = re.compile(r"\s+")


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    furniture: bool
    article: bool
    heading: bool
    named: int  # innermost element that its class or id calls furniture; -1 if none


def _says_furniture(token: str, whole: bool) -> bool:
    """Whether one class or id is a name of furniture; if whole, only a name with nothing beside it."""
    parts = [p.lower() for p in _PART.findall(token)]
    if len(parts) > 1 and (whole or parts[0] in _STATES or parts[-1] in _STATE_ENDS):
        return False
    return any(p in _NAMES for p in parts)


def _is_named(tag: str, attributes: str) -> bool:
    if tag in ("html", "body", "main"):
        return False
    values = (m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id"))
    return any(_says_furniture(t, tag == "article") for v in values for t in v.split())


def _is_furniture(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _FURNITURE or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
    return False


def blocks_of(page: str) -> tuple[list[Block], list[int]]:
    """Text blocks in page order, and for each element named furniture the next one around it.

    Blocks without a visible character are left out; their furniture is that of elements and roles.
    """
    out: list[Block] = []
    around: list[int] = []
    stack: list[tuple[str, bool, bool, int]] = []  # element, inside furniture, inside an article, named
    pieces: list[tuple[str, bool]] = []
    links = 0

    def close() -> None:
        text = _WHITE.sub(" ", html.unescape("".join(t for t, _ in pieces))).strip()
        if text:
            linked = sum(len(html.unescape(t).split()) for t, a in pieces if a)
            furniture, article, named = stack[-1][1:] if stack else (False, False, -1)
            out.append(Block(text, len(text.split()), linked, furniture, article, any(e[0] in _HEADINGS for e in stack), named))
        pieces.clear()

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            pieces.append((page[at:], links > 0))
            break
        if m.start() > at:
            pieces.append((page[at : m.start()], links > 0))
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                pieces.append((m[0][9:].removesuffix("]]>"), links > 0))
            continue
        ends, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in _SKIP and not ends and not (name == "svg" and attributes.endswith("/")):
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if name == "head" and not end:
                end = re.compile(r"(?=<body\b)", re.I).search(page, at)
            if end:
                at = end.end()
            elif name not in ("head", "option", "button", "title", "svg"):
                at = size  # what is never closed hides the rest
            pieces.append((" ", links > 0))
            continue
        if name == "a":
            links = 0 if ends else 1
        if name in ("br", "hr"):
            pieces.append((" ", links > 0))
        if name in _VOID:
            continue
        block = name not in _INLINE
        if block:
            close()
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if not block and any(e[0] not in _INLINE for e in stack[i + 1 :]):
                        break  # an inline end doesn't close blocks
                    if block:
                        links = 0
                    del stack[i:]
                    break
        else:
            if name in ("p", "li", "tr", "td", "th", "dt", "dd") and stack:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                    if stack[i][0] not in _INLINE | {"p"}:
                        break
            furniture, article, named = stack[-1][1:] if stack else (False, False, -1)
            own, called = _is_furniture(name, attributes, article), _is_named(name, attributes)
            if (own or called) and not block:
                close()
            if called:
                around.append(named)
                named = len(around) - 1
            stack.append((name, furniture or own, article or name in ("article", "main"), named))
    close()
    return out, around


def features_of(blocks: list[Block]) -> np.ndarray:
    words = np.array([b.words for b in blocks], float)
    links = np.array([b.linked / max(1, b.words) for b in blocks], float)
    pad = lambda x, by: np.concatenate([[0.0], x[:-1]]) if by < 0 else np.concatenate([x[1:], [0.0]])
    flags = [np.array([getattr(b, f) for b in blocks], float) for f in ("furniture", "article", "heading")]
    return np.stack([words, links, pad(words, -1), pad(links, -1), pad(words, 1), pad(links, 1), *flags], 1)


def grow(table: np.ndarray, most_depth: int = 8) -> list | float:
    """A decision tree by Gini impurity: [feature, threshold, below or at, above], or the share of main text in a leaf."""
    x, y = table[:, :-1], table[:, -1]
    share = float(y.mean())
    best = (share * (1 - share) * len(y), -1, 0.0)
    for f in range(x.shape[1] if most_depth else 0):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= cut
            cost = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[left], y[~left]))
            if cost < best[0] - 1e-9:
                best = (cost, f, float(cut))
    if best[1] < 0:
        return share
    left = x[:, best[1]] <= best[2]
    return [best[1], best[2], grow(table[left], most_depth - 1), grow(table[~left], most_depth - 1)]


def decide(tree: list | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, list):
        return np.full(len(x), tree >= 0.5)
    left = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x), bool)
    out[left], out[~left] = decide(tree[2], x[left]), decide(tree[3], x[~left])
    return out


def _with_names(blocks: list[Block], around: list[int], free: set[int]) -> list[Block]:
    """Blocks with names taken as furniture too, but for the elements in free."""
    marked: list[bool] = []
    for i, outer in enumerate(around):
        marked.append(i not in free or outer >= 0 and marked[outer])
    return [b._replace(furniture=b.furniture or b.named >= 0 and marked[b.named]) for b in blocks]


def main_text(page: str | None, tree: list | float) -> str:
    blocks, around = blocks_of(page or "")
    if not blocks:
        return ""
    main = decide(tree, features_of(_with_names(blocks, around, set())))
    if around:
        held = [0] * len(around)
        for b in blocks:
            if b.named >= 0 and not b.furniture:
                held[b.named] += b.words
        for i in range(len(around) - 1, -1, -1):
            if around[i] >= 0:
                held[around[i]] += held[i]
        left = [b for b, m in zip(blocks, main, strict=True) if m]
        kept, total = sum(b.words for b in left), sum(b.words for b in blocks)
        short = not any(b.article and not b.heading for b in left)  # a short article before long comments is the text
        free = {i for i, n in enumerate(held) if short and 2 * n > total and 10 * kept < n}
        if free:
            main = decide(tree, features_of(_with_names(blocks, around, free)))
    return " ".join(b.text for b, m in zip(blocks, main, strict=True) if m)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", labelled: np.ndarray = LABELLED) -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars; no shuffle.

    Null and empty html give an empty text; ids and urls pass through, null or
    repeated; whole pages are read, however long; markup that ends early is
    read as far as it goes.  Other columns are ignored; an empty table gives no rows.
    """
    tree = grow(labelled)

    def of(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in column:
            yield pa.array([main_text(x.as_py(), tree) for x in texts], pa.string())

    text = F.arrow_udf(of, "string")(F.col(page))
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
