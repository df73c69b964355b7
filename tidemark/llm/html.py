"""Main text of web pages: blocks labelled as content or boilerplate by a minimum cut."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.mincut import labels

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>|[^>]*+(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements by the role they have in the HTML standard.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "button", "audio", "video", "canvas", "xmp", "noembed", "noframes"}
#: Those of them that hold elements: one that is not closed ends with its parent, the others with the page.
OPEN = {"noscript", "svg", "object", "select", "button", "audio", "video", "canvas"}
#: How publishing systems begin classes that name a page's topics.
TOPIC = ("category-", "cat-", "tag-", "topic-")
#: Other encodings of a formula that <math> shows already; browsers do not show them.
ENCODED = {"annotation", "annotation-xml"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav",
    "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
#: A start tag of the first closes an open element of the second, unless one of the third lies between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "tbody": ({"tbody", "thead", "tr"}, {"table"}), "body": ({"head"}, set()),
}
SCOPE = {"table", "td", "th", "article", "section", "div", "body", "html", "li", "blockquote"}
ASIDE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "search", "fieldset", "address"}
#: Words in class, id or role that name something other than the article.
ASIDE_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "alert", "aside", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "dialog", "disclaimer", "disqus", "footer", "form", "gdpr", "header", "legal",
    "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "overlay", "pager", "pagination", "popup",
    "privacy", "promo", "promotion", "recommended", "related", "reply", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "skip",
    "social", "sponsor", "sponsored", "subscribe", "subscription", "teaser", "toolbar", "topbar", "trending", "widget",
}
MAIN_NAMES = {"article", "content", "entry", "main", "post", "story", "body", "text"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Block:
    """Text between two block boundaries, with what its surroundings say about it."""

    __slots__ = ("text", "linked", "path", "aside", "main", "heading")

    def __init__(self, text: str, linked: int, path: tuple[int, ...], aside: int, main: int, heading: bool):
        self.text, self.linked, self.path, self.aside, self.main, self.heading = text, linked, path, aside, main, heading


def _said(tag: str, rest: str, in_main: bool) -> tuple[int, int, bool]:
    """What an element says of its inside: aside, main, hidden."""
    aside = int(tag in ASIDE_TAGS and not (tag == "address" and in_main) or tag == "header" and not in_main)
    main = int(tag in ("article", "main"))
    hidden = False
    if rest and tag not in ("html", "body"):
        for m in ATTRIBUTE.finditer(rest):
            name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if name == "style":
                hidden |= "display:none" in value.replace(" ", "").lower()
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                hidden |= name == "hidden"
            else:
                words = [w for w in value.split() if not w.lower().startswith(TOPIC)]
                parts = {p.lower() for w in words for p in NAME_PART.findall(w)}
                named = parts & ASIDE_NAMES
                if tag in ("article", "main") and not in_main and parts & MAIN_NAMES:
                    # the element itself says more than further names on it
                    named = set()
                if parts & MAIN_NAMES and (tag in ("article", "main") or in_main or named <= {"header", "banner"}):
                    main += 1
                    named -= {"header", "banner"}
                aside += bool(named)
    return min(aside, 1), min(main, 1), hidden


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order, from its tags as they come; what is not closed ends with its parent."""
    out: list[Block] = []
    # (tag, number, aside, main, links, hidden)
    stack: list[tuple[str, int, int, int, int, bool]] = [("", 0, 0, 0, 0, False)]
    held: list[tuple[str, bool]] = []
    number, pos = 0, 0

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(t for t, _ in held)).split())
            if text:
                linked = sum(len(" ".join(t.split())) for t, in_link in held if in_link)
                inner = stack[-1]
                path = tuple(e[1] for e in stack if e[0] in BLOCK)
                out.append(Block(text, linked, path, inner[2], inner[3], any(e[0] in HEADING for e in stack)))
            held.clear()

    def cut(depth: int) -> None:
        if any(e[0] in BLOCK for e in stack[depth:]):
            flush()
        del stack[depth:]

    while True:
        m = TOKEN.search(html, pos)
        text = html[pos : m.start() if m else len(html)]
        if text and not stack[-1][5]:
            held.append((text, stack[-1][4] > 0))
        if not m:
            break
        pos = m.end()
        tag = m.group("tag")
        if not tag:
            continue
        tag = tag.lower()
        if m.group("end"):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    cut(depth)
                    break
                if stack[depth][0] in ("table", "article", "body") and tag not in BLOCK:
                    break
            else:
                if tag in BLOCK:
                    flush()
            continue
        if tag in RAW:
            if tag == "svg" and m.group("rest").endswith("/>"):
                continue
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, pos)
            again = re.compile(rf"<{tag}\b", re.I).search(html, pos, end.start() if end else len(html)) if tag in OPEN else None
            if tag in OPEN and (again or not end):
                # not closed, or others of its kind inside
                number += 1
                stack.append((tag, number, *stack[-1][2:5], True))
            else:
                pos = end.end() if end else len(html)
            continue
        if tag in BLOCK:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p" or stack[depth][0] in HEADING and tag in HEADING:
                    cut(depth)
                    break
                if stack[depth][0] in SCOPE:
                    break
            flush()
        if tag in IMPLIED:
            closed, between = IMPLIED[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in closed:
                    cut(depth)
                    break
                if stack[depth][0] in between:
                    break
        rest = m.group("rest")
        if tag in VOID or rest.endswith("/>") and tag not in BLOCK:
            if tag in ("br", "wbr", "hr") or tag == "img":
                held.append((" ", False)) if tag != "wbr" else None
            continue
        if tag in ("td", "th", "mtd"):
            held.append((" ", False))
        _, _, aside, main, links, hidden = stack[-1]
        if tag in BLOCK or len(rest) > 1:
            own_aside, own_main, own_hidden = _said(tag, rest, main > 0)
        else:
            own_aside, own_main, own_hidden = 0, 0, False
        number += 1
        stack.append((tag, number, aside + own_aside, main + own_main, links + (tag == "a"), hidden or own_hidden or tag in ENCODED))
    flush()
    return out


def gain(block: Block) -> float:
    """How much more a block looks like the article than like anything else. Links tell navigation only outside what is marked as the article."""
    size = len(block.text)
    share = min(1.0, block.linked / size)
    value = -0.5 + min(size / 120, 2.5) - 4.0 * share * (share > 0.4 and not block.main)
    value += 0.6 * (block.text[-1] in ".!?:;\"'»”…") + 3.0 * (block.main > 0) + 0.5 * block.heading
    if block.aside:
        value -= 8.0
    if "©" in block.text[:40] or "all rights reserved" in block.text[-80:].lower():
        value -= 2.0
    return value


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between blocks that follow one another, by how near they are in the tree, and between neighbours under one parent."""
    edges, last = [], {}
    for k, block in enumerate(found):
        if k:
            a, b = found[k - 1].path, block.path
            shared = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            edges.append((k - 1, k, 1.2 / max(1, len(a) + len(b) - 2 * shared)))
        parent = block.path[-2] if len(block.path) > 1 else 0
        if parent in last and last[parent] != k - 1:
            edges.append((last[parent], k, 0.5))
        last[parent] = k
    return edges


def main_blocks(html: str | None) -> list[str]:
    """Texts of the blocks that the minimum cut leaves on the article's side."""
    found = blocks(html or "")
    chosen = labels([gain(b) for b in found], smoothness(found))
    return [b.text for b, kept in zip(found, chosen) if kept]


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url`` and ``text`` for every row of ``pages``.

    Reads ``page_id``, ``url`` and ``html`` only. The text is the blocks of the
    article in page order, joined by empty lines; white space inside a block
    is one blank. A null or empty page, or one without an article, has an
    empty text. Rows are handled one by one, so repeated rows and null ids stay
    as they are.
    """

    def task(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrived:
            texts = ["\n\n".join(main_blocks(h.as_py())) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(task, "page_id long, url string, text string")
