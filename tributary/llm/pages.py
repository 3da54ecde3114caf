"""Main text of HTML pages by scoring the tree of their elements."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<![^>]*>?|<\?[^>]*>?|</\s*([a-zA-Z][^\s/>]*)[^>]*>?|"
    # A quote that nothing closes before a space or the tag's end is no quote: such a tag ends at its first `>`.
    r"<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>]|$)|'[^']*'(?=[\s/>]|$))*)(?:>|$)|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

# The kinds of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea iframe svg math title xmp".split())
INLINE = set(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr td th".split()
)
# What a start tag ends, and the elements beyond which it doesn't look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
KEEPS_P = INLINE | {"script", "style", "template", "input", "button", "select", "object", "video", "audio", "option"}
# Elements that are no part of an article, roles and names of the same kind.
OUTSIDE = set("head nav header footer aside button select dialog menu input object canvas audio video datalist".split()) | RAW
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promotion sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs masthead footer copyright comment comments disqus replies respond discussion cookie cookies "
    "consent gdpr popup modal overlay share sharing related recommended recommendations subscribe subscription newsletter "
    "signup login widget pagination pager toolbar".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | {"p", "li", "pre", "tr"}
# These may also name a part of an article, beside one of `CONTENT`.
WEAK = set("header banner promo side foot notice notices notification alert social search reply toc skip legal disclaimer".split())
CONTENT = set("article main content post entry story".split())
WRAPS = set("wrap wrapper container layout grid page".split())
# Elements and parts of compound names that a page may also put around all it has: what they hold decides.
FRAMES = set("form fieldset".split())
LAYOUT = set("sidebar menu nav navbar navigation toolbar widget header side ad ads popup modal overlay share social search notice".split())
SHARE = 2 / 3
_STATE = re.compile(r"(?:has|with|no|without|is|show|hide)[-_]")


@dataclass
class Node:
    tag: str
    parent: Node | None = None
    outside: bool = False
    doubtful: bool = False
    children: list[Node | str] = field(default_factory=list)
    points: float = 0.0
    score: float = 0.0
    has_block: bool = False


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _outside(tag: str, attributes: dict[str, str]) -> tuple[bool, bool]:
    """Whether an element is no part of an article, and whether what it holds may say otherwise."""
    if tag in OUTSIDE:
        return True, False
    if tag in ("html", "body", "article", "main"):
        return False, False
    named, doubtful = _named_outside(attributes)
    return named or tag in FRAMES, not named and tag in FRAMES or doubtful


def _named_outside(attributes: dict[str, str]) -> tuple[bool, bool]:
    if attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True, False
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return True, False
    found = False
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = {x.lower() for x in [name, *_NAME.findall(name)]}
        content = parts & CONTENT
        if _STATE.match(name) or content and parts & WRAPS:
            continue
        hits = parts & NAMES or (parts & WEAK if not content else set())
        if hits and (hits - LAYOUT or name.lower() in hits):
            return True, False
        found = found or bool(hits)
    return found, found


class _Open:
    """Open elements: a stack, and the depths at which each tag and the last blocks are open."""

    def __init__(self, root: Node):
        self.stack, self.depths, self.blocks = [root], {root.tag: [0]}, [0]

    def push(self, node: Node) -> None:
        depth = len(self.stack)
        self.stack.append(node)
        self.depths.setdefault(node.tag, []).append(depth)
        if node.tag not in INLINE:
            self.blocks.append(depth)

    def cut(self, depth: int) -> None:
        """Ends everything from a depth on; the root stays open."""
        while len(self.stack) > max(depth, 1):
            node = self.stack.pop()
            self.depths[node.tag].pop()
            if node.tag not in INLINE:
                self.blocks.pop()

    def last(self, tag: str) -> int:
        found = self.depths.get(tag)
        return found[-1] if found else -1

    def first_after(self, tag: str, depth: int) -> int | None:
        found = self.depths.get(tag, [])
        at = bisect_right(found, depth)
        return found[at] if at < len(found) else None


def parse(page: str) -> Node:
    """The tree of a page. Elements that are left open end where their parent does."""
    root = Node("html")
    opened = _Open(root)
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        start = m.start() if m else end
        if start > at:
            opened.stack[-1].children.append(html.unescape(page[at:start]))
        if not m:
            break
        at = max(m.end(), start + 1)
        if m[1]:
            name = m[1].lower()
            depth = opened.last(name)
            # An inline end tag ends nothing beyond its block.
            if depth > 0 and (name not in INLINE or depth > opened.blocks[-1]):
                opened.cut(depth)
        elif m[2] or m[4]:
            name, inside = (m[2] or m[4]).lower(), m[3] if m[2] else m[5]
            if name == "html":
                continue
            if name not in KEEPS_P and opened.stack[opened.blocks[-1]].tag == "p":
                opened.cut(opened.blocks[-1])
            if name in CLOSES:
                ends, stop = CLOSES[name]
                within = max((opened.last(x) for x in stop), default=-1)
                first = [d for d in (opened.first_after(x, within) for x in ends) if d is not None]
                if first:
                    opened.cut(min(first))
            attributes = _attributes(inside) if inside.strip() else {}
            current = opened.stack[-1]
            made = Node(name, current, *_outside(name, attributes))
            if name == "header" and current.tag in ("article", "main"):
                made.outside = False
            current.children.append(made)
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}\s*>?", re.I).search(page, at)
                at = close.end() if close else end
                if close and page[at - 1] != ">":
                    at = page.find(">", at) + 1 or end
            elif name not in VOID and not inside.endswith("/") or name in ("p", "div", "span", "a"):
                opened.push(made)
    return root


def _ordered(root: Node) -> list[Node]:
    """All elements that are not inside one that is certainly no part of an article, parents first."""
    order = [root]
    for node in order:
        order += [x for x in node.children if isinstance(x, Node) and (not x.outside or x.doubtful)]
    return order


def _settle(root: Node) -> None:
    """Takes doubtful elements in that hold most of the page's prose, unless an article or main element is beside them.

    Prose is text outside of links, in elements with 40 characters of it or more of their own.
    """
    order = _ordered(root)
    if not any(x.doubtful for x in order):
        return
    prose, marked = {}, {}
    for node in reversed(order):
        own = len(" ".join("".join(x for x in node.children if isinstance(x, str)).split())) if node.tag != "a" else 0
        below = [x for x in node.children if isinstance(x, Node) and id(x) in prose]
        prose[id(node)] = (own if own >= 40 else 0) + sum(prose[id(x)] for x in below)
        marked[id(node)] = (node.tag in ("article", "main") and prose[id(node)] > 0) + sum(marked[id(x)] for x in below)
    for node in order:
        if node.doubtful and prose[id(node)] > SHARE * prose[id(root)] and marked[id(node)] == marked[id(root)]:
            node.outside = False


def _mark_blocks(root: Node) -> None:
    """Notes in every element whether it holds a block, from the leaves up."""
    order = [root]
    for node in order:
        order += [x for x in node.children if isinstance(x, Node) and not x.outside]
    for node in reversed(order):
        node.has_block = any(
            isinstance(x, Node) and not x.outside and (x.tag not in INLINE or x.has_block) for x in node.children
        )


def _inline(node: Node) -> tuple[str, int]:
    """Text of an inline element, and how much of it is in links."""
    parts, linked, link, start = [], 0, None, 0
    todo: list[tuple[Node | str, bool]] = [(node, False)]
    while todo:
        x, ended = todo.pop()
        if isinstance(x, str):
            parts.append(x)
            continue
        if x.tag in ("br", "td", "th"):
            parts.append(" ")
        if ended:
            if x is link:
                linked += len("".join(parts[start:]).strip())
                link = None
            continue
        if x.tag == "a" and link is None:
            link, start = x, len(parts)
        todo.append((x, True))
        todo += [(y, False) for y in reversed(x.children) if isinstance(y, str) or not y.outside]
    return "".join(parts), linked


def blocks(node: Node) -> Iterator[tuple[Node, str, int]]:
    """(element, text, characters in links) of every run of inline content, in page order.

    Elements are kept on a stack, so that a page may be nested to any depth.
    """
    todo = [(node, iter([*node.children, None]))]
    run, linked = [], 0
    while todo:
        at, rest = todo[-1]
        x = next(rest)
        if isinstance(x, str):
            run.append(x)
        elif x is not None and x.outside:
            run.append(" ")
        elif x is not None and x.tag in INLINE and not x.has_block:
            text, n = _inline(x)
            run.append(text)
            linked += n
        else:
            text = " ".join("".join(run).split())
            if text:
                yield at, text, linked
            run, linked = [], 0
            if x is None:
                todo.pop()
            else:
                todo.append((x, iter([*x.children, None])))


def extract(page: str | None) -> str:
    """The article's text: blocks joined by an empty line.

    A block passes 1 point, 1 for each comma and 1 for each 100 characters up to 3,
    less its share of links, in full to its parent element and by half, a quarter and so
    on to those above. The element with the most points is the container. It widens to an
    article or main element around it. Its siblings are kept if they have a fifth
    of its points, or if they are paragraphs with few links. Where there is no article or
    main element, nothing says where the article ends: what lies beside the container
    or the elements around it is kept, but for what is outside or dense in links.
    """
    if not page:
        return ""
    root = parse(page)
    _settle(root)
    _mark_blocks(root)
    found = list(blocks(root))
    if not found:
        return ""
    order = _ordered(root)
    for node, text, linked in found:
        above = node.parent if node.tag in PARAGRAPHS and node.parent is not None else node
        above.points += (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - min(1.0, linked / len(text)))
    for node in reversed(order):
        node.score += node.points
        if node.parent is not None:
            node.parent.score += node.score / 2
    best = max(order, key=lambda n: n.score)
    wide = best
    while wide.parent is not None:
        wide = wide.parent
        if wide.tag in ("article", "main"):
            best = wide
    kept, around = {id(best)}, set()
    marked = best.tag in ("article", "main")
    inner = best
    while inner.parent is not None and (inner is best or not marked):
        for x in inner.parent.children:
            if isinstance(x, Node) and not x.outside and x is not inner:
                inside = [(t, n) for _, t, n in blocks(x)]
                size = sum(len(t) for t, _ in inside)
                few = size and sum(n for _, n in inside) < 0.25 * size
                if not marked:
                    wanted = few or x.tag in HEADINGS
                else:
                    wanted = few and (x.score >= max(10.0, 0.2 * best.score) or x.tag == best.tag == "article" or (x.tag == "p" and size > 80))
                if wanted:
                    kept.add(id(x))
        inner = inner.parent
        if not marked:
            around.add(id(inner))

    taken: set[int] = set()
    for node in order:
        if id(node) in kept or node.parent is not None and id(node.parent) in taken:
            taken.add(id(node))

    beside = lambda node, text, linked: id(node) in around and linked < 0.25 * len(text)
    return "\n\n".join(text for node, text, linked in found if id(node) in taken or beside(node, text, linked))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of `pages`.

    Null and empty pages, and pages without text, give an empty text. Markup that is cut
    off or left open is closed at its parent's end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    ids = pages.schema["page_id"].dataType.simpleString()
    return map_batches(pages.select("page_id", "url", "html"), run, f"page_id {ids}, url string, text string, n_chars long")
