"""Main text of web pages by composite text density.

The page is parsed into a tree with the implied end tags of HTML. Every block has characters, tags, link characters and link
tags; its density is characters per tag, adjusted for links with the share of link text in the body. A block that holds
blocks is scored by the sum of its child blocks' densities, and the largest sum under the body is where the text is densest. The
article is the outermost <article> or <main> around that block, or else the body, and all its text is kept, on every level:
headings, paragraphs, lists, tables, code. In a body without such an element, blocks beside the densest one go if more than half
of their text is links. Menus, page headers, footers, sidebars, notices, adverts, forms and comments, known by element or by a
whole class, id or role, never count; but a class does not remove what holds every <article> and <main> of the page or, where there
are none, more than half of its text.

Rows: null and empty html give an empty text. Repeated rows give one row each. Of equally dense blocks the outermost and first
is taken. Pages of any length are read whole, in time that follows their length. An empty table gives no rows. Columns other than
page_id, url and html are not read.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

from pyspark.sql import DataFrame

from .text import map_rows

SCHEMA = "page_id long, url string, text string, n_chars long"
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object audio video canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NOISE_TAGS = frozenset("nav footer aside form button select option input dialog menu".split())
_WORD = r"ads?|advert(?:s|isements?|ising)?|adsbygoogle|banner|sponsor(?:ed|s)?|promo(?:tions?|s)?|nav(?:bar|igation)?|menus?|breadcrumbs?|sidebar|side-bar|aside|footer|masthead|comments?|comment-?list|disqus|respond|replies|cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscribe|signup|share|sharing|social|related|recommended|toolbar|pagination|pager|search|login|site-header|page-header|complementary|contentinfo|banner|skip-link|paywall|widget"
#: What may stand beside such a word in one name: main-nav and ad_box_2 are noise, has-sidebar and social-history are not.
_BESIDE = r"site|page|main|top|bottom|left|right|primary|secondary|box|block|bar|area|list|section|container|links?|buttons?|wrapper|\d+"
_NOISE = re.compile(rf"(?<!\S)(?:(?:{_BESIDE})[_-])*(?:{_WORD})\d*(?:[_-](?:{_WORD}|{_BESIDE})\d*)*(?!\S)", re.I)
#: A start tag of the key ends an open element of the values, up to the next enclosing container.
_P_ENDS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul dd dt li".split())
ENDS = {**{t: frozenset(["p"]) for t in _P_ENDS}, "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "body": frozenset(["head"])}
SCOPE = frozenset("html body article section div main table td th ul ol dl blockquote nav aside footer header form figure button".split())


class Node:
    __slots__ = ("tag", "parent", "parts", "noise", "chars", "tags", "link_chars", "link_tags", "density", "total", "blocks")

    def __init__(self, tag: str, parent: Node | None, noise: int = 0):
        self.tag, self.parent, self.noise = tag, parent, noise
        self.parts: list = []  # strings and nodes in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.blocks: list[Node] = []


def _is_noise(tag: str, attrs: str, stack: list[Node]) -> int:
    """0: no; 1: by element or because it is hidden; 2: by a name only."""
    if tag in NOISE_TAGS:
        return 1
    if tag == "header":
        return int(not any(n.tag in ("article", "main") for n in stack))
    if not attrs or tag in ("html", "body"):
        return 0
    if _HIDDEN.search(attrs):
        return 1
    return 2 * any(_NOISE.search(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs))


def parse(html: str) -> Node:
    root = Node("html", None)
    stack, at, n = [root], 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            stack[-1].parts.append(html[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if any(x.tag == tag for x in stack[1:]):
                while stack.pop().tag != tag:
                    pass
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = close.end() if close else n
            continue
        if tag == "html":
            continue
        if ends := ENDS.get(tag):
            for k in range(len(stack) - 1, 0, -1):
                name = stack[k].tag
                if name in ends:
                    del stack[k:]
                    break
                if name in SCOPE:
                    break
            if tag == "tr" and stack[-1].tag in ("td", "th", "tr"):
                stack.pop()
        node = Node(tag, stack[-1], _is_noise(tag, m[3], stack))
        stack[-1].parts.append(node)
        if tag not in VOID:
            stack.append(node)
    return root


def _visible(text: str) -> int:
    return sum(map(len, text.split()))


def _clear(root: Node) -> None:
    """Noise by name only does not hold for what contains the page's articles or, without any, most of its text."""
    order = [root]
    for node in order:
        order += [p for p in node.parts if isinstance(p, Node) and p.noise != 1]
    if not any(n.noise for n in order):
        return
    held = {id(n): [sum(_visible(p) for p in n.parts if isinstance(p, str)), int(n.tag in ("article", "main") and not n.noise)] for n in order}
    for n in reversed(order[1:]):
        up, own = held[id(n.parent)], held[id(n)]
        up[0] += own[0]
        up[1] += own[1]
    chars, articles = held[id(root)]
    for n in order:
        if n.noise and (held[id(n)][1] == articles if articles else 2 * held[id(n)][0] > chars):
            n.noise = 0


def _measure(root: Node) -> list[Node]:
    """Counts of each node without noise; the nodes, parents first."""
    order = [root]
    for node in order:
        order += [p for p in node.parts if isinstance(p, Node) and not p.noise]
    for node in reversed(order):
        node.chars += sum(_visible(p) for p in node.parts if isinstance(p, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if up := node.parent:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
            if node.tag in INLINE:
                up.blocks += node.blocks
            else:
                up.blocks.append(node)
    for node in order:  # they were met from the last to the first
        node.blocks.reverse()
    return order


def _density(node: Node, body_link_share: float) -> float:
    if not node.chars:
        return 0.0
    tags, links, link_tags = max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
    plain = max(node.chars - node.link_chars, 1)
    base = log(node.chars / plain * links + body_link_share * node.chars + e)
    ratio = node.chars / links * (tags / link_tags)
    return node.chars / tags * log(max(ratio, 1.0) + 1e-9) / max(log(base), 1e-6)


def _render(node: Node, blocks: list[list[str]]) -> None:
    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        elif x.tag == "br":
            blocks[-1].append(" ")
        elif not x.noise:
            edge = [] if x.tag in INLINE else [None]
            todo += [*edge, *reversed(x.parts), *edge]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    _clear(root)
    order = _measure(root)
    body = next((x for x in order if x.tag == "body"), root)
    share = body.link_chars / max(body.chars, 1)
    inside = [body]
    for node in inside:
        inside += node.blocks
    for node in inside:
        node.density = _density(node, share)
    for node in inside:
        node.total = sum(b.density for b in node.blocks)
    best = max(inside, key=lambda x: x.total)  # the first of equals: the outermost
    if not best.total:
        best = body
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    article = next((x for x in reversed(path) if x.tag in ("article", "main")), None)
    if article is None:
        keep = {id(x) for x in path}
        todo = list(body.blocks)
        for x in todo:
            if x is best:
                continue
            if id(x) not in keep and 2 * x.link_chars > x.chars:
                x.noise = 1
            else:
                todo += x.blocks
    blocks: list[list[str]] = [[]]
    _render(article or body, blocks)
    lines = (" ".join(unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""

    def start():
        def work(ids, urls, htmls):
            texts = [main_text(h) for h in htmls]
            return {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return map_rows(pages.select("page_id", "url", "html"), SCHEMA, start)
