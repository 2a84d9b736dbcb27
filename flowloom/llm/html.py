"""The main text of web pages by composite text density.

A page becomes a tree of its elements. What a page has around its article (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments) is cut off by element, role and class name. Every
node left gets a density: characters per tag, adjusted by how much of its text and how many of its
tags are links, against the page as a whole. The node whose children's densities have the largest sum
is the article; the lowest density on its path to the body is the threshold for the blocks beside it
that belong to it too.
"""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
#: Elements by how the page is laid out; fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead"
    " caption tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "tbody", "tfoot", "thead", "tr", "caption", "legend"}
#: Start tag -> open elements that it ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol menu dl table html body article section div main aside".split())
#: Elements that never hold main text.
DROPPED = frozenset(
    "script style noscript template textarea title head iframe noembed noframes svg canvas math object audio video map"
    " button select datalist input nav header footer aside dialog menu".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Parts of class names and ids, by what they name.
COMMENTS = frozenset("comment comments commentlist commentary disqus respond reply replies discussion".split())
AROUND = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager topbar masthead header footer"
    " sidebar aside rail widget widgets"
    " cookie cookies consent gdpr notice notices alert popup modal overlay toast banner announcement"
    " ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion"
    " form search login signup subscribe subscription newsletter"
    " share sharing social follow related recommended recommendations trending".split()
)
#: Names of wrappers: what else they are called tells of the layout if they hold the content.
LAYOUT = frozenset("layout wrapper wrap container page site has with no without open enabled row grid left right".split())
CONTENT = frozenset("content article post entry story main".split())
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: A list or block of at least this share of link text, with several links, is a menu unless the page
#: names the article that it stands in.
MENU_SHARE = 0.8


class Node:
    __slots__ = ("tag", "parent", "content", "drop", "article", "text", "wrapper", "named", "chars", "tags", "link_chars", "links", "density", "sum")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.content = tag, parent, []
        self.drop = self.article = self.text = self.wrapper = self.named = False
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = self.sum = 0.0


def _junk(tag: str, attributes: str) -> int:
    """2: certainly around the article; 1: unless the article stands inside; 0: no."""
    if tag in DROPPED:
        return 2
    level = 1 if tag == "form" else 0
    if not attributes:
        return level
    for name, a, b, c, hidden in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if hidden or name == "hidden" or name == "aria-hidden" and value == "true":
            return 2
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 2
        if name == "role" and value.lower() in ROLES:
            level = 1
        if name in ("class", "id"):
            parts = _parts(value)
            if parts & COMMENTS and not parts & LAYOUT:
                return 2
            if parts & (AROUND | COMMENTS):
                level = 1
    return level


def _parts(name: str) -> set[str]:
    return {x.lower() for x in NAME_PART.findall(name)}


def _named(attributes: str) -> set[str]:
    names = (a or b or c for name, a, b, c, _ in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id"))
    return set().union(*map(_parts, names))


class Open:
    """The elements that are open, with the depths of each kind, so that an end tag is one look-up
    however many elements a page leaves open."""

    def __init__(self, root: Node):
        self.path, self.depths = [root], {}
        self.blocks, self.scopes = [0], [0]

    @property
    def here(self) -> Node:
        return self.path[-1]

    def push(self, node: Node) -> None:
        depth = len(self.path)
        self.path.append(node)
        self.depths.setdefault(node.tag, []).append(depth)
        if node.tag in BLOCK:
            self.blocks.append(depth)
        if node.tag in SCOPE:
            self.scopes.append(depth)

    def _cut(self, depth: int) -> None:
        while len(self.path) > depth:
            tag = self.path.pop().tag
            self.depths[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            if tag in SCOPE:
                self.scopes.pop()

    def imply(self, tags: set[str]) -> None:
        """Ends the nearest of `tags`, if it is open inside the nearest scope."""
        depth = max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)
        if depth > self.scopes[-1]:
            self._cut(depth)

    def close(self, tag: str) -> None:
        if tag in ("html", "body") or not self.depths.get(tag):
            return
        depth = self.depths[tag][-1]
        if tag in BLOCK or depth > self.blocks[-1]:  # an inline end does not close the block it stands in
            self._cut(depth)


def parse(page: str) -> list[Node]:
    """The elements of a page in their order, the root first. Missing end tags are supplied where the
    standard has them implied; unknown ends are skipped; a page that breaks off is taken as it is."""
    root = Node("html", None)
    nodes, at = [root], 0
    opened = Open(root)
    maybe: list[Node] = []
    size = len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            mark = size
        if mark > at:
            opened.here.content.append(page[at:mark])
        if mark == size:
            break
        match = TOKEN.match(page, mark)
        if not match:
            opened.here.content.append("<")
            at = mark + 1
            continue
        at = match.end()
        end, start, attributes = match[1], match[2] or match[4], match[3] or match[5] or ""
        if end:
            opened.close(end.lower())
        elif start:
            tag = start.lower()
            if tag in ("html", "body") and opened.here is not root and any(n.tag == tag for n in nodes[:3]):
                continue
            if tag in CLOSES_P:
                opened.imply({"p"})
            if tag in ENDS:
                opened.imply(ENDS[tag])
            here = opened.here
            node = Node(tag, here)
            here.content.append(node)
            nodes.append(node)
            junk = 0 if tag in ("html", "body") else _junk(tag, attributes)
            node.drop = junk == 2
            names = _named(attributes) if attributes else set()
            node.wrapper = bool(names & LAYOUT)
            node.named = tag in ("article", "main") or bool(names & CONTENT) and not node.wrapper
            if junk == 1:
                maybe.append(node)
            elif not junk:
                if tag in ("article", "main"):
                    _hold(here, "article")
                elif names & CONTENT:
                    _hold(here, "text")
            if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
                continue
            if tag in RAW:
                stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
                at = page.find(">", stop.end()) + 1 or size if stop else size
                continue
            opened.push(node)
    for node in maybe:
        node.drop = node.drop or not (node.article or node.wrapper and node.text)
    return nodes


def _hold(node: Node | None, what: str) -> None:
    while node is not None and not getattr(node, what):
        setattr(node, what, True)
        node = node.parent


def measure(nodes: list[Node]) -> Node:
    """Counts and densities of all nodes; what is cut off counts nothing. Returns the body."""
    for node in nodes:
        node.drop = node.drop or node.parent is not None and node.parent.drop
    for node in reversed(nodes):
        if node.drop:
            continue
        own = sum(len(html.unescape(x).strip()) for x in node.content if isinstance(x, str))
        node.chars += own
        if node.tag == "a":
            node.link_chars, node.links = node.chars, node.links + 1
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.links += node.links
    body = next((n for n in nodes if n.tag == "body" and not n.drop), nodes[0])
    share = body.link_chars / max(body.chars, 1)
    for node in nodes:
        if node.chars and not node.drop:
            rest = max(node.chars - node.link_chars, 1)
            base = math.log(node.chars / rest * node.link_chars + share * node.chars + math.e)
            tags, links = max(node.tags, 1), max(node.links, 1)
            text = node.chars / max(node.link_chars, 1) * tags / links
            node.density = node.chars / tags * math.log(max(text, 1e-9)) / math.log(max(base, 1.1))
            if node.parent is not None:
                node.parent.sum += node.density
    return body


def main_nodes(nodes: list[Node]) -> list[Node]:
    """The roots of the main text, in page order."""
    body = measure(nodes)
    inside = [n for n in nodes if not n.drop and n.chars]
    if not inside:
        return []
    best = max(inside, key=lambda n: n.sum)
    if best.sum <= 0 or best.tag == "html":
        best = body
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    # the article as a whole, where the page names it
    top = max((i for i, n in enumerate(path) if n.tag in ("article", "main")), default=0)
    chosen = [path[top]]
    for child, parent in zip(path[top:], path[top + 1 :]):
        chosen += [
            n
            for n in parent.content
            if isinstance(n, Node) and n is not child and not n.drop and n.chars and n.density >= threshold and 2 * n.link_chars < n.chars
        ]
    picked = set(map(id, chosen))
    return [n for n in nodes if id(n) in picked]


def _is_menu(node: Node) -> bool:
    return node.tag in ("ul", "ol", "div", "section", "dl") and node.links > 1 and node.link_chars >= MENU_SHARE * node.chars


def blocks(root: Node) -> list[str]:
    """Texts of a node's blocks in order; white space is one space, empty blocks are left out. What a page
    names its article is taken whole, lists of links and all; elsewhere such a list is a menu."""
    out: list[list[str]] = [[]]
    todo: list = [root]
    while todo:
        item = todo.pop()
        if item is None:
            out.append([])
        elif isinstance(item, str):
            out[-1].append(item)
        elif item.tag in ("br", "td", "th"):
            out[-1].append(" ")
            todo.extend(reversed(item.content))
        elif not item.drop and (root.named or item is root or not _is_menu(item)):
            apart = item.tag in BLOCK
            todo += [None] * apart
            todo.extend(reversed(item.content))
            if apart:
                out.append([])
    # texts are decoded once their pieces are together, so that no reference is cut in two
    found = (" ".join(html.unescape("".join(parts)).split()) for parts in out)
    return [x for x in found if x]


def main_text(page: str | None) -> str:
    """Main text of a page, a line per block; empty for a page that is null or has none."""
    if not page:
        return ""
    return "\n".join(text for node in main_nodes(parse(page)) for text in blocks(node))


def extract(pages: DataFrame) -> DataFrame:
    """A row per row of `pages` (page_id, url, html): page_id, url, text, n_chars (code points).

    Null and empty pages, and those without main text, have an empty text. Repeated rows are taken
    one by one; an empty table gives an empty result; other columns are left out.
    """

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    out = pages.select("page_id", "url", text("html").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
