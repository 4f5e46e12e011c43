"""Operator 8, HTML extraction by tree scoring.

The page becomes a tree. Each paragraph-like block gives points, for its length and its commas, to its
ancestors, half as many with each step up; a container's points are discounted by its link density. The
best container is kept with those siblings that score enough beside it or are long prose themselves;
its blocks are joined in page order. Parts that aren't the reader's (scripts, buttons and so on) are cut
before scoring. Parts that their element, role or name marks as menus, notices, forms and the like are cut
too, unless they hold the article: most of the page's prose outside links, in paragraphs or under the page's heading.

Time is linear in the page. Elements nested deeper than DEPTH lose their nesting and keep their text.

Defined results: a null, empty or text-free page gives an empty text. Unclosed and misnested tags are
closed as a browser would; a tag that the page's end cuts off is dropped; a quote that never ends ends with
its tag; an unclosed title, template or the like is no element. Repeated rows get equal texts; ties go to
the container that comes first; extra columns are never read. A page of any length is read whole.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# HTML's elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
ENDS_WITH_PAGE = frozenset("script style".split())
NEVER = frozenset("script style noscript iframe noembed noframes template svg head title button select textarea input object embed canvas audio video map annotation annotation-xml".split())
APART = frozenset("nav footer aside menu dialog header form".split())
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts semantics".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
BREAKS_OUT = CLOSES_P | frozenset("b big body br code dd dt em embed head i img li meta nobr ruby s small span strong strike sub sup tt u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = frozenset("p pre td blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
ROLES_OUT = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
# Words in class and id names of parts that are not the article.
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
OUT_WORDS = COMMENT_WORDS | frozenset(
    "ad ads adv advert adverts advertisement advertisements banner banners sponsor sponsored promo promos promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc header masthead topbar footer foot colophon sidebar sidebars rail aside "
    "widget widgets related recommended recommendations share sharing social follow newsletter subscribe subscription signup login "
    "cookie cookies consent gdpr notice notices alert popup modal overlay hidden skip search form".split()
)
#: Words of names that mark the article itself.
POINTS_IN = frozenset("article content main post entry story body text page hentry".split())
#: What follows such a word in a name says what stands beside the part, or its state, and not what it is.
STATES = frozenset("has with no without is not".split())
#: Shares of the page's prose from which a part is kept in spite of its mark, by how strong the mark is.
MOSTLY, HALF, SOME = 0.9, 0.5, 0.3
DEPTH = 200

_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>=]")
_VALUE = re.compile(r"\s*([\"']?)")
_BARE = re.compile(r"[^\s>]*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")
_SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("attributes", "children", "depth", "links", "main", "name", "parent", "points", "prose", "signs", "size")

    def __init__(self, name: str, parent: Node | None, attributes: str = "") -> None:
        self.name, self.parent, self.attributes = name, parent, attributes
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node | str] = []
        self.points, self.size, self.links = 0.0, 0, 0


class _Page:
    """A page's characters, and the places after which a search for one would find nothing."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.ends: dict[str, int] = {}

    def tag_end(self, at: int) -> int:
        """The place of the > that ends the tag whose name ends at at; -1 if the page ends first."""
        page = self.page
        if page.startswith(">", at):
            return at
        while at <= self.last[">"]:
            stop = _STOP.search(page, at)
            if stop[0] == ">":
                return stop.start()
            value = _VALUE.match(page, stop.end())
            quote = value[1]
            if not quote:
                at = _BARE.match(page, value.end()).end()
            elif self.last[quote] < value.end():
                return page.find(">", value.end())
            else:
                at = page.find(quote, value.end()) + 1
        return -1

    def closed(self, name: str, at: int) -> bool:
        """Whether an end tag of that name comes after at."""
        if name not in self.ends:
            self.ends[name] = max((m.start() for m in re.finditer(f"</{re.escape(name)}", self.page, re.I)), default=-1)
        return self.ends[name] >= at


class _Tree:
    """The tree so far, and how many elements of each name are open: in all, and of inline ones in the innermost block."""

    def __init__(self) -> None:
        self.top = self.here = Node("#page", None)
        self.open: dict[str, int] = defaultdict(int)
        self.inline: list[dict[str, int]] = [defaultdict(int)]
        self.flat: dict[str, int] = defaultdict(int)

    def push(self, node: Node) -> None:
        if node.depth > DEPTH:
            self.flat[node.name] += 1
            return
        self.here = node
        self.open[node.name] += 1
        if node.name in INLINE:
            self.inline[-1][node.name] += 1
        else:
            self.inline.append(defaultdict(int))

    def pop_to(self, node: Node) -> None:
        """Closes all that is open below node."""
        while self.here is not node:
            name = self.here.name
            self.open[name] -= 1
            if name in INLINE:
                self.inline[-1][name] -= 1
            else:
                self.inline.pop()
            self.here = self.here.parent

    def end(self, name: str) -> None:
        if self.flat[name]:
            self.flat[name] -= 1
            return
        # an inline end tag never closes what stands around the block that it is in
        if not (self.inline[-1][name] if name in INLINE else self.open[name]):
            return
        node = self.here
        while node.name != name:
            node = node.parent
        self.pop_to(node.parent)

    def close(self, name: str, within: frozenset = frozenset()) -> None:
        """Closes an open element of that name, if there is one inside the nearest of within."""
        if not self.open[name]:
            return
        node = self.here
        while node.parent is not None and node.name not in within:
            if node.name == name:
                self.pop_to(node.parent)
                return
            node = node.parent

    def begin(self, name: str) -> None:
        """Closes what the start tag of that name closes."""
        if name in BREAKS_OUT and not self.open["foreignobject"]:
            self.close("svg")
            self.close("math")
        if name in CLOSES_P:
            self.close("p", _P_ENDS)
        if name == "li":
            self.close("li", _LISTS)
        elif name in ("dt", "dd"):
            self.close("dt", _PAIRS)
            self.close("dd", _PAIRS)
        elif name in ("td", "th", "tr"):
            self.close("td", _TABLES)
            self.close("th", _TABLES)
            if name == "tr":
                self.close("tr", _TABLES)
        elif name == "option":
            self.close("option", _SELECTS)
        elif name in HEADINGS and self.here.name in HEADINGS:
            self.pop_to(self.here.parent)


_P_ENDS = frozenset(("table", "td", "th", "li", "button", "article", "section", "div"))
_LISTS, _PAIRS, _TABLES, _SELECTS = frozenset(("ul", "ol", "menu")), frozenset(("dl",)), frozenset(("table",)), frozenset(("select",))


def parse(page: str) -> Node:
    """A tree of nodes and raw text."""
    tree, source = _Tree(), _Page(page)
    at, n = 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            tree.here.children.append(page[at:])
            break
        mark = page[begin + 1 : begin + 2]
        found = _NAME.match(page, begin + 1 + (mark == "/"))
        if not found and mark not in ("!", "?", "/"):  # no tag
            tree.here.children.append(page[at : begin + 1])
            at = begin + 1
            continue
        if begin > at:
            tree.here.children.append(page[at:begin])
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 2)
            at = end + 3 if end >= 0 else n
            continue
        if not found:
            end = page.find(">", begin) if begin < source.last[">"] else -1
            at = end + 1 if end >= 0 else n
            continue
        end = source.tag_end(found.end())
        if end < 0:
            break
        at, name = end + 1, found[0].lower()
        if mark == "/":
            tree.end(name)
            continue
        tree.begin(name)
        if (name in RAW and name not in ENDS_WITH_PAGE or name == "template") and not source.closed(name, at):
            continue
        node = Node(name, tree.here, page[found.end() : end])
        tree.here.children.append(node)
        if name in RAW:
            end_tag = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)[^>]*>?", re.I).search(page, at) if source.closed(name, at) else None
            node.children.append(page[at : end_tag.start() if end_tag else n])
            at = end_tag.end() if end_tag else n
        elif name not in VOID and not (page[end - 1] == "/" and (tree.open["svg"] or tree.open["math"])):
            tree.push(node)
    return tree.top


def _attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(node.attributes)}


def _named(a: dict[str, str]) -> list[list[str]]:
    """The words of each class and id name, up to what only says what stands beside."""
    out = []
    for name in f"{a.get('class', '')} {a.get('id', '')}".split():
        words = _WORD.findall(_CAMEL.sub(r"\1 \2", name).lower())
        stop = next((k for k, w in enumerate(words) if w in STATES), len(words))
        if words[:stop]:
            out.append(words[:stop])
    return out


def _words(a: dict[str, str]) -> set[str]:
    return {w for words in _named(a) for w in words}


def _needed(node: Node, in_article: bool) -> float | None:
    """The share of the page's prose that a part must hold to stay: None for a part without a mark, over 1 where nothing helps."""
    if node.name in NEVER:
        return 2.0
    marks: list[float] = []
    if node.name in APART and not (node.name == "header" and in_article):
        marks.append(HALF if node.name == "form" else MOSTLY)
    if node.attributes and not node.attributes.isspace():
        a = _attributes(node)
        if "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style", "")):
            marks.append(MOSTLY)
        if (role := a.get("role", "").lower()) in ROLES_OUT:
            marks.append(HALF if role in ("form", "search") else MOSTLY)
        names = _named(a)
        if node.name in ("article", "main", "body", "html"):
            names = [[w for w in words if w in COMMENT_WORDS] for words in names] if node.name == "article" else []
        if in_article:
            names = [[w for w in words if w not in ("header", "masthead")] for words in names]  # holds the heading
        out = [words for words in names if OUT_WORDS & set(words)]
        # a name of the article's own beside the others says that they are no more than its look
        inside = any(POINTS_IN & set(words) for words in names if words not in out)
        if any(COMMENT_WORDS & set(words) for words in out):
            marks.append(MOSTLY if inside else 2.0)
        elif out:
            marks.append(SOME if inside else HALF if all(words[-1] in POINTS_IN for words in out) else MOSTLY)
    return max(marks, default=None)


def _cut(top: Node) -> None:
    """Removes what is never article text, and what its mark says is none unless the page's prose is there."""
    nodes = _order(top)
    for node in reversed(nodes):
        # signs: paragraphs, and two for the page's heading or an element that says it's the article; main: holds such an element
        name, prose, signs, main = node.name, 0, 0, False
        if name not in NEVER and name != "a":
            for c in node.children:
                if isinstance(c, str):
                    prose += len(c.strip())
                else:
                    prose += c.prose
                    signs += c.signs
                    main = main or c.main
            if prose:
                main = main or name in ("article", "main")
                signs += 2 if name in ("h1", "article", "main") else int(name == "p")
        node.prose, node.signs, node.main = prose, signs, main
    whole = max(1, top.prose)
    stack = [(top, False)]
    while stack:
        node, in_article = stack.pop()
        in_article = in_article or node.name == "article"
        kept: list[Node | str] = []
        for c in node.children:
            if not isinstance(c, str):
                needed = _needed(c, in_article)
                if needed is not None:
                    elsewhere = top.main and not c.main and not in_article
                    if elsewhere or c.prose < needed * whole or c.signs < (1 if needed <= HALF else 2):
                        continue
                if c.children:
                    stack.append((c, in_article))
            kept.append(c)
        node.children = kept


def _order(top: Node) -> list[Node]:
    """All nodes, parents first."""
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        out.append(node)
        if node.children:
            stack += [c for c in reversed(node.children) if not isinstance(c, str)]
    return out


def _score(top: Node) -> list[Node]:
    nodes = _order(top)
    paragraphs: list[tuple[Node, int]] = []
    for node in reversed(nodes):
        own = inline = inner = links = 0
        for c in node.children:
            if isinstance(c, str):
                own += len(c.strip())
            else:
                inner += c.size
                links += c.links
                if c.name in INLINE:
                    inline += c.size
        node.size = own + inner
        node.links = node.size if node.name == "a" else links
        if own + inline >= 2 and node.name not in INLINE and (own or node.name in TEXTUAL):
            paragraphs.append((node, own + inline))
    for node, size in reversed(paragraphs):  # in page order
        commas = sum(c.count(",") for c in node.children if isinstance(c, str))
        points = 1 + commas + min(size / 100, 10)
        if node.name in HEADINGS:
            points = 0.5
        points *= 1 - node.links / max(1, node.size)
        up, share = (node if node.name not in TEXTUAL else node.parent), 1.0
        while up is not None and share > 0.1:
            up.points += points * share
            up, share = up.parent, share / 2
    return nodes


def _bonus(node: Node) -> float:
    if node.name in ("article", "main"):
        return 1.5
    if not node.points or not node.attributes:
        return 1.0
    return 1.25 if _words(_attributes(node)) & POINTS_IN else 1.0


def best(top: Node) -> list[Node]:
    """The best container and the siblings that belong to it, in page order."""
    nodes = _score(top)
    scored = [(n.points * (1 - n.links / max(1, n.size)) * _bonus(n), n) for n in nodes if n.name not in INLINE]
    most, chosen = max(scored, key=lambda x: x[0], default=(0.0, top))
    if most <= 0:
        return [top]
    if chosen.parent is None:
        return [chosen]
    if chosen.name != "article":  # an article element around it holds its heading too
        up = chosen
        while up is not None and up.name not in ("article", "body", "main"):
            up = up.parent
        if up is not None and up.name == "article":
            chosen = up
    value = {id(n): s for s, n in scored}
    out = []
    for node in chosen.parent.children:
        if isinstance(node, str):
            continue
        density = node.links / max(1, node.size)
        prose = node.name == "p" and node.size > 80 and density < 0.25
        alike = node.name == chosen.name and value.get(id(node), 0) >= max(10, 0.2 * most)
        heading = node.name in HEADINGS and node.size and density < 0.5 and chosen.name != "article"
        if node is chosen or prose or alike or heading:
            out.append(node)
    return out


def blocks(nodes: list[Node]) -> list[str]:
    """The texts of the blocks below nodes, in page order; inline elements don't part a block, br is a space."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = _SPACES.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append(text)

    for node in nodes:
        stack: list[Node | str | None] = [node]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                held.append(x)
            elif x.name == "br":
                held.append(" ")
            else:
                if x.name not in INLINE:
                    flush()
                    stack.append(None)
                stack += reversed(x.children)
        flush()
    return out


def article(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    top = parse(page)
    _cut(top)
    return "\n".join(blocks(best(top)))


def extracted(page: str | Column) -> Column:
    """A text column from a column of pages."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([article(x) for x in part], dtype=object)

    return F.pandas_udf(run, "string")(page)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = pages.select("page_id", "url", extracted(pages["html"]).alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
