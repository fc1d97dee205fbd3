"""Main text of web pages by composite text density.

For every node of a page's tree: its characters, its tags, and those of them within links. A node's density is its
characters per tag, divided by how much of it is links compared with the page (so menus fall away). The node whose
children's densities have the largest sum holds the main text and is kept whole. The least density on the path from it
to the body is the threshold: from the body down, a subtree whose density is below it is dropped, and so is a box whose largest sum is below a SHARE of
the main node's, unless it holds a heading or stands in the same article. Of a subtree that stays, the node of largest sum is kept whole and the parts around it are
looked at in the same way. So an article split over several subtrees stays whole, and menus, footers, notices and adverts beside it go, however deep all of them
are wrapped. Inline content between blocks counts as one child. Only scripts, styles and other elements without text are left out before.

Tags, roles, and the words of class and id decide only what densities can't tell: reader comments may be longer than the article, and a footer may be as long as
a short one. Of what density keeps, an element that is named as no part of an article is left out: by its tag or role, or if all words of a class or id are listed ("comment-list",
but not "share-price"); if only some are, where most of its text is links. If the main node itself is in such an element, or nothing is left, the elements that are left out go first and density chooses again.
On a page without any other text but links, the largest element that words name (or a form) is the article, whatever its box is called.

Character references are decoded; white space inside a block becomes one space; blocks are trimmed and joined by one
line feed in page order; empty blocks vanish; nothing else is dropped. A null or empty page has the empty text; pages
without markup are one block; unclosed and stray tags are tolerated; repeated rows repeat.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.llm._shared import ship

#: Fixed values of HTML: elements without an end tag, elements that begin a new line, and what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section div body html td th".split())

#: Elements whose text is never shown.
HIDDEN_TAGS = frozenset("head script style noscript template iframe object svg canvas audio video select textarea".split())
#: Elements that are no part of an article's text.
OUT_TAGS = frozenset("nav footer aside button input menu dialog".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
OUT_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent notice banner popup modal newsletter subscribe comment comments respond disqus share sharing social related recommended".split())
#: Words that say nothing beside those: "ad-box", "comments-list".
PLAIN_WORDS = frozenset("a area block body bottom box btn button container content element group holder inner item items left list main outer panel position post posts row right section slot space text thread title top unit view widget wrap wrapper".split())
#: Boxes, which go if their largest sum of densities is less than this share of the main node's.
BOXES = frozenset("address aside center dd details dialog div dl dt fieldset figure footer form header li menu nav ol section table tbody td tr ul".split())
SHARE = 1 / 12
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "parent", "parts", "out", "doubt", "chars", "tags", "link_chars", "link_tags", "density", "block", "total", "best")

    def __init__(self, tag: str, parent: Node | None, out: bool, doubt: str = ""):
        self.tag, self.parent, self.out, self.doubt = tag, parent, out, doubt
        self.parts: list[str | Node] = []


class Tree(HTMLParser):
    """A page's nodes; text that is never shown is not kept."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", None, False)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._end("p", SCOPES)
        for closed in CLOSES.get(tag, ()):
            self._end(closed, SCOPES)
        node = Node(tag, self.at, self.at.out or tag in HIDDEN_TAGS or any(name == "hidden" for name, _ in attrs), _doubt(tag, attrs, self.at))
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID:
            self._end(tag, frozenset())

    def handle_data(self, data: str) -> None:
        if not self.at.out:
            self.at.parts.append(data)

    def _end(self, tag: str, within: frozenset) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            if node.tag in within:
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent


def _doubt(tag: str, attrs: list, parent: Node) -> str:
    """Why an element is no part of an article: "sure" by its tag or role, "likely" by all words of a class or id, "maybe" by some of them; or nothing."""
    if tag in OUT_TAGS or tag == "header" and not _inside(parent, "article"):
        return "sure"
    if tag in ("header", "body", "html", "article", "main"):
        return ""
    given = {name: (value or "").lower() for name, value in attrs}
    if given.get("role") in OUT_ROLES:
        return "sure"
    names = [{w for w in _SPLIT.split(name) if w and not w.isdigit()} for name in (given.get("class", "") + " " + given.get("id", "")).split()]
    listed = [name for name in names if not OUT_WORDS.isdisjoint(name)]
    if tag == "form" or any(name <= OUT_WORDS | PLAIN_WORDS for name in listed):
        return "likely"
    return "maybe" if listed else ""


def _inside(node: Node | None, tag: str) -> bool:
    while node is not None:
        if node.tag == tag:
            return True
        node = node.parent
    return False


def _walk(root: Node) -> list[Node]:
    """The nodes that are kept, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [x for x in node.parts if not isinstance(x, str) and not x.out]
    return out


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    c, t, lc, lt = chars, max(tags, 1), link_chars, max(link_tags, 1)
    base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
    return c / t * math.log(max(c / max(lc, 1) * t / lt, 1.0) + 1e-9, max(base, 1.0 + 1e-9) + 1e-9) if c else 0.0


def _kids(node: Node) -> list[Node]:
    return [x for x in node.parts if not isinstance(x, str) and not x.out]


def _measure(node: Node, parts: list) -> None:
    """A node's counts, from its parts, whose own are known."""
    kids = [x for x in parts if not isinstance(x, str) and not x.out]
    node.chars = sum(len(" ".join(x.split())) for x in parts if isinstance(x, str)) + sum(x.chars for x in kids)
    node.tags = sum(x.tags + 1 for x in kids)
    node.link_chars = node.chars if node.tag == "a" else sum(x.link_chars for x in kids)
    node.link_tags = sum(x.link_tags + (x.tag == "a") for x in kids)


def _units(node: Node) -> Iterator[Node]:
    """The parts of a node: its blocks, and its runs of inline content, each as a node without a tag."""
    run: list = []
    for x in [*node.parts, None]:
        if x is None or not isinstance(x, str) and not x.out and x.block:
            if run:
                unit = Node("", node, False)
                unit.parts, unit.block, run = run, False, []
                yield unit
            if x is not None:
                yield x
        else:
            run.append(x)


def main_nodes(root: Node) -> list[Node]:
    """The subtrees that are kept, in page order; the main node is root.best's."""
    nodes = _walk(root)
    for node in reversed(nodes):
        _measure(node, node.parts)
        node.block = node.tag in BLOCKS or any(x.block for x in _kids(node))
    body = next((n for n in nodes if n.tag == "body"), root)
    share = body.link_chars / max(body.chars, 1)
    for node in reversed(nodes):
        node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        node.total = 0.0
        if node.block or node is body:
            for x in _units(node):
                if not x.block:
                    _measure(x, x.parts)
                    x.density = _density(x.chars, x.tags, x.link_chars, x.link_tags, share)
                node.total += x.density
        # the node of largest sum; of equal ones that with more characters, then the first on the page; inline ones stay in their block
        node.best = max([node, *(x.best for x in _kids(node) if x.block and x.chars)], key=lambda n: (n.total, n.chars))
    root.best = top = body.best
    if not body.chars:
        return [body]
    above = [top, *_above(top)]
    least = min(x.density for x in above[: above.index(body) + 1])
    frame, path = next((x for x in above if x.tag in ("article", "main")), None), set(map(id, above))
    titled: set[int] = set()
    for node in reversed(nodes):
        if node.tag in HEADINGS and node.chars > node.link_chars or any(id(x) in titled for x in _kids(node)):
            titled.add(id(node))
    out, todo = [], [(body, frame is body)]
    while todo:
        node, framed = todo.pop()
        framed = framed or node is frame
        if not node.block and node is not body:
            _measure(node, node.parts)
            if _density(node.chars, node.tags, node.link_chars, node.link_tags, share) >= least:
                out.append(node)
        elif node.density >= least and (id(node) in path or framed or node.tag not in BOXES or id(node) in titled or node.best.total >= SHARE * top.total):
            if node.best is node:
                out.append(node)
            else:
                todo += [(x, framed) for x in reversed(list(_units(node)))]
    return out


def _above(node: Node) -> list[Node]:
    out = []
    while node.parent is not None:
        node = node.parent
        out.append(node)
    return out


def blocks(node: Node, doubted: list[Node]) -> list[str]:
    """The texts of a subtree's blocks; nodes in doubt are left out and put to doubted."""
    out: list[str] = []
    now: list[str] = []

    def close() -> None:
        text = " ".join("".join(now).split())
        now.clear()
        if text:
            out.append(text)

    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            now.append(x)
        elif x.tag == "br":
            now.append(" ")
        elif x.doubt and not x.out:
            doubted.append(x)
            if x.tag in BLOCKS:
                close()
        elif not x.out:
            block = x.tag in BLOCKS
            if block:
                close()
                todo.append(None)
            todo += reversed(x.parts)
    close()
    return out


def _choose(root: Node) -> tuple[list[str], list[Node], bool]:
    """The blocks of the subtrees that density chooses, the nodes in doubt that were left out of them, and whether the main node is in one."""
    out, doubted = [], []
    nodes = main_nodes(root)
    for node in nodes:
        # a node in doubt further up leaves out all that is below it
        last = next((x for x in reversed(_above(node)) if x.doubt), None)
        if last is None:
            out += blocks(node, doubted)
        else:
            doubted.append(last)
    return out, doubted, any(x.doubt for x in (root.best, *_above(root.best)))


def _settle(root: Node) -> None:
    """Decides about elements with some listed words, and takes the largest one told by words for the article while the rest of the page has no text but links."""
    for node in reversed(_walk(root)):
        _measure(node, node.parts)
        if node.doubt == "maybe":
            node.doubt = "likely" if 2 * node.link_chars > node.chars else ""
    while True:
        likely, rest, todo = [], False, [root]
        while todo and not rest:
            node = todo.pop()
            if node.doubt:
                likely += [node] if node.doubt == "likely" and node.chars > node.link_chars else []
            elif node.tag != "a":
                rest = any(isinstance(x, str) and not x.isspace() for x in node.parts)
                todo += _kids(node)
        if rest or not likely:
            return
        max(likely, key=lambda x: x.chars - x.link_chars).doubt = ""


def main_text(html: str | None) -> str:
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    _settle(tree.root)
    out, doubted, within = _choose(tree.root)
    while doubted and (within or not out):  # the main text is no article's: density chooses again without it
        for x in doubted:
            x.out = True
        out, doubted, within = _choose(tree.root)
    return "\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row (id_col, url_col, text, n_chars) per page."""
    ship(pages.sparkSession)
    given = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("html"))
    kinds = [f.dataType.simpleString() for f in given.schema][:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return given.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
