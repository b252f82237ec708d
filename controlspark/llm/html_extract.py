"""Main text of web pages by tree scoring.

A tolerant parser makes a tree. Every paragraph earns points for its length and
commas, less its share of linked text, and passes them on to its ancestors,
halved at each level above the parent. The best container, its own points
discounted by its link density, is kept with those siblings that read like it.

Before that, page furniture is cut off: elements that are never prose, and those
that a tag, class, id or role names as menus, headers, footers, sidebars,
notices, adverts, forms or comments. A name is a hint and no verdict: an element
that holds most of what there is to read on the page stays, whatever its name
(``_spared`` has the rules). Time grows in proportion to the page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, passes, prepare, tidy

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template xmp iframe noembed noframes".split())
#: Never prose.
NEVER = RAW | set("head button select option input label menu dialog svg canvas object audio video map".split())
#: Furniture, unless it holds most of the prose.
FRAME = set("nav header footer aside form fieldset".split())
BLOCK = set("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An element that such a start tag ends, if it is open inside the nearest container.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: An end tag inside one of these does not reach what is open outside.
CELLS = {"td", "th", "caption"}
TABLE = CELLS | {"table", "tr", "tbody", "thead", "tfoot"}
FURNITURE = set(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsense banner breadcrumb breadcrumbs byline consent cookie cookies copyright disclaimer footer form gdpr header hidden legal login "
    "masthead menu menubar modal nav navbar navigation newsletter notice notices notification notifications overlay pager pagination paywall popular popup promo promoted promotion recommended related "
    "search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription tags tagcloud teaser teasers toast toolbar topbar tracking trending".split()
)
COMMENTS = set("comment comments commentlist discussion disqus reply replies respond response responses reviews shoutbox".split())
#: A name with one of these says how something else looks.
MODIFIERS = set("has no non not with without is hide show js enable enabled disabled".split())
ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
PROSE = set("article body content entry main post story text".split())
#: Characters that an element with a plain name of furniture must hold to stay for its size.
MUCH = 200
TOKEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|![^>]*>?|\?[^>]*>?|(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>?)", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


END_OF = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW}


class Node:
    __slots__ = ("tag", "parent", "children", "names", "role", "hidden", "suspect", "marker", "chars", "linked", "links", "commas", "marked", "points")

    def __init__(self, tag: str, parent: "Node | None", attributes: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.names, self.role, self.hidden = set(), "", False
        #: How strongly tag, names and role speak for furniture: 0 to 2, 3 for readers' comments.
        self.suspect = 2 if tag in FRAME else 0
        self.chars = self.linked = self.links = self.commas = self.marked = 0
        self.points = 0.0
        if attributes.strip(" /"):
            for m in ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key in ("class", "id"):
                    for name in value.split():
                        own = [x.lower() for x in NAME.findall(name)]
                        self.names.update(own)
                        self.suspect = max(self.suspect, suspicion(own))
                elif key == "role":
                    self.role = value.lower()
                    if self.role in ROLES:
                        self.suspect = max(self.suspect, 2)
                elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                    self.hidden = True
                elif key == "style" and INVISIBLE.search(value):
                    self.hidden = True
        if tag in ("html", "body") or (tag in TABLE and self.names & {"header", "footer"}) or tag in HEADINGS:
            self.suspect = 0
        self.marker = not self.suspect and (tag in ("article", "main") or self.role in ("article", "main"))


def suspicion(words: list[str]) -> int:
    """Of the words of one class or id: ``sidebar`` 2, ``search-results-page`` 1, ``has-sidebar`` and ``content`` 0, ``comment-list`` 3."""
    if not words or MODIFIERS.intersection(words):
        return 0
    if words[0] in COMMENTS or words[-1] in COMMENTS:
        return 3
    if words[0] in FURNITURE or words[-1] in FURNITURE:
        return 2 if len(words) <= 2 else 1
    return 1 if FURNITURE.intersection(words) else 0


class Builder:
    """Open elements as a stack, and where in it each tag is open, so that no step climbs the tree."""

    def __init__(self):
        self.root = Node("#root", None)
        self.stack = [self.root]
        self.open: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []  # open blocks other than p
        self.cells: list[int] = []

    def down_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.stack.pop().tag
            self.open[tag].pop()
            if tag in CELLS:
                self.cells.pop()
            if tag in BLOCK and tag != "p":
                self.blocks.pop()

    def last(self, *tags: str) -> int:
        return max((self.open[t][-1] for t in tags if self.open[t]), default=0)

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and self.open[tag]:
            return
        block = self.blocks[-1] if self.blocks else 0
        if tag in BLOCK and self.last("p") > block:
            self.down_to(self.last("p"))
        if tag in ENDS:
            scope = self.last(*SCOPE[tag])
            inside = [self.open[t][i] for t in ENDS[tag] if (i := bisect_right(self.open[t], scope)) < len(self.open[t])]
            if inside:
                self.down_to(min(inside))
        node = Node(tag, self.stack[-1], attributes)
        node.parent.children.append(node)
        if tag not in VOID and tag not in RAW and not attributes.rstrip().endswith("/"):
            place = len(self.stack)
            self.stack.append(node)
            self.open[tag].append(place)
            if tag in CELLS:
                self.cells.append(place)
            if tag in BLOCK and tag != "p":
                self.blocks.append(place)

    def end(self, tag: str) -> None:
        if tag in ("html", "body") or not self.open[tag]:
            return
        place = self.open[tag][-1]
        block = self.blocks[-1] if self.blocks else 0
        if tag not in BLOCK and max(block, self.last("p")) > place:
            return  # an inline element does not end a block inside it
        if (tag == "p" and block > place) or (tag not in TABLE and self.cells and self.cells[-1] > place):
            return
        self.down_to(place)


def parse(page: str) -> Node:
    """The tree of a page; children are nodes and strings."""
    tree, at = Builder(), 0
    while True:
        m = TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            tree.stack[-1].children.append(text)
        if not m:
            return tree.root
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            tree.end(tag)
            continue
        tree.start(tag, m[3] or "")
        if tag in RAW:
            end = END_OF[tag].search(page, at)
            at = end.end() if end else len(page)


def _order(root: Node) -> list[Node]:
    """Every element, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(x for x in reversed(node.children) if isinstance(x, Node))
    return out


def _measure(root: Node) -> list[Node]:
    """Sums each element's text, linked text, links, commas, and unlinked text inside markers."""
    order = _order(root)
    for node in reversed(order):
        node.chars = node.linked = node.links = node.commas = node.marked = 0
        for x in node.children:
            if isinstance(x, Node):
                node.chars, node.linked, node.links = node.chars + x.chars, node.linked + x.linked, node.links + x.links
                node.commas, node.marked = node.commas + x.commas, node.marked + x.marked
            elif not x.isspace():
                node.chars += len(x)
                node.commas += x.count(",") + (0 if x.isascii() else x.count("、") + x.count("，"))
        if node.tag == "a":
            node.linked, node.links = node.chars, 1
        if node.marker:
            node.marked = node.chars - node.linked
    return order


def _spared(node: Node, root: Node, free: int) -> bool:
    """Whether an element with a name of furniture stays. free: unlinked characters outside all furniture.

    It must hold more than what would be left, and either most of the text in
    articles or, where none is outside it, most of the page's (with a plain name
    like ``sidebar`` four fifths and MUCH characters). Comments stay if there is
    nothing else.
    """
    own = node.chars - node.linked
    if own <= free or (node.suspect == 3 and free >= 20):
        return False
    if root.marked:
        return 2 * node.marked >= root.marked
    whole = root.chars - root.linked
    return own >= MUCH and 5 * own >= 4 * whole if node.suspect > 1 else 2 * own >= whole


def _prune(root: Node) -> None:
    """Cuts off what is never prose, what is hidden and what is furniture."""
    order = _order(root)
    for node in order:
        node.children = [x for x in node.children if not isinstance(x, Node) or not (x.tag in NEVER or (x.hidden and x.tag not in ("html", "body")))]
    _measure(root)
    free = root.chars - root.linked
    todo = [root]
    while todo:  # the topmost suspects hold all text of furniture
        for x in todo.pop().children:
            if isinstance(x, Node):
                if x.suspect:
                    free -= x.chars - x.linked
                else:
                    todo.append(x)
    todo2: list[tuple[Node, bool]] = [(root, False)]
    while todo2:
        node, inside = todo2.pop()
        inside = inside or node.tag == "article"
        kept = []
        for x in node.children:
            if isinstance(x, Node):
                if x.suspect and x.tag == "header" and inside:
                    x.children = [y for y in _order(x) if y.tag in HEADINGS]  # the title of an article
                    for y in x.children:
                        y.parent = x
                elif x.suspect and not _spared(x, root, free):
                    continue
                todo2.append((x, inside))
            kept.append(x)
        node.children = kept


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _paragraph(node: Node) -> bool:
    """Holds text, and no block inside."""
    return node.tag in BLOCK and node.chars > 0 and not any(isinstance(x, Node) and (x.tag in BLOCK) for x in node.children)


def _blocks(nodes: list) -> list[str]:
    """The texts of the blocks below, in page order."""
    out, now = [], []

    def end() -> None:
        text = " ".join(html.unescape("".join(now)).split())
        if text:
            out.append(text)
        now.clear()

    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            now.append(x)
        elif x.tag == "br":
            now.append(" ")
        elif x.tag in BLOCK:
            end()
            todo.append(None)
            todo.extend(reversed(x.children))
        else:
            todo.extend(reversed(x.children))
    end()
    return out


def _points(order: list[Node]) -> list[Node]:
    """Gives the paragraphs' points to their ancestors; those that got some."""
    candidates: dict[int, Node] = {}
    for node in order:
        if not (_paragraph(node) or ((node.tag in BLOCK or node.tag == "#root") and any(isinstance(x, str) and not x.isspace() for x in node.children))):
            continue
        points = (1 + node.commas + min(node.chars / 100, 3)) * (1 - _density(node)) if node.chars >= 20 and node.tag not in HEADINGS else 0.2
        up, share = (node if node.tag in ("article", "main", "body", "#root") else node.parent), 1.0
        for _ in range(6):
            if up is None:
                break
            up.points += points * share
            candidates[id(up)] = up
            up, share = up.parent, share / 2
    return list(candidates.values())


def _final(node: Node) -> float:
    bonus = 3.0 if node.marker and node.tag != "main" and node.role != "main" else 2.5 if node.marker else 1.4 if node.names & PROSE else 1.0
    return node.points * (1 - _density(node)) * bonus / (1 + node.suspect)


def _menus(node: Node, inside: bool = False) -> None:
    """Takes lists of short links, and nothing else in them, out of a container that no tag calls an article."""
    todo = [(node, inside)]
    while todo:
        now, inside = todo.pop()
        inside = inside or now.marker
        kept, before = [], None
        for x in now.children:
            if isinstance(x, Node):
                menu = x.tag in ("ul", "ol", "div", "section") and x.links >= 3 and x.linked >= 0.95 * x.chars and x.linked < 30 * x.links
                if menu and not inside and (before is None or before.tag not in HEADINGS):
                    continue
                before = x
                todo.append((x, inside))
            kept.append(x)
        now.children = kept


def _whole(best: Node) -> Node:
    """The article that the best container is a part of, or itself."""
    up: Node | None = best
    while up is not None and not (up.marker and up.tag == "article"):
        up = up.parent
    return up if up is not None and _density(up) < 0.5 else best


def extract(page: str | None) -> str:
    """The main text; blocks are joined by an empty line. A null, empty or proseless page gives an empty text."""
    if not page:
        return ""
    root = parse(page)
    _prune(root)
    candidates = _points(_measure(root))
    if not candidates:
        return ""
    best = _whole(max(candidates, key=_final))
    top, kept = _final(best), []
    for x in [best] if best.parent is None or best.tag in ("body", "html") else best.parent.children:
        if x is best:
            kept.append(x)
        elif isinstance(x, Node):
            like = x.tag == best.tag and x.names == best.names
            if (
                (x.tag in BLOCK and _density(x) < 0.3 and _final(x) >= max(2.0, top * (0.1 if like else 0.2)))
                or (not best.marker and x.tag == "p" and x.chars > 80 and _density(x) < 0.25)
                or (not best.marker and x.tag in ("h1", "h2") and best not in kept)
            ):
                kept.append(x)
    up, inside = best.parent, False
    while up is not None and not inside:
        inside, up = up.marker, up.parent
    for x in kept:
        _menus(x, inside)
    return "\n\n".join(_blocks(kept))


@tidy
def _extracted(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
        for first, pages in passes(batch, "html"):
            texts = [extract(p.decode("utf-8", "replace")) for p in pages]
            yield batch_of(_OUT, (ids[first : first + len(pages)], urls[first : first + len(pages)], texts, map(len, texts)))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of ``pages`` (page_id, url, html, anything else).

    A null html is an empty page. Repeated and null page_ids keep a row each. An
    empty table gives an empty one. A page is read whole at any length.
    """
    prepare(pages.sparkSession)
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(_extracted, "page_id bigint, url string, text string, n_chars bigint")
