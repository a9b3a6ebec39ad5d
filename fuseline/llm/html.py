"""Main text of HTML pages by tree scoring.

The page becomes a tree (unclosed ``p``, ``li`` and the like are closed as browsers do).  What its tag, role or style says
is no article text goes first: scripts, styles, navigation, forms, asides, footers, page headers, hidden parts, and comment
threads by their name.  Then every paragraph-like block has points: one, one for each comma, and one for each hundred
characters (three at most); of a block below 25 characters they count a quarter.

* **Names only discount.**  A container whose class or id names adverts, menus, notices and so on is cut unless it holds nearly
  all points of the article or page around it; one named for a list of links stays, too, where it reads like prose.  A name
  counts by its last word or when its other words are about layout, so that ``notice-period`` is no notice.
* **Scores choose.**  Blocks pass their points to their ancestors: the parent gets all, the grandparent half, and so on, and a
  container's sum is discounted by the share of its text inside links.  An ``article`` or ``main`` around the best container is
  kept, and of its siblings those that score at least a fifth of it or read like paragraphs.
* **Without one**, the best container grows while what stands beside it carries a share of the score: boxes with a fifth of its
  points, or several paragraphs, headings, lists and bare texts with a twentieth together.  What lies between such parts
  belongs to them.  Where nothing of the kind stands beside it the growth ends, with an ``h1`` beside it as its title.
  A table cell
  of several blocks with most of its table's points is a container, other parts of tables, lists and quotations are not.
  Boxes at the edge of a container made of boxes, or of the page's body, stay only with a fifth of the largest part's points;
  blocks of which half or more is links go.

Text: character references are decoded, white space inside a block (``br`` included) becomes one space, blocks are
trimmed and joined by one line feed in page order.  A ``label`` or ``button`` inside a sentence, formulas and the texts of a
drawing inside a paragraph are words of it.  Nothing else is dropped or cut.

Odd input: a null or empty page gives the empty text; markup that is cut off or nested wrongly is repaired, and a quote
in an attribute counts only behind ``=`` and where it is closed; a page without any tag is one block of text; among
containers of the same score the first wins; repeated rows are judged each by itself; an empty table gives no rows.
Additional columns stay as they are (one that has the result's name is replaced).

Cost: each character, element and ancestor is looked at a bounded number of times, however deep the page nests.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

_NAME_OF_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""[\s/]*(?:([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?|=)""")
_SKIP = re.compile(r"[\s/]*")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object canvas annotation annotation-xml".split())
DROPPED = RAW | frozenset("head nav footer aside form select dialog menu input fieldset audio video".split())
DRAWN = frozenset("desc defs metadata".split())  # inside a drawing, no text
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote li dd td h1 h2 h3 h4 h5 h6 figcaption".split())
CLOSED_BY = {  # an open element of the key ends where one of these begins
    "p": BLOCKS - {"body", "html"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "option": frozenset({"option"}),
}
ITEMS = frozenset("li dt dd".split())
CELLS = frozenset("table tr td th".split())  # a cell closes nothing outside its table

# Words in class and id that name what is not the article.
COMMENTS = frozenset("comment comments commentlist disqus replies respond shoutbox".split())
SURE = frozenset(
    "ad ads adbox adblock adbanner adv advert adverts advertisement advertising adslot adsense breadcrumb breadcrumbs cookie "
    "cookies consent footnav gdpr login masthead navbar newsletter pagination pager paywall sidebar sidebars signin signup "
    "sidenav subnav skyscraper sponsor sponsored sponsors subscribe tagcloud topbar".split()
)
LINKS = frozenset("menu menus nav navigation recommended recommendations related share sharing social toolbar".split())
AWAY = SURE | LINKS | frozenset(
    "alert alerts banner banners copyright disclaimer discussion footer modal notice notices overlay popup popups promo promos "
    "promoted promotion subscription widget widgets".split()
)
#: Words that say where or what shape a part is, not what it holds.
LAYOUT = frozenset(
    "area aside bar block bottom box btn button buttons center col column container div fixed group holder icons inner item items "
    "js left list main module outer page panel right row section site slot sticky strip top unit user wrap wrapper zone".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
STATES = frozenset("no has with without".split())
TITLES = frozenset("article post entry story title content".split())
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")

# How much of a named part's points count against those of all else around it.
DISCOUNT = {"sure": 1 / 20, "title": 1 / 20, "weak": 1 / 3, "links": 1 / 3}
SURE_POINTS = 20.0  # a part with a sure name and fewer points is never the article
SHORT = 25  # characters below which a block's points count a quarter
STRONG, SEVERAL = 0.2, 0.05  # shares of the score: of a box beside the article, of paragraphs and the like together


class Node:
    __slots__ = ("tag", "parent", "children", "score", "kind")

    def __init__(self, tag: str, parent: Node | None, kind: str = ""):
        self.tag, self.parent, self.kind = tag, parent, kind
        self.children: list[Node | str] = []
        self.score = 0.0


def _tag_end(page: str, at: int) -> tuple[int, dict[str, str], bool] | None:
    """From behind a tag's name: the place behind its ``>``, its attributes (the first of a name counts) and whether it
    closes itself; None if the page ends before."""
    attrs: dict[str, str] = {}
    size = len(page)
    behind = at  # the last attribute
    while at < size:
        if page[at] == ">":
            return at + 1, attrs, page[at - 1] == "/" and at > behind
        # A quote that is never closed is an ordinary character; no other of its kind follows, so looking for it is linear.
        m = _ATTR.match(page, at)
        if m is None:
            at = _SKIP.match(page, at).end()
            continue
        if m[1]:
            attrs.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        at = behind = m.end()
    return None


def _away(tag: str, attrs: dict[str, str], inside_article: bool) -> bool:
    """Whether an element is no part of an article by its tag, state or role, or as a thread of comments."""
    if tag in DROPPED:
        return True
    if tag == "header":
        return not inside_article  # an article's own header holds its title
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    if ROLES.intersection(attrs.get("role", "").lower().split()):
        return True
    return any(COMMENTS.intersection(words) for _, words in _names(attrs))


def _names(attrs: dict[str, str]):
    """(words, words and joined neighbours) of each name in class and id that says what the element is."""
    for key in ("class", "id"):
        for name in attrs.get(key, "").split():
            words = [w.lower() for w in _NAME.findall(name)]
            if words and not STATES.intersection(words):  # "no-sidebar", "has-comments": about the page
                # "side-bar" counts as "sidebar"
                yield words, {*words, *(a + b for a, b in zip(words, words[1:], strict=False))}


def _kind(tag: str, attrs: dict[str, str], inside_article: bool) -> str:
    """What an element's names say it is: a key of ``DISCOUNT``, or nothing."""
    if not attrs or tag in ("html", "body", "article", "main"):
        return ""
    for words, joined in _names(attrs):
        if SURE.intersection(joined):
            return "sure"
        if "header" in words and not inside_article and not TITLES.intersection(words):
            return "title" if "page" in words else "sure"
        named = AWAY.intersection(words)
        if named and (words[-1] in AWAY or all(w in AWAY or w in LAYOUT for w in words)):
            return "links" if words[-1] in LINKS or named <= LINKS else "weak"
    return ""


class _Builder:
    """The tree in the making: the open node and, so that nothing has to walk up for them, the open blocks, the open
    cells (with their tables) and how many elements of each tag are open."""

    def __init__(self):
        self.root = self.node = Node("#root", None)
        self.blocks: list[Node] = []
        self.cells: list[Node] = []
        self.open: Counter[str] = Counter()

    def enter(self, tag: str, kind: str = "") -> None:
        child = Node(tag, self.node, kind)
        self.node.children.append(child)
        self.node = child
        self.open[tag] += 1
        if tag in BLOCKS:
            self.blocks.append(child)
        if tag in CELLS:
            self.cells.append(child)

    def leave(self, tag: str) -> None:
        """Closes the innermost open element of the tag, and all inside it."""
        if not self.open[tag]:
            return
        while True:
            own = self.node
            self.open[own.tag] -= 1
            if self.blocks and self.blocks[-1] is own:
                self.blocks.pop()
            if self.cells and self.cells[-1] is own:
                self.cells.pop()
            self.node = own.parent
            if own.tag == tag:
                return

    def close_before(self, tag: str) -> None:
        """Closes what ends where an element of this tag begins."""
        if tag in CLOSED_BY["p"] or tag in ITEMS:
            inner = self.blocks[-1].tag if self.blocks else ""
            if inner in CLOSED_BY and inner not in CELLS and tag in CLOSED_BY[inner]:
                self.leave(inner)
                if inner == "p":
                    self.close_before(tag)
        if tag in CLOSED_BY["td"]:
            for own in ("td", "th", "tr"):
                if tag in CLOSED_BY[own] and self.cells and self.cells[-1].tag == own:
                    self.leave(own)
        if tag == "option" and self.node.tag == "option":
            self.leave("option")

    @property
    def in_article(self) -> bool:
        return self.open["article"] + self.open["main"] > 0


def parse(page: str) -> Node:
    """The tree of a page without the parts whose tag, role or state says that they are no article."""
    tree = _Builder()
    at, size = 0, len(page)
    skipping: list[str] = []  # open elements inside one that is left out
    skipped: Counter[str] = Counter()

    def text(start: int, end: int) -> None:
        if end > start and not skipping:
            tree.node.children.append(page[start:end])

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            text(at, size)
            break
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            text(at, lt)
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            continue
        name = _NAME_OF_TAG.match(page, lt + 1)
        if name is None:
            text(at, lt + 1)  # an ordinary character
            at = lt + 1
            continue
        text(at, lt)
        found = _tag_end(page, name.end())
        if found is None:
            break  # a tag that the end cuts off
        at, attrs, closed = found
        tag = name[2].lower()
        if name[1]:
            ends_all = tag in ("body", "html", "article", "main") and tree.open[tag] > 0
            if skipping:
                if skipped[tag]:
                    while True:
                        last = skipping.pop()
                        skipped[last] -= 1
                        if last == tag:
                            break
                    if skipping or not ends_all:
                        continue
                elif ends_all:
                    skipping, skipped = [], Counter()
                else:
                    continue
            tree.leave(tag)
            continue
        empty = tag in VOID or closed
        if skipping:
            if not empty:
                if tag in RAW:
                    at = _raw_end(page, tag, at)
                elif skipping[-1] in CLOSED_BY and tag in CLOSED_BY[skipping[-1]] and len(skipping) > 1:
                    skipped[skipping[-1]] -= 1
                    skipping[-1] = tag
                    skipped[tag] += 1
                elif skipping == ["p"] and tag in CLOSED_BY["p"]:
                    skipping, skipped = [], Counter()
                else:
                    skipping.append(tag)
                    skipped[tag] += 1
            if skipping or empty or tag in RAW:
                continue
        if tag == "br":
            tree.node.children.append(" ")
            continue
        in_paragraph = bool(tree.blocks) and tree.blocks[-1].tag in PARAGRAPHS
        if tag in RAW or tag == "svg" and not in_paragraph:
            at = at if empty else _raw_end(page, tag, at)
            continue
        tree.close_before(tag)
        if empty:
            if tag == "hr":
                tree.node.children.append(Node("hr", tree.node))
            continue
        apart = tag in ("label", "button") and not in_paragraph or tag in DRAWN and tree.open["svg"] > 0
        if apart or _away(tag, attrs, tree.in_article):
            skipping, skipped = [tag], Counter([tag])
            if tag in BLOCKS:
                tree.node.children.append(Node("hr", tree.node))  # blocks on either side stay apart
            continue
        tree.enter(tag, _kind(tag, attrs, tree.in_article))
    return tree.root


def _open(node: Node | None, tag: str) -> Node | None:
    while node is not None and node.tag != tag:
        node = node.parent
    return node


def _raw_end(page: str, tag: str, at: int) -> int:
    m = _raw_close(tag).search(page, at)
    return m.end() if m else len(page)


@lru_cache(maxsize=None)  # of the tags in RAW
def _raw_close(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def _walk(root: Node):
    """Nodes in document order, without recursion: pages nest as deep as they like."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [c for c in reversed(node.children) if type(c) is Node]


@dataclass
class Sizes:
    """Of what is below a node: characters, those inside links, blocks of text and their points."""

    text: int = 0
    link: int = 0
    blocks: int = 0
    points: float = 0.0

    @property
    def density(self) -> float:
        return self.link / self.text if self.text else 0.0


def points_of(text: str) -> float:
    """The points of a block with this text."""
    points = 1 + text.count(",") + min(len(text) // 100, 3)
    return points if len(text) >= SHORT else points / 4


def sizes_of(root: Node) -> dict[int, Sizes]:
    out: dict[int, Sizes] = {}
    for node in reversed(list(_walk(root))):
        own = Sizes()
        for c in node.children:
            if type(c) is Node:
                s = out[id(c)]
                own.text, own.link, own.blocks, own.points = own.text + s.text, own.link + s.link, own.blocks + s.blocks, own.points + s.points
            else:
                own.text += len(c.strip())
        if node.tag == "a":
            own.link = own.text
        if text := _own_text(node):
            own.blocks, own.points = own.blocks + 1, own.points + points_of(text)
        out[id(node)] = own
    return out


def cut_named(root: Node) -> Node:
    """Cuts the parts that names discount below what else is there, and labels and buttons outside sentences."""
    sizes = sizes_of(root)
    titles = sum(n.tag == "h1" and sizes[id(n)].text > 0 for n in _walk(root))
    stack = [(root, sizes[id(root)].points)]
    while stack:
        node, scope = stack.pop()
        if node.tag in ("article", "main"):
            scope = sizes[id(node)].points
        prose = [k for k, c in enumerate(node.children) if type(c) is str and any(map(str.isalnum, c))]
        for k, c in enumerate(node.children):
            if type(c) is str:
                continue
            if c.tag == "label" and not prose or c.tag == "button" and not (prose and prose[0] < k < prose[-1]):
                node.children[k] = ""
            elif c.kind and not _outweighs(c.kind, sizes[id(c)], scope):
                inside = [n for n in _walk(c) if n.tag == "h1" and sizes[id(n)].text] if c.kind == "title" else []
                gap = Node("hr" if c.tag in BLOCKS else "span", node)  # blocks on either side stay apart
                if len(inside) == titles == 1:  # the page's only title
                    gap = inside[0]
                    gap.parent = node
                node.children[k] = gap
            else:
                stack.append((c, scope))
    return root


def _outweighs(kind: str, own: Sizes, scope: float) -> bool:
    """Whether a part stays in spite of its name."""
    if kind == "links" and own.blocks and own.density < 0.2 and own.text >= 40 * own.blocks:
        return True
    if kind in ("sure", "title") and own.points < SURE_POINTS:
        return False
    return DISCOUNT[kind] * own.points > scope - own.points + 1e-9


def blocks(nodes: list[Node | str]) -> list[str]:
    """Texts of the blocks below the nodes, in page order."""
    found: list[str] = []
    piece: list[str] = []

    def flush():
        text = _SPACE.sub(" ", entities.unescape("".join(piece))).strip()
        piece.clear()
        if text:
            found.append(text)

    stack: list[Node | str | None] = list(reversed(nodes))
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif type(item) is str:
            piece.append(item)
        else:
            if item.tag in BLOCKS:
                flush()
                stack.append(None)
            stack += reversed(item.children)
    flush()
    return found


def _own_text(node: Node) -> str:
    """The text of a block without that of the blocks in it."""
    if node.tag not in BLOCKS and node.tag != "#root":
        return ""
    return "".join(c if type(c) is str else _inline(c) for c in node.children if type(c) is str or c.tag not in BLOCKS).strip()


def scores(root: Node, sizes: dict[int, Sizes]) -> list[Node]:
    """Gives ancestors the points of their paragraphs, discounted by links; returns the nodes that have some, in page
    order of the first block that gave them any."""
    scored: dict[int, Node] = {}
    for node in _walk(root):
        text = _own_text(node)
        if not text:
            continue
        points, share = points_of(text), 1.0
        # Text that stands in a container itself counts for the container.
        up = node.parent if node.tag in PARAGRAPHS else node
        while up is not None and points * share > 1e-9:  # beyond that, ancestors get nothing that shows
            up.score += points * share
            scored[id(up)] = up
            up, share = up.parent, share / 2
    for node in scored.values():
        node.score *= 1 - sizes[id(node)].density
    return list(scored.values())


def _inline(node: Node) -> str:
    parts, stack = [], [node]
    while stack:
        item = stack.pop()
        if type(item) is str:
            parts.append(item)
        elif item.tag not in BLOCKS:
            stack += reversed(item.children)
    return "".join(parts)


FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure address details".split())
PARTS = frozenset("ul ol dl li dt dd blockquote table tbody thead tr td th p pre figure figcaption".split())  # of an article, not the article


def _is_text(c: Node | str, sizes: dict[int, Sizes]) -> bool:
    return bool(c.strip()) if type(c) is str else sizes[id(c)].text > 0


def _linked(c: Node | str, sizes: dict[int, Sizes], prose: bool) -> bool:
    """Whether a part is mostly links; in a container with text of its own, inline links are words of it."""
    if type(c) is str or c.tag in HEADINGS or c.tag not in BLOCKS and prose:
        return False
    return sizes[id(c)].text > 0 and sizes[id(c)].density >= 0.5


def _spread(items: list[Node | str], is_article: list[bool], sizes: dict[int, Sizes]) -> list[Node | str]:
    """From the first to the last child that belongs to the article, without blocks of links."""
    belong = [k for k, yes in enumerate(is_article) if yes]
    prose = any(type(c) is str and c.strip() for c in items)
    return [c for k, c in enumerate(items) if belong and belong[0] <= k <= belong[-1] and (is_article[k] or not _linked(c, sizes, prose))]


def _is_flow(c: Node | str, sizes: dict[int, Sizes]) -> bool:
    """Paragraphs, headings, lists and bare text, with text that is not mostly links."""
    return _is_text(c, sizes) and (type(c) is str or (c.tag in FLOW or c.tag not in BLOCKS) and sizes[id(c)].density < 0.5)


def _points_in(c: Node | str, sizes: dict[int, Sizes]) -> float:
    return points_of(c.strip()) if type(c) is str else sizes[id(c)].points or (points_of("x" * sizes[id(c)].text) if sizes[id(c)].text else 0.0)


def _trimmed(node: Node, sizes: dict[int, Sizes]) -> list[Node | str]:
    """The children of a container, without boxes at its edges that hold no share of its points."""
    items = node.children
    flow = [_is_flow(c, sizes) for c in items]
    points = [_points_in(c, sizes) for c in items]
    most = max(points, default=0.0)
    boxes = sum(p for p, f in zip(points, flow, strict=True) if not f)
    if node.tag not in ("body", "html", "#root") and boxes <= sum(points) / 2:
        return _spread(items, [not _linked(c, sizes, any(flow)) for c in items], sizes)
    return _spread(items, [f or p > 0 and p >= STRONG * most and not _linked(c, sizes, False) for c, f, p in zip(items, flow, points, strict=True)], sizes)


def _around(best: Node, sizes: dict[int, Sizes]) -> list[Node | str]:
    """The best container and what belongs to it beside it and beside its ancestors."""
    kept: list[Node | str] = _trimmed(best, sizes)
    held = sizes[id(best)].points
    while (up := best.parent) is not None and best.tag not in ("body", "html"):
        items = up.children
        others = [c for c in items if c is not best and _is_text(c, sizes) and not _linked(c, sizes, False)]
        strong = {id(c) for c in others if not _is_flow(c, sizes) and _points_in(c, sizes) >= max(STRONG * held, 1.0)}
        flow = [c for c in others if _is_flow(c, sizes)]
        several = len(flow) > 1 or any(type(c) is Node and sizes[id(c)].text > 80 for c in flow)
        joined = several and sum(_points_in(c, sizes) for c in flow) >= SEVERAL * held
        if others and not strong and not joined:
            return [part for c in items for part in (kept if c is best else [c] if type(c) is Node and c.tag == "h1" else [])]
        belongs = [c is best or id(c) in strong or (joined and _is_flow(c, sizes)) or type(c) is Node and c.tag == "h1" for c in items]
        whole = _spread(items, belongs, sizes)
        if len(whole) > 1:
            inside = Node("div", None)
            inside.children = kept
            kept = [inside if c is best else c for c in whole]
        held += sum(_points_in(c, sizes) for c in whole if c is not best)
        best = up
    return kept


def main_text(page: str | None) -> str:
    """The article of a page."""
    if not page:
        return ""
    root = cut_named(parse(page))
    sizes = sizes_of(root)
    scored = scores(root, sizes)
    if not scored:
        return ""
    best = max(scored, key=lambda n: n.score)
    for tag in ("article", "main"):
        if (around := _open(best, tag)) is not None:
            return "\n".join(blocks(_with_siblings(around, sizes)))
    while best.parent is not None and best.tag in PARTS and not _lays_out(best, sizes):
        best = best.parent
    return "\n".join(blocks(_around(best, sizes)))


def _lays_out(node: Node, sizes: dict[int, Sizes]) -> bool:
    """Whether a cell is a column of the page: blocks stand in it, and it holds most of its table's points."""
    table = _open(node, "table") if node.tag == "td" and any(type(c) is Node and c.tag in BLOCKS for c in node.children) else None
    return table is not None and sizes[id(node)].points > sizes[id(table)].points / 2


def _with_siblings(best: Node, sizes: dict[int, Sizes]) -> list[Node | str]:
    """An ``article`` or ``main`` and its siblings that score at least a fifth of it or read like paragraphs."""
    if best.parent is None:
        return [best]
    least = max(2.0, best.score * STRONG)
    kept: list[Node | str] = []
    for s in best.parent.children:
        if s is best:
            kept.append(s)
        elif type(s) is Node:
            own = sizes[id(s)]
            scores_well = s.tag in ("article", "main", "section", "div") and s.score >= least and own.density < 0.25
            reads = s.tag in ("p", "blockquote", "pre") and own.text > 80 and own.density < 0.25
            if scores_well or reads or s.tag == "h1":
                kept.append(s)
    return kept


def with_main_text(pages: DataFrame, into: str = "text", html_col: str = "html") -> DataFrame:
    """``pages`` with the article text in column ``into``."""

    @F.arrow_udf(T.StringType())
    def extract(pages_: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages_], pa.string())

    return small_batches(pages).withColumn(into, extract(F.col(html_col).cast("string")))
