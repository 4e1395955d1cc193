"""Operator 10: the main text of a page, by scoring its tree.

Paragraphs, and text that stands in a container itself, give points for their length and their commas to
their ancestors (whole to the container, less to those above). A container's points are discounted by its
link density. The best container is kept, with those siblings that score well enough or that are text rather
than links; menus, headers, footers, sidebars, notices, adverts, forms and comments inside them are left out.

Defined results: a null or empty page has an empty text; markup that is never closed ends with its parent,
and so do scripts, styles and other raw elements (at the parent's end tag, else with the page); an unfinished
tag at the end is dropped and an unfinished character reference is kept as it stands, also where markup cuts
it; a page without any paragraph falls back to its body. Pages are read whole, in time linear in their length
whatever their nesting. Other columns aren't read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, whole

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
DROP = frozenset("script style noscript iframe template svg math head title nav header footer aside form button select textarea menu dialog object embed canvas audio video xmp noembed noframes input option".split())
BLOCK = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head title br".split())
CLOSES_P = BLOCK - {"br", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: An element that opens ends those of its row, up to the nearest one of the second set.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
PARAGRAPH = frozenset("p pre td blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
CONTAINER = frozenset("article main section div body td blockquote center".split())
#: Words in class, id or role that mark what isn't the article.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|foot|side-?bar|aside|cookie\w*|consent|notice|notification|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|disqus|replies|respond|pagination|pager|toolbar|widget|copyright|legal|search)(?:$|[\s_-])",
    re.I,
)
LIKELY = re.compile(r"article|body|content|entry|main|page|post|story|text", re.I)
#: What a p element that is still open doesn't reach beyond.
WALLS = CONTAINER | {"table", "button", "form"}
#: Siblings of the best container that are text whatever their points, if they aren't links.
TEXT = frozenset("p pre blockquote ul ol dl table figure h1 h2 h3 h4 h5 h6 b i em strong span font q cite code abbr br hr".split())
_SENTENCE = re.compile(r"[.!?:\u2026\u3002]\W*$")
BONUS = {"article": 25.0, "main": 25.0, "section": 3.0, "div": 5.0, "td": 3.0, "blockquote": 3.0}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("chars", "commas", "drop", "ended", "hint", "items", "likely", "links", "parent", "points", "tag")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.items: list = []  # texts and nodes in order
        self.points = 0.0
        self.drop = False
        self.likely = False
        self.hint = ""


class _Open:
    """The elements that are open, with the places of each tag, so that none is looked for among the others."""

    def __init__(self, root: Node):
        self.stack, self.at, self.walls = [root], {}, []

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in WALLS:
            self.walls.append(len(self.stack))
        self.stack.append(node)

    def close(self, place: int) -> None:
        """End the element at that place and all inside it."""
        while len(self.stack) > place:
            tag = self.stack.pop().tag
            self.at[tag].pop()
            if tag in WALLS:
                self.walls.pop()

    def last(self, tag: str) -> int:
        return self.at[tag][-1] if self.at.get(tag) else 0

    def first_after(self, tags, place: int) -> int:
        """The outermost element of these tags inside the one at that place; 0 where there is none."""
        found = [own[k] for t in tags if (own := self.at.get(t)) and (k := bisect_right(own, place)) < len(own)]
        return min(found, default=0)


class _Ends:
    """Where the end tags of an element come next. The page is searched forwards once for each tag."""

    def __init__(self, html: str):
        self.html, self.known = html, {}

    def next(self, tag: str, at: int) -> tuple[int, int] | None:
        found = self.known.get(tag, (-1, -1))
        if found is not None and found[0] < at:
            m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(self.html, at)
            found = self.known[tag] = m.span() if m else None
        return found


def parse(html: str) -> Node:
    """A tree; elements whose end is missing are closed by their parent's end or by what can't stand inside them."""
    root = Node("html", None)
    opened, ends, at, n = _Open(root), _Ends(html), 0, len(html)
    while at < n:
        now = opened.stack[-1]
        lt = html.find("<", at)
        if lt < 0:
            now.items.append(html[at:])
            break
        if lt > at:
            now.items.append(html[at:lt])
        m = _TOKEN.match(html, lt)
        if not m:
            now.items.append("<")
            at = lt + 1
            continue
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                now.items.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if not m[4]:
            break  # the page ends inside a tag
        tag = m[2].lower()
        if m[1]:
            place = opened.last(tag)
            if place:
                opened.close(place)
            elif tag == "p":
                now.items.append(Node("br", now))
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            place = opened.last("p")
            if place and place > (opened.walls[-1] if opened.walls else 0):
                opened.close(place)
        if tag in ENDS:
            own, stop = ENDS[tag]
            place = opened.first_after(own, max(opened.last(t) for t in stop))
            if place:
                opened.close(place)
        now = opened.stack[-1]
        node = Node(tag, now)
        now.items.append(node)
        node.drop = tag in DROP
        if m[3]:
            for a in _ATTRIBUTE.finditer(m[3]):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key in ("class", "id", "role"):
                    node.drop |= bool(UNLIKELY.search(value)) and tag not in ("article", "main", "body") or value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog")
                    node.likely |= bool(LIKELY.search(value))
                    node.hint = node.hint or (value if key == "class" else "")
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    node.drop = True
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = ends.next(tag, at)
            over = None if end else ends.next(now.tag if now is not root else "body", at)
            at = end[1] if end else over[0] if over else n
            continue
        opened.push(node)
    return root


def _plain(text: str) -> str:
    return _SPACE.sub(" ", unescape(text) if "&" in text else text).strip()


def _measure(root: Node) -> list[Node]:
    """Set chars, links, commas and whether the text ends like a sentence, of all kept nodes; they are returned parents first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        node.chars = node.links = node.commas = 0
        node.ended = False
        for x in node.items:
            if isinstance(x, str):
                own = _plain(x)
                node.chars += len(own)
                node.commas += own.count(",") + own.count("\u3001") + own.count("\uff0c")
                node.ended = bool(_SENTENCE.search(own[-20:])) if own else node.ended
            elif not x.drop:
                todo.append(x)
    for node in reversed(order):
        if node.tag == "a":
            node.links = node.chars
        if node.parent is not None and node is not root:
            node.parent.chars += node.chars
            node.parent.links += node.links
            node.parent.commas += node.commas
            node.parent.ended |= node.ended
    return order


def _density(node: Node) -> float:
    return node.links / node.chars if node.chars else 0.0


def _points(chars: int, commas: int) -> float:
    return 1 + commas + min(chars / 100, 3.0)


def best_nodes(root: Node) -> list:
    """The best container and the siblings and texts that are kept with it, in page order."""
    order = _measure(root)
    scored: dict[int, Node] = {}

    def give(points: float, up: Node | None) -> None:
        share = 1.0
        for depth in range(1, 5):
            if up is None:
                break
            up.points += points * share
            scored[id(up)] = up
            up, share = up.parent, 1.0 / (2 * depth)

    for node in order:
        if node.tag in PARAGRAPH and node.chars and node.parent is not None:
            give(_points(node.chars, node.commas) * (1 - _density(node)), node.parent)
        elif node.tag in CONTAINER and node is not root:
            own = " ".join(filter(None, (_plain(x) for x in node.items if isinstance(x, str))))
            if own:
                give(_points(len(own), own.count(",")), node)
    if not scored:
        return [root]
    for node in scored.values():
        node.points = (node.points + BONUS.get(node.tag, 0.0) + 25.0 * node.likely) * (1 - _density(node))
    top = max((x for x in order if id(x) in scored), key=lambda x: x.points)
    if top.parent is None:
        return [top]
    kept = []
    for x in top.parent.items:
        if isinstance(x, str):
            kept.append(x)
        elif x is top:
            kept.append(x)
        elif not x.drop and x.tag not in DROP and _density(x) < 0.33:
            scores = id(x) in scored and x.points >= 0.2 * top.points
            if scores or x.tag in TEXT or x.chars and (x.ended or x.chars > 80 or x.hint and x.hint == top.hint):
                kept.append(x)
    return kept


def text_of(nodes: list) -> str:
    """The text without what is dropped; white space inside a block is one space, and so is the space between blocks.

    References are decoded in each text by itself, so that markup doesn't join the halves of one.
    """
    out: list[str] = []
    chosen = {id(x) for x in nodes}
    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(unescape(x) if "&" in x else x)
        elif not x.drop or id(x) in chosen:
            if x.tag in BLOCK:
                out.append(" ")
                todo.append(" ")
            todo.extend(reversed(x.items))
    return _SPACE.sub(" ", "".join(out)).strip()


def extract(html: str) -> str:
    """The main text of one page."""
    return text_of(best_nodes(parse(html))) if html else ""


def main_text(pages: DataFrame, html: str = "html", keep_columns: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep_columns`` with main_text."""
    ship(pages.sparkSession)
    base = pages.select(*keep_columns, whole(html).alias("main_html"))
    n = len(keep_columns)

    def run(batches):
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], [*keep_columns, "main_text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:n])
    return base.mapInArrow(run, f"{fields}, main_text string")


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    found = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
