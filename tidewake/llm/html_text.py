"""Operator 3, HTML extraction by composite text density.

Every DOM node gets its link-adjusted characters per tag (composite text density); the node whose children's densities
have the largest sum is found, and the lowest density on its path to the body is the threshold. That subtree is the main
text, with what lies beside its path and is as dense as the threshold and has a fair share of the largest sum, or is of
the same kind as the path, or stands between a heading and it; and with headings and single blocks beside the path. Inside
it, lists and boxes of links that are less dense than the threshold (menus without a name) go.

Names of elements, classes, ids and roles (nav, footer, advert, comments and the like) take a subtree's density and its
part in the sums around it, but never of one that holds most of the page's text: a wrapper keeps its density.
Only what is never text (scripts, styles, form controls, pictures) is left out beforehand.

Defined results: null, empty or textless pages give the empty string; unclosed, misnested and truncated markup is read
as browsers do in the common cases, in time that grows with the page's length; plain text without tags is one block; on
ties the outermost and first node wins; repeated rows give equal texts; long pages are read whole; an empty table gives
an empty result; other input columns are ignored, and kept ones named text or n_chars are an error.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewake.llm.common import map_texts, text_or_empty

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never text, with all they hold; of the first, the rest of the page where no end tag follows.
TO_THE_END = frozenset("script style textarea title xmp".split())
RAW = TO_THE_END | frozenset("iframe noembed noframes noscript template svg select button option datalist canvas audio video object".split())
#: Searched in the page itself, as lower() changes the length of some characters (U+0130).
RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I | re.A) for name in RAW}
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A single block of text: it belongs to the node around it and is not chosen for itself.
SINGLE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre caption figcaption legend summary address tr th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Inside the main text, boxes of these kinds go where links fill them.
BOX = frozenset("ul ol div section menu center".split())
#: Names that hint at what is not the article: elements, roles, and words of classes and ids.
TAG_HINTS = frozenset("nav footer aside menu dialog search form fieldset header".split())
ROLE_HINTS = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
READERS = frozenset("comment comments commentlist reply replies respond disqus".split())
WORD_HINTS = READERS | frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adslot adunit banner banners promo promos promotion sponsor sponsored sponsors cookie cookies consent "
    "gdpr notice notices alert newsletter subscribe subscription popup modal overlay nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars side aside "
    "footer header masthead topbar share sharing social related recommended recommendations widget widgets toolbar pagination pager skip login signin signup search".split()
)
#: Words after these say what is not there, or how a page is laid out; a token that ends in the latter names a layout.
FLAGS = frozenset("has have no non not with without hide is and".split())
LAYOUTS = frozenset("layout on off enabled disabled open closed article post page text".split())
#: The head of an article holds its title; any other header is hinted.
ARTICLE_WORDS = frozenset("article entry post story title content section".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: A hint holds if the rest of the page has so much of the subtree's text without links.
REST, REST_OF_READERS = 0.5, 0.1
#: The share of the largest density sum that a subtree elsewhere needs to be main text too.
FAIR_SHARE = 0.15
#: The part of the threshold that a short neighbour of the same kind needs.
NEARLY = 0.25
#: What a start tag closes, and where the search for it ends.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "parent", "children", "attributes", "hint", "chars", "tags", "link_chars", "link_tags", "density", "total", "cut")

    def __init__(self, name: str, parent: Node | None, attributes: str = "", hint: float = 0.0):
        self.name, self.parent, self.children, self.attributes, self.hint = name, parent, [], attributes, hint
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.cut = False  # the hint holds

    def inner(self) -> list[Node]:
        return [c for c in self.children if type(c) is Node]


def attributes_of(text: str) -> dict[str, str]:
    """Names in small letters and values; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), "".join(values))
    return out


def word_hint(token: str) -> float:
    words = [w.lower() for w in WORD.findall(token)]
    for i, w in enumerate(words):
        if w in FLAGS:
            words = words[:i]
            break
    if not words or words[-1] in LAYOUTS:
        return 0.0
    own = WORD_HINTS.intersection(words)
    if ARTICLE_WORDS.intersection(words):
        own -= {"header"}
    return 0.0 if not own else REST_OF_READERS if own & READERS else REST


def hint_of(name: str, attributes: str, inside_article: bool) -> float:
    """0 without a hint, else the share of its text that the rest of the page must have for it to hold."""
    if name in ("html", "body", "article", "main") or name in HEADINGS or name not in BLOCK and "-" not in name:
        return 0.0
    if name in TAG_HINTS and not (name == "header" and inside_article):
        return REST
    best = word_hint(name) if "-" in name else 0.0
    if not attributes:
        return best
    own = attributes_of(attributes)
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or own.get("role", "").lower() in ROLE_HINTS or re.search(r"display\s*:\s*none", own.get("style", ""), re.I):
        return REST
    tokens = f"{own.get('class', '')} {own.get('id', '') if name != 'p' else ''}".split()
    return min((h for t in tokens if (h := word_hint(t))), default=best)


def parse(page: str) -> Node:
    """The tree of a page; texts are children that are strings. Each tag costs the elements that it closes, no more."""
    root = Node("html", None)
    stack, blocks = [root], [0]
    places: dict[str, list[int]] = defaultdict(list)  # of each open element by name
    no_end: set[str] = set()  # raw elements without an end tag in the rest of the page
    articles = at = 0

    def close(place: int) -> None:
        nonlocal articles
        while len(stack) > place:
            node = stack.pop()
            places[node.name].pop()
            if blocks[-1] == len(stack):
                blocks.pop()
            articles -= node.name in ("article", "main")

    def innermost(names) -> int:
        return max((places[n][-1] for n in names if places[n]), default=-1)

    while True:
        found = TOKEN.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text:
            stack[-1].children.append(html.unescape(text))
        if not found:
            return root
        at, name = found.end(), (found[2] or "").lower()
        if not name or name in ("html", "body"):
            continue
        if found[1]:
            place = innermost((name,))
            if place > 0 and (name in BLOCK or place > blocks[-1]):
                close(place)
            elif name == "br":
                stack[-1].children.append(Node("br", stack[-1]))
            continue
        if name in BLOCK and stack[blocks[-1]].name == "p":
            close(blocks[-1])
        if name in CLOSES:
            names, stop = CLOSES[name]
            if (place := innermost(names)) > innermost(stop):
                close(place)
        if name in RAW:
            if found[3].endswith("/") and name == "svg":
                continue
            end = None if name in no_end else RAW_END[name].search(page, at)
            if end:
                at = page.find(">", end.start()) + 1 or len(page)
            elif name in TO_THE_END:
                at = len(page)
            else:
                no_end.add(name)
            continue
        node = Node(name, stack[-1], found[3], hint_of(name, found[3], articles > 0))
        node.parent.children.append(node)
        if name in VOID or found[3].endswith("/") and name not in BLOCK and name != "a":
            continue
        if name in BLOCK:
            blocks.append(len(stack))
        places[name].append(len(stack))
        stack.append(node)
        articles += name in ("article", "main")


def walk(root: Node) -> list[Node]:
    """All nodes outside subtrees whose hint holds, and the roots of these; parents first."""
    out = [root]
    for node in out:
        if not node.cut:
            out += node.inner()
    return out


def count(nodes: list[Node]) -> None:
    """Characters and tags of each node, without those of subtrees whose hint holds."""
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for c in node.children:
            if type(c) is str:
                node.chars += len(c.strip()) if len(c) < 64 else len(c)
            elif not c.cut:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.name == "a")
        if node.name == "a":
            node.link_chars = node.chars


def hold_hints(root: Node) -> None:
    """Decide which hints hold: one of a subtree with most of the text does not, and those inside it are looked at then."""
    nodes = walk(root)
    hinted = [n for n in nodes if n.hint]
    if not hinted:
        return
    count(nodes)
    plain = lambda n: n.chars - n.link_chars
    under: dict[int, list[Node]] = defaultdict(list)  # hinted nodes by the nearest hinted node above
    above: dict[int, int] = {id(root): id(root)}
    for node in nodes:
        if node.parent:
            above[id(node)] = id(node.parent) if node.parent.hint else above[id(node.parent)]
            if node.hint:
                under[above[id(node)]].append(node)
    content = {id(root): 0}  # paragraphs and the like, which a wrapper of the article holds and a short notice does not
    for node in reversed(nodes):
        own = content.setdefault(id(node), 0) + (node.name in ("p", "li", "br")) + 2 * (node.name in ("h1", "article", "main"))
        content[id(node)] = own
        if node.parent:
            content[id(node.parent)] = content.get(id(node.parent), 0) + own
    free = plain(root) - sum(map(plain, under[id(root)]))
    todo = [(-plain(n) * n.hint, i, n) for i, n in enumerate(under[id(root)])]
    heapq.heapify(todo)
    number = len(todo)
    while todo:
        size, _, node = heapq.heappop(todo)
        if -size > free and (content[id(node)] > 1 or plain(node) > 300):
            free += plain(node) - sum(map(plain, under[id(node)]))
            for c in under[id(node)]:
                heapq.heappush(todo, (-plain(c) * c.hint, number, c))
                number += 1
        else:
            node.cut = True


def weigh(root: Node) -> list[Node]:
    """Densities and their sums; the nodes of walk()."""
    nodes = walk(root)
    count(nodes)
    share = root.link_chars / root.chars if root.chars else 0.0

    def density(c: int, t: int, lc: int, lt: int) -> float:
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        return c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / base

    for node in nodes:
        if node.chars and not node.cut:
            node.density = density(node.chars, max(node.tags, 1), node.link_chars, node.link_tags)
    for node in nodes:
        if node.chars and not node.cut and (node is root or node.name in BLOCK and node.name not in SINGLE):
            own = sum(len(c.strip()) for c in node.children if type(c) is str)  # text of its own counts as one child
            node.total = (density(own, 1, 0, 0) if own else 0.0) + sum(c.density for c in node.inner())
    return nodes


def is_heading(node: Node) -> bool:
    """All its text is in headings."""
    todo = [node]
    for own in todo:
        if own.name in HEADINGS:
            continue
        if any(type(c) is str and c.strip() for c in own.children):
            return False
        todo += [c for c in own.inner() if not c.cut]
    return True


def alike(c: Node, on: Node, threshold: float) -> bool:
    """Of the same element and class; what tells nothing, such as a plain div, must be nearly as dense as the threshold.

    Composite density grows with a subtree's size, so a short section is less dense than all of the article."""
    classes = [attributes_of(n.attributes).get("class", "") for n in (c, on)]
    telling = classes[0] or c.name not in ("div", "td", "center")
    return c.name == on.name and classes[0] == classes[1] and (telling or c.density >= NEARLY * threshold)


def main_nodes(root: Node) -> tuple[list[Node], float]:
    """Roots of the main text, and the threshold of density."""
    hold_hints(root)
    nodes = weigh(root)
    best = max(nodes, key=lambda n: n.total)
    if not best.total:
        return [root], 0.0
    threshold, up = best.density, best
    while up:
        threshold, up = min(threshold, up.density), up.parent
    largest: dict[int, Node] = {}
    for node in reversed(nodes):
        own = node
        for c in () if node.cut else node.inner():
            if largest[id(c)].total > own.total:
                own = largest[id(c)]
        largest[id(node)] = own
    kept, todo = [], [root]
    while todo:
        node = todo.pop()
        own = largest[id(node)]
        if own is node or not own.total:
            kept.append(node)
            continue
        path, up = {}, own
        while up is not node:
            path[id(up.parent)] = up
            up = up.parent
        at, title = node, False
        while at is not own:
            on, before = path[id(at)], True
            for c in at.inner():
                if c is on:
                    before = False
                if c is on or c.cut or not c.chars or c.name not in BLOCK:
                    continue
                text = 2 * c.link_chars < c.chars
                if text and (c.name == "header" or is_heading(c)):
                    title = title or before
                    kept.append(c)
                elif text and c.name in SINGLE and c.density >= threshold:
                    kept.append(c)
                elif c.total and text and (before and title or alike(c, on, threshold) or c.density >= threshold and c.total >= FAIR_SHARE * best.total):
                    todo.append(c)
            at = on
        kept.append(own)
    return kept, threshold


def dropped(node: Node, threshold: float) -> bool:
    """Inside the main text: a subtree whose hint holds, or a box that links fill and that is below the threshold."""
    return node.cut or node.density < threshold and node.name in BOX and 2 * node.link_chars > node.chars


def render(root: Node, kept: list[Node], threshold: float) -> str:
    chosen = {id(n) for n in kept}
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            if text := SPACE.sub(" ", "".join(line)).strip():
                blocks.append(text)
            line.clear()

    todo: list[tuple[Node | str | None, bool]] = [(root, False)]
    while todo:
        item, inside = todo.pop()
        if item is None:
            flush()
        elif type(item) is str:
            if inside:
                line.append(item)
        elif item.name == "br":
            if inside:
                line.append("\n")
        elif id(item) in chosen or not (dropped(item, threshold) if inside else item.cut):
            inside = inside or id(item) in chosen
            block = item.name in BLOCK
            if block:
                flush()
                todo.append((None, inside))
            todo += [(c, inside) for c in reversed(item.children)]
    flush()
    return "\n".join(blocks)


def extract(page: str) -> str:
    root = parse(page)
    return render(root, *main_nodes(root))


def extract_pages(df: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars (code points) of every row."""
    if {"text", "n_chars"}.intersection(keep):
        raise ValueError("columns named text and n_chars are made here")
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(x.as_py()) for x in batch.column(len(keep))]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*keep, "text", "n_chars"])

    return map_texts(df.select(*keep, text_or_empty(page).alias("__page")), "__page", ", ".join([*kinds, "text string", "n_chars long"]), lambda: work)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
