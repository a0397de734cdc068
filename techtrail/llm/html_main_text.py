"""Main text of web pages by tree scoring.

A page becomes a tree. Every block's own text passes points, for its length and commas, less the share of it that is in links, to its ancestors: all to the
container around it, half to the next one, less further up. Elements that are seldom article (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments), by tag, role and class names, weigh the points of all that is in them down; nothing is cut for its name alone. A
container's points are discounted by the share of its text that is in links; an article or main element, or a class name such as "content", is worth a quarter
more. The best container is kept, with siblings that score well, are plain paragraphs or headings, or belong to the same article element. In what is kept, an
element that is weighed down goes if less than a quarter of the weighed points is its own. Scripts, styles, controls and
hidden elements are never read.

Defined results: null, empty and unparsable html give an empty text; unclosed and misplaced tags are closed where the next block, item or ancestor
says so; a tag without an end ends the page, and after an attribute without an end quotes are plain characters; ties between containers
go to the first; rows are independent, so repeated rows have equal results; an empty table gives an empty result. Pages of any length are read whole, in time in
proportion to their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from techtrail.llm.common import small_batches

START = re.compile(r"<(?:!--|[!?]|/?[A-Za-z])")
TAG_NAME = re.compile(r"[^\s/>]*")
COMMENT_END = re.compile(r"--!?>")
TAG_PART = re.compile(r"""=\s*["']|>""")
NAMES = re.compile(r"""(?:^|\s)(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Kinds of elements.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What may stand before the body, and does not open it.
BEFORE_BODY = set("head base basefont bgsound link meta noframes noscript script style template title".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
INLINE = {"a", "b", "em", "i", "p", "span", "strong"}
#: Elements without text of their own.
UNSEEN = set("audio button canvas datalist embed head iframe input map math meter noscript object option output progress script select style svg template textarea title video".split())
#: What an element's start closes, by the first such element that is open; and where the search for it ends.
CLOSES_P = BLOCK - {"body", "html", "caption", "legend", "td", "th", "tr", "tbody", "thead", "tfoot"}
CLOSED_BY = {"li": "item", "dt": "term", "dd": "term", "tr": "row", "td": "cell", "th": "cell", "option": "option", **dict.fromkeys(CLOSES_P - {"li", "dt", "dd"}, "paragraph")}
OPENS = {"p": {"paragraph"}, "li": {"item"}, "dt": {"term"}, "dd": {"term"}, "tr": {"row"}, "td": {"row", "cell"}, "th": {"row", "cell"}, "option": {"option"}}
BOUNDS = {
    **dict.fromkeys("article body button div li section".split(), {"paragraph"}),
    **dict.fromkeys(("td", "th"), {"paragraph"}),
    **dict.fromkeys(("ul", "ol", "menu"), {"item"}),
    "dl": {"term"},
    "table": {"paragraph", "row", "cell"},
    "tr": {"cell"},
    "select": {"option"},
}

# Tags, roles and words of class names and ids that are seldom article.
LOW_TAGS = {"aside", "dialog", "fieldset", "footer", "form", "header", "menu", "nav", "search"}
LOW_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "note"}
LOW_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars rail menu menus nav navbar navigation topnav subnav breadcrumb breadcrumbs header masthead footer footers colophon cookie cookies consent gdpr notice notices notification notifications alert disclaimer popup modal overlay subscribe subscription newsletter signup login share sharing sharebar social related recommended recommendations widget widgets toolbar pager pagination skip outbrain taboola form search copyright".split()
)
#: Those that count for a paragraph or a piece of one too.
LOW_INLINE_WORDS = {"ad", "ads", "advert", "advertisement", "advertising", "cookie", "copyright", "notice", "promo", "related", "sponsored", "teaser"}
READER_WORDS = {"comment", "comments", "commentlist", "disqus", "replies", "reply", "respond"}
# What links and buttons under a reader's text say.
ANSWERS = set("reply|respond|answer|report|flag|like|upvote|quote|react|répondre|signaler|citer|j'aime|responder|denunciar|citar|me gusta|antworten|melden|zitieren|gefällt mir".split("|"))
DATE = re.compile(r"\b\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\b|\b\d{1,2}:\d\d\b|\b\d+ ?(?:s|m|h|d|w|min|mins|sec|second|minute|hour|day|week|month|year)s? ago\b|\b(?:il y a|hace|vor) \d+|\b(?:19|20)\d\d\b|\b(?:yesterday|today|just now)\b", re.IGNORECASE)
#: Siblings of one shape, each with a date and something to answer it by, that are readers' texts; and the characters of such a mark at most.
THREAD, MARK = 3, 40
GOOD_WORDS = {"article", "content", "main", "post", "entry", "story", "text", "blog", "hentry"}
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

#: What points are worth in such elements, and in reader comments.
LOW, READER = 0.1, 0.02
#: What points are worth more in elements that are mostly article.
GOOD = 1.25
#: Part of the kept points that an element which is weighed down must have to stay.
STAYS = 0.25
#: Points and part of the best's score that a sibling has at least.
SIBLING, SIBLING_PART = 10.0, 0.2
#: Ancestors that a block's points are passed to.
LEVELS = 10


class Node:
    __slots__ = tuple("tag parent children names role unseen open holds inside in_link home share weight strings own own_linked size linked mass points marks reader".split())

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.children, self.names, self.role, self.unseen = tag, parent, [], frozenset(), "", tag in UNSEEN
        self.open: dict[str, Node] = parent.open if parent else {}  # what a later start may close, by kind
        self.holds = 0  # 1 an article, 2 a main element
        self.marks, self.reader = 0, False  # 1 something to answer by, 2 a date; one of several readers' texts
        if tag in OPENS or tag in BOUNDS:
            self.open = {k: x for k, x in self.open.items() if k not in BOUNDS.get(tag, ())}
            for kind in OPENS.get(tag, ()):
                self.open.setdefault(kind, self)
        if attributes:
            self.read(attributes)

    def read(self, attributes: str) -> None:
        words: set[str] = set()
        for name, value in NAMES.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "role":
                self.role = value.strip().lower()
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN_STYLE.search(value):
                self.unseen = True
            elif name in ("class", "id"):
                words.update(x.lower() for x in WORDS.findall(value))
        self.names = frozenset(words)


class _Reader:
    """Where in a page the next tag ends; what was sought in vain is not sought again."""

    def __init__(self, html: str):
        self.html, self.last, self.quotes = html, html.rfind(">"), True

    def tag_end(self, at: int) -> int:
        """Place of the > of a tag, -1 if there is none."""
        if at > self.last:
            return -1
        begin = at
        while self.quotes:
            m = TAG_PART.search(self.html, at)
            if m and m[0] == ">":
                return m.start()
            at = self.html.find(m[0][-1], m.end()) + 1 if m else 0
            self.quotes = at > 0
        return self.html.find(">", begin)


def parse(html: str) -> Node:
    """The tree of a page; texts are its strings, with character references decoded."""
    root = here = Node("html", None)
    reader, counts = _Reader(html), Counter()
    at, end, opened = 0, len(html), False

    def implied() -> Node:
        """Where the next content goes: into a body, which text and elements open that can't stand before it."""
        nonlocal opened
        if opened or here is not root and here.tag != "head":
            return here
        opened = True
        root.children.append(body := Node("body", root))
        counts["body"] += 1
        return body

    def closed(node: Node) -> Node:
        """The parent of an open element, after it and all within it are closed."""
        x = here
        while x is not node:
            counts[x.tag] -= 1
            x = x.parent
        counts[x.tag] -= 1
        return x.parent

    while at < end:
        m = START.search(html, at)
        if m is None or m.start() > at:
            text = html[at : m.start() if m else end]
            if not text.isspace():
                here = implied()
            here.children.append(unescape(text))
        if m is None:
            break
        at = m.end()
        if m[0] == "<!--":
            close = COMMENT_END.search(html, at - 2)
            at = close.end() if close else end
            continue
        if m[0] in ("<!", "<?"):
            at = html.find(">", at) + 1 or end
            continue
        name = TAG_NAME.match(html, at - 1)
        tag, stop = name[0].lower(), reader.tag_end(name.end())
        if stop < 0:
            break
        attributes, at = html[name.end() : stop], stop + 1
        if m[0][1] == "/":  # an end tag closes up to the element of its name, if one is open
            if counts[tag] > 0:
                node = here
                while node.tag != tag:
                    node = node.parent
                here = closed(node)
            elif tag == "br":
                here.children.append(" ")
            continue
        if tag == "html" or tag == "body" and opened:
            continue
        if tag == "body":
            opened = True
        elif tag not in BEFORE_BODY:
            here = implied()
        if tag in CLOSES_P and (node := here.open.get("paragraph")):
            here = closed(node)
        if tag in CLOSED_BY and (node := here.open.get(CLOSED_BY[tag])):
            here = closed(node)
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(html, at)
            at = html.find(">", close.end()) + 1 if close else 0
            at = at or end  # no end tag, or one that does not end: neither do those after it
            continue
        node = Node(tag, here, attributes)
        here.children.append(node)
        if tag not in VOID:  # a slash at the end of a tag means nothing
            here = node
            counts[tag] += 1
    return root


def _marked(node: Node) -> int:
    """The marks that an element has itself, before what is not seen is taken out of it."""
    own = "".join(x for x in node.children if isinstance(x, str) and len(x) <= 2 * MARK).strip()
    marks = 2 if node.tag == "time" or 0 < len(own) <= MARK and DATE.search(own) else 0
    if node.tag in ("a", "button"):
        inner = [y for x in node.children[:4] if not isinstance(x, str) for y in x.children[:4] if isinstance(y, str)]
        said = " ".join([own, *inner][:5])[: 2 * MARK].strip(" \n\t()[]·|•↩0123456789").lower()
        marks |= said in ANSWERS
    return marks


def find_threads(order: list[Node]) -> None:
    """Marks readers' texts, whatever their names are: siblings of one shape most of which have a date and something to answer them by."""
    for node in reversed(order):
        if node.parent is not None:
            node.parent.marks |= node.marks
    for node in order:
        shapes: dict[tuple, list[Node]] = {}
        for x in node.children:
            if not isinstance(x, str) and x.tag in BLOCK and not x.holds:
                shapes.setdefault((x.tag, x.names), []).append(x)
        for alike in shapes.values():
            marked = [x for x in alike if x.marks == 3]
            if len(marked) >= THREAD and 2 * len(marked) >= len(alike):
                for x in alike:
                    x.reader = True


def share_of(node: Node) -> float:
    """What points in an element are worth."""
    tag, names = node.tag, node.names
    if tag in ("html", "body"):
        return 1.0
    if node.reader:
        return READER
    if names & READER_WORDS and (tag not in INLINE | HEADINGS | {"main"}) and node.holds < 2 and not (tag == "article" and names & {"content", "body"}):
        return READER
    if node.role in LOW_ROLES or tag in LOW_TAGS and not (tag == "header" and node.parent.inside):
        return LOW
    if tag in INLINE:
        return LOW if names & LOW_INLINE_WORDS else 1.0
    if tag in HEADINGS or tag in ("article", "main") or node.holds:
        return 1.0
    low = names & LOW_WORDS
    if names & GOOD_WORDS:
        low -= {"header"}
    return LOW if low else 1.0


def weighed(root: Node) -> list[Node]:
    """Fills in sizes, weights and points of all elements, and gives them in page order."""
    order: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.marks |= _marked(node)
        for x in node.children:
            if not isinstance(x, str) and x.tag == "button":
                node.marks |= _marked(x)
        node.children = [x for x in node.children if isinstance(x, str) or not x.unseen]
        node.strings, node.own, node.own_linked, node.size, node.linked, node.mass, node.points = [], 0, 0, 0, 0, 0.0, 0.0
        stack += [x for x in reversed(node.children) if not isinstance(x, str)]
    for node in reversed(order):
        if node.tag == "main" or node.tag == "article" and not node.names & READER_WORDS:
            node.holds = max(node.holds, 2 if node.tag == "main" else 1)
        if node.parent is not None:
            node.parent.holds = max(node.parent.holds, node.holds)
    find_threads(order)
    for node in order:
        up = node.parent
        node.inside = node.tag in ("article", "main") or bool(node.names & GOOD_WORDS) or up is not None and up.inside
        node.share = share_of(node)
        node.weight = node.share * (up.weight if up else 1.0)
        node.home = home = node if up is None or node.tag in BLOCK else up.home
        node.in_link = node.tag == "a" or up is not None and up.in_link
        for x in node.children:
            if isinstance(x, str) and not x.isspace():
                size = len(x) - x.count(" ")
                home.strings.append(x)
                home.own += size
                home.own_linked += size if node.in_link else 0
    for node in reversed(order):
        node.size += node.own
        node.linked += node.own_linked
        if node.own:
            points = node.own / 20
            if points >= 1:
                text = "".join(node.strings)
                points = 1 + text.count(",") + text.count("、") + text.count("，") + min(node.own / 100, 3)
            if node.tag in HEADINGS:  # as much as one short paragraph
                points = min(points, 1.0)
            points *= node.weight * (1 - node.own_linked / node.own)
            node.mass += points
            x, level = node if node.tag in ("div", "section", "article", "main", "body", "html") else node.parent, 0
            while x is not None and level < LEVELS:
                x.points += points * (1.0 if level == 0 else 0.5 if level == 1 else 1 / (3 * level))
                x, level = x.parent, level + 1
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.linked += node.linked
            node.parent.mass += node.mass
    return order


def score(node: Node) -> float:
    if not node.points or not node.size or node.tag == "html" and any(not isinstance(x, str) and x.tag == "body" for x in node.children):
        return 0.0
    good = node.share == 1.0 and (node.tag in ("article", "main") or node.names & GOOD_WORDS)
    return node.points * (1 - node.linked / node.size) * (GOOD if good else 1.0)


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack += [y for y in reversed(x.children) if not isinstance(y, str)]


def beside(x: Node, best: float, titled: bool) -> list[Node]:
    """What of a sibling of the best container is kept: all, nothing, or the headings of a title block."""
    if x.share < 1.0 or not x.size or x.linked / x.size >= 0.25 and x.tag not in BLOCK - HEADINGS - {"p"}:
        return []
    plain = x.linked / x.size < 0.25
    if x.tag in HEADINGS or x.tag == "p":
        return [x] if plain else []
    if score(x) >= max(SIBLING, SIBLING_PART * best):
        return [x]
    titles = [y for y in _walk(x) if y.tag == "h1"] if plain and not titled else []
    return titles if titles and 2 * sum(y.size for y in titles) >= x.size else []


def chosen(root: Node) -> tuple[list[Node | str], float]:
    """The best container and what goes with it, in page order, and the points that it has at most and goes nevertheless."""
    order = weighed(root)
    best = max(order, key=score)
    if score(best) <= 0:
        return [root], 0.0
    kept: list[Node | str] = [best]
    node, top = best, score(best)
    while node.parent is not None:
        around: list[Node | str] = []
        titled = any(not isinstance(x, str) and any(y.tag == "h1" for y in _walk(x)) for x in kept)
        for x in node.parent.children:
            if x is node:
                around += kept
                titled = True
            elif node.parent.inside:
                around.append(x)
            elif not isinstance(x, str):
                around += beside(x, top, titled)
        kept, node = around, node.parent
        if not node.inside:  # outside of an article, what is beside it, and no more
            break
    for x in _line(best):
        x.share = 1.0
    return kept, STAYS * sum(x.mass for x in kept if not isinstance(x, str))


def _line(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def blocks(nodes: list[Node | str], least: float) -> list[str]:
    """Texts of the blocks in page order, with single spaces; elements that are weighed down and have no more than some points are left out."""
    made: list[str] = []
    line: list[str] = []

    def end() -> None:
        if text := " ".join("".join(line).split()):
            made.append(text)
        line.clear()

    stack: list[Node | str | None] = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif x.share < 1.0 and x.mass <= least:
            continue
        elif x.tag in BLOCK:
            end()
            stack.append(None)
            stack += reversed(x.children)
        else:
            stack += reversed(x.children)
    end()
    return made


def main_text(html: str) -> str:
    return "\n\n".join(blocks(*chosen(parse(html))))


def extract(df: DataFrame, column: str = "html") -> DataFrame:
    """Adds, or replaces, text: the main text of the page in a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, column):
            texts = pa.array([main_text(x or "") for x in batch.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "text"])

    kept = df.drop("text")
    return kept.mapInArrow(run, kept.select("*", F.lit("").alias("text")).schema)


def op6_html_tree_scoring(spark, sf_dir):
    """Main text of each page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
