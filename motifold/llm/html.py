"""HTML to text by layout: a tree builder with implied tags, visibility rules, and a renderer of blocks.

All visible text comes out once, in document order, whatever the depth. Paragraphs, headings, lists and tables
stand apart by a blank line, other blocks by a new line; items have bullets or numbers and are indented by depth,
up to `INDENT` blanks; a table's cells begin where their column does, if that is within `WIDE` characters, and
two blanks behind the cell before else. Tables within `NESTED` others are written cell by cell.

Time and sizes are linear in the page: the tree is built with a stack that knows where its tags are, and is
rendered without recursion. A tag that the page's end cuts off is no text.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame

from .common import pick, slices

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
PLAIN = frozenset("textarea title".split())
HIDDEN = frozenset("head script style template noscript title meta link base datalist iframe noembed noframes object audio video canvas rp annotation annotation-xml defs desc metadata".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
TABLE_PARTS = frozenset("caption col colgroup tbody thead tfoot tr td th".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
#: A start tag closes the open elements named here, but not beyond the ones that bound the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"optgroup", "option"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, set()),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
}
CLOSES = {t: (frozenset(tags), frozenset(fences)) for t, (tags, fences) in CLOSES.items()}
#: Start tags that close an open paragraph.
CLOSE_P = BLOCKS - {"html", "body", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}
#: An end tag doesn't look for its start beyond these.
FENCES = frozenset({"table", "td", "th", "caption", "template", "object"})
TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|)|["'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
BLANKS = re.compile(r"[ \t\n\r\f]+")
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
#: What an end tag doesn't look beyond, if it isn't FENCES.
ENDS = {t: FENCES - {t} for t in FENCES} | {t: FENCES - {t, "td", "th", "caption"} for t in ("table", "tr", "tbody", "thead", "tfoot")}
P_ENDS, A_ENDS = FENCES | {"button"}, FENCES | BLOCKS
#: Sets of tags whose innermost open one is asked for, and those that a tag is in.
GROUPS = {frozenset(g) for g in (FENCES, P_ENDS, A_ENDS, HEADINGS, *ENDS.values(), *(x for pair in CLOSES.values() for x in pair))}
GROUPS_OF = {t: [g for g in GROUPS if t in g] for t in frozenset().union(*GROUPS)}
#: Blanks of indentation, characters up to which columns are kept, characters of a column, tables around a table, all at most.
INDENT, WIDE, COLUMN, NESTED = 80, 400, 120, 8


class Node:
    __slots__ = ("attributes", "children", "foreign", "tabled", "tag")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None, tabled: bool = False):
        self.tag, self.attributes, self.children = tag, attributes or {}, []
        self.tabled = tabled or tag == "table"  # whether it is in a table, or is one
        self.foreign = tag in ("svg", "math")  # whether a slash can end its start tag and those within


class Stack(list):
    """Open elements, and the places of those of a tag and of those of a group of tags."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.places: dict = {}

    def open(self, node: Node) -> None:
        for key in (node.tag, *GROUPS_OF.get(node.tag, ())):
            self.places.setdefault(key, []).append(len(self))
        self.append(node)

    def shut(self, place: int) -> None:
        """Close the element at a place, and those within."""
        while len(self) > place:
            tag = self.pop().tag
            for key in (tag, *GROUPS_OF.get(tag, ())):
                self.places[key].pop()

    def last(self, key) -> int:
        """The place of the innermost open one of a tag or group; 0, the root's, without any."""
        found = self.places.get(key)
        return found[-1] if found else 0

    def close(self, tags: frozenset, fences: frozenset) -> None:
        """Close up to the outermost of the innermost open ones of `tags`, which no fence stands before."""
        k = self.last(tags)
        if k > self.last(fences):
            while k > 1 and self[k - 1].tag in tags:
                k -= 1
            self.shut(k)

    def imply(self, tag: str) -> None:
        node = Node(tag, None, self[-1].tabled)
        self[-1].children.append(node)
        self.open(node)


def parse(html: str) -> Node:
    """The tree. Tags that can be left out are implied, end tags without a start are passed over."""
    root = Node("html")
    stack = Stack(root)
    at = 0
    while at < len(html):
        m = TOKEN.search(html, at)
        if m is None:
            _text(stack, html[at:])
            break
        if m.start() > at:
            _text(stack, html[at : m.start()])
        at = m.end()
        if m[2] is None or html[at - 1] != ">":
            continue
        tag = m[2].lower()
        if m[1]:
            _end(stack, tag)
            continue
        attributes = {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(m[3])} if m[3] else None
        if tag == "html" or (tag in TABLE_PARTS and not stack[-1].tabled):
            continue
        _start(stack, tag)
        node = Node(tag, attributes, stack[-1].tabled)
        node.foreign |= stack[-1].foreign and stack[-1].tag != "foreignobject"
        stack[-1].children.append(node)
        if node.foreign and m[3].endswith("/"):
            continue
        if tag in RAW or tag in PLAIN:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>|\\Z", re.I).search(html, at)
            if tag in PLAIN:
                node.children.append(unescape(html[at : end.start()]))
            at = end.end()
        elif tag not in VOID:
            stack.open(node)
    return root


def _text(stack: Stack, text: str) -> None:
    if stack[-1].tag in ("table", "tbody", "thead", "tfoot", "tr") and not text.strip(" \t\n\r\f"):
        return
    if stack[-1].tag == "head" and text.strip(" \t\n\r\f"):
        stack.shut(len(stack) - 1)  # text ends the head
    stack[-1].children.append(unescape(text))


def _start(stack: Stack, tag: str) -> None:
    if stack[-1].tag == "head" and tag not in HIDDEN and tag not in VOID:
        stack.shut(len(stack) - 1)
    if tag in CLOSES:
        stack.close(*CLOSES[tag])
    if tag in CLOSE_P:
        k = stack.last("p")
        if k > stack.last(P_ENDS):
            stack.shut(k)
    elif tag == "a":
        k = stack.last("a")
        if k > stack.last(A_ENDS):
            stack.shut(k)
    if tag in ("td", "th") and stack[-1].tag != "tr":
        if stack[-1].tag == "table":
            stack.imply("tbody")
        if stack[-1].tag in ("tbody", "thead", "tfoot"):
            stack.imply("tr")
    elif tag == "tr" and stack[-1].tag == "table":
        stack.imply("tbody")


def _end(stack: Stack, tag: str) -> None:
    if tag == "br":
        stack[-1].children.append(Node("br"))
        return
    k = stack.last(HEADINGS if tag in HEADINGS else tag)
    if k > stack.last(ENDS.get(tag, FENCES)):
        stack.shut(k)
    elif tag == "p" and k == 0:
        stack[-1].children.append(Node("p"))


def visible(node: Node) -> bool:
    a = node.attributes
    if node.tag in HIDDEN or not a:
        return node.tag not in HIDDEN
    return not ("hidden" in a or UNSEEN.search(a.get("style", "")) or (node.tag == "input" and a.get("type", "").lower() == "hidden") or (node.tag == "dialog" and "open" not in a))


class Page:
    """Lines of output. Blocks ask for new lines or a blank one; nothing is written until text comes."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = self.gap = False  # a blank is due within the line; an empty line before the next
        self.indent, self.lead = "", ""

    def text(self, text: str, kept: bool = False) -> None:
        if kept:
            for k, line in enumerate(text.split("\n")):
                if k:
                    self.line(True)
                if line:
                    self._put(line)
            return
        text = BLANKS.sub(" ", text)
        if text.startswith(" "):
            self.blank = bool(self.now)
        words = text.strip(" ")
        if words:
            self._put((" " if self.blank and self.now else "") + words)
            self.blank = text.endswith(" ")

    def _put(self, text: str) -> None:
        if not self.now:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.now.append(self.lead or self.indent)
            self.lead = ""
        self.now.append(text)
        self.blank = False

    def line(self, forced: bool = False) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
        elif forced:
            self.lines.append("")
        self.blank = False

    def space(self) -> None:
        self.line()
        self.gap = True


def _number(text: str, other: int) -> int:
    return int(text) if re.fullmatch(r"-?[0-9]{1,6}", text or "") else other


def render(root: Node) -> str:
    """The visible text. Work is a list of nodes and of steps that end them."""
    page = Page()
    work: list = [root]
    lists: list[list] = []  # of open lists: next number, or None
    grids: list[dict] = []  # of open tables: their rows, and the page around them
    kept = deep = 0
    while work:
        x = work.pop()
        if isinstance(x, str):
            page.text(x, kept > 0)
            continue
        if callable(x):
            x()
            continue
        if not visible(x):
            continue
        tag = x.tag
        done: list = []
        if tag == "br":
            page.line(True)
            continue
        if tag == "hr":
            page.space()
            continue
        if tag == "img":
            continue
        if tag == "input":
            if x.attributes.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email") and x.attributes.get("value"):
                page.text(x.attributes["value"])
            continue
        if tag == "table":
            page.space() if not grids else page.line()
            deep += 1
            if deep <= NESTED:
                grids.append({"rows": [], "around": page})
                page = Page()

            def close():
                nonlocal page, deep
                page.line()
                deep -= 1
                if deep < NESTED:
                    grid = grids.pop()
                    loose, page = page.lines, grid["around"]
                    for line in loose + aligned(grid["rows"]):
                        page._put(line) if line else None
                        page.line()
                page.space()

            done.append(close)
        elif tag == "tr" and grids and deep <= NESTED:
            grids[-1]["rows"].append([])
        elif tag in ("td", "th") and grids and deep <= NESTED:
            outer, page = page, Page()
            rows = grids[-1]["rows"]
            if not rows:
                rows.append([])

            across, down = max(1, min(1000, _number(x.attributes.get("colspan", ""), 1))), _number(x.attributes.get("rowspan", ""), 1)

            def close(outer=outer, row=rows[-1], across=across, down=down if down > 0 else 1 << 30):
                nonlocal page
                page.line()
                row.append((page.lines, across, down))
                page = outer

            done.append(close)
        elif tag in ("ul", "ol", "menu", "dir"):
            page.space() if not lists else page.line()
            lists.append([_number(x.attributes.get("start", ""), 1) if tag == "ol" else None, page.indent])

            def close():
                _, page.indent = lists.pop()
                page.lead = ""
                page.space() if not lists else page.line()

            done.append(close)
        elif tag == "li":
            page.line()
            outer = page.indent
            number = lists[-1][0] if lists else None
            mark = "- "
            if number is not None:
                number = _number(x.attributes.get("value", ""), number)
                mark, lists[-1][0] = f"{number}. ", number + 1
            page.lead, page.indent = outer + mark, (outer + " " * len(mark))[:INDENT]

            def close(outer=outer):
                page.line()
                page.indent, page.lead = outer, ""

            done.append(close)
        elif tag == "dd" or tag == "blockquote":
            page.space() if tag == "blockquote" else page.line()
            outer, page.indent = page.indent, (page.indent + "  ")[:INDENT]

            def close(outer=outer, wide=tag == "blockquote"):
                page.space() if wide else page.line()
                page.indent = outer

            done.append(close)
        elif tag == "pre":
            page.space()
            kept += 1

            def close():
                nonlocal kept
                kept -= 1
                page.space()

            done.append(close)
        elif tag == "textarea":
            page.line()
            kept += 1

            def close():
                nonlocal kept
                kept -= 1
                page.line()

            done.append(close)
        elif tag == "text":  # of an image
            page.line()
            done.append(lambda: page.line())
        elif tag == "q":
            page.text('"')
            done.append(lambda: page.text('"'))
        elif tag in SPACED:
            page.space()
            done.append(lambda: page.space())
        elif tag in BLOCKS:
            page.line()
            done.append(lambda: page.line())
        children = x.children
        if tag == "details" and "open" not in x.attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        if tag in ("option", "optgroup") and x.attributes.get("label"):
            page.text(x.attributes["label"])
            page.line()
            children = [] if tag == "option" else children
        if tag in ("pre", "textarea") and children and isinstance(children[0], str) and children[0].startswith("\n"):
            children = [children[0][1:], *children[1:]]
        work.extend(done)
        work.extend(reversed(children))
    page.line()
    while page.lines and not page.lines[-1]:
        page.lines.pop()
    return "\n".join(page.lines)


def places(rows: list[list[tuple[list[str], int, int]]]) -> list[list[int]]:
    """The column at which each cell begins; those that cells above reach down to are passed over."""
    taken: dict[int, tuple[int, int]] = {}  # columns up to which, and rows up to which, a cell from above reaches
    ahead: dict[int, tuple[int, int]] = {}  # the same for runs of such cells
    out = []
    for r, row in enumerate(rows):
        at, own = 0, []
        for _, across, down in row:
            start, until = at, 1 << 30
            while True:
                found = ahead.get(at)
                if found is None or r >= found[1]:
                    found = taken.get(at)
                if found is None or r >= found[1]:
                    break
                at, until = found[0], min(until, found[1])
            if at > start:
                ahead[start] = (at, until)
            own.append(at)
            if down > 1:
                taken[at] = (at + across, r + down)
            at += across
        out.append(own)
    return out


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table: columns two blanks apart, each as wide as its widest cell that spans no other. Columns in which no cell begins take no room."""
    begins = places(rows)
    number = {c: i for i, c in enumerate(sorted({c for own in begins for c in own}))}
    widths = [0] * len(number)
    for row, own in zip(rows, begins):
        for (lines, across, _), c in zip(row, own):
            if across == 1:
                widths[number[c]] = max(widths[number[c]], *map(len, lines), 0)
    starts = [0]
    for w in widths:
        starts.append(min(WIDE, starts[-1] + min(w, COLUMN) + 2))
    out = []
    for row, own in zip(rows, begins):
        cells = [(starts[number[c]], lines) for (lines, _, _), c in zip(row, own) if lines]
        for k in range(max((len(lines) for _, lines in cells), default=0)):
            line, size = [], 0
            for start, lines in cells:
                if k < len(lines) and lines[k]:
                    blanks = max(start - size, 2 if size else 0)
                    line.append(" " * blanks + lines[k])
                    size += blanks + len(lines[k])
            cells = [x for x in cells if len(x[1]) > k + 1]
            out.append("".join(line))
    return out


def extract(html: str | None) -> str:
    return render(parse(html or ""))


def visible_text(pages: DataFrame) -> DataFrame:
    """page_id, n_chars and text of every page. A null page counts as an empty one, with an empty text.

    Each row gives a row, repeated or not; other columns are ignored.
    """
    rows = pick(pages, "page_id", "html")

    def batches(it):
        import pyarrow as pa

        for batch in it:
            for start, htmls in slices(batch.column(1)):
                texts = [extract(h) for h in htmls]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(map(len, texts), pa.int64()), pa.array(texts, pa.string())], names=["page_id", "n_chars", "text"])

    return rows.mapInArrow(batches, f"page_id {rows.schema['page_id'].dataType.simpleString()}, n_chars bigint, text string")


def op9_html(spark, sf_dir: str) -> DataFrame:
    return visible_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
