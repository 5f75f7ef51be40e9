"""Layout-aware rendering of HTML to plain text.

A tree builder supplies implied end tags and moves stray table content before
its table; a renderer walks the visible nodes and keeps block spacing, list
markers and aligned table cells.

What isn't displayed (display:none, hidden, a closed dialog, elements that show
no text) is left out with all inside; what is only invisible leaves room for
descendants that are visible again.  Columns are as wide as their widest cell,
as long as the blanks of a table stay in proportion to its text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import map_arrow, slices

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("area audio base canvas col colgroup datalist embed iframe link meta noembed noframes object param script source style svg template title track video".split())
RAW = frozenset("script style iframe noembed noframes xmp".split())
PLAIN = frozenset("textarea title".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
BLOCK = SPACED | frozenset(
    "address article aside body caption center dd details dialog div dt figcaption footer form header hgroup html legend li main menu nav optgroup option search section summary tbody td tfoot th thead tr".split())
CLOSES_P = BLOCK - frozenset("body caption html legend optgroup option tbody td tfoot th thead tr".split())
TABLE_PARTS = frozenset("table tbody thead tfoot tr".split())
#: A start tag ends these open elements, up to the given boundary.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
SCOPES = frozenset("table td th caption template".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
MAY_HIDE = re.compile(r"hidden|style|type", re.I)
# The most columns and rows that a cell may span by the HTML standard.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534
#: Blanks that may align a table, as a multiple of its text and at least; beyond, the widest cells stick out.
BLANKS, LEAST_BLANKS = 8, 4096


class Node:
    __slots__ = ("tag", "shown", "visible", "attrs", "children", "home")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children, self.home = tag, attrs, [], None
        #: Whether the element is displayed, and whether it is visible: None is as its parent.
        self.shown, self.visible = tag not in UNSEEN, None
        if attrs and MAY_HIDE.search(attrs):
            found = _attributes(attrs)
            style = found.get("style", "")
            if "hidden" in found or NOT_SHOWN.search(style) or tag == "input" and found.get("type", "").lower() == "hidden":
                self.shown = False
            if last := VISIBILITY.findall(style):
                self.visible = last[-1].lower() == "visible"
        if tag == "dialog" and "open" not in _attributes(attrs):
            self.shown = False


def _attributes(attrs: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def parse(page: str) -> Node:
    """The tree below an implied body; html, head and body tags add nothing."""
    root = Node("body")
    stack = [root]
    # Where in the stack the open elements of a tag, all blocks and all scopes are, so that no search walks a deep stack.
    places: defaultdict[str, list[int]] = defaultdict(list)
    at, size = 0, len(page)

    def kinds(tag: str) -> Iterator[str]:
        yield tag
        if tag in BLOCK:
            yield "<block"
        if tag in SCOPES:
            yield "<scope"

    def push(node: Node) -> None:
        for kind in kinds(node.tag):
            places[kind].append(len(stack))
        stack.append(node)

    def cut(k: int) -> None:
        """Close the element at place k and all inside it."""
        while len(stack) > k:
            for kind in kinds(stack.pop().tag):
                places[kind].pop()

    def last(kind: str) -> int:
        """The innermost place of an open element; 0 if there is none."""
        found = places.get(kind)
        return found[-1] if found else 0

    def place(child: Node | str) -> None:
        """Into the open element, or before the table if it can't hold the child."""
        top = stack[-1]
        home, before = top.children, None
        stray = top.tag in TABLE_PARTS and last("table") and (not child.isspace() if isinstance(child, str) else child.tag not in ("caption", "colgroup", "col", "tbody", "thead", "tfoot", "tr", "td", "th", "script", "style", "template"))
        if stray:
            before = stack[last("table")]
            home = before.home
        if not isinstance(child, str):
            child.home = home
        if before is None:
            home.append(child)
        else:
            home.insert(next(i for i in range(len(home) - 1, -1, -1) if home[i] is before), child)

    def close(tag: str) -> None:
        k = last(tag)
        wall = last("<scope" if tag not in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption") else "table")
        if max(wall, last("<block") if tag not in BLOCK else 0) > k:
            return
        if k:
            cut(k)
        elif tag == "p":
            place(Node("p"))

    while at < size:
        start = page.find("<", at)
        if start < 0:
            start = size
        if start > at:
            text = page[at:start]
            place(html.unescape(text) if "&" in text else text)
            at = start
            continue
        m = TAG.match(page, at)
        if m is None:
            second = page[at + 1 : at + 2]
            if page.startswith("<!--", at):
                end = page.find("-->", at + 2)
                at = size if end < 0 else end + 3
            elif second in ("!", "?", "/") and second:
                end = page.find(">", at)
                at = size if end < 0 else end + 1
            elif second.isascii() and second.isalpha():
                at = size  # a tag that never ends
            else:
                place("<")
                at += 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                place(Node("br"))
            elif tag not in ("html", "head", "body"):
                close(tag)
            continue
        if tag in ("html", "head", "body"):
            continue
        if tag in CLOSES_P:
            if last("p") > last("<scope"):
                cut(last("p"))
        if (ends := ENDS.get(tag)) is not None:
            wall = max(map(last, ends[1]))
            inner = [found[k] for t in ends[0] if (found := places.get(t)) and (k := bisect_right(found, wall)) < len(found)]
            if inner:
                cut(min(inner))
            inside = stack[-1].tag
            if tag in ("td", "th") and inside in ("table", "tbody", "thead", "tfoot"):
                row = Node("tr")
                row.home = stack[-1].children
                row.home.append(row)
                push(row)
        node = Node(tag, m[3])
        place(node)
        if tag in RAW or tag in PLAIN:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            stop = end.start() if end else size
            text = page[at:stop]
            node.children.append(html.unescape(text) if tag in PLAIN else text)
            gt = page.find(">", stop)
            at = size if gt < 0 else gt + 1
        elif tag not in VOID:
            push(node)
    return root


class Writer:
    """Lines with collapsed white space; blank lines never begin, end or double."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.breaks, self.space, self.indent, self.marker = 0, False, "", ""

    def block(self, breaks: int) -> None:
        self.breaks, self.space = max(self.breaks, breaks), False

    def _open(self) -> None:
        if self.breaks or not self.out:
            if self.out:
                self.out.append("\n" * self.breaks)
            self.out.append(self.indent)
            self.breaks = 0
            if self.marker:
                self.out[-1] = self.indent[: -len(self.marker)] + self.marker
                self.marker = ""
        elif self.space:
            self.out.append(" ")
        self.space = False

    def text(self, s: str) -> None:
        words = s.split()
        if not words:
            self.space = self.space or bool(s)
            return
        if s[0].isspace():
            self.space = True
        self._open()
        self.out.append(" ".join(words))
        self.space = s[-1].isspace()

    def lines(self, s: str) -> None:
        """Text whose spaces and line ends stay."""
        for k, line in enumerate(s.split("\n")):
            if k:
                self.breaks, self.space = self.breaks + 1, False
            if line:
                self._open()
                self.out.append(line.expandtabs(8))

    def value(self) -> str:
        return "".join(self.out)


def render(node: Node, w: Writer) -> None:
    """Walk the tree; open elements are generators on a stack of their own, so any depth will do."""
    open_, value = [_render(node, w)], None
    while open_:
        try:
            open_.append(open_[-1].send(value))
            value = None
        except StopIteration as end:
            open_.pop()
            value = end.value


#: Yields what must be done first and gets what that returns.
Steps = Generator["Steps", list[str] | None, list[str] | None]


def _render(node: Node, w: Writer, pre: bool = False, seen: bool = True) -> Steps:
    """``seen`` says whether the parent is visible."""
    tag = node.tag
    if not node.shown:
        return
    if node.visible is not None:
        seen = node.visible
    if tag == "br":
        w.breaks, w.space = w.breaks + 1, False
        return
    if tag == "table":
        w.block(2)
        for line in (yield _table_lines(node, seen)):
            w.lines(line)
            w.block(1)
        w.block(2)
        return
    if tag in ("ul", "ol", "menu"):
        w.block(1 if w.indent else 2)
        yield _list(node, w, pre, seen)
        w.block(1 if w.indent else 2)
        return
    gap = 0 if tag not in BLOCK else 2 if tag in SPACED and not (w.marker and tag == "p") else 1
    if gap:
        w.block(gap)
    indent = w.indent
    if tag in ("blockquote", "dd"):
        w.indent += "  "
    pre = pre or tag in ("pre", "textarea", "xmp")
    put = w.lines if pre else w.text
    for child in node.children:
        if not isinstance(child, str):
            if child.shown:
                yield _render(child, w, pre, seen)
        elif seen:
            put(child)
    w.indent = indent
    if tag == "pre":
        w.breaks = 0
    if gap:
        w.block(gap)


def _list(node: Node, w: Writer, pre: bool, seen: bool) -> Steps:
    number, indent = 1, w.indent
    if node.tag == "ol" and node.attrs:
        start = _attributes(node.attrs).get("start", "")
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, str):
            if seen:
                w.text(child)
        elif child.tag == "li" and child.shown:
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            w.block(1)
            w.indent, w.marker = indent + " " * len(mark), mark
            inside = seen if child.visible is None else child.visible
            for x in child.children:
                if not isinstance(x, str):
                    yield _render(x, w, pre, inside)
                elif inside:
                    (w.lines if pre else w.text)(x)
            w.indent, w.marker = indent, ""
            w.block(1)
        else:
            yield _render(child, w, pre, seen)


def _rows(node: Node, seen: bool) -> Iterator[tuple[Node, bool, int]]:
    """Rows, whether they are visible, and the number of the group they stand in."""
    left, group = [(iter(node.children), seen, 0)], 0
    while left:
        children, visible, number = left[-1]
        c = next(children, None)
        if c is None:
            left.pop()
        elif isinstance(c, Node) and c.shown:
            own = visible if c.visible is None else c.visible
            if c.tag == "tr":
                yield c, own, number
            elif c.tag in ("tbody", "thead", "tfoot"):
                group += 1
                left.append((iter(c.children), own, group))


def _span(cell: Node, name: str, most: int) -> int:
    """How many columns or rows a cell takes; 0 rows are all that are left of its group."""
    if name not in cell.attrs.lower():
        return 1
    value = re.match(r"\s*\+?(\d+)", _attributes(cell.attrs).get(name, ""))
    n = min(int(value[1][:9]), most) if value else 1
    return n if n or name == "rowspan" else 1


def _width(sizes: list[int], room: int) -> int:
    """The widest column for which shorter cells need no more than ``room`` blanks."""
    order, total = sorted(sizes), 0
    best = order[0] if order else 0
    for k, size in enumerate(order):
        if k * size - total > room:
            break
        best, total = size, total + size
    return best


def _table_lines(node: Node, seen: bool) -> Steps:
    """Captions, then rows whose cells start at common columns; spans leave empty places beside and below."""
    out: list[str] = []
    for c in node.children:
        if isinstance(c, Node) and c.tag == "caption" and c.shown:
            w = Writer()
            yield _render(c, w, seen=seen)
            out += w.value().split("\n")
    grid: list[dict[int, list[str]]] = []
    # By column: in how many more rows, and of which group, a cell from above stands there.
    above: dict[int, list[int]] = {}
    for row, visible, group in _rows(node, seen):
        cells, at = {}, 0
        above = {k: v for k, v in above.items() if v[0] and v[1] == group}
        taken = set(above)
        for v in above.values():
            v[0] -= 1
        for c in row.children:
            if isinstance(c, Node) and c.tag in ("td", "th") and c.shown:
                w = Writer()
                yield _render(c, w, seen=visible)
                while at in taken:
                    at += 1
                cells[at] = w.value().split("\n")
                wide, high = _span(c, "colspan", MAX_COLSPAN), _span(c, "rowspan", MAX_ROWSPAN)
                if high != 1:
                    above |= {k: [high - 1 if high else MAX_ROWSPAN, group] for k in range(at, at + wide)}
                at += wide
        if any(line for cell in cells.values() for line in cell):
            grid.append(cells)
    sizes: defaultdict[int, list[int]] = defaultdict(list)
    for cells in grid:
        last = max(cells)
        for k in range(last + 1):
            # The last cell of a row needs no blanks after it.
            if k < last:
                sizes[k] += [len(x) for x in cells.get(k, [""])]
    text = sum(len(line) for cells in grid for cell in cells.values() for line in cell)
    room = (BLANKS * text + LEAST_BLANKS) // max(1, len(sizes))
    widths = {k: _width(v, room) for k, v in sizes.items()}
    for cells in grid:
        for k in range(max(map(len, cells.values()))):
            line = {j: cell[k] for j, cell in cells.items() if k < len(cell) and cell[k]}
            last = max(line, default=-1)
            out.append(" | ".join(line.get(j, "").ljust(widths[j] if j < last else 0) for j in range(last + 1)))
    return out


def visible_text(page: str | None) -> str:
    if not page:
        return ""
    w = Writer()
    render(parse(page), w)
    return w.value()


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id and ``text``, the visible text of every whole page.

    Null and empty pages give an empty text, as do pages without visible text;
    pages of any length and depth are rendered whole.  Each page is its own
    row, so repeated rows give repeated rows, and no rows none.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(visible_text, b.column(1).to_pylist()), pa.string())], names=["page_id", "text"])

    return map_arrow(rows, run, f"page_id {rows.schema[0].dataType.simpleString()}, text string")
