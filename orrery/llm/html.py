"""HTML extraction by layout-aware rendering.

A tree builder with implied tags turns a page into a tree; visibility rules drop
what a browser does not show; the renderer emits all visible text with the spacing
of blocks, list marks and table cells in aligned columns. Pages are rendered one
by one in a single scan: no shuffle, and one page's tree is all that is held.
"""

from __future__ import annotations

import bisect
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from orrery.llm.common import table

# HTML element names by their role in layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("area audio base canvas datalist embed head iframe link meta noscript object param script select source style svg template title track video".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
BLOCK = SPACED | frozenset("address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary tbody td tfoot th thead tr".split())
#: A start tag of the first closes an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th", "caption", "colgroup"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, "thead": {"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, "tfoot": {"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
#: Those searches stop at these elements.
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "optgroup": {"select"}}
TABLE_SCOPE = frozenset({"table"})
#: An end tag does not close what lies outside the cell that it stands in.
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
BARRIER = frozenset({"td", "th", "caption", "table"})
MAX_DEPTH = 150  # of lists, tables and quotes in each other; deeper ones are shown as plain blocks, without columns and more indents
CELL_WIDTH = 60  # lines of cells with others to their right are wrapped at blanks beyond it; a longer word makes its column wider, up to
WORD_WIDTH = 200  # this: the line of a still longer word goes beyond its column
GAP = "  "
# The most that HTML lets a cell span.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534

_SPACE = re.compile(r"[ \t\n\f\r]+")
_INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!\s*important\s*)?(?:;|$)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []

    def visible(self) -> bool:
        a = self.attrs
        if self.tag in HIDDEN or "hidden" in a or (self.tag == "dialog" and "open" not in a):
            return False
        return not _INVISIBLE.search(a.get("style") or "")


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}  # tag -> where it is open

    def _last(self, tags) -> int:
        """Where the innermost open element of these is; 0 for none."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def _push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def _close(self, at: int) -> None:
        while len(self.open) > at:
            self.places[self.open.pop().tag].pop()

    def _pop_to(self, names: set, stop) -> None:
        outside = self._last(t for t in stop if t not in names)
        while (at := self._last(names)) > outside:
            self._close(at)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            if tag == "body" and self._last(("head",)):
                self._pop_to({"head"}, ())
            if tag == "body" and self.open[-1].tag != "html":
                return
            if tag == "html":
                return
        if tag in CLOSES:
            self._pop_to(CLOSES[tag], SCOPE.get(tag, TABLE_SCOPE))
        if tag in BLOCK and tag not in ("html", "body"):
            self._pop_to({"p"}, BARRIER | {"button", "object"})
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" and self.open[-1].tag in HEADINGS:
            self._close(len(self.open) - 1)
        if tag == "a":
            self._pop_to({"a"}, BARRIER)
        if tag not in HIDDEN and self.open[-1].tag == "head":
            self._close(len(self.open) - 1)
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self._push(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if tag in VOID or tag in ("html", "body"):
            return
        within = BARRIER if not (tag in BARRIER or tag in ("tr", "tbody", "thead", "tfoot")) else TABLE_SCOPE - {tag}
        if (at := self._last(HEADINGS if tag in HEADINGS else (tag,))) > self._last(within):
            self._close(at)
            return
        if tag == "p":
            self.open[-1].children.append(Node("p", {}))

    def handle_data(self, data):
        if self.open[-1].tag == "head" and data.strip():
            self._close(len(self.open) - 1)
        self.open[-1].children.append(data)

    def parse_marked_section(self, i, report=1):  # these are comments in HTML
        return self.parse_bogus_comment(i, 0)

    def unknown_decl(self, data):
        return


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


class Lines:
    """Lines of text under construction; blank lines are kept between spaced blocks alone."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.spaced = False  # a blank line is due before the next text
        self.preformatted = False

    def text(self, data: str) -> None:
        if self.preformatted:
            first, *rest = data.split("\n")
            self._put(first)
            for line in rest:
                self.lines.append("".join(self.now))
                self.now = []
                self._put(line)
            return
        data = _SPACE.sub(" ", data)
        if not self.now or self.now[-1].endswith(" "):
            data = data.lstrip(" ")
        self._put(data)

    def _put(self, data: str) -> None:
        if data:
            if self.spaced:
                if self.lines:
                    self.lines.append("")
                self.spaced = False
            self.now.append(data)

    def end_line(self, always: bool = False) -> None:
        line = "".join(self.now).rstrip(" ")
        if line or always:
            self.lines.append(line)
        self.now = []

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.spaced = self.spaced or spaced

    def add(self, lines: list[str]) -> None:
        if lines:
            self.block(False)
            if self.spaced and self.lines:
                self.lines.append("")
            self.spaced = False
            self.lines.extend(lines)

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def _lines(nodes: list, level: int = 0) -> list[str]:
    """level: the number of lists, tables and quotes around."""
    out = Lines()
    for n in nodes:
        _render(n, out, level)
    lines = out.done()
    while lines and not lines[-1]:
        lines.pop()
    return lines


def _integer(text: str, default: int) -> int:
    return int(text) if re.fullmatch(r"\s*[+-]?\d{1,9}\s*", text) else default


def _list(node: Node, level: int) -> list[str]:
    out: list[str] = []
    items = [c for c in node.children if isinstance(c, Node) and c.visible() and c.tag == "li"]
    step = -1 if "reversed" in node.attrs else 1
    number = _integer(node.attrs.get("start", ""), len(items) if step < 0 else 1)
    for c in node.children:
        if isinstance(c, str):
            if c.strip():
                out += _lines([c], level)
            continue
        if not c.visible():
            continue
        if c.tag != "li":
            out += _lines([c], level)
            continue
        mark = "- "
        if node.tag == "ol":
            number = _integer(c.attrs.get("value", ""), number)
            mark = f"{number}. "
            number += step
        for inner in c.children:  # a list within an item has no space around it
            if isinstance(inner, Node) and inner.tag in ("ul", "ol", "menu", "dir"):
                inner.attrs["_nested"] = ""
        body = _lines(c.children, level)
        out += [(mark if i == 0 else " " * len(mark) if line else "") + line for i, line in enumerate(body)]
    return out


def _rows(node: Node) -> list[Node]:
    found = []
    for c in node.children:
        if isinstance(c, Node) and c.visible():
            if c.tag == "tr":
                found.append(c)
            elif c.tag in ("thead", "tbody", "tfoot"):
                found += _rows(c)
    return found


def _table(node: Node, level: int) -> list[str]:
    out: list[str] = []
    for c in node.children:  # captions and text that lies outside of rows
        if isinstance(c, str):
            out += _lines([c], level) if c.strip() else []
        elif c.visible() and c.tag not in ("tr", "thead", "tbody", "tfoot", "colgroup"):
            out += _lines([c], level)
    grid: list[list[tuple[int, int, list[str]]]] = []  # rows of (column, columns spanned, lines)
    busy: list[tuple[int, int, int]] = []  # columns [a, b) taken by a cell from above, and rows left
    for row in _rows(node):
        cells, taken, at, j = [], sorted(busy), 0, 0
        busy = [(a, b, left - 1) for a, b, left in taken if left > 1]
        for c in row.children:
            if isinstance(c, str):
                if c.strip():
                    out += _lines([c], level)
                continue
            if not c.visible():
                continue
            while j < len(taken) and taken[j][0] <= at:
                at = max(at, taken[j][1])
                j += 1
            wide = min(max(_integer(c.attrs.get("colspan", ""), 1), 1), MAX_COLSPAN)
            down = min(_integer(c.attrs.get("rowspan", ""), 1) or MAX_ROWSPAN, MAX_ROWSPAN)
            cells.append((at, wide, _lines(c.children if c.tag in ("td", "th") else [c], level)))
            if down > 1:
                busy.append((at, at + wide, down - 1))
            at += wide
        grid.append(cells)
    return out + _aligned(grid)


def _wrapped(line: str) -> list[str]:
    """The line in parts of CELL_WIDTH at most, cut at blanks alone."""
    if len(line) <= CELL_WIDTH:
        return [line]
    parts, now = [], ""
    for word in line.split(" "):
        if now.strip() and len(now) + 1 + len(word) > CELL_WIDTH:
            parts.append(now.rstrip(" "))
            now = word
        else:
            now = f"{now} {word}" if now else word
    return [*parts, now]


def _aligned(grid: list[list[tuple[int, int, list[str]]]]) -> list[str]:
    """The rows of a table as lines. Cells begin where their column does; the last of a row is as wide as it likes."""
    starts = sorted({at for cells in grid for at, _, _ in cells})
    number = {at: i for i, at in enumerate(starts)}
    widths = [0] * len(starts)
    rows = []
    for cells in grid:
        row = {}
        for at, wide, lines in cells:
            i, stop = number[at], bisect.bisect_left(starts, at + wide)
            if stop < len(starts):
                lines = [part for line in lines for part in _wrapped(line)]
                if stop == i + 1:
                    widths[i] = max(widths[i], max((len(x) for x in lines if len(x) <= WORD_WIDTH), default=0))
            row[i] = (stop, lines)
        rows.append(row)
    room_of = lambda i, stop: sum(widths[i:stop]) + len(GAP) * (stop - i - 1)
    for stop, i, lines in sorted(((stop, i, lines) for row in rows for i, (stop, lines) in row.items() if i + 1 < stop < len(starts)), key=lambda x: (x[0] - x[1], x[1])):
        widths[stop - 1] += max(0, max((len(x) for x in lines if len(x) <= WORD_WIDTH), default=0) - room_of(i, stop))
    out = []
    for row in rows:
        for k in range(max((len(lines) for _, lines in row.values()), default=0)):
            line, i, last = [], 0, max(row)
            while i <= last:
                stop, lines = row.get(i, (i + 1, []))
                line.append((lines[k] if k < len(lines) else "").ljust(room_of(i, stop)))
                i = stop
            out.append(GAP.join(line).rstrip(" "))
    return out


def _marked(node: Node) -> list:
    """The children of a list with the marks of its items before them, for lists that are shown as plain blocks."""
    out: list = []
    items = [c for c in node.children if isinstance(c, Node) and c.visible() and c.tag == "li"]
    step = -1 if "reversed" in node.attrs else 1
    number = _integer(node.attrs.get("start", ""), len(items) if step < 0 else 1)
    for c in node.children:
        if not (isinstance(c, Node) and c.tag == "li" and c.visible()):
            out.append(c)
            continue
        number = _integer(c.attrs.get("value", ""), number)
        out += [("block", False), f"{number}. " if node.tag == "ol" else "- ", *c.children, ("block", False)]
        number += step
    return out


def _render(node, out: Lines, level: int) -> None:
    """Elements of any depth: todo has what is left, the next at its end; pairs end what was begun."""
    todo = [node]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.text(node)
            continue
        if isinstance(node, tuple):
            what, value = node
            if what == "pre":
                out.preformatted = value
            else:
                out.block(value)
            continue
        if not node.visible():
            continue
        tag, children = node.tag, node.children
        nested = level < MAX_DEPTH
        if tag == "br":
            out.end_line(always=True)
        elif tag == "hr":
            out.block(True)
        elif tag == "input":
            if node.attrs.get("type", "").lower() in ("submit", "button", "reset") and node.attrs.get("value"):
                out.text(node.attrs["value"])
        elif tag in ("ul", "ol", "menu", "dir") and nested:
            out.block("_nested" not in node.attrs)
            out.add(_list(node, level + 1))
            out.block("_nested" not in node.attrs)
        elif tag == "table" and nested:
            out.block(True)
            out.add(_table(node, level + 1))
            out.block(True)
        elif tag == "details" and "open" not in node.attrs:
            out.block(False)
            todo.append(("block", False))
            todo += [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        elif tag in ("pre", "textarea", "listing"):
            out.block(True)
            todo += [("block", True), ("pre", out.preformatted)]
            out.preformatted = True
            if children and isinstance(children[0], str) and children[0].startswith("\n"):
                children = [children[0][1:], *children[1:]]
            todo += reversed(children)
        elif tag in ("blockquote", "dd") and nested:
            out.block(tag != "dd")
            out.add([f"  {line}" if line else line for line in _lines(children, level + 1)])
            out.block(tag != "dd")
        elif tag in BLOCK:
            out.block(tag in SPACED)
            todo.append(("block", tag in SPACED))
            todo += reversed(_marked(node) if tag in ("ul", "ol", "menu", "dir") else children)
        else:
            todo += reversed(children)


def render(html: str | None) -> str | None:
    """The visible text of a page. Null stays null; a page without visible text gives the empty text."""
    if html is None:
        return None
    return "\n".join(_lines(parse(html.replace("\r\n", "\n").replace("\r", "\n")).children)).replace("\xa0", " ").strip("\n")


def extract(html: Column) -> Column:
    """The visible text of each page: blocks on lines of their own, a blank line around
    spaced ones, list marks, table cells in columns.

    Cells of a column begin at the same place of their lines; those with others to their
    right are wrapped at blanks. Pages of any length and depth are rendered whole, with all visible
    text and none that is hidden; lists, tables and quotes beyond MAX_DEPTH in each other
    are shown as blocks without more indents and columns. Malformed pages are repaired by
    implied tags. Rows are rendered one by one, so that nulls in other columns, ties,
    repeated rows and empty tables need no rule.
    """

    def run(pages: pd.Series) -> pd.Series:
        return pages.map(render, na_action="ignore")

    return pandas_udf(run, "string")(html)


def op6_html_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages.select("page_id", "url", extract(F.col("html")).alias("text"))
