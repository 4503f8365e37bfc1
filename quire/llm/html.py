"""HTML extraction by layout-aware rendering.

A tag soup is read into a tree: end tags that may be left out are implied, void elements close themselves, scripts and styles
are taken whole. Rendering walks the tree under visibility rules (no head, script, style, template, hidden or display:none; text
under visibility:hidden shows only where an element inside is visible again) and emits all visible text: blocks on lines of their
own, a blank line around paragraphs and headings, marks for list items, and table cells padded to the width of their columns,
spans included. Cells without a written row get one; what stands in a table, a section or a row but in no cell comes before the
table.

The reader never looks back, so that a page of broken markup costs as much as any other of its length.

Defined results: null or empty HTML gives an empty text. Broken markup never fails: what is no tag is text, a quote that is never
closed is none, and what is never closed ends with the page. Depth is bounded by DEPTH; deeper elements are read into the one at
that depth. Columns are padded while a table's padding stays within PADDING characters a column, beyond to NARROW. Repeated rows
each get theirs. An empty table of pages yields no rows. Columns of any other name may be there.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded, slices

DEPTH = 200
#: Characters of padding that a column of a table may take, and the width that it is padded to beyond them.
PADDING = 1 << 20
NARROW = 60
#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
HIDDEN = frozenset("head script style template title noscript iframe object canvas audio video datalist desc metadata defs annotation annotation-xml".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption select optgroup option text".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
#: What a table is made of.
PARTS = frozenset("tbody thead tfoot tr td th colgroup".split())
#: A start tag on the left ends the open elements on the right, up to the nearest of those after the bar.
_P = "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
IMPLIED = {t: (frozenset(["p"]), frozenset("button table td th li div article section body".split())) for t in _P} | {
    "li": (frozenset(["li", "p"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "p", "li"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "p", "li"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "p", "li"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "p", "li", "caption"]), frozenset(["table"])),
    "thead": (frozenset(["caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tr", "td", "th", "p", "li"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}

_opening = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)|!--|!\[CDATA\[|[!?])")
_between = re.compile(r"[\s/]*")
_name = re.compile(r"=?[^\s/>=]*")
_equals = re.compile(r"\s*=\s*")
_bare = re.compile(r"[^\s>]+")
_gone = re.compile(r"display\s*:\s*none")
_veil = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)")
_white = re.compile(r"[ \t\n\r\f]+")
_number = re.compile(r"[+-]?\d{1,9}")


class Node:
    """tag; hidden: with all that is in it; veiled: its own text only; start: of a list, or an item's number; wide, high: a cell's spans."""

    __slots__ = ("children", "hidden", "high", "start", "tag", "veiled", "wide")

    def __init__(self, tag: str, hidden: bool = False, veiled: bool = False):
        self.tag, self.hidden, self.veiled, self.start, self.wide, self.high, self.children = tag, hidden, veiled, None, 1, 1, []


class Reader:
    """The tags of a page, from left to right."""

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")
        #: Where the next sign of a kind is, as far as it was looked for; the end if there is none.
        self.signs = {"'": -1, '"': -1, ">": -1}
        #: Whether a tag was met whose quotes hide all that follows. From then on no quote hides the end of a tag.
        self.wary = False

    def _next(self, sign: str, at: int) -> int:
        if self.signs[sign] < at:
            found = self.source.find(sign, at)
            self.signs[sign] = len(self.source) if found < 0 else found
        return self.signs[sign]

    def _closed(self, at: int) -> bool:
        """Whether the quote at `at` begins a value."""
        if self.source[at : at + 1] not in ("'", '"'):
            return False
        end = self._next(self.source[at], at + 1)
        return end < (self._next(">", at) if self.wary else len(self.source))

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], int, bool]:
        """The attributes from `at` on, the place after the tag, and whether it closes itself. There must be a '>' to come."""
        source, begin, found = self.source, at, []
        while True:
            space = _between.match(source, at)
            at = space.end()
            if at > self.last:
                # Some quote hid the end of the tag: it ends at the next sign for that, whatever stands before it.
                self.wary = True
                return found, source.index(">", begin) + 1, False
            if source[at] == ">":
                return found, at + 1, space[0].endswith("/")
            name = _name.match(source, at)
            at, value = name.end(), ""
            if m := _equals.match(source, at):
                at = m.end()
                if self._closed(at):
                    end = self._next(source[at], at + 1)
                    value, at = source[at + 1 : end], end + 1
                elif m := _bare.match(source, at):
                    value, at = m[0], m.end()
            found.append((name[0].lower(), html.unescape(value)))


def tree(source: str) -> Node:
    """The tree of a page; its texts are strings among the children."""
    root = Node("#root")
    stack = [root]
    reader = Reader(source)
    at = begun = 0  # where reading goes on, and where text that is not in the tree yet begins
    while m := _opening.search(source, at):
        at = m.end()
        kind = m[0]
        if kind == "<!--" or kind == "<![CDATA[":
            end = source.find("-->" if kind == "<!--" else "]]>", at)
            if m.start() > begun:
                stack[-1].children.append(html.unescape(source[begun : m.start()]))
            if kind != "<!--":
                stack[-1].children.append(source[at : end if end >= 0 else len(source)])
            at = begun = end + 3 if end >= 0 else len(source)
            continue
        if at > reader.last:
            if m[2]:
                break  # no tag ends any more: the rest is text
            if m.start() > begun:
                stack[-1].children.append(html.unescape(source[begun : m.start()]))
            begun = len(source)
            break
        if m.start() > begun:
            stack[-1].children.append(html.unescape(source[begun : m.start()]))
        if not m[2] or m[1]:
            at = begun = source.index(">", at) + 1
            if m[2]:
                _end(stack, m[2].lower())
            continue
        given, at, closed = reader.attributes(at)
        begun = at
        tag = m[2].lower()
        node = _start(stack, tag, given)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(source, at)
            if not node.hidden:
                node.children.append(html.unescape(source[at : end.start() if end else len(source)]))
            at = begun = end.end() if end else len(source)
        elif tag not in VOID and not (closed and tag not in BLOCKS) and len(stack) < DEPTH:
            stack.append(node)
    if begun < len(source):
        stack[-1].children.append(html.unescape(source[begun:]))
    return root


def _end(stack: list[Node], tag: str) -> None:
    """An end tag closes its element and what is open in it, but no cell is closed by what ends inside it."""
    names = [n.tag for n in stack]
    if tag == "p" and "p" not in names:
        stack[-1].children.append(Node("p"))
    wall = max((i for i, n in enumerate(names) if n in ("td", "th", "table") and n != tag), default=0) if tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") else 0
    for i in range(len(stack) - 1, wall, -1):
        if names[i] == tag:
            del stack[i:]
            return


def _start(stack: list[Node], tag: str, given: list[tuple[str, str]]) -> Node:
    """The node of a start tag, put into the tree; what it implies is closed or opened before."""
    if tag in IMPLIED:
        ends, until = IMPLIED[tag]
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in until:
                break
            if stack[i].tag in ends:
                del stack[i:]
                if tag in _P:
                    break
    if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot") and len(stack) < DEPTH:
        row = Node("tr", veiled=stack[-1].veiled)
        stack[-1].children.append(row)
        stack.append(row)
    node = Node(tag, tag in HIDDEN, stack[-1].veiled)
    for name, value in given:
        whole = int(value) if name in ("start", "value", "colspan", "rowspan") and _number.fullmatch(value.strip()) else None
        if name == "hidden":
            node.hidden = True
        elif name == "style":
            style = value.lower()
            node.hidden |= bool(_gone.search(style))
            if found := _veil.findall(style):
                node.veiled = found[-1] != "visible"
        elif name == "alt" and tag == "img" and value and not node.hidden and not node.veiled:
            node.children.append(value)
        elif whole is not None and (name == "start" and tag == "ol" or name == "value" and tag == "li"):
            node.start = whole
        elif whole is not None and name == "colspan":
            node.wide = min(max(whole, 1), 1000)
        elif whole is not None and name == "rowspan":
            node.high = min(max(whole, 1), 65534)
    stack[-1].children.append(node)
    return node


class Lines:
    """Text that grows by runs, lines and gaps."""

    def __init__(self):
        self.lines: list[str] = []
        self.now = ""
        self.gap = False

    def text(self, run: str) -> None:
        run = _white.sub(" ", run)
        if not self.now or self.now.endswith((" ", "\n")):
            run = run.lstrip(" ")
        self.now += run

    def line(self) -> None:
        if self.now.strip(" "):
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append(self.now.rstrip(" "))
        self.now = ""

    def blank(self) -> None:
        self.line()
        self.gap = True

    def put(self, lines: list[str]) -> None:
        """Lines as they are."""
        self.line()
        if lines:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines += lines

    def done(self) -> list[str]:
        self.line()
        return self.lines


def _parts(node: Node) -> bool:
    """Whether rows or cells of the table around stand in the node, which then is none of the table's own elements."""
    held = [node]
    while held:
        for c in held.pop().children:
            if isinstance(c, Node) and not c.hidden:
                if c.tag in PARTS:
                    return True
                if c.tag != "table":
                    held.append(c)
    return False


def _rows(node: Node, rows: list[list[Node]], strays: list[Node], row: list[Node] | None = None) -> None:
    """The rows of cells in the node, and what else is visible in it: a node for each run of siblings. row: where cells go that have no row of their own."""
    run = None
    for c in node.children:
        if isinstance(c, Node) and c.hidden:
            continue
        if isinstance(c, str) or c.tag not in PARTS and not _parts(c):
            if run is None and not (isinstance(c, str) and not c.strip(" \t\n\r\f")):
                strays.append(run := Node("div", veiled=node.veiled))
            if run is not None:
                run.children.append(c)
            continue
        run = None
        if c.tag in ("td", "th"):
            if row is None:
                rows.append(row := [])
            row.append(c)
        elif c.tag == "tr":
            rows.append(own := [])
            _rows(c, rows, strays, own)
            row = None
        elif c.tag in PARTS:
            _rows(c, rows, strays)
            row = None
        else:
            _rows(c, rows, strays, row)


def _table(node: Node, depth: int) -> tuple[list[list[str]], list[str]]:
    """The lines of all that is in the table but in no cell, and those of the cells: cells of a column start at the same place."""
    rows: list[list[Node]] = []
    strays: list[Node] = []
    _rows(node, rows, strays)
    widths: dict[int, int] = {}
    grid: list[list[tuple[int, int, list[str]]]] = []  # of each row: first column, columns, lines
    below: dict[int, int] = {}  # rows that a cell of an earlier row still takes of a column
    for row in rows:
        placed, j = [], 0
        held = {c: n - 1 for c, n in below.items() if n > 1}
        for cell in row:
            while below.get(j):
                j += 1
            lines = _render(cell, depth + 1)
            placed.append((j, cell.wide, lines))
            if cell.high > 1:
                held |= dict.fromkeys(range(j, j + cell.wide), cell.high - 1)
            if cell.wide == 1:
                widths[j] = max(widths.get(j, 0), max(map(len, lines), default=0))
            j += cell.wide
        grid.append(placed)
        below = held
    widths = {j: w if w * len(rows) <= PADDING else min(w, NARROW) for j, w in widths.items()}
    starts, last = {}, max((j + wide for placed in grid for j, wide, _ in placed), default=0)
    at = 0
    for j in range(last):
        starts[j] = at
        at += widths[j] + 2 if j in widths else 0
    out = []
    for placed in grid:
        for k in range(max((len(lines) for _, _, lines in placed), default=0)):
            line = ""
            for j, _, lines in placed:
                if k < len(lines) and lines[k]:
                    # An overlong cell pushes what stands right of it, and keeps two blanks before it.
                    line = line.ljust(max(starts[j], len(line) + 2 if line else 0)) + lines[k]
            out.append(line.rstrip(" "))
    return [_render(x, depth + 1) for x in strays], out


def _render(node: Node, depth: int = 0) -> list[str]:
    lines = Lines()
    _walk(node, lines, depth)
    return lines.done()


def _walk(node: Node, lines: Lines, depth: int) -> None:
    number = 1 if node.start is None or node.tag != "ol" else node.start
    for c in node.children:
        if isinstance(c, str):
            if not node.veiled and (node.tag not in ("table", "tbody", "thead", "tfoot", "tr", "ul", "ol", "colgroup") or c.strip(" \t\n\r\f")):
                lines.text(c)
            continue
        if c.hidden:
            continue
        tag = c.tag
        if tag == "br":
            held = lines.now.strip(" ")
            lines.line()
            if not held and lines.lines:
                lines.gap = True
        elif tag == "hr":
            lines.blank()
        elif tag == "pre":
            lines.blank()
            lines.put([x.rstrip() for x in "".join(_strings(c)).strip("\n").split("\n")])
            lines.gap = True
        elif tag == "table":
            lines.blank()
            # What is in no cell stands before the table, as browsers place it.
            strays, aligned = _table(c, depth + 1)
            for stray in strays:
                lines.put(stray)
            lines.put(aligned)
            lines.gap = True
        elif tag == "li":
            lines.line()
            number = number if c.start is None else c.start
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            inner = _render(c, depth + 1)
            lines.put([(mark if k == 0 else " " * len(mark)) + x if x else "" for k, x in enumerate(inner)])
        elif tag in BLOCKS:
            # A list inside a list's item follows the item's line.
            end = lines.blank if tag in SPACED and not (node.tag == "li" and tag in ("ul", "ol")) else lines.line
            end()
            _walk(c, lines, depth + 1)
            end()
        else:
            _walk(c, lines, depth + 1)


def _strings(node: Node) -> Iterator[str]:
    for c in node.children:
        if isinstance(c, str):
            if not node.veiled:
                yield c
        elif not c.hidden:
            if c.tag == "br":
                yield "\n"
            else:
                yield from _strings(c)


def render(source: str | None) -> str:
    """All visible text of a page."""
    return "\n".join(_render(tree(source))) if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id and text of every page; one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([render(h) for h in batch.column("html").to_pylist()], pa.string())], ["page_id", "text"])

    return bounded(pages).select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, "page_id long, text string")
