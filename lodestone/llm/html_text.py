"""HTML extraction: layout-aware rendering of all visible text.

A tokenizer and a tree builder with implied tags (p, li, dt and dd, table parts,
options; void elements; end tags without a start are dropped, open elements end
with their parent) give a tree; elements that are not displayed (head, script,
style, template, the hidden attribute, display:none, closed details and dialogs,
definitions and notes inside of drawings and formulas) go.  Visibility is inherited,
and a descendant may turn it on again: text shows by that of its own element.  What
style sheets say is not looked at, only style attributes.  The rest is laid out: white space collapses outside pre and
textarea, blocks stand on lines of their own with blank lines around paragraphs
and headings, list items get a marker and their depth as indent, table cells
begin where their columns do, over as many columns and rows as they span.  A
line of a cell widens its column up to OVERHANG characters; what is longer runs on,
and what follows in its line comes two spaces after.  Cells and rows
outside of their table parts get them, and whatever else stands between those is
laid out as blocks before the rows, as browsers do.

Null html gives null, empty html an empty text.  Truncated and broken pages
give what can be seen of them.  Elements may be nested to any depth: neither the
builder nor the layout calls itself.  Repeated rows and null ids are rendered
like any others; an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import slices

#: The most characters that a column is wide, and that lists and quotations indent.
OVERHANG = 400
# Fixed values of HTML: the most that a span may say.
MOST_COLUMNS, MOST_ROWS = 1000, 65_534

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE_RAW = frozenset(["textarea", "title"])
UNSEEN = frozenset("head script style template title meta link base noembed noframes iframe object audio video canvas datalist param source track area map".split())
#: Not displayed inside of svg and math.
FOREIGN, UNSEEN_THERE = frozenset(["svg", "math"]), frozenset("defs desc metadata symbol clippath mask annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup html legend li main menu nav ol optgroup option p pre search section select summary table ul".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
ENDS_P = BLOCK - frozenset(["body", "html", "option", "optgroup", "select", "legend", "dialog"]) | {"hr"}
#: A start tag ends these open elements, as far up as the second set.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select", "datalist"])),
}
SECTIONS = frozenset(["thead", "tbody", "tfoot"])
CELLS = frozenset(["td", "th"])
#: A start tag ends all that is open below the nearest of these in its table, or below the table.
TABLE_PARTS = {"tr": SECTIONS, "td": SECTIONS | {"tr"}, "th": SECTIONS | {"tr"}} | dict.fromkeys([*SECTIONS, "caption", "colgroup"], frozenset())
#: An end tag doesn't reach through these.
WALLS = frozenset(["table", "td", "th", "caption", "template"])

_TAG = re.compile(r"<(?:!--(.*?)(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
_MAY_HIDE = re.compile("hidden|style", re.IGNORECASE)
#: An attribute may spell letters as character references.
_VISIBILITY = re.compile("visibility|&", re.IGNORECASE)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
_NUMBER = re.compile(r"\s*([+-]?\d+)")
_SPACE = re.compile(r"[ \t\n\r\f]+")


@dataclass(slots=True)
class Node:
    tag: str
    attributes: str = ""
    children: list = field(default_factory=list)  # nodes and texts
    seen: bool = True  # whether its own texts are visible


class Open(list):
    """The open elements, outermost first, and how many of each tag there are: what isn't open needn't be looked for."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.count = Counter([root.tag])
        self.paragraphs = [0]  # for each element where the p is that a block would end, 0: none

    def push(self, node: Node) -> None:
        self.count[node.tag] += 1
        last = len(self) if node.tag == "p" else 0 if node.tag in WALLS or node.tag == "button" else self.paragraphs[-1]
        self.paragraphs.append(last)
        self.append(node)

    def cut(self, at: int) -> None:
        """End all elements from place `at` on."""
        self.count.subtract(n.tag for n in self[at:])
        del self[at:], self.paragraphs[at:]

    def some(self, tags: frozenset) -> bool:
        return any(self.count[t] > 0 for t in tags)


def attributes_of(text: str) -> dict[str, str]:
    """Names, in lower case, and values of a tag's attributes; of equal names the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    return out


def declarations(style: str) -> dict[str, str]:
    """Properties of a style attribute: the last of each counts, of important ones the last important."""
    out: dict[str, str] = {}
    important = set()
    for part in _COMMENT.sub("", style).lower().split(";"):
        name, colon, value = part.partition(":")
        name, (value, bang, word) = name.strip(), value.partition("!")
        if colon and value.strip() and (bang or name not in important):
            out[name] = value.strip()
            if bang and word.strip() == "important":
                important.add(name)
    return out


def build(page: str) -> Node:
    """The page's tree."""
    root = Node("html")
    stack = Open(root)
    at, end = 0, len(page)

    def close(tags: frozenset, stop: frozenset) -> None:
        """End the outermost open element of tags below the nearest of stop."""
        if not stack.some(tags):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in stop:
                break
            if stack[depth].tag in tags:
                found = depth
                while found > 1 and stack[found - 1].tag in tags:
                    found -= 1
                stack.cut(found)
                break

    def table_part(tag: str) -> None:
        """Go up to where a part of a table belongs; a cell outside of rows gets one."""
        if not stack.count["table"]:
            return
        found = None
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag == "template":
                return
            if found is None and stack[depth].tag in TABLE_PARTS[tag]:
                found = depth
            if stack[depth].tag == "table":
                stack.cut((found or depth) + 1)
                if tag in CELLS and stack[-1].tag != "tr":
                    row = Node("tr")
                    stack[-1].children.append(row)
                    stack.push(row)
                return

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            stack[-1].children.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            if tag in ("html", "body"):
                continue
            for depth in range(len(stack) - 1, 0, -1) if stack.count[tag] else ():
                if stack[depth].tag == tag:
                    stack.cut(depth)
                    break
                if stack[depth].tag in WALLS and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                    break
            else:
                if tag in ("p", "br"):
                    stack[-1].children.append(Node(tag))
            continue
        if tag == "html":
            continue
        if stack[-1].tag == "head" and tag not in UNSEEN and tag != "noscript":
            stack.cut(len(stack) - 1)  # the body begins
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in TABLE_PARTS:
            table_part(tag)
        if tag in ENDS_P and stack.paragraphs[-1]:
            stack.cut(stack.paragraphs[-1])
        node = Node(tag, m[4])
        stack[-1].children.append(node)
        if tag in RAW or tag in ESCAPABLE_RAW:
            closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            inner = page[at : closing.start() if closing else end]
            node.children.append(entities.unescape(inner) if tag in ESCAPABLE_RAW else inner)
            at = end if closing is None else (page.find(">", closing.end()) + 1 or end)
        elif tag not in VOID:
            stack.push(node)
    return root


def visible(node: Node) -> bool:
    """Whether an element is displayed at all."""
    if node.tag in UNSEEN:
        return False
    if node.tag == "dialog" and "open" not in attributes_of(node.attributes):
        return False
    if not node.attributes or not _MAY_HIDE.search(node.attributes):
        return True
    attributes = attributes_of(node.attributes)
    return "hidden" not in attributes and declarations(attributes.get("style", "")).get("display") != "none"


def with_visibility(root: Node) -> Node:
    """The tree with what elements inherit: `seen`, and nothing inside of what drawings and formulas don't display."""
    waiting = [(root, False)]
    while waiting:
        node, foreign = waiting.pop()
        foreign |= node.tag in FOREIGN
        for child in node.children:
            if isinstance(child, Node):
                child.seen = node.seen
                if child.attributes and _VISIBILITY.search(child.attributes):
                    told = declarations(attributes_of(child.attributes).get("style", "")).get("visibility")
                    child.seen = told not in ("hidden", "collapse") if told and told != "inherit" else node.seen
                if foreign and child.tag in UNSEEN_THERE:
                    child.children = []
                waiting.append((child, foreign))
    return root


class Layout:
    """Lines of text, filled from left to right."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False  # a blank line is due before the next text
        self.space = False  # a space is due before the next word
        self.indent = ""
        self.marker = ""

    def text(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if words.startswith(" "):
            self.space = True
        words_only = words.strip(" ")
        if words_only:
            self.write((" " if self.space and self.line else "") + words_only)
            self.space = words.endswith(" ")

    def write(self, text: str) -> None:
        if not self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.line.append(self.indent[: max(0, len(self.indent) - len(self.marker))] + self.marker)
            self.marker = ""
        self.line.append(text)

    def end_line(self, spaced: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False
        self.blank |= spaced and bool(self.lines)

    def break_line(self) -> None:
        if self.line:
            self.end_line()
        elif self.lines and not self.blank:
            self.lines.append("")

    def verbatim(self, text: str) -> None:
        rows = text.split("\n")
        for i, row in enumerate(rows):
            if i:
                if not self.line:
                    self.write("")
                self.end_line()
            if row:
                self.write(row.replace("\r", ""))

    def finished(self) -> str:
        self.end_line()
        return "\n".join(self.lines)


#: A part of the layout: it yields the parts that have to be done before it goes on.
Steps = Iterator["Steps"]


def done(steps: Steps) -> None:
    """All of the layout, whatever its depth."""
    waiting = [steps]
    while waiting:
        further = next(waiting[-1], None)
        if further is None:
            waiting.pop()
        else:
            waiting.append(further)


def lay(node: Node, out: Layout, pre: bool = False, depth: int = 0) -> Steps:
    for child in node.children:
        if isinstance(child, str):
            if node.seen:
                out.verbatim(child) if pre else out.text(child)
            continue
        if not visible(child):
            continue
        tag = child.tag
        if tag == "br":
            out.break_line()
        elif tag == "hr":
            out.end_line()
            if child.seen:
                out.write("---")
            out.end_line()
        elif tag == "table":
            out.end_line(True)
            yield lay_table(child, out, depth)
            out.end_line(True)
        elif tag in ("ul", "ol", "menu", "dir"):
            out.end_line(depth == 0)
            yield lay_list(child, out, depth)
            out.end_line(depth == 0)
        elif tag == "details" and "open" not in attributes_of(child.attributes):
            out.end_line()
            yield lay(Node("div", "", [c for c in child.children if isinstance(c, Node) and c.tag == "summary"][:1]), out, pre, depth)
            out.end_line()
        elif tag == "textarea":
            out.end_line()
            yield lay(child, out, True, depth)
            out.end_line()
        elif tag in BLOCK:
            spaced = tag in SPACED
            out.end_line(spaced)
            before = out.indent
            if tag in ("dd", "blockquote"):
                out.indent = (out.indent + "  ")[:OVERHANG]
            if tag == "pre" and child.children and isinstance(child.children[0], str):
                child.children[0] = child.children[0].removeprefix("\n")
            yield lay(child, out, pre or tag == "pre", depth)
            out.end_line(spaced)
            out.indent = before
        else:
            yield lay(child, out, pre, depth)


def lay_list(node: Node, out: Layout, depth: int) -> Steps:
    start = _NUMBER.match(attributes_of(node.attributes).get("start", ""))
    number = int(start[1]) if start else 1
    before = out.indent
    for child in node.children:
        if isinstance(child, Node) and child.tag == "li" and visible(child):
            marker = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            out.end_line()
            out.indent, out.marker = (before + " " * len(marker))[:OVERHANG], marker
            yield lay(child, out, False, depth + 1)
            out.end_line()
            out.marker = ""
            out.indent = before
        else:
            yield lay(Node("div", "", [child], node.seen), out, False, depth + 1)


def table_parts(node: Node) -> Iterator[Node | str]:
    """Rows, captions, and what else stands in a table, its sections and column groups; rows of a section end with it."""
    waiting = [(node, iter(node.children))]
    while waiting:
        parent, children = waiting[-1]
        child = next(children, None)
        if child is None:
            waiting.pop()
            yield END_OF_ROWS
        elif isinstance(child, str) and not parent.seen:
            continue
        elif isinstance(child, Node) and (child.tag in SECTIONS or child.tag == "colgroup"):
            if visible(child):
                yield END_OF_ROWS
                waiting.append((child, iter(child.children)))
        else:
            yield child


#: Cells don't span rows beyond this.
END_OF_ROWS = Node("")


def span_of(cell: Node, name: str, most: int) -> int:
    found = _NUMBER.match(attributes_of(cell.attributes).get(name, "")) if name in cell.attributes.lower() else None
    return min(max(1, int(found[1])), most) if found else 1


@dataclass
class Grid:
    """The cells of a table: where each begins, how many columns it spans, its lines."""

    rows: list[list[tuple[int, int, list[str]]]] = field(default_factory=list)
    taken: dict[int, int] = field(default_factory=dict)  # for each column the rows that a cell above still spans

    def add(self, cells: list[tuple[int, int, list[str]]]) -> None:
        """A row of cells (columns, rows, lines), from the left wherever there is room."""
        row, at, below = [], 0, {c: n - 1 for c, n in self.taken.items() if n > 1}
        for columns, rows, lines in cells:
            while self.taken.get(at):
                at += 1
            row.append((at, columns, lines))
            if rows > 1:
                below.update(dict.fromkeys(range(at, at + columns), rows - 1))
            at += columns
        self.taken = below
        if row:
            self.rows.append(row)

    def starts(self) -> dict[int, int]:
        """Where each column begins; columns without text of their own take no room."""
        widths: dict[int, int] = {}
        need = lambda lines: min(max(map(len, lines), default=0), OVERHANG)
        wide = []
        for row in self.rows:
            for at, columns, lines in row:
                if columns == 1:
                    widths[at] = max(widths.get(at, 0), need(lines))
                else:
                    wide.append((at, columns, need(lines)))
        used = sorted({at for row in self.rows for at, _, _ in row})
        for at, columns, width in sorted(wide):
            inside = used[bisect_left(used, at) : bisect_left(used, at + columns)]
            have = sum(widths.get(c, 0) + 2 for c in inside if widths.get(c) or c == inside[-1]) - 2
            widths[inside[-1]] = widths.get(inside[-1], 0) + max(0, width - have)
        starts, x = {}, 0
        for c in used:
            starts[c] = x
            x += widths[c] + 2 if widths.get(c) else 0
        return starts

    def lines(self) -> Iterator[str]:
        starts = self.starts()
        for row in self.rows:
            for i in range(max(len(lines) for _, _, lines in row)):
                out, length = [], 0
                for at, _, lines in row:
                    text = lines[i] if i < len(lines) else ""
                    if text:
                        gap = max(starts[at] - length, 2 if length else 0)
                        out += [" " * gap, text]
                        length += gap + len(text)
                yield "".join(out)


def lay_table(node: Node, out: Layout, depth: int) -> Steps:
    grid = Grid()
    before: list[Node] = []  # captions, and runs of what stands outside of any cell

    def stray(child: Node | str, run: bool) -> bool:
        if isinstance(child, Node) and child.tag == "caption":
            if visible(child):
                before.append(child)
            return False
        if not run:
            before.append(Node("div"))
        before[-1].children.append(child)
        return True

    run = False
    for part in table_parts(node):
        if part is END_OF_ROWS:
            grid.taken = {}
            continue
        if not isinstance(part, Node) or part.tag not in ("tr", *CELLS):
            run = stray(part, run)
            continue
        run = False
        if not visible(part):
            continue
        cells = []
        for cell in [part] if part.tag in CELLS else part.children:
            if isinstance(cell, str) and not part.seen:
                continue
            if not isinstance(cell, Node) or cell.tag not in CELLS:
                run = stray(cell, run)
                continue
            run = False
            if visible(cell):
                inner = Layout()
                yield lay(cell, inner, False, depth + 1)
                cells.append((span_of(cell, "colspan", MOST_COLUMNS), span_of(cell, "rowspan", MOST_ROWS), inner.finished().split("\n")))
        run = False
        grid.add(cells)
    for block in before:
        out.end_line()
        yield lay(block, out, False, depth)
        out.end_line()
    for line in grid.lines():
        if line.strip():
            out.write(line.rstrip(" "))
            out.end_line()


def render(page: str) -> str:
    """All visible text of a page."""
    out = Layout()
    done(lay(with_visibility(build(page)), out))
    return out.finished()


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """For each row its id, the visible text, and n_lines of it."""
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [None if page is None else render(page) for page in batch[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(texts, pa.string())], [id_col, "text"])

    rows = pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {id_type}, text string")
    return rows.withColumn("n_lines", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))))
