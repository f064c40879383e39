"""HTML to text as it is laid out.

A tree builder adds the tags that HTML implies (a paragraph ends at the next block, a list item at the next, rows and
cells at theirs), visibility rules take out what a browser does not show, and the renderer emits all that is left:
blocks on lines of their own with the blank lines of their margins, lists with their marks and indents, preformatted
text as it is, and table cells in aligned columns, whatever their depth. Reading and layout keep their own stacks and
take time linear in the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.arrowtext import SLICE, as_bytes, slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe noembed noframes xmp textarea title object svg math".split())
#: Never shown, with all that they hold.
UNSEEN = frozenset("head script style template noscript iframe noembed noframes title datalist object svg math audio video canvas".split())
#: Blocks with a blank line around them, and those that only begin a line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr menu fieldset".split())
BLOCK = SPACED | frozenset(
    "address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav option "
    "optgroup section summary tbody td tfoot th thead tr search".split()
)
ENDS_P = BLOCK - frozenset("option optgroup body html caption tbody td tfoot th thead tr".split())
#: tag -> (open elements that its start ends, elements beyond which this does not reach)
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}), "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "body": ({"head"}, set()),
}
#: An end tag does not close what lies outside of these.
BARRIER = frozenset("table td th caption".split())
#: A tag up to its end or its first quote.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)([^>"']*)""")
UNQUOTED = re.compile(r"""[^>"']*""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
SIMPLE = re.compile(r"\s*([a-z][a-z0-9]*)?([.#][\w-]+)?\s*$", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")
#: Spaces that align a column, at most, for each character and cell of it (see _widths).
PADDING = 16


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(text: str) -> dict[str, str]:
    if not text or text.isspace() or text == "/":
        return {}
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


class Tags:
    """Where the tags of a page end. Quotes hide the sign that ends a tag; a tag whose quotes never end is none.

    From an opening quote on, what follows does not depend on where the tag began. So the opening quotes from which no
    end is reached are kept, and none is tried twice: reading all tags takes time linear in the page.
    """

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.endless: set[int] = set()

    def at(self, lt: int) -> tuple[bool, str, str, int] | None:
        """(whether an end tag, name, attributes, first place after the tag) of the tag that begins at lt."""
        head = TAG.match(self.source, lt)
        if head is None:
            return None
        source, p, tried = self.source, head.end(), []
        while p <= self.last:
            sign = source[p]
            if sign == ">":
                return bool(head[1]), head[2].lower(), source[head.start(3) : p], p + 1
            if p in self.endless:
                break
            tried.append(p)
            close = source.find(sign, p + 1)
            if close < 0 or close > self.last:
                break
            p = UNQUOTED.match(source, close + 1).end()
        self.endless.update(tried)
        return None


def build(source: str) -> tuple[Node, str]:
    """The tree of a page, and the text of its style sheets. Anything is accepted; text is never lost."""
    root, styles = Node("#root", {}), []
    stack, counts = [root], {}

    def close(to: int) -> None:
        for node in stack[to:]:
            counts[node.tag] -= 1
        del stack[to:]

    def find(tags: set[str] | frozenset[str], barriers: set[str] | frozenset[str]) -> int:
        """Depth of the nearest open element among tags, or 0 where a barrier comes first."""
        if not any(counts.get(t) for t in tags):
            return 0
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                return depth
            if stack[depth].tag in barriers:
                return 0
        return 0

    at, n = 0, len(source)
    tags = Tags(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            stack[-1].children.append(source[at:])
            break
        if lt > at:
            stack[-1].children.append(source[at:lt])
        nxt = source[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            mark = ("-->", 4) if source.startswith("<!--", lt) else (">", 2)
            end = source.find(mark[0], lt + mark[1])
            at = n if end < 0 else end + len(mark[0])
            continue
        maybe = lt < tags.last and (nxt.isalpha() or nxt == "/")
        tag = tags.at(lt) if maybe else None
        if tag is None:
            end = source.find(">", lt) if maybe else -1
            if end < 0:  # no tag: the sign itself
                stack[-1].children.append("<")
                at = lt + 1
            else:
                at = end + 1
            continue
        ends, name, given, at = tag
        if ends:
            if name == "br":
                stack[-1].children.append(Node("br", {}))
            elif name in ("body", "html"):
                continue
            else:
                depth = find({name}, BARRIER if name not in ("table", "tr", "tbody", "thead", "tfoot") else frozenset({"table"}) - {name})
                if depth:
                    close(depth)
            continue
        if name in ENDS_P and counts.get("p"):
            depth = find({"p"}, BARRIER | {"button", "#root"})
            if depth:
                close(depth)
        if name in ENDED_BY:
            depth = find(*ENDED_BY[name])
            if depth:
                close(depth)
        if name in ("td", "th") and not find({"tr"}, {"table"}) and counts.get("table"):
            _open(stack, counts, Node("tr", {}))
        if counts.get("head") and name in BLOCK and name not in ("html", "body"):
            depth = find({"head"}, set())
            if depth:
                close(depth)
        node = Node(name, _attributes(given))
        if name in VOID or (given.endswith("/") and name in ("svg", "math", "object")):
            stack[-1].children.append(node)
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?![^\s/>])", re.I).search(source, at)
            inner = source[at : end.start() if end else n]
            if name == "style":
                styles.append(inner)
            elif name in ("textarea", "xmp"):
                node.children.append(inner)
            stack[-1].children.append(node)
            if end is None:
                break
            close_at = source.find(">", end.start())
            at = n if close_at < 0 else close_at + 1
        else:
            _open(stack, counts, node)
    return root, "\n".join(styles)


def _open(stack: list[Node], counts: dict[str, int], node: Node) -> None:
    stack[-1].children.append(node)
    stack.append(node)
    counts[node.tag] = counts.get(node.tag, 0) + 1


def hiding_rules(css: str) -> set[tuple[str, str]]:
    """(tag or '', .class or #id or '') of simple selectors whose rule hides."""
    out: set[tuple[str, str]] = set()
    if "none" not in css and "hidden" not in css and "collapse" not in css:
        return out
    for selectors, body in RULE.findall(css):
        if HIDING.search(body):
            for one in selectors.split(","):
                m = SIMPLE.match(one)
                if m and (m[1] or m[2]):
                    out.add(((m[1] or "").lower(), m[2] or ""))
    return out


def visible(node: Node, rules: set[tuple[str, str]]) -> bool:
    if node.tag in UNSEEN:
        return False
    a = node.attrs
    if a:
        if "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
            return False
        if "style" in a and HIDING.search(a["style"]):
            return False
    if node.tag == "dialog" and "open" not in a:
        return False
    if rules:
        marks = ["", *[f".{c}" for c in a.get("class", "").split()], *([f"#{a['id']}"] if a.get("id") else [])]
        if any((t, m) in rules for t in (node.tag, "") for m in marks if t or m):
            return False
    return True


class Flow:
    """Text under layout: lines so far, blank lines that are due, and white space that waits.

    A line is a text, or (indent, lines): lines that were laid out in a cell, from the second on, which are not copied
    again at each level of nested tables.
    """

    def __init__(self) -> None:
        self.lines: list[str | tuple[str, list]] = []
        self.now: list[str] = []
        self.due = self.gap = 0
        self.space = False
        self.indent: list[str] = []
        self.mark = ""
        self.pre = 0
        self.lists: list[list] = []

    def text(self, data: str) -> None:
        data = SPACES.sub(" ", data)
        if data == " " or not data:
            self.space = self.space or bool(data and self.now)
            return
        lead = bool(self.now) and (self.space or data[0] == " ")
        self._begin()
        if lead and not self.now[-1].endswith(" "):
            self.now.append(" ")
        self.space = data[-1] == " "
        self.now.append(data.strip(" "))

    def _begin(self) -> None:
        if not self.now:
            if self.lines and self.gap > 1:
                self.lines.extend([""] * (self.gap - 1))
            self.gap = 0
            lead = "".join(self.indent)
            if self.mark:
                lead = lead[: max(0, len(lead) - len(self.mark))] + self.mark
                self.mark = ""
            self.now.append(lead)
            self.space = False

    def end(self, lines: int) -> None:
        """End the line; lines: 1, or 2 for a blank line before what follows."""
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
        self.gap = max(self.gap, lines)
        self.space = False

    def line_break(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
        elif self.lines:
            self.lines.append("")
        self.space = False

    def verbatim(self, data: str) -> None:
        for k, line in enumerate(data.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if k:
                if not self.now:
                    self._begin()
                self.lines.append("".join(self.now).rstrip())
                self.now = []
            if line:
                self._begin()
                self.now.append(line)

    def block(self, lines: list) -> None:
        """Finished lines of a cell on lines of their own."""
        self.end(1)
        self._begin()
        self.now.append(lines[0])
        if len(lines) > 1:
            self.end(1)
            self.lines.append(("".join(self.indent), lines[1:]))
        self.end(1)

    def finish(self) -> list:
        self.end(1)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def joined(lines: list) -> str:
    out, todo = [], [("", iter(lines))]
    while todo:
        lead, rest = todo[-1]
        for x in rest:
            if isinstance(x, tuple):
                todo.append((lead + x[0], iter(x[1])))
                break
            out.append(lead + x if x else x)
        else:
            todo.pop()
    return "\n".join(out)


def _cells(table: Node, rules: set[tuple[str, str]]) -> tuple[list[Node], list[list[Node]]]:
    """Captions and what else is outside of rows; rows of visible cells."""
    rest, rows, todo = [], [], list(reversed(table.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if not x.isspace():
                rest.append(x)
        elif not visible(x, rules):
            continue
        elif x.tag in ("tbody", "thead", "tfoot"):
            todo.extend(reversed(x.children))
        elif x.tag == "tr":
            cells, loose = [], []
            for c in x.children:
                if isinstance(c, Node) and c.tag in ("td", "th"):
                    if visible(c, rules):
                        cells.append(c)
                elif not (isinstance(c, str) and c.isspace()):
                    loose.append(c)
            rest.extend(loose)
            rows.append(cells)
        elif x.tag not in ("colgroup", "col"):
            rest.append(x)
    return rest, rows


class Table:
    """A table under layout: rows of cells that wait, and the laid-out cells of the rows before."""

    def __init__(self, rows: list[list[Node]], flow: Flow):
        self.flow, self.rows = flow, rows
        self.grid: list[list[tuple[list, int]]] = [[] for _ in rows]
        self.todo = [(r, cell) for r in range(len(rows) - 1, -1, -1) for cell in reversed(rows[r])]

    def add(self, row: int, cell: Node, lines: list) -> None:
        span = cell.attrs.get("colspan", "1")
        self.grid[row].append((lines, min(1000, max(1, int(span))) if span.isascii() and span.isdigit() and len(span) < 6 else 1))

    def lay_out(self) -> None:
        """In aligned columns; where a cell has several lines, cells come one after another as blocks instead."""
        flow = self.flow
        if any(len(lines) > 1 for row in self.grid for lines, _ in row):
            for row in self.grid:
                for lines, _ in row:
                    if lines:
                        flow.block(lines)
            return
        rows = [[(lines[0] if lines else "", span) for lines, span in row] for row in self.grid]
        upto = _widths(rows)
        pads, text = [], 0
        for row in rows:
            c = 0
            for x, span in row:
                end = min(c + span, len(upto) - 1)
                pads.append(upto[end] - upto[c] + 2 * (end - c - 1) if end > c else 0)
                c += span
                text += len(x) + 1
        spare = sum(max(0, wide - len(x)) for wide, (x, span) in zip(pads, (cell for row in rows for cell in row), strict=True) if span > 1)
        wide = iter(pads)
        for row in rows:
            done = "  ".join([x.ljust(w) if span == 1 or spare <= PADDING * text else x for (x, span), w in zip(row, wide)]).rstrip()
            if done:
                flow.block([done])


def _widths(rows: list[list[tuple[str, int]]]) -> list[int]:
    """Running sums of the columns' widths, from 0. A column is as wide as its widest cell, if that takes at most PADDING
    spaces for each character and cell of the column; else as the widest of its cells for which this holds, and wider
    ones reach over it. So a laid-out table is linear in its text, and one odd cell does not push all others apart."""
    sizes: list[list[int]] = []
    for row in rows:
        c = 0
        for text, span in row:
            sizes.extend([] for _ in range(c + (span == 1) - len(sizes)))
            if span == 1:
                sizes[c].append(len(text))
            c += span
    upto = [0]
    for column in sizes:
        column.sort()
        most, width, below = PADDING * (sum(column) + len(column)), 0, 0
        for k, size in enumerate(column):  # below: characters of the k shorter ones
            if size * k - below <= most:
                width = size
            below += size
        upto.append(upto[-1] + width)
    return upto


def _render(root: Node, flow: Flow, rules: set[tuple[str, str]]) -> None:
    """Lay a tree out. What is to be done waits on one stack, cells and nested tables too."""
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            data = html.unescape(x) if "&" in x else x
            flow.verbatim(data) if flow.pre else flow.text(data)
            continue
        if isinstance(x, Table):
            if x.todo:  # the next cell, in a flow of its own
                row, cell = x.todo.pop()
                flow = Flow()
                todo.append((x, row, cell))
                todo.extend(reversed(cell.children))
            else:
                x.lay_out()
                flow.end(2)
            continue
        if isinstance(x, tuple) and len(x) == 3:  # the end of a cell
            table, row, cell = x
            table.add(row, cell, flow.finish())
            flow = table.flow
            todo.append(table)
            continue
        if isinstance(x, tuple):  # the end of an element
            tag, undo = x
            if tag in BLOCK:
                flow.end(2 if tag in SPACED and not (tag in ("ul", "ol") and len(flow.lists) > 1) else 1)
            if tag in ("ul", "ol", "menu", "dir"):
                flow.lists.pop()
            if undo:
                flow.indent.pop()
                flow.mark = ""
            if tag in ("pre", "textarea", "xmp"):
                flow.pre -= 1
            continue
        tag = x.tag
        if tag[0] != "#" and not visible(x, rules):
            continue
        if tag == "br":
            flow.line_break()
            continue
        if tag == "wbr" or tag in VOID - {"hr", "input"}:
            continue
        if tag == "input":
            if x.attrs.get("type", "").lower() in ("submit", "button", "reset") and x.attrs.get("value"):
                flow.text(f" {x.attrs['value']} ")
            continue
        if tag in BLOCK:
            flow.end(2 if tag in SPACED and not (tag in ("ul", "ol") and flow.lists) else 1)
        if tag == "table":
            rest, rows = _cells(x, rules)
            todo.append(Table(rows, flow))
            if rest:
                holder = Node("div", {})
                holder.children = rest
                todo.append(holder)
            continue
        undo = False
        if tag in ("ul", "ol", "menu", "dir"):
            start = x.attrs.get("start", "1")
            flow.lists.append([tag, int(start) if start.isascii() and start.isdigit() and len(start) < 9 else 1])
        elif tag == "li":
            mark = "- "
            if flow.lists and flow.lists[-1][0] == "ol":
                mark = f"{flow.lists[-1][1]}. "
                flow.lists[-1][1] += 1
            flow.indent.append(" " * len(mark))
            flow.mark, undo = mark, True
        elif tag == "dd" or tag == "blockquote":
            flow.indent.append("  ")
            undo = True
        elif tag in ("td", "th", "q"):
            flow.space = True
        elif tag in ("pre", "textarea", "xmp"):
            flow.pre += 1
            if x.children and isinstance(x.children[0], str) and x.children[0].startswith("\n"):
                x.children[0] = x.children[0][1:]
        todo.append((tag, undo))
        todo.extend(reversed(x.children))


def render(source: str | None) -> str:
    """All visible text of a page; null and empty give the empty string."""
    if not source:
        return ""
    root, css = build(source)
    flow = Flow()
    _render(root, flow, hiding_rules(css))
    return joined(flow.finish())


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with out_col: the laid-out text of html_col. Every row stays; a null page gives the empty string; a column
    already named like out_col is replaced."""
    keep = [c for c in pages.columns if c not in (html_col, out_col)]
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = as_bytes(batch.column(n_keep))
            for a, b in slices(off, 8 * SLICE):
                part = batch.slice(a, b - a)
                text = pa.array([render(x.as_py()) for x in part.column(n_keep)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:n_keep], text], [*[f"_c{i}" for i in range(n_keep)], "_text"])

    given = pages.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)], F.col(f"`{html_col}`").alias("_html"))
    schema = ", ".join([*[f"_c{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)], "_text string"])
    return given.mapInArrow(run, schema).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], F.col("_text").alias(out_col))
