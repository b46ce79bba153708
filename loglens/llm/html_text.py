"""Text of HTML pages as a reader sees it: a tree built with implied tags, rendered block by block.

The tree builder opens and closes tags as browsers do where pages leave them out (``p``, ``li``, table parts, ``option``
…), and ignores end tags that match nothing. The renderer skips what is not visible, folds white space outside ``pre``,
separates blocks by a line and paragraphs by an empty one, numbers and indents lists, and pads table cells to columns;
what else stands in a table comes before it. Of a select the selected option is shown, else the first; of inputs their values.
Cells of more than ``MAX_CELL`` characters do not widen their column and are not padded, and cells over several columns are padded
to at most ``MAX_SPAN``, so the text of a table is no longer than a fixed multiple of the page. Tags are found in one pass over the
quotes and ends of tags, so the time is in proportion to the page, whatever is left open.
Each page is rendered on its own, so rows only pass through.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
HIDDEN = frozenset(
    "script style title head template noscript iframe noembed noframes object canvas audio video datalist".split()
)
#: Parts of svg and math that are not shown; elsewhere their names mean nothing.
FOREIGN_HIDDEN = frozenset("desc metadata defs symbol clippath mask marker pattern annotation annotation-xml".split())
#: Controls whose value is not shown as text.
NO_TEXT = frozenset("hidden checkbox radio password file image color range".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre xmp ul ol dl table figure hr".split())
BLOCK = PARAGRAPH | frozenset(
    "address article aside body caption center dd details dialog dir div dt fieldset figcaption footer form header hgroup "
    "html legend li main menu nav optgroup option section summary tbody td tfoot th thead tr".split()
)
CLOSES_P = (PARAGRAPH | BLOCK) - frozenset("caption dd dt body html legend li option optgroup tbody td tfoot th thead tr".split())
#: An opening tag closes these open ones, unless one of the fences stands between.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "caption"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "caption"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "caption"), ("table",)),
    "body": (("head",), ()),
}
#: What may hold a table part. An opening part closes all that is open above its holder, so that wrappers stay empty.
TABLE_PARTS = {
    "td": ("tr", "tbody", "thead", "tfoot", "table"),
    "th": ("tr", "tbody", "thead", "tfoot", "table"),
    "tr": ("tbody", "thead", "tfoot", "table"),
    "tbody": ("table",),
    "thead": ("table",),
    "tfoot": ("table",),
}
_SCOPE = frozenset("table td th caption html body".split())
MAX_DEPTH = 400  # deeper elements become siblings, as in browsers

MAX_CELL = 40
MAX_SPAN = 160
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MARK = re.compile("[\"'>]")
_NAME_END = re.compile(r"[\s/>]")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_UNQUOTED = re.compile(r"=\s*[^\s\"']\S*/$")
_FOLD = re.compile(r"[ \t\n\r\f]+")


class _Tags:
    """The tags of a page from left to right. What was found out about the rest of the page is kept, so that no part is looked
    through again from each tag left open."""

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.name_from = self.name_end = -1
        # For each quote or end of a tag: where a tag ends if it is open there outside of quotes, or -1.
        self.marks = [m.start() for m in _MARK.finditer(page)]
        self.ends = [-1] * (len(self.marks) + 1)
        later = {'"': -1, "'": -1}
        for i in range(len(self.marks) - 1, -1, -1):
            c = page[self.marks[i]]
            if c == ">":
                self.ends[i] = self.marks[i]
            else:
                if later[c] >= 0:
                    self.ends[i] = self.ends[later[c] + 1]
                later[c] = i

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, name, attributes) of the next tag; the name of a comment is empty."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            c = page[at : at + 1]
            if page.startswith("!--", at):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), False, "", ""
            if start > self.last:
                # No tag ends any more; only a comment can come.
                at = page.find("<!--", at)
                if at < 0:
                    return None
                continue
            if c in ("!", "?"):
                return start, page.find(">", at) + 1, False, "", ""
            closing = c == "/"
            name = at + closing
            if page[name : name + 1] not in _LETTERS:
                continue
            if not self.name_from <= name <= self.name_end:
                self.name_from, self.name_end = name, _NAME_END.search(page, name).start()
            end = self.ends[bisect_left(self.marks, self.name_end)]
            if end >= 0:
                return start, end + 1, closing, page[name : self.name_end], page[self.name_end : end]
        return None


@dataclass(slots=True)
class Node:
    name: str
    hidden: bool = False
    start: int = 1
    chosen: bool = False  # of an option: selected; of a select: shows all options; of details: open
    span: int = 1  # columns of a cell
    children: list[Node | str] = field(default_factory=list)


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(text)}


def _close(stack: list[Node], names: tuple[str, ...], fences: tuple[str, ...] | frozenset) -> None:
    """Closes the outermost open element with one of the names above the nearest fence."""
    at = None
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in names:
            at = i
        elif stack[i].name in fences:
            break
    if at is not None:
        del stack[at:]


def parse(page: str) -> Node:
    """The tree of a page. Anything can be parsed; what is no tag is text."""
    root = Node("#root")
    stack = [root]
    at = 0

    def add_text(text: str) -> None:
        if text:
            stack[-1].children.append(html.unescape(text) if "&" in text else text)

    tags = _Tags(page)
    while tag := tags.next(at):
        start, end, closing, name, attributes = tag
        add_text(page[at:start])
        at = end
        if not name:
            continue
        name = name.lower()
        if closing:
            if name == "p" and not any(n.name == "p" for n in stack):
                stack[-1].children.append(Node("p"))
            elif name == "br":
                stack[-1].children.append(Node("br"))
            else:
                _end(stack, name)
            continue
        if name in CLOSES_P:
            _close(stack, ("p",), _SCOPE)
        if name in IMPLIED:
            _close(stack, *IMPLIED[name])
        if name in TABLE_PARTS:
            _to_holder(stack, TABLE_PARTS[name])
        if name in ("td", "th") and stack[-1].name in ("table", "tbody", "thead", "tfoot"):
            _open(stack, Node("tr"))
        node = Node(name)
        foreign = name in FOREIGN_HIDDEN or attributes.endswith("/")
        foreign = foreign and any(n.name in ("svg", "math") for n in stack)
        if attributes.strip(" /\n\t"):
            values = _attributes(attributes)
            node.hidden = (
                "hidden" in values
                or bool(_HIDING.search(values.get("style", "")))
                or (name == "input" and values.get("type", "").lower() == "hidden")
                or (name == "dialog" and "open" not in values)
            )
            if name == "ol" and re.fullmatch(r"-?\d{1,9}", values.get("start", "")):
                node.start = int(values["start"])
            if name == "img" and values.get("alt"):
                node.children.append(values["alt"])
            if name == "input" and values.get("type", "").lower() not in NO_TEXT and values.get("value"):
                node.children.append(values["value"])
            node.chosen = {"option": "selected", "select": "multiple", "details": "open"}.get(name, "") in values
            if name in ("td", "th") and re.fullmatch(r"[1-9]\d{0,2}", values.get("colspan", "")):
                node.span = int(values["colspan"])
        elif name == "dialog":
            node.hidden = True
        if foreign:
            node.hidden |= name in FOREIGN_HIDDEN
            if attributes.endswith("/") and not _UNQUOTED.search(attributes):
                stack[-1].children.append(node)
                continue
        if name in VOID or (name in RAW):
            stack[-1].children.append(node)
            if name in RAW:
                closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                end = page.find(">", closing.end()) if closing else -1
                if name in ("xmp", "textarea"):
                    body = page[at : closing.start() if end >= 0 else len(page)]
                    node.children.append(html.unescape(body) if name == "textarea" else body)
                at = end + 1 if end >= 0 else len(page)
        else:
            _open(stack, node)
    add_text(page[at:])
    return root


def _open(stack: list[Node], node: Node) -> None:
    stack[-1].children.append(node)
    if len(stack) < MAX_DEPTH:
        stack.append(node)


def _to_holder(stack: list[Node], holders: tuple[str, ...]) -> None:
    """Closes what is open above the nearest holder of a table part, but no cell around it."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in holders:
            del stack[i + 1 :]
            return
        if stack[i].name in ("td", "th", "caption"):
            return


def _end(stack: list[Node], name: str) -> None:
    """Closes the nearest open element of the name; a cell's or table's end is not passed by tags within."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name == name:
            del stack[i:]
            return
        if stack[i].name in ("td", "th", "caption") and name not in ("tr", "tbody", "thead", "tfoot", "table", "body", "html"):
            return
        if stack[i].name == "table" and name not in ("table", "body", "html"):
            return


class _Lines:
    """Rendered lines; spaces are folded across elements, and empty lines never double."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.gap = False

    def text(self, text: str) -> None:
        folded = _FOLD.sub(" ", text)
        if not folded:
            return
        if folded == " ":
            self.space = True
            return
        if (self.space or folded[0] == " ") and self.parts:
            self.parts.append(" ")
        self.space = folded[-1] == " "
        self.parts.append(folded.strip(" "))

    def end(self, gap: bool = False) -> None:
        """Ends the line; ``gap`` asks for an empty line before what comes next."""
        if self.parts:
            self.whole("".join(self.parts))
        self.parts, self.space = [], False
        self.gap |= gap

    def whole(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(line)

    def pre(self, text: str) -> None:
        for i, line in enumerate(text.split("\n")):
            if i:
                self.whole("".join(self.parts).rstrip()) if self.parts else self.whole("")
                self.parts = []
            if line:
                self.parts.append(line)


def _rendered(nodes: list[Node | str], pre: bool = False) -> list[str]:
    out = _Lines()
    _render(nodes, out, pre)
    out.end()
    return out.lines


def _render(nodes: list[Node | str], out: _Lines, pre: bool) -> None:
    for node in nodes:
        if isinstance(node, str):
            (out.pre if pre else out.text)(node)
            continue
        if node.hidden or node.name in HIDDEN:
            continue
        if node.name == "svg":
            _svg(node.children, out, pre)
            continue
        if node.name == "select":
            _select(node, out, pre)
            continue
        if node.name == "br":
            if out.parts:
                out.end()
            else:
                out.whole("")
            continue
        if node.name not in BLOCK and node.name != "textarea":
            _render(node.children, out, pre)
            continue
        gap = node.name in PARAGRAPH
        out.end(gap)
        if node.name == "details" and not node.chosen:
            summaries = (c for c in node.children if isinstance(c, Node) and c.name == "summary")
            _render(list(islice(summaries, 1)), out, pre)
        elif node.name in ("ul", "ol", "menu", "dir"):
            _list(node, out)
        elif node.name == "table":
            _table(node, out)
        elif node.name in ("pre", "xmp", "textarea"):
            lines = _rendered(node.children, True)
            while lines and not lines[0].strip():
                del lines[0]
            for line in lines:
                out.whole(line)
        elif node.name in ("blockquote", "dd"):
            for line in _rendered(node.children):
                out.whole("  " + line if line else "")
        elif node.name == "hr":
            out.whole("---")
        else:
            _render(node.children, out, pre)
        out.end(gap)


def _svg(nodes: list[Node | str], out: _Lines, pre: bool) -> None:
    """The text elements, each a word of its own; text around them is not shown."""
    for node in nodes:
        if isinstance(node, str) or node.hidden:
            continue
        if node.name in ("svg", "g", "a", "switch"):
            _svg(node.children, out, pre)
        else:
            out.space = True
            _render([node], out, pre)
            out.space = True


def _options(node: Node) -> list[Node]:
    found = []
    for child in node.children:
        if isinstance(child, Node) and not child.hidden:
            found += [child] if child.name == "option" else _options(child)
    return found


def _select(node: Node, out: _Lines, pre: bool) -> None:
    """All options of a list that takes several, else the one that the page selects, else the first."""
    options = _options(node)
    for option in options if node.chosen else [o for o in options if o.chosen][-1:] or options[:1]:
        out.space = True
        _render(option.children, out, pre)
        out.space = True


def _list(node: Node, out: _Lines) -> None:
    number = node.start
    for child in node.children:
        if isinstance(child, str):
            out.text(child)
        elif child.name != "li":
            _render([child], out, False)
        elif not child.hidden:
            out.end()
            mark = f"{number}. " if node.name == "ol" else "- "
            number += 1
            lines = _rendered(child.children)
            for i, line in enumerate(lines):
                out.whole((mark if not i else " " * len(mark)) + line if line else "")


def _rows(node: Node) -> list[Node]:
    found = []
    for child in node.children:
        if isinstance(child, Node) and not child.hidden:
            if child.name == "tr":
                found.append(child)
            elif child.name in ("tbody", "thead", "tfoot"):
                found += _rows(child)
    return found


def _strays(node: Node) -> list[Node | str]:
    """What stands between the parts of a table; browsers show it before the table, even out of hidden parts."""
    found = []
    for child in node.children:
        if isinstance(child, Node) and child.name in ("tr", "tbody", "thead", "tfoot", "colgroup"):
            found += _strays(child)
        elif isinstance(child, str) or not (node.name == "tr" and child.name in ("td", "th")):
            found.append(child)
    return found


def _table(node: Node, out: _Lines) -> None:
    rows = [
        [(" ".join(x.strip() for x in _rendered(c.children) if x.strip()), c.span) for c in row.children
         if isinstance(c, Node) and c.name in ("td", "th") and not c.hidden]
        for row in _rows(node)
    ]
    strays = _strays(node)
    _render(strays, out, False)
    out.end()
    widths: dict[int, int] = {}
    for row in rows:
        column = 0
        for cell, span in row:
            if span == 1 and len(cell) <= MAX_CELL:
                widths[column] = max(widths.get(column, 0), len(cell))
            column += span
    for row in rows:
        if not any(cell for cell, _ in row):
            continue
        cells, column = [], 0
        for cell, span in row:
            over = [widths[i] for i in range(column, column + span) if i in widths]
            width = sum(over) + 3 * (len(over) - 1)
            cells.append(cell.ljust(width) if width <= MAX_SPAN else cell)
            column += span
        out.whole(" | ".join([*cells[:-1], row[-1][0]]).rstrip())


def page_text(page: str | None) -> str:
    """The visible text of a page; empty for null, and for pages without any."""
    if not page:
        return ""
    lines = [line.rstrip() for line in _rendered(parse(page.replace("\r\n", "\n").replace("\r", "\n")).children)]
    return "\n".join(lines).strip("\n")


def text_column(name: str) -> Column:
    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([page_text(p) for p in pages.to_pylist()], pa.string())

    return extract.asNondeterministic()(F.col(name))


def extract(pages: DataFrame, page_id: str = "page_id", html_column: str = "html") -> DataFrame:
    """(page_id, text) per row. Null and empty pages give an empty text; text without tags is itself, folded; tags left
    open end with the page. Repeated rows and null ids pass through; other columns are not read."""
    return pages.select(F.col(page_id), text_column(html_column).alias("text"))


