"""Visible text of web pages, laid out as a browser would.

A tokenizer that reads each character once and a small tree builder (void and raw-text elements, implied
end tags, a bound on depth) are followed by rules of visibility and a layout: blocks start lines, some keep
an empty line around them, lists carry marks and indents, table cells are aligned in columns and reach
over rows and columns, preformatted text keeps its spaces.

A null page gives null, an empty one or one without visible text an empty text. Markup of any kind gives a
text: what is no markup is text, and a tag or comment that never ends reaches to the page's end. Elements
deeper than ``DEEPEST`` join their ancestor; a cell wider than ``WIDEST`` is shown whole and moves its row.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, functions as F

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas title meta link datalist".split())
#: In drawings only text elements show their text; formulas show all but their other forms.
UNDRAWN = frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient".split())
OTHER_FORMS = frozenset("annotation annotation-xml".split())
#: Inputs whose value is their label, with the label shown where none is given.
BUTTONS = {"submit": "Submit", "reset": "Reset", "button": ""}
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir".split())
#: A start tag ends these open elements, up to a boundary.
ENDS = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist optgroup"),
    "optgroup": ("option optgroup", "select"), "tr": ("tr td th caption colgroup", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("tbody thead tfoot tr td th caption colgroup", "table"), "thead": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "tfoot": ("tbody thead tfoot tr td th caption colgroup", "table"), "body": ("head", "html"),
}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
#: A start tag of a block ends an open paragraph.
ENDS_P = BLOCK - {"html", "body", "option", "optgroup", "legend", "dialog"}
SCOPE = frozenset("table td th caption button object html template".split())
IN_HEAD = frozenset("base link meta noscript script style template title head html".split())
#: What may stand directly in the parts of a table; other elements and text there go before the table.
TABLE_PARTS = frozenset("table tbody thead tfoot tr colgroup".split())
IN_TABLE = frozenset("caption colgroup col tbody thead tfoot tr td th".split())
STAYS = IN_TABLE | {"script", "style", "template"}
FOREIGN = frozenset({"svg", "math"})
DEEPEST = 150
WIDEST = 60

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"(=?[^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?")
_GONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_SEEN = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.I)
_SPACE = re.compile(r"[ \t\n\f\r]+")


@dataclass
class Node:
    tag: str
    attributes: dict[str, str]
    children: list[Node | str] = field(default_factory=list)
    parent: Node | None = field(default=None, repr=False, compare=False)


@dataclass
class Token:
    """Markup from ``start`` to ``end``; ``name`` is empty for comments and declarations."""

    start: int
    end: int
    name: str = ""
    closes: bool = False
    attributes: dict[str, str] = field(default_factory=dict)
    closed: bool = False


def token(page: str, at: int) -> Token | None:
    """The next markup at or after ``at``. What follows ``<`` and is no markup is text."""
    start = page.find("<", at)
    while start >= 0:
        mark = page[start + 1 : start + 2]
        if mark in ("!", "?") and mark:
            comment = page.startswith("<!--", start)
            end = page.find("-->" if comment else ">", start + (4 if comment else 2))
            return Token(start, len(page) if end < 0 else end + (3 if comment else 1))
        name = _NAME.match(page, start + 1 + (mark == "/"))
        if name:
            return _tag(page, start, name[0].lower(), mark == "/", name.end())
        start = page.find("<", start + 1)
    return None


def _tag(page: str, start: int, name: str, closes: bool, at: int) -> Token:
    """A tag read attribute by attribute, as far as its ``>``; the first of equal names counts."""
    found: dict[str, str] = {}
    while True:
        gap = _GAP.match(page, at)
        at = gap.end()
        if at >= len(page):
            return Token(start, len(page))  # never ended: no tag
        if page[at] == ">":
            return Token(start, at + 1, name, closes, found, gap[0].endswith("/"))
        m = _ATTRIBUTE.match(page, at)
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        at = m.end()


def tree(page: str) -> Node:
    """The elements of a page. Unknown end tags are skipped; elements beyond a depth join their ancestor."""
    root = Node("html", {})
    stack = [root]
    at = 0
    while at < len(page):
        found = token(page, at)
        if found is None:
            _text(stack, page[at:])
            break
        if found.start > at:
            _text(stack, page[at : found.start])
        at, name = found.end, found.name
        if not name:
            continue
        if found.closes:
            _close(stack, name)
            continue
        if name not in IN_HEAD:
            _leave_head(stack)
        _imply(stack, name)
        node = Node(name, found.attributes)
        if name in ("html", "body") and any(n.tag == name for n in stack):
            continue
        if name in IN_TABLE or name == "table":
            _to_table(stack, name)
        if name == "form" and stack[-1].tag in TABLE_PARTS:
            continue
        stays = name in STAYS or (name == "input" and node.attributes.get("type", "").lower() == "hidden")
        _put(stack, node, stays)
        if found.closed and (name in FOREIGN or any(n.tag in FOREIGN for n in stack)):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            inner = page[at : end.start() if end else len(page)]
            if inner:
                node.children.append(html.unescape(inner) if name in ("textarea", "title") else inner)
            close = page.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else len(page)
        elif name not in VOID and len(stack) < DEEPEST:
            stack.append(node)
    return root


def _leave_head(stack: list[Node]) -> None:
    """What cannot stand in the head ends it."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == "head":
            del stack[i:]


def _text(stack: list[Node], text: str) -> None:
    if stack[-1].tag == "head" and text.strip():
        _leave_head(stack)
    _put(stack, html.unescape(text) if "&" in text else text, not text.strip(" \t\n\f\r"))


def _put(stack: list[Node], child: Node | str, stays: bool) -> None:
    """Appends to the open element; what cannot stand directly in a part of a table goes before the table."""
    home = stack[-1]
    place = len(home.children)
    if not stays and home.tag in TABLE_PARTS:
        table = next((n for n in reversed(stack) if n.tag == "table"), None)
        if table is not None and table.parent is not None:
            # A table may itself have been put before another one, so its parent need not be below it in the stack.
            home = table.parent
            place = next((i for i in range(len(home.children) - 1, -1, -1) if home.children[i] is table), len(home.children))
    home.children.insert(place, child)
    if isinstance(child, Node):
        child.parent = home


def _to_table(stack: list[Node], name: str) -> None:
    """Leaves what was put before a table when one of its parts follows; a table directly in a table ends it."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in ("td", "th", "caption", "template"):
            return
        if stack[i].tag == "table":
            if name == "table":
                del stack[i:]
            while stack[-1].tag not in TABLE_PARTS and len(stack) > i + 1:
                stack.pop()
            return


def _imply(stack: list[Node], name: str) -> None:
    """End tags that the start of ``name`` implies."""
    if name in ENDS_P:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p":
                del stack[i:]
                break
            if stack[i].tag in SCOPE:
                break
    ends, bound = ENDS.get(name, ((), ()))
    last = len(stack)
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in bound:
            break
        if stack[i].tag in ends:
            last = i
    if last > 0:
        del stack[last:]


def _close(stack: list[Node], name: str) -> None:
    if name == "br":
        _put(stack, Node("br", {}), False)
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == name:
            del stack[i:]
            return
        if stack[i].tag in ("td", "th", "table") and name not in ("table", "tr", "tbody", "thead", "tfoot"):
            return


def displayed(node: Node) -> bool:
    """Whether an element takes part in the layout, whatever its visibility."""
    given = node.attributes
    if node.tag in HIDDEN or "hidden" in given or (node.tag == "dialog" and "open" not in given):
        return False
    if node.tag == "input" and given.get("type", "").lower() == "hidden":
        return False
    return not ("style" in given and _GONE.search(given["style"]))


def prune(node: Node, shown: bool = True, drawing: bool = False) -> None:
    """Leaves what is visible below ``node``; what is visible inside something invisible stays."""
    left: list[Node | str] = []
    closed = node.tag == "details" and "open" not in node.attributes
    for child in node.children:
        if isinstance(child, str):
            if shown and not drawing and not closed:
                left.append(child)
            continue
        if not displayed(child) or (closed and (child.tag != "summary" or any(isinstance(x, Node) and x.tag == "summary" for x in left))):
            continue
        if child.tag in OTHER_FORMS or (child.tag in UNDRAWN and drawing):
            continue
        style = _SEEN.findall(child.attributes.get("style", ""))
        seen = style[-1].lower() == "visible" if style else shown
        prune(child, seen, (drawing or child.tag == "svg") and child.tag not in ("text", "foreignobject"))
        if not seen:
            child.attributes = {k: v for k, v in child.attributes.items() if k in ("colspan", "rowspan", "start", "value") and child.tag != "input"}
        elif drawing and child.tag == "text":
            child.children += [" "]
        left.append(child)
    node.children = left


class Lines:
    """Lines of a block under construction."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.inline: list[str] = []
        self.space = False

    def text(self, value: str) -> None:
        if value:
            self.inline.append(value)

    def line(self) -> None:
        """Ends the current line, if it has any text."""
        text = _SPACE.sub(" ", "".join(self.inline)).strip()
        self.inline = []
        if text:
            self.block([text], False)

    def block(self, lines: list[str], spaced: bool) -> None:
        if not lines:
            return
        if (spaced or self.space) and self.done:
            self.done.append("")
        self.done += lines
        self.space = spaced

    def brk(self) -> None:
        """Ends the current line; on an empty one, leaves an empty line."""
        if any(t.strip() for t in self.inline):
            self.line()
        elif self.done and self.done[-1]:
            self.done.append("")


def lines_of(node: Node) -> list[str]:
    """The laid-out lines of a node's visible children."""
    out = Lines()
    number = _number(node.attributes.get("start")) if node.tag == "ol" else 1
    for child in node.children:
        if isinstance(child, str):
            out.text(child)
        else:
            if node.tag in ("ul", "ol", "menu", "dir") and child.tag == "li":
                number = _number(child.attributes.get("value"), number)
                mark = f"{number}. " if node.tag == "ol" else "- "
                number += 1
                out.line()
                out.block(_marked(lines_of(child), mark), False)
            else:
                _place(child, out)
    out.line()
    return out.done


def _place(node: Node, out: Lines) -> None:
    tag = node.tag
    if tag == "br":
        out.brk()
    elif tag == "hr":
        out.line()
        out.block(["---"], True)
    elif tag == "img":
        out.text(node.attributes.get("alt", ""))
    elif tag == "input":
        kind = node.attributes.get("type", "").lower()
        if kind in BUTTONS:
            out.text(node.attributes.get("value", BUTTONS[kind]))
    elif tag == "optgroup":
        out.line()
        out.text(node.attributes.get("label", ""))
        out.line()
        out.block(lines_of(node), False)
    elif tag == "pre":
        out.line()
        raw = "".join(_strings(node)).expandtabs(8).strip("\n")
        out.block([x.rstrip() for x in raw.split("\n")] if raw.strip() else [], True)
    elif tag == "table":
        out.line()
        out.block(_table(node), True)
    elif tag in BLOCK or tag in ("tr", "td", "th", "caption", "tbody", "thead", "tfoot"):
        out.line()
        inner = lines_of(node)
        indent = {"blockquote": "> ", "dd": "    ", "li": "- "}.get(tag, "")
        out.block([(indent + x).rstrip() for x in inner] if indent else inner, tag in SPACED)
    elif any(not isinstance(c, str) for c in node.children):  # inline, perhaps with blocks inside
        for child in node.children:
            if isinstance(child, str):
                out.text(child)
            else:
                _place(child, out)
    else:
        for child in node.children:
            out.text(child)


def _marked(lines: list[str], mark: str) -> list[str]:
    return [(mark if i == 0 else " " * len(mark)) + x if x else "" for i, x in enumerate(lines)]


def _number(text: str | None, other: int = 1) -> int:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,9}", text.strip()) else other


def _strings(node: Node) -> Iterator[str]:
    for child in node.children:
        if isinstance(child, str):
            yield child
        elif child.tag == "br":
            yield "\n"
        else:
            yield from _strings(child)


def _span(cell: Node, name: str) -> int:
    """Rows or columns a cell takes, within the bounds of HTML; 0 rows mean all that follow."""
    given = _number(cell.attributes.get(name))
    return min(1000, max(1, given)) if name == "colspan" else (65_534 if given == 0 else min(65_534, max(1, given)))


def _table(node: Node) -> list[str]:
    """Rows as lines: a column is as wide as its widest cell, up to WIDEST; wider cells push their row."""
    top: list[str] = []
    rows: list[dict[int, tuple[int, list[str]]]] = []  # by column: columns taken and lines

    def gather(part: Node, over: dict[int, int]) -> dict[int, int]:
        """``over``: for how many more rows a column is taken from above; ends with its part of the table."""
        for child in part.children:
            if isinstance(child, str):
                continue
            if child.tag == "tr":
                row: dict[int, tuple[int, list[str]]] = {}
                at, below = 0, {c: n - 1 for c, n in over.items() if n > 1}
                for cell in child.children:
                    if isinstance(cell, str):
                        continue
                    while at in over:
                        at += 1
                    inner = lines_of(cell) if cell.tag in ("td", "th") else lines_of(Node("div", {}, [cell]))
                    wide, deep = _span(cell, "colspan"), _span(cell, "rowspan")
                    row[at] = (wide, inner)
                    if deep > 1:
                        below |= dict.fromkeys(range(at, at + wide), deep - 1)
                    at += wide
                rows.append(row)
                over = below
            elif child.tag == "caption":
                top.extend(lines_of(child))
            elif child.tag in ("tbody", "thead", "tfoot"):
                gather(child, {})
                over = {}
            else:
                top.extend(lines_of(Node("div", {}, [child])))
        return over

    gather(node, {})
    width: dict[int, int] = {}
    for row in rows:
        for at, (_, lines) in row.items():
            width[at] = max(width.get(at, 0), min(WIDEST, max(map(len, lines), default=0)))
    # Where a column begins; columns in which no cell begins take no room.
    places, begin = {}, 0
    for at in sorted(width):
        places[at] = begin
        begin += width[at] + 2
    out = list(top)
    for row in rows:
        cells = sorted(row.items())
        for k in range(max((len(lines) for _, (_, lines) in cells), default=0)):
            text = ""
            for i, (at, (_, lines)) in enumerate(cells):
                text += ("  " if i and len(text) >= places[at] else " " * (places[at] - len(text))) + (lines[k] if k < len(lines) else "")
            out.append(text.rstrip())
    return out


def render(page: str | None) -> str | None:
    """Visible text of a page: null for null, empty where nothing is visible."""
    if page is None:
        return None
    root = tree(page)
    prune(root)
    return "\n".join(lines_of(root))


def rendered(page: Column) -> Column:
    """Visible text of each page, as ``render`` gives it."""

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([render(p if isinstance(p, str) else None) for p in batch], dtype=object)

    return F.pandas_udf(texts, "string").asNondeterministic()(page)
