"""Layout-aware rendering of web pages as plain text.

A small tree builder reads the tags of a page with the implied ones (head, paragraphs, list items, table parts), keeps what
visibility rules show, and a renderer writes all visible text: a blank line between paragraphs, headings, lists and
tables, a new line between other blocks, markers and indents for list items, and table cells in aligned columns.

Hidden are scripts, styles, templates, head matter, comments, closed `details` and `dialog`, fallbacks, and what the cascade of
`page_styles` doesn't show. Text fields show their value, or else their placeholder; passwords don't.
List items count from `start`, by `value`, downwards in `reversed` lists, and in the `type` of their list. Rows of the first
`thead` come first and those of the first `tfoot` last; a cell over several rows or columns leaves its further places empty.
Null and empty pages give empty text. Broken markup gives the text that is there. Extra columns pass through.
Layout has three bounds, which lose no text: tables nested deeper than DEEPEST_TABLE are written as plain blocks; a cell spans
100 columns at most (a span of more than four digits counts as one); cells after the first 100 columns span one row.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrylake.llm import page_styles

# Element names by their behaviour in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset("head script style template noscript noframes noembed iframe object audio video canvas datalist rp title param source track".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr menu".split())
LINE = frozenset("address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary tr thead tbody tfoot td th".split())
BLOCK = PARAGRAPH | LINE
#: Starting one of these closes the open ones of the second set, unless an element of the third stands between.
IMPLIED = {
    **{t: (frozenset({"p"}), frozenset("td th table button object caption".split())) for t in BLOCK - frozenset("body html dd dt li tr thead tbody tfoot td th caption option optgroup".split())},
    "li": (frozenset({"li"}), frozenset("ul ol menu dir table td th".split())),
    **{t: (frozenset({"dd", "dt"}), frozenset("dl table td th".split())) for t in ("dd", "dt")},
    "tr": (frozenset({"tr", "td", "th", "caption"}), frozenset({"table"})),
    **{t: (frozenset({"td", "th"}), frozenset({"tr", "table"})) for t in ("td", "th")},
    **{t: (frozenset({"thead", "tbody", "tfoot", "tr", "caption"}), frozenset({"table"})) for t in ("thead", "tbody", "tfoot")},
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "body": (frozenset({"head"}), frozenset()),
}
#: Start tags that leave an open head open; any other, and text that is not white space, ends it.
OF_HEAD = frozenset("html head base link meta noscript script style template title".split())
#: End tags don't reach out of these.
SCOPES = frozenset("table td th caption".split())

_OPENS = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z]|/)")
# Possessive, so that a tag without an end is given up at once. Quotes open a value directly after "=" only.
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)))?+")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+))?+)*+)>")
#: A tag up to the first ">", even in quotes.
_CUT_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
#: White space that is not one blank already, so that most blanks stay where they are.
_SPACE = re.compile(r"[\t\n\r\f][ \t\n\r\f]*+| [ \t\n\r\f]++")
#: Tables nested deeper than this are written as plain blocks.
DEEPEST_TABLE = 12
#: Columns that a cell may span, and first columns in which cells may span rows.
WIDEST_SPAN = 100
# Inputs that show no text of their own, and buttons, whose value is all they show.
WITHOUT_TEXT = frozenset("hidden password checkbox radio file range color".split())
BUTTONS = frozenset("button submit reset".split())
LISTS = frozenset("ul ol menu dir".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "display", "visible")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.display = self.visible = True


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if text and not text.isspace():
        for name, a, b, c in _ATTRIBUTE.findall(text):
            out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def build(page: str) -> tuple[Node, list[page_styles.Rule]]:
    """The tree of a page, and the rules of its style sheets."""
    root = Node("html", {})
    stack = [root]
    inside: Counter[str] = Counter()  # open elements by tag, so that nothing is looked for in vain
    sheet: list[page_styles.Rule] = []
    at, n = 0, len(page)
    pattern = _TAG
    while at < n:
        opens = _OPENS.search(page, at)
        if not opens:
            _text(stack, inside, html.unescape(page[at:]))
            break
        if opens.start() > at:
            _text(stack, inside, html.unescape(page[at : opens.start()]))
        at = opens.start()
        if opens[0] == "<!--":
            end = page.find("-->", at + 2)
            at = end + 3 if end >= 0 else n
            continue
        if opens[0][-1] in "!?/":  # declarations, and end tags without a name
            end = page.find(">", at)
            at = end + 1 if end >= 0 else n
            continue
        found = pattern.match(page, at)
        if not found and pattern is _TAG:  # the page ends within quotes, and so it would for the tags in there
            pattern = _CUT_TAG
            found = pattern.match(page, at)
        if not found:  # the page ends within the tag, and browsers show nothing of it
            break
        at = found.end()
        closing, tag, rest = found.groups()
        tag = tag.lower()
        if closing:
            _close(stack, inside, tag)
            continue
        if stack[-1].tag == "head" and tag not in OF_HEAD:
            _cut(stack, inside, len(stack) - 1)
        if tag in IMPLIED:
            closed, bounds = IMPLIED[tag]
            if any(inside[c] for c in closed):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in bounds:
                        break
                    if stack[i].tag in closed:
                        _cut(stack, inside, i)
                        if tag not in ("tr", "thead", "tbody", "tfoot"):
                            break
        if tag == "body" and inside["body"]:
            continue
        node = root if tag == "html" else Node(tag, _attributes(rest))
        if tag == "html":
            root.attrs.update(_attributes(rest))
            continue
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at) if tag != "plaintext" else None
            text = page[at : end.start() if end else n]
            node.children.append(html.unescape(text) if tag in ("textarea", "title") else text)
            if tag == "style":
                sheet += page_styles.rules(text, node.attrs.get("media", ""))
            at = end.end() if end else n
        elif tag not in VOID and not (rest.endswith("/") and tag in ("svg", "path", "g", "use")):
            stack.append(node)
            inside[tag] += 1
    tops = [c for c in root.children if not isinstance(c, str)]
    if not any(c.tag == "body" for c in tops):  # it is implied, and selectors name it
        body = Node("body", {})
        heads = [c for c in tops if c.tag == "head"]
        body.children = [c for c in root.children if isinstance(c, str) or c.tag != "head"]
        root.children = [*heads, body]
    return root, sheet


def _cut(stack: list[Node], inside: Counter[str], i: int) -> None:
    for x in stack[i:]:
        inside[x.tag] -= 1
    del stack[i:]


def _text(stack: list[Node], inside: Counter[str], text: str) -> None:
    if stack[-1].tag == "head" and text.strip(" \t\n\r\f"):
        _cut(stack, inside, len(stack) - 1)
    stack[-1].children.append(text)


def _close(stack: list[Node], inside: Counter[str], tag: str) -> None:
    if tag == "br":
        if stack[-1].tag == "head":
            _cut(stack, inside, len(stack) - 1)
        stack[-1].children.append(Node("br", {}))
        return
    for i in range(len(stack) - 1, 0, -1) if inside[tag] else ():
        if stack[i].tag == tag:
            _cut(stack, inside, i)
            return
        if stack[i].tag in SCOPES and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "caption", "body"):
            return


def _shown(node: Node) -> bool:
    return node.display and node.tag not in HIDDEN


def _number(text: str | None, default: int) -> int:
    """A whole number of an attribute as browsers read it."""
    found = re.match(r"[ \t\n\r\f]*([+-]?\d{1,9})(?!\d)", text or "")
    return int(found[1]) if found else default


def _numeral(n: int, kind: str) -> str:
    """A list number in the style 1, a, A, i or I; numbers that have none in the style are written as 1."""
    if kind.lower() == "a" and n > 0:
        out = ""
        while n:
            n, digit = divmod(n - 1, 26)
            out = chr(97 + digit) + out
    elif kind.lower() == "i" and 0 < n < 4000:
        out = ""
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out += sign * (n // value)
            n %= value
    else:
        return str(n)
    return out.upper() if kind.isupper() else out


def _field(a: dict[str, str]) -> str:
    """The text that an input shows."""
    kind = a.get("type", "").strip().lower()
    if kind == "image":
        return a.get("alt", "")
    if kind in BUTTONS:
        return a.get("value", "")
    return "" if kind in WITHOUT_TEXT else a.get("value", "") or a.get("placeholder", "")


class _Page:
    """Lines written so far, the open line, and the blank line that is due."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.open: list[str] = []
        self.due = False
        self.indent = ""
        self.marker = ""

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s[:1] == " " and (not self.open or self.open[-1][-1:] == " "):
            s = s[1:]
        if s:
            self.open.append(s)

    def line(self, blank: bool = False) -> None:
        """Ends the open line; `blank`: an empty one is due before the next."""
        s = "".join(self.open).strip(" ")
        if s:
            self.put(s)
        self.open = []
        self.due |= blank

    def put(self, s: str) -> None:
        if self.due and self.lines:
            self.lines.append("")
        self.due = False
        indent = self.indent
        if self.marker:
            indent, self.marker = self.marker, ""
        self.lines.append((indent + s).rstrip(" "))


def render(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    return text_of(*build(page))


def text_of(root: Node, sheet: list[page_styles.Rule]) -> str:
    """The visible text of a tree."""
    page_styles.resolve(root, sheet)
    return "\n".join(_lines(root, 0)).strip("\n")


def _lines(top: Node, depth: int) -> list[str]:
    out = _Page()
    work: list[tuple] = [("node", top)]
    lists: list[list] = []  # of each open list: numbered, next number, step, style
    pre = 0
    while work:
        kind, x, *more = work.pop()
        if kind == "text":
            if pre:
                first, *rest = x.replace("\r\n", "\n").split("\n")
                out.open.append(first)
                for s in rest:
                    out.put("".join(out.open))
                    out.open = [s]
            else:
                out.text(x)
            continue
        if kind == "end":
            tag = x
            if tag == "pre":
                pre -= 1
                if s := "".join(out.open).rstrip():
                    out.put(s)
                out.open = []
            out.line(tag in PARAGRAPH and not (tag in LISTS and len(lists) > 1))
            if tag in LISTS:
                lists.pop()
                out.indent, out.marker = more[0], ""
            elif tag in ("li", "dd", "blockquote"):
                if out.marker and tag == "li":  # an item without text
                    out.put("")
                out.indent, out.marker = more[0], ""
            continue
        if not _shown(x):
            continue
        tag, children = x.tag, x.children
        if tag == "br":
            if out.open:
                out.line()
            else:
                out.due = bool(out.lines)
            continue
        if tag == "hr":
            out.line(True)
            continue
        if tag == "img":
            if x.visible:
                out.text(x.attrs.get("alt", ""))
            continue
        if tag == "input":
            if x.visible:
                out.text(_field(x.attrs))
            continue
        if tag == "table" and x is not top and depth < DEEPEST_TABLE:
            out.line(True)
            for s in _table(x, depth + 1):
                out.put(s)
            out.due = True
            continue
        if tag == "details" and "open" not in x.attrs:
            children = [c for c in children if not isinstance(c, str) and c.tag == "summary"][:1]
        if tag in BLOCK:
            nested = tag in LISTS and bool(lists)
            out.line(tag in PARAGRAPH and not nested)
            before = out.indent
            if tag in LISTS:
                down = tag == "ol" and "reversed" in x.attrs
                items = sum(not isinstance(c, str) and c.tag == "li" and _shown(c) for c in children) if down else 1
                lists.append([tag == "ol", _number(x.attrs.get("start"), items), -1 if down else 1, x.attrs.get("type", "")])
            elif tag == "li":
                now = lists[-1] if lists else [False, 1, 1, ""]
                now[1] = _number(x.attrs.get("value"), now[1])
                mark = f"{_numeral(now[1], x.attrs.get('type', now[3]))}. " if now[0] else "- "
                mark = mark if x.visible else " " * len(mark)
                now[1] += now[2]
                out.marker = (out.marker or before) + mark if out.marker else before + mark
                out.indent = before + " " * len(mark)
            elif tag == "dd":
                out.indent = before + "    "
            elif tag == "blockquote":
                out.indent = before + "> "
            elif tag == "pre":
                pre += 1
                if children and isinstance(children[0], str):
                    children = [children[0].removeprefix("\r").removeprefix("\n"), *children[1:]]
            work.append(("end", tag, before))
        for c in reversed(children):
            if not isinstance(c, str):
                work.append(("node", c))
            elif x.visible:
                work.append(("text", c))
    out.line()
    return out.lines


def _groups(table: Node) -> tuple[list[Node | str], list[list[Node]]]:
    """What of a table stands above its rows, and its groups of rows: the first `thead` comes first, the first `tfoot` last."""
    above: list[Node | str] = []
    first: list[list[Node]] = []
    groups: list[list[Node]] = []
    last: list[list[Node]] = []
    loose = False  # the last group holds rows that stand in the table itself
    for x in table.children:
        if isinstance(x, str):
            if x.strip() and table.visible:
                above.append(x)
            continue
        if not _shown(x) or x.tag in ("col", "colgroup"):
            continue
        if x.tag in ("thead", "tbody", "tfoot"):
            rows = []
            for c in x.children:
                if not isinstance(c, str):
                    if _shown(c):
                        (rows if c.tag in ("tr", "td", "th") else above).append(c)
                elif c.strip() and x.visible:
                    above.append(c)
            to = first if x.tag == "thead" and not first else last if x.tag == "tfoot" and not last else groups
            to.append(rows)
            loose = False
        elif x.tag in ("tr", "td", "th"):
            if not loose:
                groups.append([])
                loose = True
            groups[-1].append(x)
        else:
            above.append(x)
    return above, first + groups + last


def _table(table: Node, depth: int) -> list[str]:
    """A table's caption and rows; cells of a column begin at the same place."""
    above, groups = _groups(table)
    head: list[str] = []
    for x in above:
        head += [_SPACE.sub(" ", x).strip()] if isinstance(x, str) else _lines(x, depth)
    rows: list[list[str]] = []
    for group in groups:
        below: dict[int, int] = {}  # rows of the group that a cell above still takes, by column
        for n, x in enumerate(group):
            row: list[str] = []
            taken: dict[int, int] = {}
            for c in x.children if x.tag == "tr" else [x]:
                if isinstance(c, str):
                    if c.strip() and x.visible:
                        head.append(_SPACE.sub(" ", c).strip())
                elif _shown(c):
                    while below.get(len(row)):
                        row.append("")
                    span = c.attrs.get("colspan", "1").strip()
                    wide = max(1, min(int(span), WIDEST_SPAN)) if re.fullmatch(r"\d{1,4}", span) else 1
                    tall = _number(c.attrs.get("rowspan"), 1)
                    tall = len(group) - n if tall == 0 else max(1, tall)
                    if tall > 1:
                        taken |= {i: tall for i in range(len(row), min(len(row) + wide, WIDEST_SPAN))}
                    row += [" ".join(s.strip() for s in _lines(c, depth) if s.strip())] + [""] * (wide - 1)
            below = {i: left - 1 for i, left in (below | taken).items() if left > 1}
            rows.append(row)
    widths: list[int] = []
    for row in rows:
        for i, s in enumerate(row):
            if i == len(widths):
                widths.append(0)
            widths[i] = max(widths[i], len(s))
    return head + [" | ".join(s.ljust(w) for s, w in zip(row, widths, strict=False)).rstrip() for row in rows if any(row)]


def links(root: Node) -> list[tuple[str, str]]:
    """(element/attribute, target) of all links of a tree, in order."""
    out, work = [], [root]
    while work:
        x = work.pop()
        for name in ("href", "src") if x.attrs else ():
            if x.attrs.get(name):
                out.append((f"{x.tag.upper()}@/{name}", x.attrs[name].strip()))
        work.extend(c for c in reversed(x.children) if not isinstance(c, str))
    return out


def title(root: Node) -> str:
    """Text of the first title element."""
    work = [root]
    while work:
        x = work.pop()
        if x.tag == "title":
            return _SPACE.sub(" ", "".join(c for c in x.children if isinstance(c, str))).strip()
        work.extend(c for c in reversed(x.children) if not isinstance(c, str))
    return ""


def extract(pages: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """Adds the visible text of each page. Rows keep their partitions; nothing is shuffled."""

    @F.pandas_udf("string")
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in pages:
            yield p.map(render)

    stay = [i for i, c in enumerate(pages.columns) if c != out]
    own = pages.toDF(*(f"own{i}" for i in range(len(pages.columns))))  # no name of theirs clashes then
    return own.select(*(f"own{i}" for i in stay), run(F.col(f"own{pages.columns.index(column)}"))).toDF(*(pages.columns[i] for i in stay), out)
