"""Layout-aware text of web pages: all visible text, with block spacing, lists and aligned table cells.

A tree builder opens and closes the elements that HTML lets authors leave out. Elements that are not
rendered, or hidden by attribute, inline style or a simple rule of a style element, give nothing; what says
``visibility: visible`` inside an invisible element shows again. What is left is laid out in lines, tables on a
grid that row and column spans keep in place.

Rules of style elements count if their selector is an element name, classes and an id written together
(``div.note``), not inside an at-rule or a style element for other media; style sheets in other files are not read.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from html import unescape
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

ROWS_PER_BATCH = 200
MAX_DEPTH = 150  # deeper elements join the one at this depth; their text stays

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript head title meta link datalist object iframe audio video canvas".split())
FOREIGN = frozenset(("svg", "math"))
#: What svg and math hold without showing it in place, and where HTML begins again in them.
FOREIGN_UNSEEN = frozenset(
    "defs symbol clippath mask marker pattern lineargradient radialgradient filter desc metadata annotation annotation-xml".split()
)
HTML_AGAIN = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr fieldset form".split())
BLOCK = SPACED | frozenset(
    "html body div section article aside header footer nav main address li dt dd details summary figcaption legend "
    "center caption option optgroup select dir menu text foreignobject".split()
)
TABLE_PARTS = frozenset("thead tbody tfoot".split())
CELLS = frozenset(("td", "th"))
ROWS = frozenset(("tr",))
#: A start tag closes these open elements, searched up to one of the tags after them.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)), "body": (("head",), ("html",)),
    **{part: (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)) for part in TABLE_PARTS},
}
CLOSES_P = SPACED | frozenset("div section article aside header footer nav main address details center li dt dd".split())
SCOPE = frozenset("td th table caption button object html body".split())
#: Input types that show no value, and those that show their value only (no placeholder).
MUTE_INPUTS = frozenset("hidden checkbox radio range color file".split())
BUTTON_INPUTS = frozenset("submit reset button".split())
SCREEN = frozenset(("", "all", "screen"))
DECLARED = re.compile(r"(?:^|[;{])\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
SIMPLE = re.compile(r"([a-z][a-z0-9]*|\*)?((?:[.#][\w-]+)*)", re.I)
MOST_COLUMNS = 1000  # HTML reads a larger colspan as 1000
BLANKS = re.compile(r"[ \t\r\n\f]+")


class Node:
    """An element: ``seen`` if it is laid out at all, ``shown`` if its own text is visible."""

    __slots__ = ("tag", "attrs", "children", "seen", "shown")

    def __init__(self, tag: str, attrs: dict[str, str | None], seen: bool, shown: bool = True) -> None:
        self.tag, self.attrs, self.seen, self.shown = tag, attrs, seen, shown
        self.children: list[Node | str] = []


@dataclass
class Rules:
    """Declarations of display and visibility by the id, class or name that their selectors end in."""

    by_key: dict[str, list[tuple]] = field(default_factory=dict)
    count: int = 0

    def read(self, sheet: str) -> None:
        for selectors, body in _top_rules(COMMENT.sub(" ", sheet)):
            declared = {name.lower(): value.lower() for name, value in DECLARED.findall(body)}
            for selector in selectors.split(",") if declared else ():
                found = SIMPLE.fullmatch(selector.strip())
                if not found or not selector.strip():
                    continue
                name = (found.group(1) or "*").lower()
                marks = re.findall(r"[.#][\w-]+", found.group(2))
                ids = [m[1:] for m in marks if m[0] == "#"]
                classes = frozenset(m[1:] for m in marks if m[0] == ".")
                key = f"#{ids[0]}" if ids else f".{min(classes)}" if classes else name
                self.count += 1
                weight = (len(ids), len(classes), name != "*", self.count)
                self.by_key.setdefault(key, []).append((weight, name, frozenset(ids), classes, declared))

    def of(self, tag: str, attrs: dict[str, str | None]) -> dict[str, str]:
        """What holds for an element; of two rules the more specific, then the later one."""
        if not self.by_key:
            return {}
        own, classes = attrs.get("id"), frozenset((attrs.get("class") or "").split())
        keys = ["*", tag, *(f".{c}" for c in classes), *([f"#{own}"] if own else [])]
        rules = [r for k in keys for r in self.by_key.get(k, ()) if r[1] in ("*", tag) and r[2] <= {own} and r[3] <= classes]
        held: dict[str, str] = {}
        for rule in sorted(rules, key=lambda r: r[0]):
            held.update(rule[4])
        return held


def _top_rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, body) of the rules outside at-rules; a block that is never closed ends with the sheet."""
    at = 0
    while (start := sheet.find("{", at)) >= 0:
        head = sheet[at:start].rsplit(";", 1)[-1].strip()
        depth, end = 1, start + 1
        while depth and end < len(sheet):
            depth += {"{": 1, "}": -1}.get(sheet[end], 0)
            end += 1
        if not head.startswith("@"):
            yield head, sheet[start:end].rstrip("}")
        at = end


class TreeBuilder(HTMLParser):
    """The element tree of a page; unclosed and misnested tags are repaired, none is lost."""

    def __init__(self, rules: Rules | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.rules = rules or Rules()
        self.sheets: list[str] = []
        self.root = Node("html", {}, True)
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> Node | None:
        if tag == "html":
            return None
        if tag in CLOSES_P:
            self._close(("p",), SCOPE)
        if tag in IMPLIED:
            for _ in range(3):
                if not self._close(*IMPLIED[tag]):
                    break
        if self.open[-1].tag == "head" and tag not in UNSEEN and tag not in ("base",):
            self.open.pop()
        if tag in CELLS and self.open[-1].tag in (TABLE_PARTS | {"table"}):
            self._push("tr", {})
        given = dict(attrs)
        node = self._push(tag, given)
        if tag in VOID:
            if self.open[-1] is node:
                self.open.pop()
        elif tag == "textarea":
            self.set_cdata_mode(tag)  # its content is text, tags included
        return node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        """Only svg, math and what is in them close themselves; a slash means nothing on other elements."""
        closes = tag in FOREIGN or self._foreign()
        node = self.handle_starttag(tag, attrs)
        if closes and self.open[-1] is node:
            self.open.pop()

    def _foreign(self) -> bool:
        for node in reversed(self.open):
            if node.tag in FOREIGN:
                return True
            if node.tag in HTML_AGAIN:
                return False
        return False

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            self.handle_starttag("p", [])
        self._close((tag,), SCOPE - {tag} if tag not in SCOPE and tag not in ("tr", *TABLE_PARTS) else frozenset())

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self.open.pop()
        node = self.open[-1]
        if node.tag == "style" and (node.attrs.get("media") or "").strip().lower() in SCREEN:
            self.sheets.append(data)
        elif node.tag == "textarea" and self.cdata_elem:
            data = unescape(data)
        if node.shown:
            node.children.append(data)

    def _push(self, tag: str, attrs: dict[str, str | None]) -> Node:
        parent = self.open[-1]
        style = self.rules.of(tag, attrs)
        if attrs.get("style"):
            style = style | {name.lower(): value.lower() for name, value in DECLARED.findall(attrs["style"])}
        display = style.get("display", "none" if "hidden" in attrs or (tag == "dialog" and "open" not in attrs) else "")
        visibility = style.get("visibility", "inherit")
        shown = visibility in ("visible", "initial") or (parent.shown and visibility not in ("hidden", "collapse"))
        deep = len(self.open) >= MAX_DEPTH
        hidden = (
            tag in UNSEEN or display == "none" or (tag in FOREIGN_UNSEEN and self._foreign())
            or (deep and not shown)  # it gets no node of its own to hold what shows again
        )
        node = Node(tag, attrs, not hidden, shown)
        parent.children.append(node)
        if not deep or hidden:
            self.open.append(node)
        return node

    def _close(self, tags: tuple[str, ...], until: frozenset | tuple) -> bool:
        """Close the innermost open element of ``tags`` and all in it, unless one of ``until`` is met first."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return True
            if self.open[k].tag in until:
                return False
        return False


class Lines:
    """Laid-out lines. Runs of blanks collapse; a block starts on a new line, a spaced one after a blank line."""

    def __init__(self, in_item: bool = False) -> None:
        self.in_item = in_item
        self.done: list[str] = []
        self.current = ""
        self.gap = 0

    def text(self, data: str) -> None:
        data = BLANKS.sub(" ", data)
        if not self.current or self.current.endswith(" "):
            data = data.lstrip(" ")
        if data:
            self._space()
            self.current += data

    def end_line(self, gap: int = 0) -> None:
        if self.current:
            self.done.append(self.current.rstrip(" "))
            self.current = ""
        self.gap = max(self.gap, gap)

    def line_break(self) -> None:
        if self.current:
            self.end_line()
        elif self.done:
            self.done.append("")

    def whole(self, lines: list[str], gap: int = 0) -> None:
        if lines:
            self.end_line(gap)
            self._space()
            self.done.extend(lines)
        self.gap = max(self.gap, gap)

    def _space(self) -> None:
        if self.gap and self.done and not self.current and self.done[-1]:
            self.done.append("")
        self.gap = 0

    def finished(self) -> list[str]:
        self.end_line()
        return self.done


def _laid_out(node: Node, out: Lines) -> None:
    for child in node.children:
        if isinstance(child, str):
            out.text(child)
        elif child.seen:
            _element(child, out)


def _element(node: Node, out: Lines) -> None:
    tag, gap = node.tag, int(node.tag in SPACED)
    if tag == "br":
        out.line_break()
    elif tag in VOID and not node.shown:
        return
    elif tag == "hr":
        out.whole(["---"], 1)
    elif tag == "img":
        out.text(node.attrs.get("alt") or "")
    elif tag == "input":
        out.text(_input_text(node.attrs))
    elif tag == "details" and "open" not in node.attrs:
        # closed: the first summary is all that shows
        summary = next((c for c in node.children if isinstance(c, Node) and c.tag == "summary"), None)
        if summary is not None and summary.seen:
            _element(summary, out)
    elif tag in ("pre", "textarea"):
        out.whole(_raw(node).strip("\n").expandtabs(8).split("\n"), 1)
    elif tag in ("ul", "ol", "menu", "dir"):
        out.whole(_list(node), 0 if out.in_item else gap)
    elif tag == "table":
        out.whole(_table(node), gap)
    elif tag == "blockquote":
        out.whole([f"> {line}".rstrip() for line in _inner(node)], gap)
    elif tag == "dd":
        out.whole([f"  {line}".rstrip() for line in _inner(node)])
    elif tag in BLOCK:
        out.end_line(gap)
        _laid_out(node, out)
        out.end_line(gap)
    elif tag == "q":
        out.text("“")
        _laid_out(node, out)
        out.text("”")
    else:
        _laid_out(node, out)


def _input_text(attrs: dict[str, str | None]) -> str:
    kind = (attrs.get("type") or "").strip().lower()
    value, hint = attrs.get("value") or "", attrs.get("placeholder") or ""
    if kind in MUTE_INPUTS:
        return ""
    if kind == "image":
        return attrs.get("alt") or ""
    if kind == "password":
        return "" if value else hint
    return value if kind in BUTTON_INPUTS else value or hint


def _inner(node: Node, in_item: bool = False) -> list[str]:
    out = Lines(in_item)
    _laid_out(node, out)
    return out.finished()


def _raw(node: Node) -> str:
    return "".join(
        c if isinstance(c, str) else ("\n" if c.tag == "br" else _raw(c)) for c in node.children if isinstance(c, str) or c.seen
    )


def _whole(text: str | None, default: int) -> int:
    return int(text) if re.fullmatch(r"[+-]?\d{1,9}", (text or "").strip(), re.A) else default


def _list(node: Node) -> list[str]:
    """Items with a dash or their number; what an item holds is indented below its mark."""
    lines: list[str] = []
    step = -1 if "reversed" in node.attrs else 1
    items = sum(isinstance(c, Node) and c.tag == "li" for c in node.children)
    number = _whole(node.attrs.get("start"), items if step < 0 else 1)
    for child in node.children:
        if isinstance(child, str) or child.tag != "li":
            loose = Node("div", {}, True)
            loose.children = [child]
            lines += [f"  {line}".rstrip() for line in _inner(loose)] if isinstance(child, str) or child.seen else []
            continue
        number = _whole(child.attrs.get("value"), number)
        if child.seen and (child.shown or any(_inner(child, True))):
            mark = f"{number}. " if node.tag == "ol" else "- "
            inner = _inner(child, True) or [""]
            lines += [(mark if k == 0 else " " * len(mark) if line else "") + line for k, line in enumerate(inner)]
        number += step
    return [line.rstrip() for line in lines]


def _holds(node: Node, tags: frozenset) -> bool:
    """Whether one of ``tags`` is shown inside, not counting tables inside."""
    return any(
        isinstance(c, Node) and c.seen and c.tag != "table" and (c.tag in tags or _holds(c, tags)) for c in node.children
    )


def _rows(node: Node, stray: list[Node | str], group: Node | None = None) -> Iterator[tuple[Node, Node | None]]:
    """The rows of a table with their row group, also those in forms and other elements; all else goes to ``stray``."""
    for child in node.children:
        if isinstance(child, str):
            stray.append(child)
        elif child.seen:
            if child.tag == "tr":
                yield child, group
            elif child.tag in TABLE_PARTS:
                yield from _rows(child, stray, child)
            elif child.tag == "colgroup" or (child.tag != "table" and _holds(child, ROWS)):
                yield from _rows(child, stray, group)
            else:
                stray.append(child)


def _cells(row: Node) -> Iterator[Node | str]:
    """What a row holds, with the cells in forms and other elements one by one."""
    for child in row.children:
        if isinstance(child, Node) and child.seen and child.tag not in CELLS and child.tag != "table" and _holds(child, CELLS):
            yield from _cells(child)
        else:
            yield child


def _width(text: str) -> int:
    return len(text) if text.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _table(node: Node) -> list[str]:
    """Rows of cells, every column as wide as its widest line, two blanks apart; captions and stray text first.

    A cell takes the first free columns of its row, as many as it spans, and keeps them for the rows it spans, at most
    to the end of its row group (span 0: all of them). Columns without text take no room; cells that are not laid out
    take no column.
    """
    stray = Node("div", {}, True)
    grid: list[dict[int, list[str]]] = []
    held: list[tuple[int, int, float]] = []  # columns from, to and last row of the cells above that reach further down
    last_group: Node | None = None
    for row, group in _rows(node, stray.children):
        if group is not last_group:
            held, last_group = [], group
        held = [span for span in held if span[2] >= len(grid)]
        placed: dict[int, list[str]] = {}
        reaching = []
        at = passed = 0
        for child in _cells(row):
            across, down = 1, 1
            if isinstance(child, str) or child.tag not in CELLS:
                if not (isinstance(child, Node) and child.seen) and not (isinstance(child, str) and child.strip()):
                    continue
                loose = Node("div", {}, True)
                loose.children = [child]
                inner = _inner(loose)
            elif child.seen:
                across = min(max(_whole(child.attrs.get("colspan"), 1), 1), MOST_COLUMNS)
                down = max(_whole(child.attrs.get("rowspan"), 1), 0)
                inner = _inner(child)
            else:
                continue
            while passed < len(held) and held[passed][0] <= at:
                at = max(at, held[passed][1])
                passed += 1
            placed[at] = inner
            if down != 1:
                reaching.append((at, at + across, len(grid) + down - 1 if down else float("inf")))
            at += across
        if reaching:
            held = sorted(held + reaching)
        grid.append(placed)
    widths: dict[int, int] = {}
    for placed in grid:
        for c, cell in placed.items():
            widths[c] = max(widths.get(c, 0), *map(_width, cell or [""]))
    columns = sorted(c for c, width in widths.items() if width)
    lines = _inner(stray)
    for placed in grid:
        for k in range(max((len(cell) for cell in placed.values()), default=0)):
            parts = [(placed[c][k] if c in placed and k < len(placed[c]) else "", widths[c]) for c in columns]
            lines.append("  ".join(p + " " * (w - _width(p)) for p, w in parts).rstrip())
    return lines


def _built(html: str, rules: Rules | None = None) -> TreeBuilder:
    builder = TreeBuilder(rules)
    builder.feed(html)
    builder.close()
    return builder


def page_text(html: str) -> str:
    """The visible text of one page, laid out in lines."""
    builder = _built(html)
    if builder.sheets:
        rules = Rules()
        rules.read("".join(builder.sheets))
        if rules.by_key:  # rules hold for elements before them, too
            builder = _built(html, rules)
    out = Lines()
    _laid_out(builder.root, out)
    return "\n".join(out.finished())


def extract(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Per row: ``key``, text, n_chars and n_lines of the page's visible text.

    Null and empty pages, and pages with nothing visible, give the empty text of no lines. Pages stream
    through Arrow in small batches and nothing is shuffled; repeated rows come back repeated.
    """
    schema = f"{key} {pages.schema[key].dataType.simpleString()}, text string, n_chars long, n_lines long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_PER_BATCH):
                batch = whole.slice(at, ROWS_PER_BATCH)
                texts = [page_text(value.as_py() or "") for value in batch.column(1)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
                ], names=[key, "text", "n_chars", "n_lines"])

    return pages.select(key, html).mapInArrow(run, schema)
