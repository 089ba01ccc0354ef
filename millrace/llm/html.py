"""Visible text of HTML pages, laid out as a browser would place it.

A tree builder keeps the stack of open elements. It supplies what authors may leave out: paragraphs end
where a block begins, list items, table rows and cells, options and definition parts end where the next
one begins, tables get rows, and end tags close what is open inside their element. Elements that no open
one matches, and void elements' end tags, change nothing.

All text that would be seen is emitted: not the head, scripts, styles, templates, noscript and other
elements without boxes, nor what ``hidden``, an inline style or a rule of a style sheet with a simple selector (``*``,
tag, .class, #id, tag.class or tag#id) hides by ``display: none`` or ``visibility: hidden`` or ``collapse``; a child
may be made visible again from the latter only. Declarations are weighed as browsers do: ``hidden`` first, then
rules by specificity and order, then inline styles, then what is marked important in this order again. Rules within
``@media`` hold if they hold on a screen SCREEN pixels wide. Form fields' values and alternative texts are
not text; texts of drawings and formulas are.

Blocks stand on lines of their own, paragraphs and the like between blank lines; white space collapses
outside ``pre``; list items are marked and indented by level; cells of a table are aligned in columns, two
blanks apart, also where cells span columns or rows; a table is aligned as far as that takes at most ALIGN times its text in
blanks, and indents are at most MOST_INDENT wide, so a page's text is at most some twenty times the page. Closed dialogs, and
closed details but for their first summary, aren't seen. The page's title, kept apart, is the text of the first title
element outside a drawing.

Null and empty pages give empty text. Pages are rendered one by one, whole, whatever their size; a page takes
memory in proportion to its size. Repeated rows are rendered as often as they come, an empty table gives an empty
result, and only the id and the page are read, so other columns may have any names.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, released

# Fixed values of the language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist defs desc metadata symbol annotation annotation-xml param source track".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset menu".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog dir div dt fieldset figcaption footer form frameset header hgroup html legend li listing main nav optgroup option section summary tbody thead tfoot tr caption text".split())
CELLS = frozenset(("td", "th"))
ENDS_P = BLOCK - frozenset("li dd dt option optgroup tr td th tbody thead tfoot caption body html legend summary".split()) | {"li", "dd", "dt"}
#: Blanks that align a table's columns are at most so many times what the table holds; indents are at most so wide.
ALIGN, MOST_INDENT = 10, 24
#: Tables in so many others aren't aligned, and elements in so many others end the one they are in, as in browsers.
DEEP_TABLE, MOST_DEPTH = 6, 512
#: Spans are taken as at most so many columns and rows.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: What a start tag closes first, looking no further up than the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption"}, {"table"}),
    "th": ({"td", "th", "caption"}, {"table"}),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    "tbody": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, {"table"}),
}
#: End tags stop looking for their element at these.
SCOPE = frozenset(("table", "td", "th", "caption"))

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_BETWEEN = re.compile(r"[ \t\n\r\f/]*")
_ATTRIBUTE = re.compile(r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*")
_EQUALS = re.compile(r"[ \t\n\r\f]*=[ \t\n\r\f]*")
_UNQUOTED = re.compile(r"[^ \t\n\r\f>]*")
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_SELECTOR = re.compile(r"(\*|[a-zA-Z][\w-]*)?(?:\.([\w-]+)|#([\w-]+))?$")
_DECLARATION = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([\w-]+)\s*(!\s*important)?", re.I)
_NO_CSS = re.compile(r"/\*.*?\*/|<!--|-->", re.S)
_STRINGS = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", re.S)
_WIDTH = re.compile(r"\(\s*(min|max)-width\s*:\s*([\d.]+)(px|em|rem)?\s*\)", re.I)
_LISTS = re.compile(r"<(/?)(ol|ul|menu|dir|li)(?=[\s/>])", re.I)
#: The width in pixels that rules for media see.
SCREEN = 1280


def _on_screen(query: str) -> bool:
    """Whether one of the media that a rule names is this screen."""
    for one in query.lower().split(","):
        kind = re.match(r"\s*(not\s+|only\s+)?([a-z]+)?", one)
        fits = (kind[2] or "all") in ("all", "screen", "and")
        for side, value, unit in _WIDTH.findall(one):
            px = float(value) * (16 if unit in ("em", "rem") else 1)
            fits &= SCREEN >= px if side == "min" else SCREEN <= px
        if fits != ((kind[1] or "").strip() == "not"):
            return True
    return False


def _rules(css: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations of the rules that hold on the screen."""
    css = _STRINGS.sub("''", _NO_CSS.sub(" ", css))
    holds, head, start = [True], None, 0
    for m in re.finditer("[{};]", css):
        part = css[start : m.start()].strip()
        if m.group() == "{" and head is None:
            if part.startswith("@"):
                name, _, query = part[1:].partition(" ")
                holds.append(holds[-1] and (_on_screen(query) if name.lower() == "media" else name.lower() in ("supports", "layer")))
            else:
                head = part
        elif m.group() == "}":
            if head is not None:
                if holds[-1]:
                    yield head, part
                head = None
            elif len(holds) > 1:
                holds.pop()
        elif head is not None:
            continue
        start = m.end()
    if head is not None and holds[-1]:
        yield head, css[start:]  # a rule that never ends


def _declared(body: str) -> list[tuple[str, bool, bool]]:
    """(property, whether it hides, whether it is important)."""
    return [(p.lower(), v.lower() in (("none",) if p.lower() == "display" else ("hidden", "collapse")), bool(i)) for p, v, i in _DECLARATION.findall(body)]


def _tag(s: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of the tag whose name ends at ``at``, and where the tag ends.

    Attributes are read one after another; a quoted value ends at its own kind of quote only, however far,
    and of equal names the first counts. A tag or value that never ends takes the rest of the page.
    """
    found: dict[str, str] = {}
    while True:
        at = _BETWEEN.match(s, at).end()
        if at >= len(s):
            return found, len(s)
        if s[at] == ">":
            return found, at + 1
        m = _ATTRIBUTE.match(s, at)
        name, value, at = m.group().lower(), "", m.end()
        if m := _EQUALS.match(s, at):
            at = m.end()
            if s[at : at + 1] in ('"', "'"):
                end = s.find(s[at], at + 1)
                if end < 0:
                    return found, len(s)
                value, at = s[at + 1 : end], end + 1
            else:
                m = _UNQUOTED.match(s, at)
                value, at = m.group(), m.end()
        found.setdefault(name, value)


class _Text:
    """Lines of one flow: the page's, or a cell's."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.mark = ""

    def add(self, text: str, indent: str) -> None:
        words = _BLANKS.sub(" ", text)
        if words == " ":
            self.space = bool(self.line)
            return
        if not self.line:
            self._open(indent)
            words = words.lstrip(" ")
        elif self.space and words[0] != " ":
            self.line.append(" ")
        elif words[0] == " " and self.line[-1].endswith(" "):
            words = words[1:]
        self.space = words.endswith(" ")
        self.line.append(words.rstrip(" ") if self.space else words)

    def _open(self, indent: str) -> None:
        if self.lines and self.gap:
            self.lines.append("")
        self.gap = 0
        self.line.append(indent[: max(0, len(indent) - len(self.mark))] + self.mark)
        self.mark = ""

    def end(self, force: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        elif force and self.lines and not self.gap:
            self.lines.append("")
        self.space = False

    def space_before(self) -> None:
        self.end()
        self.gap = 1

    def raw(self, lines: list[str], indent: str) -> None:
        self.end()
        for i, x in enumerate(lines):
            if i == 0:
                self._open(indent)
                self.line.append(x)
                self.end()
            else:
                self.lines.append((indent + x).rstrip(" "))

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class _Open:
    """An open element."""

    __slots__ = ("tag", "gone", "dim", "pre", "indent", "text", "rows", "cells", "count", "step", "ordered", "shut", "span", "down")

    def __init__(self, tag: str, up: _Open | None) -> None:
        self.tag, self.gone, self.dim, self.pre = tag, bool(up and up.gone), bool(up and up.dim), bool(up and up.pre)
        self.indent, self.text = (up.indent, up.text) if up else ("", _Text())
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.cells: list[tuple[list[str], int, int]] = []
        self.count, self.step, self.ordered, self.shut, self.span, self.down = 0, 1, False, False, 1, 1


def _placed(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, int, list[str]]]]:
    """Rows of cells (lines, columns and rows spanned) with the columns where each begins and ends: not where one from above reaches down."""
    out, busy = [], []  # busy: columns from, to, and the last row of those that reach down, in order
    for n, row in enumerate(rows):
        placed, at, i, reach = [], 0, 0, []
        for lines, span, down in row:
            while i < len(busy) and busy[i][0] <= at:
                at = max(at, busy[i][1])
                i += 1
            placed.append((at, at + span, lines))
            if down > 1:
                reach.append((at, at + span, n + down - 1))
            at += span
        out.append(placed)
        merged: list[tuple[int, int, int]] = []
        for a, b, last in sorted([x for x in busy if x[2] > n] + reach):
            if merged and merged[-1][1] == a and merged[-1][2] == last:
                a = merged.pop()[0]
            merged.append((a, b, last))
        busy = merged
    return out


def _widths(rows: list[list[tuple[int, int, list[str]]]], edges: int, most: int) -> list[int]:
    """Each column's place: the sum of the widths, of at most ``most``, and gaps before it."""
    width = [0] * edges
    for row in rows:
        for a, b, lines in row:
            if b == a + 1:
                width[a] = max(width[a], min(most, max(map(len, lines), default=0)))
    for row in rows:
        for a, b, lines in row:
            if b > a + 1 and lines:
                have = sum(width[a:b]) + 2 * (b - a - 1)
                width[b - 1] += max(0, min(most, max(map(len, lines))) - have)
    place = [0]
    for w in width:
        place.append(place[-1] + w + 2)
    return place


def _columns(rows: list[list[tuple[int, int, list[str]]]], aligned: bool = True) -> list[str]:
    """Rows of placed cells as lines with aligned columns, as far as blanks come to at most ALIGN times what the table holds.

    Where they come to more, columns are aligned to at most 64 or 16 characters, and longer cells push the others on; where that is
    still too much, cells stand two blanks apart.
    """
    edges = sorted({x for row in rows for a, b, _ in row for x in (a, b)})
    number = {x: i for i, x in enumerate(edges)}  # columns that no cell begins or ends in are one
    rows = [[(number[a], number[b], lines) for a, b, lines in row] for row in rows]
    if not aligned or sum(b - a for row in rows for a, b, _ in row) > 64 * sum(map(len, rows)):
        places: Iterable[list[int]] = ()  # spans over so many columns that their sums would cost more than the page
    else:
        places = (_widths(rows, len(edges), most) for most in (1 << 30, 64, 16))
    held = sum(sum(len(x) - x.count(" ") for x in lines) + 8 + 2 * len(lines) for row in rows for _, _, lines in row)
    best = None
    for place in places:
        if sum(max(map(len, (x[2] for x in row)), default=0) * place[max((a for a, _, lines in row if lines), default=0)] for row in rows) <= ALIGN * held:
            best = place
            break
    out = []
    for row in rows:
        for i in range(max((len(lines) for _, _, lines in row), default=0)):
            line = ""
            for a, _, lines in row:
                part = lines[i] if i < len(lines) else ""
                if not part:
                    continue
                if line:
                    line += "  "
                if best:
                    line = line.ljust(best[a])
                line += part
            out.append(line.rstrip(" "))
    return out


class Page:
    """Renders one page; ``text`` and ``title`` hold the results."""

    def __init__(self, source: str | None) -> None:
        self.title, self.rules, self.n_rules = "", {}, 0
        self.stack = [_Open("#page", None)]
        self.source, self.at, self.items = (source or "").replace("\r\n", "\n").replace("\x00", ""), 0, None
        self._run(self.source)
        while len(self.stack) > 1:
            self._pop()
        self.text = "\n".join(self.stack[0].text.done())

    def _run(self, s: str) -> None:
        at, n = 0, len(s)
        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self._characters(s[at:lt])
            if lt == n:
                break
            if s.startswith("<!--", lt):
                end = s.find("-->", lt + 4)
                at = end + 3 if end >= 0 else n
                continue
            closing = s.startswith("</", lt)
            m = _NAME.match(s, lt + 1 + closing)
            if not m:
                if s[lt + 1 : lt + 2] in ("!", "?", "/") and len(s) > lt + 2:
                    end = s.find(">", lt)
                    at = end + 1 if end >= 0 else n
                else:
                    self._characters("<")
                    at = lt + 1
                continue
            tag, self.at = m.group().lower(), lt
            attributes, at = _tag(s, m.end())
            if closing:
                self._end(tag)
                continue
            self._start(tag, attributes)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(s, at)
                body = s[at : end.start() if end else n]
                if tag == "title" and not self.title and all(x.tag != "svg" for x in self.stack):
                    self.title = _BLANKS.sub(" ", _html.unescape(body)).strip(" ")
                elif tag == "style":
                    self._sheet(body)
                elif tag in ("textarea", "xmp"):
                    self._characters(body)
                self._end(tag)
                at = _tag(s, end.end())[1] if end else n

    def _sheet(self, css: str) -> None:
        for selectors, body in _rules(css):
            declared = _declared(body)
            for one in selectors.split(",") if declared else ():
                m = _SELECTOR.match(one.strip())
                if m and one.strip():
                    tag = m[1].lower() if m[1] and m[1] != "*" else None
                    key = ("#", m[3]) if m[3] else (".", m[2]) if m[2] else ("", tag or "*")
                    weight = 100 * bool(m[3]) + 10 * bool(m[2]) + bool(tag)
                    self.n_rules += 1
                    self.rules.setdefault(key, []).append((tag, weight, self.n_rules, declared))

    def _characters(self, text: str) -> None:
        top = self.stack[-1]
        if top.gone or top.dim or top.shut:
            return
        if "&" in text:
            text = _html.unescape(text)
        if top.tag in ("table", "tbody", "thead", "tfoot", "tr"):
            if not text.strip(" \t\n\r\f"):
                return
            self._start("td" if top.tag == "tr" else "tr", {})  # text where none may stand gets a cell
            if top.tag != "tr":
                self._start("td", {})
            top = self.stack[-1]
        if top.pre:
            parts = text.split("\n")
            for i, part in enumerate(parts):
                if part:
                    if not top.text.line:
                        top.text._open(top.indent)
                    top.text.line.append(part)
                if i < len(parts) - 1:
                    top.text.end(force=True)
        else:
            top.text.add(text, top.indent)

    def _close_until(self, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        """Close up to the outermost element of ``tags`` above the first of ``stop``."""
        cut = None
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in stop:
                break
            if self.stack[i].tag in tags:
                cut = i
        while cut is not None and len(self.stack) > cut:
            self._pop()

    def _start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in ENDS_P:
            self._close_until({"p"}, SCOPE | {"button"})
        if tag in IMPLIED:
            self._close_until(*IMPLIED[tag])
        top = self.stack[-1]
        if tag in CELLS and top.tag in ("table", "tbody", "thead", "tfoot"):
            self._start("tr", {})
            top = self.stack[-1]
        if tag == "br":
            if not (top.gone or top.dim or top.shut):
                top.text.end(force=True)
            return
        e = _Open(tag, top)
        e.gone |= tag in UNSEEN
        if top.shut:  # of closed details only the first summary is seen
            e.gone |= tag != "summary" or top.count > 0
            top.count += tag == "summary"
        e.shut = tag == "details" and "open" not in attributes
        if attributes or self.rules or tag == "dialog":
            self._attributes(e, attributes)
        if tag in VOID:
            if tag == "hr" and not e.gone:
                top.text.space_before()
            return
        if len(self.stack) >= MOST_DEPTH:
            self._pop()
        self.stack.append(e)
        if e.gone:
            return
        t = e.text
        if tag in CELLS:
            e.text, e.indent = _Text(), ""
        elif tag == "table":
            t.space_before()
            e.text = _Text()
        elif tag in SPACED:
            nested = tag in ("ul", "ol", "menu") and any(x.tag == "li" for x in self.stack[:-1])
            t.end() if nested else t.space_before()
        elif tag in BLOCK:
            t.end()
        if tag in ("ul", "ol", "menu", "dir"):
            e.ordered = tag == "ol"
        elif tag == "li":
            up = next((x for x in reversed(self.stack[:-1]) if x.tag in ("ul", "ol", "menu", "dir")), None)
            if up is not None:
                value = attributes.get("value", "")
                up.count = int(value) if value[:10].lstrip("-").isdecimal() and len(value) <= 10 else up.count + up.step
            mark = f"{up.count}. " if up is not None and up.ordered else "- "
            e.indent = (e.indent + " " * len(mark))[:MOST_INDENT]
            t.mark = mark
        elif tag in ("blockquote", "dd"):
            e.indent = (e.indent + "  ")[:MOST_INDENT]
        elif tag in ("pre", "xmp", "listing", "textarea"):
            e.pre = True

    def _attributes(self, e: _Open, a: dict[str, str]) -> None:
        said = [((0, 0, 0), "display", True)] if "hidden" in a or e.tag == "dialog" and "open" not in a else []
        if self.rules:
            keys = [("", "*"), ("", e.tag), *((".", c) for c in dict.fromkeys(a.get("class", "").split())), ("#", a.get("id"))]
            for tag, weight, order, declared in (r for k in keys for r in self.rules.get(k, ())):
                if tag is None or tag == e.tag:
                    said += [((2 * important, 1 + weight, order), p, hides) for p, hides, important in declared]
        if style := a.get("style"):
            said += [((1 + 2 * important, 0, i), p, hides) for i, (p, hides, important) in enumerate(_declared(style))]
        said.sort(key=lambda x: x[0])
        last = {p: hides for _, p, hides in said}
        e.gone |= last.get("display", False)
        e.dim = last.get("visibility", e.dim)
        if e.tag in CELLS and a.get("colspan", "").isdecimal():
            e.span = max(1, min(MOST_COLUMNS, int(a["colspan"])))
        if e.tag in CELLS and a.get("rowspan", "").isdecimal():
            e.down = min(MOST_ROWS, int(a["rowspan"])) or MOST_ROWS  # 0 is all rows that follow
        if e.tag == "ol":
            start = a.get("start", "")
            e.step = -1 if "reversed" in a else 1
            if start[:10].lstrip("-").isdecimal() and len(start) <= 10:
                e.count = int(start) - e.step
            elif "reversed" in a:
                e.count = self._items() + 1

    def _items(self) -> int:
        """The number of items of the list whose tag is being read."""
        if self.items is None:
            self.items, open_ = {}, []
            for m in _LISTS.finditer(self.source):
                if m[2].lower() != "li":
                    if not m[1]:
                        open_.append(m.start())
                        self.items[m.start()] = 0
                    elif open_:
                        open_.pop()
                elif open_ and not m[1]:
                    self.items[open_[-1]] += 1
        return self.items.get(self.at, 0)

    def _end(self, tag: str) -> None:
        if tag in VOID:
            if tag == "br":
                self._start("br", {})
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i].tag in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return

    def _pop(self) -> None:
        e = self.stack.pop()
        up, t = self.stack[-1], e.text
        if e.gone:
            return
        if e.tag in CELLS:
            row = next((x for x in reversed(self.stack) if x.tag in ("tr", "table")), None)
            if row is not None:
                row.cells.append((t.done(), e.span, e.down))
            else:
                up.text.raw(t.done(), up.indent)
        elif e.tag == "tr":
            table = next((x for x in reversed(self.stack) if x.tag == "table"), None)
            if table is not None:
                table.rows.append(e.cells)
            else:
                up.text.raw(_columns(_placed([e.cells])), up.indent)
        elif e.tag == "table":
            if e.cells:
                e.rows.append(e.cells)
            up.text.raw(t.done(), up.indent)
            lines = _columns(_placed([r for r in e.rows if r]), sum(x.tag == "table" for x in self.stack) < DEEP_TABLE)
            while lines and not lines[0]:
                lines.pop(0)
            up.text.raw(lines, up.indent)
            up.text.gap = 1
        elif e.tag in SPACED:
            nested = e.tag in ("ul", "ol", "menu") and any(x.tag == "li" for x in self.stack)
            t.end() if nested else t.space_before()
        elif e.tag in BLOCK:
            t.end()
        if e.tag == "li":
            t.mark = ""


def extract(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, title and text of every page."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(html).cast("string").alias("html"))

    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "html", 4 << 20):
            done = [Page(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array([p.title for p in done], pa.string()), pa.array([p.text for p in done], pa.string())], names=["page_id", "title", "text"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, title string, text string")
