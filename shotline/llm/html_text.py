"""HTML to text by layout: a small tree builder with implied tags and visibility rules, then a block renderer.

All visible text comes out: blocks on lines of their own, paragraphs and headings set off by a blank line, list items
with marks and indentation, table cells in aligned columns, preformatted text as it stands. Choices of a select and the
lines of a textarea stand on lines of their own; formulas and the text of drawings run on in their line. Each page is handled alone,
so a scan needs no shuffle and its memory is that of one page. The tokenizer is linear in the page, whatever it holds.

Defined results: null or empty HTML gives an empty text; broken markup is repaired as browsers do in the common cases
and never raises; nesting past ``DEEPEST`` is flattened, but what is hidden there stays hidden; alignment of a page's tables
adds at most ``PADDING`` characters for each of the page and ``SPARE`` more: a table that would pass that has columns of at most ``NARROW``, and
if that is too much, cells that follow each other without padding, all text kept; columns in which no cell begins or ends have no width; repeated rows are rendered each; an empty table gives none.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEEPEST = 200
PADDING, SPARE = 100, 1_000_000  # characters that aligning tables may add to a page, for each of its own and in all
MOST_HELD = 500_000  # cells that one table may hold free below others; past it, rows below take them
NARROW = 40

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_HIDDEN = frozenset("head script style template noscript title meta link iframe noembed noframes object audio video canvas datalist mphantom".split())
#: Elements of a drawing that are not drawn where they stand.
_UNDRAWN = frozenset("title desc defs metadata symbol clippath mask marker pattern style script".split())
#: HTML start tags that end a drawing or formula, and the elements within these that hold HTML.
_BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_HOLDS_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
_SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
_ENDS_P = _BLOCK - frozenset("td th tr tbody thead tfoot caption body html legend summary figcaption".split()) | {"summary", "figcaption"}
#: What a start tag closes, and the elements that such a search does not leave.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "a": ({"a"}, {"table", "td", "th"}),
    "body": ({"head"}, {"html"}),
}
_TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/<>]*)")
_STOPS = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_GONE = re.compile(r"display\s*:\s*none", re.I)
_SEEN = re.compile(r"visibility\s*:\s*(hidden|collapse|visible|initial)", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_HEAD_ONLY = frozenset("head title style script meta link base template noscript".split())


class _Element:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


class _Tags:
    """Finds the markup of a page from left to right.

    A tag ends at the first ``>`` outside quotes. A start that finds none is text, and so is any later one that runs
    into a place where such a search has failed before; so no stretch is searched more than a few times.
    """

    def __init__(self, page: str) -> None:
        self.page, self.failed, self.stop = page, set(), None
        self.last = {c: page.rfind(c) for c in "<>\"'"}

    def _end(self, at: int) -> int:
        """The place after the tag's end, or -1."""
        seen = []
        if at > self.last[">"]:
            return -1
        if not self.stop or self.stop.start() < at:  # searches begin further and further on
            self.stop = _STOPS.search(self.page, at)
        m = self.stop
        while m and at <= self.last[">"] and m.start() not in self.failed:
            if m[0] == ">":
                return m.end()
            seen.append(m.start())
            if self.last[m[0]] <= m.start():
                break
            at = self.page.index(m[0], m.end()) + 1
            m = _STOPS.search(self.page, at)
        self.failed.update(seen)
        return -1

    def next(self, at: int) -> tuple[int, int, str, bool, str]:
        """Begin and end of the next markup, its tag (empty for comments and the like), whether it closes, its attributes."""
        page, end = self.page, len(self.page)
        while at <= self.last["<"]:
            at = page.find("<", at)
            if page.startswith("<!--", at):
                stop = page.find("-->", at + 4)
                return at, stop + 3 if stop >= 0 else end, "", False, ""
            if page.startswith(("!", "?"), at + 1):
                if at < self.last[">"]:
                    return at, page.index(">", at) + 1, "", False, ""
            elif m := _TAG_NAME.match(page, at + 1):
                stop = self._end(m.end())
                if stop >= 0:
                    return at, stop, m[2].lower(), bool(m[1]), page[m.end() : stop - 1]
            at += 1
        return end, end, "", False, ""


def _drop_unseen(e: _Element, unseen: bool = False) -> None:
    """Take out the text of invisible elements; a visible one within them shows."""
    kept = []
    for c in e.children:
        if isinstance(c, str):
            if not unseen:
                kept.append(c)
            continue
        found = _SEEN.findall(c.attrs.get("style", ""))
        hidden = found[-1].lower() in ("hidden", "collapse") if found else unseen
        _drop_unseen(c, hidden)
        if c.children or not hidden or c.tag in ("td", "th"):
            kept.append(c)
    e.children = kept


def parse(page: str) -> _Element:
    """The tree of a page."""
    root = _Element("html", {})
    stack = [root]

    def close(tags: set[str], walls: set[str]) -> None:
        """Close the innermost open element of ``tags`` and all in it, unless an element of ``walls`` is nearer."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in walls:
                return

    def raw_end(tag: str, at: int) -> re.Match | None:
        return re.compile(rf"</{tag}\s*>", re.I).search(page, at)

    foreign = re.search(r"<(?:svg|math)\b", page, re.I) is not None
    at, end, tags_of = 0, len(page), _Tags(page)
    hiding: list = []  # a hidden element past DEEPEST: its tag, and how many of them are open
    while at < end:
        begin, stop, tag, closes, given = tags_of.next(at)
        if begin > at and not hiding:
            said = page[at:begin]
            if stack[-1].tag == "head" and said.strip():
                close({"head"}, set())
            stack[-1].children.append(html.unescape(said) if "&" in said else said)
        at = stop
        if not tag:
            continue
        if hiding:
            hiding[1] += (tag == hiding[0]) * (-1 if closes else 1)
            if tag in _RAW and not closes:
                found = raw_end(tag, at)
                at = found.end() if found else end
            if not hiding[1]:
                hiding = []
            continue
        if closes:
            if tag in ("br", "p") and not any(x.tag == tag for x in stack):
                stack[-1].children.append(_Element(tag, {}))
            elif tag not in ("html", "body"):
                close({tag}, {"table"} if tag not in ("table", "html") and tag not in _BLOCK else set())
            continue
        attrs = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in _ATTR.findall(given)} if given.strip(" /\t\n\r\f") else {}
        if tag == "html":
            continue
        within = foreign and next((x.tag for x in reversed(stack) if x.tag in ("svg", "math") or x.tag in _HOLDS_HTML), None)
        while within in ("svg", "math") and tag in _BREAKS:
            close({within}, set())
            within = next((x.tag for x in reversed(stack) if x.tag in ("svg", "math") or x.tag in _HOLDS_HTML), None)
        if stack[-1].tag == "head" and tag not in _HEAD_ONLY:
            close({"head"}, set())
        if tag in _ENDS_P:
            close({"p"}, {"table", "td", "th", "caption", "object", "foreignobject"})
        if tag in _IMPLIED:
            tags, walls = _IMPLIED[tag]
            while any(x.tag in tags for x in stack):
                before = len(stack)
                close(tags, walls)
                if len(stack) == before or tag in ("li", "dt", "dd", "a", "option"):
                    break
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot") and len(stack) < DEEPEST:
            row = _Element("tr", {})
            stack[-1].children.append(row)
            stack.append(row)
        new = _Element(tag, attrs)
        if len(stack) >= DEEPEST and tag not in _VOID and tag not in _RAW and not _visible(new):
            hiding = [tag, 1]
            continue
        stack[-1].children.append(new)
        if foreign and given.endswith("/") and (tag in ("svg", "math") or within in ("svg", "math")):
            continue
        if tag in _RAW:
            found = raw_end(tag, at)
            said = page[at : found.start() if found else end]
            new.children.append(html.unescape(said) if tag == "textarea" else said)
            at = found.end() if found else end
        elif tag not in _VOID and len(stack) < DEEPEST:
            stack.append(new)
    if _SEEN.search(page):
        _drop_unseen(root)
    return root


def _visible(e: _Element) -> bool:
    if e.tag in _HIDDEN or "hidden" in e.attrs or _GONE.search(e.attrs.get("style", "")):
        return False
    return not (e.tag == "dialog" and "open" not in e.attrs)


class _Out:
    """Lines of text under construction; blanks collapse unless preformatted."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False

    def text(self, said: str) -> None:
        bits = _BLANKS.split(said)
        if bits[0] == "" and len(bits) > 1:
            self.space = True
        words = [b for b in bits if b]
        if words:
            if self.space and self.parts:
                self.parts.append(" ")
            self.parts.append(" ".join(words))
            self.space = bits[-1] == ""

    def end_line(self, always: bool = False) -> None:
        if self.parts or always:
            self.lines.append("".join(self.parts).rstrip(" "))
        self.parts, self.space = [], False

    def gap(self) -> None:
        self.end_line()
        if self.lines and self.lines[-1] != "":
            self.lines.append("")

    def done(self) -> list[str]:
        self.end_line()
        lines = self.lines
        while lines and lines[-1] == "":
            lines.pop()
        return lines


def _nest(out: _Out, lines: list[str], first: str, rest: str) -> None:
    """Lines of an inner block, the first marked, the others indented alike."""
    out.end_line()
    for k, line in enumerate(lines):
        out.lines.append((first if k == 0 else rest) + line if line or k == 0 else "")


def _flow(e: _Element, out: _Out, depth: int = 0, pre: bool = False) -> None:
    number = int(e.attrs["start"]) if e.tag == "ol" and re.fullmatch(r"-?\d{1,9}", e.attrs.get("start", "")) else 1
    for child in e.children:
        if isinstance(child, str):
            if pre:
                first, *rest = child.split("\n")
                out.parts.append(first)
                for line in rest:
                    out.end_line(always=True)
                    out.parts.append(line)
            else:
                out.text(child)
            continue
        tag = child.tag
        if not _visible(child):
            continue
        if tag == "br":
            out.end_line(always=True)
        elif tag == "hr":
            out.gap()
            out.lines += ["---", ""]
        elif tag == "wbr" or (e.tag == "semantics" and tag.startswith("annotation")):
            continue
        elif tag == "svg":
            _drawn(child, out, depth + 1)
        elif tag in ("option", "optgroup"):
            out.end_line()
            label = child.attrs.get("label", "")
            if label:
                out.text(label)
                out.end_line()
            if tag == "optgroup" or not label:
                _flow(child, out, depth + 1)
            out.end_line()
        elif tag == "textarea":
            out.end_line()
            said = "".join(child.children).replace("\r\n", "\n").removeprefix("\n")
            if said.strip():
                for line in said.split("\n"):
                    out.parts.append(line)
                    out.end_line(always=True)
        elif tag == "table":
            out.gap()
            out.lines += _table(child, depth)
            out.gap()
        elif tag == "li":
            inner = _Out()
            _flow(child, inner, depth + 1, pre)
            mark = f"{number}. " if e.tag == "ol" else "- "
            number += 1
            _nest(out, inner.done() or [""], mark, " " * len(mark))
        elif tag in ("dd", "blockquote"):
            inner = _Out()
            _flow(child, inner, depth + 1, pre)
            mark = "    " if tag == "dd" else "> "
            if tag == "blockquote":
                out.gap()
            _nest(out, inner.done(), mark, mark)
            if tag == "blockquote":
                out.gap()
        elif tag in _BLOCK:
            nested_list = tag in ("ul", "ol") and e.tag == "li"
            (out.gap if tag in _SPACED and not nested_list else out.end_line)()
            _flow(child, out, depth + 1, pre or tag == "pre")
            (out.gap if tag in _SPACED and not nested_list else out.end_line)()
        else:
            _flow(child, out, depth + 1, pre)


def _drawn(e: _Element, out: _Out, depth: int) -> None:
    """The text of a drawing: that of its text elements, each set off by a blank, and of HTML within it."""
    for child in e.children:
        if isinstance(child, str) or child.tag in _UNDRAWN or not _visible(child):
            continue
        if child.attrs.get("display") == "none" or child.attrs.get("visibility") in ("hidden", "collapse"):
            continue
        out.space = True
        if child.tag == "text":
            _flow(_without(child), out, depth + 1)
        elif child.tag == "foreignobject":
            _flow(child, out, depth + 1)
        else:
            _drawn(child, out, depth + 1)
        out.space = True


def _without(e: _Element) -> _Element:
    """``e`` without descriptions, which drawings show as tips only."""
    out = _Element(e.tag, e.attrs)
    out.children = [c if isinstance(c, str) else _without(c) for c in e.children if isinstance(c, str) or c.tag not in _UNDRAWN]
    return out


def _span(e: _Element, name: str) -> int:
    """Columns that a cell takes; 1000 is the most that HTML allows."""
    given = e.attrs.get(name, "1")
    return max(1, min(int(given), 1000)) if re.fullmatch(r"\d{1,9}", given) else 1


def _rowspan(e: _Element) -> float:
    """Rows that a cell takes; 0 is the rest of its group."""
    given = e.attrs.get("rowspan", "1")
    return (int(given) or float("inf")) if re.fullmatch(r"\d{1,9}", given) else 1


def _table(table: _Element, depth: int) -> list[str]:
    """Captions, then rows with their cells in columns as wide as their widest cell; a cell keeps its columns free in the rows it spans."""
    above, rows = [], []

    def collect(e: _Element, group: int) -> None:
        for k, child in enumerate(e.children):
            if isinstance(child, str) or not _visible(child):
                if isinstance(child, str) and child.strip():
                    above.append(" ".join(child.split()))
                continue
            if child.tag in ("thead", "tbody", "tfoot"):
                collect(child, k + 1)
            elif child.tag == "tr":
                cells = []
                for cell in child.children:
                    if isinstance(cell, str):
                        if cell.strip():
                            cells.append(([" ".join(cell.split())], 1, 1))
                    elif _visible(cell):
                        inner = _Out()
                        _flow(cell if cell.tag in ("td", "th") else _wrapped(cell), inner, depth + 1)
                        cells.append((inner.done(), _span(cell, "colspan"), _rowspan(cell)))
                rows.append((cells, group))
            else:
                inner = _Out()
                _flow(_wrapped(child), inner, depth + 1)
                above.extend(inner.done())

    collect(table, 0)
    placed = []  # the cells of each row as (column, lines, span), columns that are held from above one by one and without lines
    held: list[tuple[int, int, float]] = []  # columns from one on, and how many more rows of their group they are taken in
    before, n_held = None, 0
    for cells, group in rows:
        n_held += len(held)
        if group != before or n_held > MOST_HELD:
            held, before = [], group
        row, at, k = [(c, None, span) for c, span, _ in held], 0, 0
        kept = [(c, span, n - 1) for c, span, n in held if n > 1]
        for lines, span, down in cells:
            while k < len(held) and held[k][0] <= at:
                at = max(at, held[k][0] + held[k][1])
                k += 1
            row.append((at, lines, span))
            if down > 1:
                kept.append((at, span, down - 1))
            at += span
        placed.append(sorted(row, key=lambda c: c[0]))
        held = sorted(kept)
    # only columns in which some cell begins or ends are columns
    edges = {x: k for k, x in enumerate(sorted({0} | {x for row in placed for at, _, span in row for x in (at, at + span)}))}
    placed = [[(edges[at], lines, edges[at + span] - edges[at]) for at, lines, span in row] for row in placed]
    placed = [[x for at, lines, span in row for x in ([(at, lines, span)] if lines is not None else [(j, [], 1) for j in range(at, at + span)])] for row in placed]
    width = [0] * len(edges)
    for row in placed:
        for at, lines, span in row:
            if span == 1:
                width[at] = max([width[at], *map(len, lines)])
    aligned = _affordable(width, placed)
    out = list(above)
    for row in placed:
        if not any(lines for _, lines, _ in row):
            continue
        for k in range(max(len(lines) for _, lines, _ in row)):
            if not aligned:
                out.append(" | ".join(lines[k] if k < len(lines) else "" for _, lines, _ in row if lines).rstrip(" "))
                continue
            line, next_at = [], 0
            for at, lines, span in row:
                line += ["".ljust(aligned[j]) for j in range(next_at, at)]
                room = sum(aligned[at : at + span]) + 3 * (span - 1)
                line.append((lines[k] if k < len(lines) else "").ljust(room))
                next_at = max(next_at, at + span)
            out.append(" | ".join(line).rstrip(" "))
    return out


_left = [SPARE]  # characters that aligning tables may still add to the page that is rendered


def _affordable(width: list[int], placed: list[list[tuple[int, list[str], int]]]) -> list[int] | None:
    """Column widths whose padding the page can still afford, taken from what is left; None where there are none."""
    for widest in (max(width, default=0), NARROW):
        widths = [min(n, widest) for n in width]
        upto = [0]
        for n in widths:
            upto.append(upto[-1] + n + 3)
        added = sum(upto[row[-1][0]] * max((len(lines) for _, lines, _ in row), default=0) for row in placed if row)
        if added <= _left[0]:
            _left[0] -= added
            return widths
    return None


def _wrapped(e: _Element) -> _Element:
    out = _Element("div", {})
    out.children = [e]
    return out


def render(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    _left[0] = PADDING * len(page) + SPARE
    out = _Out()
    _flow(parse(page), out)
    return "\n".join(out.done()).strip("\n")


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column(1)
        for at in range(0, len(pages), 200):
            part = pages.slice(at, 200)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 200), pa.array([render(p) for p in part.to_pylist()], pa.string())], ["id", "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of every page."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_render, "id long, text string").withColumnRenamed("id", id_col)
