"""HTML extraction: a stack of open elements with implied tags, and layout-aware rendering.

All visible text comes out: block elements on lines of their own (paragraph-like ones with a
blank line between), list items behind ``- `` or their number and indented by depth, table
rows as lines with cells padded to columns (``colspan`` and ``rowspan`` hold their places; a cell of
several lines, a nested table too, keeps them), preformatted text as it stands but for spaces at
the end of a line. A line of a cell over ``WIDE`` characters widens no column, and beyond ``LINE``
characters of a row cells are parted by two spaces, so padding stays in proportion. Texts of math and svg are inline. Not visible: comments, head, script, style,
template and the like, fallbacks of audio, video, canvas and object, in svg and math what they
only define or annotate (``FOREIGN_UNSEEN``), elements with ``hidden`` or an inline
``display:none``, and what an inline ``visibility`` hides, up to where it shows again. Missing end tags are implied (p, li, dt, dd, option,
table parts); stray end tags are ignored. Null and empty pages give an empty text.
Work and memory are linear in the page; nesting has no limit. No shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NO_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*(hidden|collapse|visible)", re.I)
SPAN = {name: re.compile(rf"\b{name}\s*=\s*[\"']?\s*(\d{{1,6}})", re.I) for name in ("colspan", "rowspan")}
WIDE, LINE = 120, 400
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style template noscript iframe noembed noframes".split())
UNSEEN = RAW | frozenset("head title datalist audio video canvas object".split())
#: Elements whose content is text only, and whether entities in it count.
PLAIN = {"xmp": False, "textarea": True}
#: The largest spans that HTML knows.
MOST = {"colspan": 1000, "rowspan": 65534}
FOREIGN = frozenset(["svg", "math"])
FOREIGN_UNSEEN = frozenset("desc metadata defs symbol annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre xmp table figure article section hr".split())
BLOCK = SPACED | frozenset("html body div li dt dd tr header footer nav main aside form fieldset legend address figcaption details summary caption option center dir menu thead tbody tfoot td th".split())
#: Start tag: (open elements that it ends, elements beyond which it does not look).
_TABLE = frozenset(["table"])
IMPLIED = {
    "li": ({"li"}, frozenset("ul ol dir menu table".split())),
    "dt": ({"dt", "dd"}, frozenset(["dl", "table"])),
    "dd": ({"dt", "dd"}, frozenset(["dl", "table"])),
    "option": ({"option"}, frozenset(["select"])),
    "td": ({"td", "th"}, _TABLE | {"tr"}),
    "th": ({"td", "th"}, _TABLE | {"tr"}),
    "tr": ({"tr"}, _TABLE),
    **{part: ({"thead", "tbody", "tfoot", "caption", "colgroup"}, _TABLE) for part in ("thead", "tbody", "tfoot")},
    "body": ({"head"}, frozenset()),
}
NO_P = BLOCK - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "option", "caption"}
P_WALL = frozenset("td th caption table button object".split())
END_WALL = frozenset(["table"])


class Lines:
    """Text under construction: runs of white space are one space, blocks ask for line breaks."""

    def __init__(self):
        self.out: list[str] = []
        self.breaks = self.depth = 0
        self.space = False
        self.mark = ""
        self.blank = ""  # preformatted spaces that stay if the line goes on
        self.fresh = True

    def block(self, n: int) -> None:
        self.breaks, self.space, self.blank = max(self.breaks, n), False, ""

    def begin(self) -> None:
        if not self.fresh and self.breaks:
            self.out.append("\n" * self.breaks)
        if self.fresh or self.breaks:
            self.out.append("  " * max(0, self.depth - 1) + (self.mark or ("  " if self.depth else "")))
            self.mark = ""
            self.space = False
        self.breaks, self.fresh = 0, False

    def text(self, s: str) -> None:
        words = s.split()
        if not words:
            self.space = self.space or bool(s)
            return
        lead = self.space or self.blank or s[0].isspace()
        self.blank = ""
        was = self.fresh or self.breaks
        self.begin()
        self.out.append((" " if lead and not was else "") + " ".join(words))
        self.space = s[-1].isspace()

    def verbatim(self, s: str) -> None:
        for i, line in enumerate(s.split("\n")):
            if i:
                self.breaks, self.blank, self.space = self.breaks + 1, "", False
            if said := line.rstrip():
                lead = " " if self.space and not (self.fresh or self.breaks) else ""
                self.begin()
                self.out.append(lead + self.blank + said)
                self.blank, self.space = line[len(said) :], False
            else:
                self.blank += line

    def done(self) -> str:
        return "".join(self.out)


class Table:
    """Rows of cells: lines, columns and rows that a cell takes."""

    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.titles: list[str] = []

    def placed(self) -> list[list[tuple[int, int, list[str]]]]:
        """Start and end column and lines of the cells of each row, clear of cells that reach down from above."""
        out, down = [], []  # down: (start, end, rows to come)
        for cells in self.rows:
            at, k, row, more = 0, 0, [], []
            for lines, wide, tall in cells:
                while k < len(down) and down[k][0] <= at:
                    at, k = max(at, down[k][1]), k + 1
                row.append((at, at + wide, lines))
                if tall > 1:
                    more.append((at, at + wide, tall))
                at += wide
            down = [(s, e, n - 1) for s, e, n in (sorted(down + more) if more else down) if n > 1]
            out.append(row)
        return out

    def lines(self) -> list[str]:
        rows = self.placed()
        edge = {c: i for i, c in enumerate(sorted({c for row in rows for s, e, _ in row for c in (s, e)}))}
        width, spans = [0] * len(edge), []
        for row in rows:
            for s, e, lines in row:
                n = max((len(x) for x in lines if len(x) <= WIDE), default=0)
                if edge[e] == edge[s] + 1:
                    width[edge[s]] = max(width[edge[s]], n)
                else:
                    spans.append((edge[s], edge[e], n))
        place = self.offsets(width)
        more = list(width)
        for s, e, n in spans:
            more[e - 1] = max(more[e - 1], width[e - 1] + n - (place[e] - place[s] - 2))
        place, out = self.offsets(more), list(self.titles)
        for row in rows:
            for i in range(max((len(lines) for *_, lines in row), default=0)):
                said, size = [], 0
                for s, _, lines in row:
                    if i < len(lines) and lines[i].strip():
                        at = place[edge[s]]
                        pad = max(at - size, 2 if said else 0) if at <= LINE else 2 * bool(said)
                        said += [" " * pad, lines[i]]
                        size += pad + len(lines[i])
                if said:
                    out.append("".join(said).rstrip())
        return out

    @staticmethod
    def offsets(width: list[int]) -> list[int]:
        """Where each column starts; one without text of its own takes no place."""
        out = [0]
        for w in width:
            out.append(out[-1] + w + 2 * bool(w))
        return out


def span(name: str, attributes: str) -> int:
    m = SPAN[name].search(attributes)
    n = min(int(m[1]), MOST[name]) if m else 1
    return n or (MOST[name] if name == "rowspan" else 1)  # rowspan=0: all rows that follow


def hidden(attributes: str) -> tuple[bool, bool | None]:
    """Whether an element is not displayed at all, and whether it is invisible (None: as its parent)."""
    low = attributes.lower()
    if "hidden" not in low and "style" not in low:
        return False, None
    gone, unseen = False, None
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden":
            gone = gone or value.lower() != "until-found"
        elif name == "style":
            gone = gone or bool(NO_DISPLAY.search(value))
            for x in VISIBILITY.findall(value):
                unseen = x.lower() != "visible"
    return gone, unseen


def extract(page: str) -> str:
    """The visible text of a page."""
    sinks, tables, lists = [Lines()], [], []  # of the open cells, tables and lists
    stack: list[tuple] = []  # open elements: tag, not displayed, preformatted, foreign, invisible, attributes of a cell

    opened: Counter = Counter()  # how many elements of a tag are open

    def push(element: tuple) -> None:
        stack.append(element)
        opened[element[0]] += 1

    def shown() -> bool:
        return not (stack and stack[-1][1])

    def seen() -> bool:
        return not (stack and (stack[-1][1] or stack[-1][4]))

    def close() -> None:
        tag, gone, _, foreign, _, attributes = stack.pop()
        opened[tag] -= 1
        if gone:
            return
        sink = sinks[-1]
        if foreign:
            sink.space = sink.space or tag == "text"  # texts of a picture stand apart
            return
        if tag in ("td", "th", "caption") and len(sinks) > 1:
            sinks.pop()
            if tables and tag == "caption":
                tables[-1].titles.append(" ".join(sink.done().split()))
            elif tables:
                lines = [x.rstrip() for x in sink.done().split("\n") if x.strip()]
                tables[-1].rows[-1].append((lines, span("colspan", attributes), span("rowspan", attributes)))
        elif tag == "table" and tables:
            done = tables.pop()
            for line in done.lines():
                sink.block(1)
                sink.begin()
                sink.out.append(line)
            sink.block(2)
        elif tag in ("ul", "ol", "dir", "menu"):
            if lists:
                lists.pop()
            sink.depth = max(0, sink.depth - 1)
            sink.block(1 if sink.depth else 2)
        elif tag in BLOCK:
            sink.mark = "" if tag == "li" else sink.mark
            sink.block(2 if tag in SPACED else 1)

    def end(tags, wall) -> None:
        """Close the nearest of ``tags`` and what is open in it, if no element of ``wall`` stands before it."""
        if not any(opened[t] for t in tags):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                while len(stack) > i:
                    close()
                return
            if stack[i][0] in wall:
                return

    def say(s: str) -> None:
        if s and seen():
            s = unescape(s) if "&" in s else s
            if stack and stack[-1][2]:
                sinks[-1].verbatim(s)
            else:
                sinks[-1].text(s)

    at = 0
    while m := TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        slash, tag, attributes = m.groups()
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            end((tag,), END_WALL if tag != "table" else ())
            continue
        if tag == "br":
            if seen():
                sinks[-1].block(min(2, sinks[-1].breaks + 1))
            continue
        foreign = tag in FOREIGN or (bool(stack) and stack[-1][3] and tag not in BLOCK)
        if foreign and attributes.endswith("/"):
            continue
        if tag in IMPLIED:
            end(*IMPLIED[tag])
        if tag in NO_P:
            end(("p",), P_WALL)
        if tag in VOID:
            if tag == "hr" and shown():
                sinks[-1].block(2)
            continue
        off, invisible = hidden(attributes)
        invisible = (bool(stack) and stack[-1][4]) if invisible is None else invisible
        gone = not shown() or tag in UNSEEN or (foreign and tag in FOREIGN_UNSEEN) or off
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if tag in PLAIN:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if not gone and not invisible:
                inside = page[at : stop.start() if stop else len(page)]
                if tag == "xmp":
                    sinks[-1].block(2)
                sinks[-1].verbatim(unescape(inside).removeprefix("\n") if PLAIN[tag] else inside)
                if tag == "xmp":
                    sinks[-1].block(2)
            at = stop.end() if stop else len(page)
            continue
        if not gone and tag in ("td", "th", "caption", "tr", "thead", "tbody", "tfoot"):
            if not tables:  # a table part alone opens a table
                push(("table", False, False, False, False, ""))
                sinks[-1].block(2)
                tables.append(Table())
            if tag == "tr" or (tag in ("td", "th") and not any(t == "tr" for t, *_ in stack[-1:])):
                tables[-1].rows.append([])
                if tag != "tr":
                    push(("tr", False, False, False, invisible, ""))
        push((tag, gone, (bool(stack) and stack[-1][2]) or tag == "pre", foreign and tag != "foreignobject", invisible, attributes))
        if gone:
            continue
        if foreign and tag == "text":
            sinks[-1].space = True
            continue
        if tag == "table":
            sinks[-1].block(2)
            tables.append(Table())
        elif tag in ("td", "th", "caption"):
            sinks.append(Lines())
        elif tag in ("ul", "ol", "dir", "menu"):
            sinks[-1].block(1 if sinks[-1].depth else 2)
            sinks[-1].depth += 1
            start = re.search(r"start\s*=\s*[\"']?(-?\d{1,9})", attributes)
            lists.append([tag, int(start[1]) if start else 1])
        elif tag == "li":
            sinks[-1].block(1)
            kind = lists[-1] if lists else ["ul", 1]
            sinks[-1].mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
            kind[1] += 1
        elif tag in BLOCK and tag not in ("tr", "thead", "tbody", "tfoot"):
            sinks[-1].block(2 if tag in SPACED else 1)
    say(page[at:])
    while stack:
        close()
    return sinks[0].done()


def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col``, ``text`` and ``n_chars``; a row for each row."""

    @F.pandas_udf("string")
    def extracted(html: pd.Series) -> pd.Series:
        return html.map(extract)

    df = pages.select(F.col(id_col).alias("_id"), extracted(text_of(html_col)).alias("_t"))
    return df.select(F.col("_id").alias(id_col), F.col("_t").alias("text"), F.char_length("_t").cast("long").alias("n_chars"))
