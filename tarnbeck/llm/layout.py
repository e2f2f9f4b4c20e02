"""HTML extraction by layout-aware rendering.

A tree builder applies the implied-tag rules of HTML; visibility rules drop what a browser would
not show; a renderer emits all visible text with block spacing, list markers and aligned table
cells. One page is held at a time, whatever its depth: nothing recurses, and no element, cell or text is left out for
its depth or length."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?:[!?]|/(?=[^a-zA-Z]))[^>]*+(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
BLANK = re.compile(r"[ \t\n\r\f]+")
STYLE_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
GONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
NEVER_SHOWN = frozenset(
    "head script style title template noscript iframe noembed noframes object audio video canvas datalist meta link base "
    "param source track rp metadata defs desc map area".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol option optgroup p plaintext pre search section "
    "summary table textarea ul xmp caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre listing table figure hr fieldset".split())
CLOSES_P = BLOCKS - frozenset("body html option optgroup caption legend textarea".split())
TABLE_PARTS = frozenset("caption colgroup thead tbody tfoot tr td th".split())
KEEPS_BLANKS = frozenset("pre listing textarea xmp plaintext".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u span sub sup mark q abbr cite label".split())

INPUTS_WITHOUT_TEXT = frozenset("hidden checkbox radio file image color range password".split())

#: Blocks nested deeper than this are indented no further, as an indent for each level of each line
#: would make texts grow with the square of the page.
MOST_INDENTS = 32
#: A row with a longer line in a cell isn't padded: its cells follow each other. Other rows stay aligned.
WIDEST_CELL = 80
#: Tables inside so many others aren't aligned, as each level copies the lines inside: cells are blocks.
MOST_GRIDS = 16


class Node:
    """hidden: it and all inside take no part. shows: whether visibility makes it seen, None as its parent."""

    __slots__ = ("attrs", "children", "hidden", "shows", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], hidden: bool, shows: bool | None = None) -> None:
        self.tag, self.attrs, self.hidden, self.shows = tag, attrs, hidden, shows
        self.children: list[Node | str] = []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(text):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        out.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
    return out


class Builder:
    """Tree builder: open elements are a stack; start tags close what they imply closed."""

    def __init__(self) -> None:
        self.root = Node("html", {}, False)
        self.open = [self.root]
        self.count: Counter[str] = Counter()  # of open elements by name, so that what isn't open isn't looked for
        self.unseen: set[str] = set()  # simple selectors that a style sheet hides
        self.shows: dict[str, bool] = {}  # visibility by simple selector

    def _cut(self, i: int, j: int | None = None) -> None:
        self.count.subtract(n.tag for n in self.open[i:j])
        del self.open[i:j]

    def _in_scope(self, tags: frozenset[str] | set[str], stop: frozenset[str]) -> int:
        """Place in the stack of the innermost of tags, 0 if a stop element comes first."""
        if not any(self.count[t] for t in tags):
            return 0
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                return i
            if self.open[i].tag in stop:
                return 0
        return 0

    def _close(self, tags: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        if i := self._in_scope(tags, stop):
            self._cut(i)

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs, *self._styled(tag, attrs))
        self.open[-1].children.append(node)
        if tag == "input" and attrs.get("type", "text").lower() not in INPUTS_WITHOUT_TEXT:
            node.children.append(attrs.get("value") or attrs.get("placeholder", ""))
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def _styled(self, tag: str, attrs: dict[str, str]) -> tuple[bool, bool | None]:
        """hidden, shows"""
        if tag in NEVER_SHOWN or (tag == "dialog" and "open" not in attrs):
            return True, None
        style = attrs.get("style", "")
        names = [tag, *("." + c for c in attrs.get("class", "").split()), *(["#" + attrs["id"]] if "id" in attrs else [])]
        hidden = "hidden" in attrs or bool(GONE.search(style)) or not self.unseen.isdisjoint(names)
        shows = None
        for name in names if self.shows else ():
            shows = self.shows.get(name, shows)
        if found := VISIBILITY.search(style):
            shows = found[1].lower() == "visible"
        return hidden, shows

    def start(self, tag: str, attrs: dict[str, str], self_closing: bool) -> None:
        scope = frozenset(("table", "td", "th", "caption", "button", "html", "body"))
        if tag in ("html", "body"):
            if tag == "body" and not self.count["body"]:
                self._close({"head"}, frozenset())
                self._push(tag, attrs)
            return
        if self.open[-1].tag == "head" and tag not in NEVER_SHOWN:
            self._cut(-1)
        if tag in CLOSES_P:
            self._close({"p"}, scope)
        if tag == "li":
            self._close({"li"}, frozenset(("ul", "ol", "menu", "dir")) | scope)
        elif tag in ("dt", "dd"):
            self._close({"dt", "dd"}, frozenset(("dl",)) | scope)
        elif tag in ("option", "optgroup"):
            self._close({"option"} if tag == "option" else {"option", "optgroup"}, frozenset(("select", "datalist")))
        elif tag in ("rt", "rp"):
            self._close({"rt", "rp"}, frozenset(("ruby",)))
        elif tag[0] == "h" and tag[1:] in "123456" and self.open[-1].tag[0] == "h" and self.open[-1].tag[1:] in tuple("123456"):
            self._cut(-1)
        elif tag == "a":
            self._close({"a"}, scope)
        elif tag in TABLE_PARTS:
            table = self._in_scope({"table"}, frozenset())
            if not table:
                return  # a part of no table: the tag is ignored, its text stays
            if tag in ("td", "th"):
                self._close({"td", "th"}, frozenset(("table",)))
                if not self._in_scope({"tr"}, frozenset(("table",))):
                    self._push("tr", {})
            elif tag == "tr":
                self._close({"tr"}, frozenset(("table",)))
                self._close({"caption", "colgroup"}, frozenset(("table",)))
            else:
                self._close(TABLE_PARTS, frozenset(("table",)))
                while self.open[-1].tag in TABLE_PARTS:
                    self._cut(-1)
        self._push(tag, attrs)
        if self_closing and tag not in VOID and tag in ("path", "use", "rect", "circle", "line", "g", "svg"):
            self._cut(-1)

    def end(self, tag: str) -> None:
        if tag == "br":
            self._push("br", {})
        elif tag == "p" and not self._in_scope({"p"}, frozenset(("table", "td", "th", "caption", "button"))):
            self._push("p", {})
            self._cut(-1)
        elif tag in FORMATTING:
            for i in range(len(self.open) - 1, 0, -1) if self.count[tag] else ():
                if self.open[i].tag == tag:
                    self._cut(i, i + 1)  # what stands inside it stays open
                    break
                if self.open[i].tag in ("table", "td", "th", "caption"):
                    break
        elif tag in ("html", "body"):
            pass  # what follows still belongs to the body
        elif tag[0] == "h" and tag[1:] in tuple("123456"):
            self._close({f"h{i}" for i in range(1, 7)}, frozenset(("table", "td", "th")))
        elif tag in TABLE_PARTS or tag == "table":
            self._close({tag}, frozenset() if tag == "table" else frozenset(("table",)))
        else:
            self._close({tag}, frozenset(("table", "td", "th", "caption")) if tag != "form" else frozenset(("table",)))

    def text(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self._cut(-1)
        self.open[-1].children.append(data)

    def style(self, sheet: str) -> None:
        for selectors, body in STYLE_RULE.findall(sheet):
            simple = [s for x in selectors.split(",") if re.fullmatch(r"[.#]?[\w-]+", s := x.strip())]
            if GONE.search(body):
                self.unseen.update(simple)
            if found := VISIBILITY.search(body):
                self.shows.update(dict.fromkeys(simple, found[1].lower() == "visible"))


def parse(page: str) -> Node:
    """The element tree of any text; nothing is an error."""
    build = Builder()
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            break
        if m.start() > at:
            build.text(unescape(page[at : m.start()]))
        at = m.end()
        if m["end"]:
            build.end(m["end"].lower())
        elif m["start"]:
            tag, rest = m["start"].lower(), m["attrs"]
            build.start(tag, _attributes(rest) if rest else {}, rest.endswith("/"))
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at) if tag != "plaintext" else None
                body = page[at : close.start() if close else n]
                at = close.end() if close else n
                if tag == "style":
                    build.style(body)
                elif tag in ("textarea", "title"):
                    body = unescape(body)
                build.open[-1].children.append(body)
                if build.open[-1].tag == tag:
                    build.open.pop()
    if at < n:
        build.text(unescape(page[at:]))
    return build.root


class Page:
    """Lines of text under way. A block starts and ends a line; spaced blocks ask for an empty
    line between themselves and their neighbours."""

    def __init__(self, grids: int = 0) -> None:
        self.grids = grids  # aligned tables around
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False  # a blank is due before the next word
        self.gap = False  # an empty line is due before the next line
        self.lead: list[str] = []  # prefixes of the lines of nested blocks
        self.mark: str | None = None  # a list marker for the next line

    def words(self, text: str) -> None:
        flat = BLANK.sub(" ", text)
        if flat == " ":
            self.space = self.space or bool(self.parts)
            return
        if flat[0] == " ":
            self.space = self.space or bool(self.parts)
            flat = flat[1:]
        if self.space:
            self.parts.append(" ")
            self.space = False
        if flat[-1:] == " ":
            self.space = True
            flat = flat[:-1]
        if flat:
            self.parts.append(flat)

    def flush(self) -> None:
        if self.parts:
            self.emit("".join(self.parts))
        self.parts, self.space = [], False

    def emit(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        lead = "".join(self.lead[:MOST_INDENTS])
        if self.mark is not None:
            lead = (lead[: len(lead) - len(self.mark)] if len(self.lead) <= MOST_INDENTS else lead) + self.mark
            self.mark = None
        self.lines.append((lead + line.replace("\xa0", " ")).rstrip())

    def line_break(self) -> None:
        if self.parts:
            self.flush()
        elif self.lines:
            self.emit("")

    def block(self, spaced: bool) -> None:
        self.flush()
        self.gap = self.gap or spaced


def _walk(first: Iterator) -> None:
    """Run a renderer; what it yields are the renderers of elements inside, to be run before it goes on."""
    stack = [first]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def _render(node: Node, page: Page, keep: bool, lists: int, seen: bool = True) -> Iterator[Iterator]:
    tag = node.tag
    if node.hidden:
        return
    seen = seen if node.shows is None else node.shows
    if tag == "br":
        if seen:
            page.line_break()
        return
    if tag == "hr":
        page.block(True)
        if seen:
            page.emit("---")
            page.gap = True
        return
    if tag == "table":
        page.block(True)
        yield _render_table(node, page, lists, seen)
        page.block(True)
        return
    block = tag in BLOCKS
    spaced = tag in SPACED and not (lists and tag in ("ul", "ol", "menu", "dir"))
    if block:
        page.block(spaced)
    lead = None
    number = 1
    if tag in ("ul", "ol", "menu", "dir"):
        lists += 1
        start = node.attrs.get("start", "")
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    elif tag == "blockquote":
        lead = "> "
    elif tag == "dd":
        lead = "    "
    elif tag == "li":
        mark = node.attrs.get("\0mark", "- ")
        page.mark, lead = mark if seen else None, " " * len(mark)
    if lead is not None:
        page.lead.append(lead)
    closed = tag == "details" and "open" not in node.attrs
    keep = keep or tag in KEEPS_BLANKS
    for child in node.children:
        if isinstance(child, str):
            if closed or not seen or not child:
                continue
            if not keep:
                page.words(child)
            else:
                text = child.replace("\r\n", "\n")
                if child is node.children[0] and tag in KEEPS_BLANKS:
                    text = text.removeprefix("\n")
                *whole, rest = text.split("\n")
                for line in whole:
                    page.emit("".join([*page.parts, line]))
                    page.parts = []
                if rest:
                    page.parts.append(rest)
        elif not closed or child.tag == "summary":
            if child.tag == "li" and tag == "ol":
                value = child.attrs.get("value", "")
                number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number
                child.attrs["\0mark"] = f"{number}. "
                number += 1
            yield _render(child, page, keep, lists, seen)
    if block:
        page.block(spaced)
    if lead is not None:
        page.lead.pop()
        if tag == "li":
            page.mark = None


def _rows(node: Node) -> Iterator[Node]:
    for child in node.children:
        if isinstance(child, Node) and not child.hidden:
            if child.tag == "tr":
                yield child
            elif child.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(child)


def _loose(node: Node) -> Iterator[Node | str]:
    """What stands in a table but in no cell: captions first of all; browsers show it before the table."""
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                yield child
        elif child.tag in ("thead", "tbody", "tfoot", "tr"):
            if not child.hidden:
                yield from _loose(child)
        elif child.tag not in ("td", "th", "colgroup"):
            yield child


def _span(attrs: dict[str, str], name: str, most: int) -> int:
    value = attrs.get(name, "1").strip()
    return max(1, min(int(value), most)) if re.fullmatch(r"\d{1,6}", value) else 1


def _render_table(node: Node, page: Page, lists: int, seen: bool) -> Iterator[Iterator]:
    for loose in _loose(node):
        if not isinstance(loose, str):
            yield _render(loose, page, False, lists, seen)
        elif seen:
            page.words(loose)
    page.flush()
    if page.grids >= MOST_GRIDS:
        for cell in (c for row in _rows(node) for c in row.children if isinstance(c, Node) and c.tag in ("td", "th") and not c.hidden):
            page.block(False)
            block = Node("div", {}, False, cell.shows)
            block.children = cell.children
            yield _render(block, page, False, lists, seen)
        return
    grid: list[dict[int, tuple[list[str], int]]] = []
    taken: dict[int, int] = {}  # columns that a cell above still covers: rows left
    for row in _rows(node):
        cells: dict[int, tuple[list[str], int]] = {}
        now = {c for c, left in taken.items() if left > 0}
        taken = {c: left - 1 for c, left in taken.items() if left > 1}
        at = 0
        row_seen = seen if row.shows is None else row.shows
        for cell in row.children:
            if not isinstance(cell, Node) or cell.tag not in ("td", "th"):
                continue
            while at in now:
                at += 1
            wide, high = _span(cell.attrs, "colspan", 1000), _span(cell.attrs, "rowspan", 65534)
            inner = Page(page.grids + 1)
            if not cell.hidden:
                cell_seen = row_seen if cell.shows is None else cell.shows
                for child in cell.children:
                    if not isinstance(child, str):
                        yield _render(child, inner, False, lists, cell_seen)
                    elif cell_seen:
                        inner.words(child)
                inner.flush()
            cells[at] = inner.lines, wide
            if high > 1:
                taken.update({c: high - 1 for c in range(at, at + wide)})
            at += wide
        grid.append(cells)
    aligned = [all(len(x) <= WIDEST_CELL for body, _ in cells.values() for x in body) for cells in grid]
    width: dict[int, int] = {}
    for cells, even in zip(grid, aligned, strict=True):
        for c, (body, wide) in cells.items():
            if even and wide == 1 and body:
                width[c] = max(width.get(c, 0), *map(len, body))
    for cells, even in zip(grid, aligned, strict=True):
        if even:
            for line in _aligned(cells, width):
                page.emit(line)
        else:
            for body, _ in cells.values():
                for line in body:
                    page.emit(line)


def _aligned(cells: dict[int, tuple[list[str], int]], width: dict[int, int]) -> Iterator[str]:
    """The lines of a row, as many as its highest cell has, each cell padded to its columns' width."""
    columns = sorted(width)
    for i in range(max((len(body) for body, _ in cells.values()), default=0)):
        out, reach = "", 0
        for c, (body, wide) in sorted(cells.items()):
            for k in columns[bisect_left(columns, reach) : bisect_left(columns, c)]:
                out += " " * (width[k] + 2) if width[k] else ""
            own = columns[bisect_left(columns, c) : bisect_left(columns, c + wide)]
            room = sum(width[k] for k in own) + 2 * (len(own) - 1)
            out += (body[i] if i < len(body) else "").ljust(max(room, 0)) + ("  " if room >= 0 else "")
            reach = c + wide
        yield out.rstrip()


def render(page: str | None) -> str | None:
    """All visible text of a page, laid out; null for null, empty for a page that shows nothing."""
    if page is None:
        return None
    out = Page()
    _walk(_render(parse(page), out, False, 0))
    out.flush()
    while out.lines and not out.lines[-1]:
        out.lines.pop()
    return "\n".join(out.lines)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) for every row of pages, whole pages, whatever their mark-up.

    Null pages have null text, empty ones and those that show nothing an empty one. Repeated rows
    each keep their row, a null id too; an empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(at, 256)
                texts = [render(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["page_id", "text"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(
        run, "page_id long, text string"
    )
