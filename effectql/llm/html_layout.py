"""Layout-aware text of web pages.

A tree builder with implied tags makes a tree of every page, and a renderer walks it as a browser lays
it out: what isn't shown is left out, all visible text is emitted, blocks stand apart, lists get their
marks and tables aligned columns.
"""

from __future__ import annotations

import bisect
import html as entities
import math
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, text_slices

# Fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "xmp", "iframe", "noembed", "noframes"}
ESCAPABLE_RAW = {"textarea", "title"}
HIDDEN = set("head title script style template noscript noembed noframes iframe datalist audio video canvas object".split())
#: Parts of graphics and formulas that are not drawn where they stand.
UNDRAWN = set("defs symbol clippath mask marker pattern lineargradient radialgradient filter metadata desc annotation annotation-xml".split())
#: Elements of graphics and formulas with page content, and tags that end a graphic or formula.
POINTS = set("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKS_OUT = set(
    "b big blockquote br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu nobr ol p pre ruby "
    "s small span strong strike sub sup table tt u ul var".split()
)
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup html hr legend li listing main menu nav ol optgroup option p plaintext pre search "
    "section summary table tbody td tfoot th thead tr ul caption xmp".split()
)
LISTS = {"ul", "ol", "menu", "dir"}
#: Blocks with an empty line before and behind.
SPACED = set("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul fieldset".split())
CLOSES_P = BLOCK - set("html body td th tr tbody thead tfoot caption option optgroup legend".split())
#: Opening such a tag closes the first open one of the second set, unless one of the third lies between.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
}
HEAD_ONLY = {"title", "base", "link", "meta", "style", "script", "template", "noscript"}
#: An end tag looks no further up than these.
SCOPE = {"table", "td", "th", "caption", "html", "template"}

_token = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.DOTALL,
)
_attribute = re.compile(r"([^\s\"'>/=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.DOTALL)
_invisible = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_visibility = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible|initial)\b", re.I)
_space = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("attributes", "children", "kind", "tag")

    def __init__(self, tag: str, attributes: str = "", parent: Node | None = None):
        self.tag, self.attributes, self.children = tag, attributes, []
        #: "svg" or "math" in a graphic or formula, "text" in a drawn text of a graphic, else empty.
        self.kind = "" if parent is None or parent.tag in POINTS else parent.kind
        if tag in ("svg", "math"):
            self.kind = tag
        elif tag == "text" and self.kind == "svg":
            self.kind = tag

    def get(self, name: str) -> str | None:
        """The value of an attribute, empty for one without value, None where it is missing."""
        if name not in self.attributes.lower():
            return None
        for m in _attribute.finditer(self.attributes):
            if m[1].lower() == name:
                return entities.unescape(next((v for v in m.groups()[1:] if v is not None), ""))
        return None


def parse(source: str) -> Node:
    """The tree of a page, below its html element. Every input has one; nothing raises."""
    root = Node("html")
    body: Node | None = None
    head: Node | None = None
    stack = [root]
    #: The places in the stack of each open tag, so that no search walks the stack.
    places: dict[str, list[int]] = {}
    at, end = 0, len(source)

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop().tag].pop()

    def last(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def into_body() -> None:
        nonlocal body
        if body is None:
            body = Node("body")
            root.children.append(body)
            cut(1)
            push(body)

    def text(value: str, decoded: bool = False) -> None:
        if not value:
            return
        if len(stack) == 1 or stack[-1] is head:
            if not value.strip(" \t\n\f\r"):
                return
            into_body()
        if not decoded and "&" in value:
            value = entities.unescape(value)
        stack[-1].children.append(value)

    def close(tags: set[str], until: set[str]) -> None:
        found = last(tags)
        if found and stack[found] is not body and found >= last(until):
            cut(found)

    while at < end:
        m = _token.search(source, at)
        if m is None:
            text(source[at:])
            break
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in ("html", "body"):
                continue
            if tag == "head":
                if stack[-1] is head:
                    cut(len(stack) - 1)
            elif tag == "br":
                into_body()
                stack[-1].children.append(Node("br"))
            elif tag == "p":
                if not places.get("p"):
                    into_body()
                    stack[-1].children.append(Node("p"))
                else:
                    close({"p"}, SCOPE)
            elif tag in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "caption"):
                close({tag}, set() if tag == "table" else {"table"})
            else:
                close({tag}, SCOPE)
            continue
        if tag == "html":
            root.attributes += m[3]
            continue
        if tag == "head":
            if head is None and body is None:
                head = Node("head", m[3])
                root.children.append(head)
                push(head)
            continue
        if tag == "body":
            if body is None:
                into_body()
                body.attributes = m[3]
            continue
        if body is None and tag not in HEAD_ONLY and not (stack[-1] is not head and len(stack) > 2):
            into_body()
        if tag in BREAKS_OUT:
            while stack[-1].kind and stack[-1].tag not in POINTS:
                cut(len(stack) - 1)
        if tag in CLOSES_P:
            close({"p"}, SCOPE | {"button"})
        if tag in IMPLIED_END:
            close(*IMPLIED_END[tag])
            if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                row = Node("tr")
                stack[-1].children.append(row)
                push(row)
        node = Node(tag, m[3], stack[-1])
        stack[-1].children.append(node)
        if tag in VOID or node.kind and m[3].endswith("/"):
            continue
        if tag in RAW or tag in ESCAPABLE_RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            raw = source[at : stop.start() if stop else end]
            at = stop.end() if stop else end
            if raw and tag not in HIDDEN:
                node.children.append(entities.unescape(raw) if tag in ESCAPABLE_RAW else raw)
            continue
        if tag == "plaintext":
            node.children.append(source[at:])
            break
        push(node)
    return root


def hidden(node: Node) -> bool:
    """Whether a page shows nothing of the element and of what it holds."""
    if node.tag in HIDDEN or node.kind and node.tag in UNDRAWN:
        return True
    if not node.attributes:
        return False
    if node.get("hidden") is not None or node.tag == "dialog" and node.get("open") is None:
        return True
    return bool(_invisible.search(node.get("style") or ""))


def visible(node: Node, inherited: bool) -> bool:
    """Whether an element's own text is visible: what it says, else as above it."""
    style = node.get("style") if node.attributes else None
    said = _visibility.findall(style) if style else []
    return said[-1].lower() in ("visible", "initial") if said else inherited


def _options(select: Node, seen: bool) -> tuple[list[str], list[str]]:
    """The lines of a list box, and the labels of options that are marked as selected."""
    lines, selected, todo = [], [], [(x, seen) for x in reversed(select.children)]
    while todo:
        x, above = todo.pop()
        if isinstance(x, str) or hidden(x):
            continue
        shown = visible(x, above)
        if x.tag == "option":
            label = x.get("label") or _flat(x)
            if shown:
                lines.append(label)
                if x.get("selected") is not None:
                    selected.append(label)
        else:
            if x.tag == "optgroup" and shown and x.get("label"):
                lines.append(x.get("label"))
            todo.extend((c, shown) for c in reversed(x.children))
    return lines, selected


def columns_of(text: str) -> int:
    """Places a line takes: two for wide characters, none for combining marks."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


#: Places that lines are indented at most; deeper blocks stand as far in.
INDENT = 64
#: Tables in tables beyond this depth are laid out as blocks: a cell on a line of its own.
TABLES = 24


class _Layout:
    """Lines of a block; inline text gathers in the last line until a block or a break ends it.

    Blocks inside that are indented or marked write to the same lines, with what stands in front of them.
    """

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = False
        self.kept = False
        #: Where the innermost block begins, what stands in front of its next line and of those behind it.
        self.start, self.first, self.rest = 0, "", ""
        #: Whether a mark waits for its line, an empty line is due before the next, and empty lines are skipped.
        self.marked = self.due = self.skip = False
        self.outer: list[tuple] = []

    def write(self, text: str, kept: bool = False) -> None:
        if kept:
            self.kept = True
            head, *rest = text.split("\n")
            self.inline.append(head)
            for line in rest:
                self.end_line(always=True)
                self.kept = True
                self.inline.append(line)
        else:
            self.inline.append(text)

    def end_line(self, always: bool = False) -> None:
        line = "".join(self.inline)
        self.inline = []
        line = line.rstrip() if self.kept else _space.sub(" ", line).strip(" \t\n\f\r")
        self.kept = False
        if not line and not always:
            return
        self.put([line])

    def put(self, lines: list[str]) -> None:
        for line in lines:
            if self.skip and not line and not self.marked:
                continue
            self.skip = False
            if self.due or self.gap and len(self.lines) > self.start:
                self.lines.append("")
            self.due = self.gap = False
            if self.marked:
                self.lines.append((self.first + line).rstrip())
                self.first, self.marked = self.rest, False
            else:
                self.lines.append(self.first + line if line else line)
                self.first = self.rest
        self.gap = False

    def space(self) -> None:
        self.end_line()
        self.gap = True

    def enter(self, mark: str = "", indent: int = 0, skip: bool = False) -> None:
        """Begin a block: its first line has ``mark`` (if any) in front, the others are indented."""
        self.outer.append((self.start, self.first, self.rest, self.marked, self.due, self.skip, self.gap, len(self.lines)))
        self.due = self.due or self.gap and len(self.lines) > self.start
        indent = min(indent, max(0, INDENT - len(self.rest)))
        if len(self.first) < 2 * INDENT:
            self.first += mark or " " * indent
        self.rest += " " * indent
        self.marked = self.marked or bool(mark)
        self.start, self.gap, self.skip = len(self.lines), False, self.skip or skip

    def leave(self, gap: bool | None, marked: bool = False) -> None:
        """End the innermost block.

        ``gap``: whether an empty line follows; None: only if one was due before and the block has no
        line. ``marked``: its mark gets a line even if the block has none.
        """
        self.end_line()
        if marked and len(self.lines) == self.start:
            self.skip = False
            self.put([""])
        start, first, rest, was_marked, due, skip, had_gap, before = self.outer.pop()
        written = len(self.lines) > before
        self.start, self.rest = start, rest
        self.first = rest if written else first
        self.marked = was_marked and not written
        self.due = due and not written
        self.skip = skip and not written
        self.gap = had_gap and not written if gap is None else gap


def _block(node: Node, kept: bool = False, seen: bool = True, tables: int = 0) -> list[str]:
    out = _Layout()
    _walk(node, out, kept, seen, tables)
    out.end_line()
    return out.lines


def _flat(node: Node) -> str:
    """The texts below a node that are shown, in a line."""
    todo: list[tuple[Node | str, bool]] = [(node, True)]
    found = []
    while todo:
        x, above = todo.pop()
        if isinstance(x, str):
            found.append(x)
        elif x is node or not hidden(x):
            shown = above if x is node else visible(x, above)
            todo.extend((c, shown) for c in reversed(x.children) if shown or not isinstance(c, str))
    return " ".join("".join(found).split())


def _nothing() -> None:
    pass


def _walk(top: Node, out: _Layout, kept: bool, seen: bool, tables: int) -> None:
    """Lay out what is below ``top``. Open elements wait in a list, so pages of any depth do."""
    # children still to come, their element, whether its text is visible and keeps white space, and what ends it
    open_: list[tuple] = [(iter(top.children), top, seen, kept, _nothing)]
    numbers: list[int] = []  # of the next item of each open list

    def lay_list(node: Node, shown: bool, kept: bool, gap: bool) -> None:
        start = node.get("start") if node.attributes else None
        numbers.append(int(start) if start and re.fullmatch(r"-?\d{1,9}", start.strip()) else 1)

        def end() -> None:
            numbers.pop()
            out.gap = gap

        open_.append((iter(node.children), node, shown, kept, end))

    def item(child: Node | str, node: Node, seen: bool, kept: bool) -> None:
        """A child of a list: an item, or something that stands where one should."""
        if isinstance(child, str) or child.tag != "li":
            if not (isinstance(child, str) and not child.strip() or not isinstance(child, str) and hidden(child)):
                loose = Node("li")
                loose.children = [child]
                out.enter(indent=2)
                open_.append((iter(loose.children), loose, seen, kept, lambda: out.leave(None)))
            return
        if hidden(child):
            return
        value = child.get("value") if child.attributes else None
        if value and re.fullmatch(r"-?\d{1,9}", value.strip()):
            numbers[-1] = int(value)
        mark = f"{numbers[-1]}. " if node.tag == "ol" else "- "
        numbers[-1] += 1
        shown = visible(child, seen)
        out.enter(mark if shown else "", len(mark))
        open_.append((iter(child.children), child, shown, kept, lambda: out.leave(None, shown)))

    while open_:
        children, node, seen, kept, end = open_[-1]
        child = next(children, None)
        if child is None:
            open_.pop()
            end()
            continue
        if node.tag in LISTS and node is not top:
            item(child, node, seen, kept)
            continue
        if isinstance(child, str):
            if seen and node.kind != "svg":
                out.write(child, kept)
            continue
        if hidden(child):
            continue
        tag = child.tag
        shown = visible(child, seen)
        if (tag in VOID or tag == "select") and not shown:
            continue
        below = iter(child.children)
        if tag == "br":
            out.end_line(always=True)
        elif tag == "hr":
            out.space()
            out.put(["---"])
            out.gap = True
        elif tag == "img":
            out.write(child.get("alt") or "")
        elif tag == "input":
            kind = (child.get("type") or "text").lower()
            if kind not in ("hidden", "password", "checkbox", "radio", "file", "image"):
                out.write(" " + (child.get("value") or "") + " ")
        elif tag == "select":
            lines, selected = _options(child, shown)
            if child.get("multiple") is not None or re.fullmatch(r"0*([2-9]|[1-9]\d+)", (child.get("size") or "").strip()):
                out.end_line()
                out.put(lines)
            elif selected:
                out.write(" " + selected[-1] + " ")
        elif tag in LISTS:
            out.end_line() if tag == "dir" or node.tag == "li" else out.space()
            lay_list(child, shown, kept, node.tag != "li")
        elif tag == "table" and tables < TABLES:
            out.space()
            out.put(_table(child, kept, shown, tables + 1))
            out.gap = True
        elif tag in ("pre", "listing", "xmp", "textarea"):
            out.space()
            out.enter(skip=True)
            open_.append((below, child, shown, True, lambda: out.leave(True)))
        elif tag in ("blockquote", "dd"):
            quote = tag == "blockquote"
            out.space() if quote else out.end_line()
            out.enter(indent=2)
            open_.append((below, child, shown, kept, lambda quote=quote: out.leave(quote)))
        elif tag in BLOCK or tag == "mtr":
            around = out.space if tag in SPACED else out.end_line
            around()
            if tag == "details" and child.get("open") is None:
                below = iter([c for c in child.children if not isinstance(c, str) and c.tag == "summary"][:1])
            open_.append((below, child, shown, kept, around))
        else:
            # texts of a graphic, parts of a fraction and cells of a formula stand apart
            apart = " " if tag == "text" and child.kind == "text" or tag == "mtd" or node.tag == "mfrac" else ""
            out.write(apart)
            open_.append((below, child, shown, kept, lambda apart=apart: out.write(apart)))


def _span(node: Node, name: str) -> int:
    value = node.get(name) if node.attributes else None
    return max(1, min(1000, int(value))) if value and re.fullmatch(r"\d{1,6}", value.strip()) else 1


def _table(node: Node, kept: bool, seen: bool, tables: int) -> list[str]:
    """Rows as lines with aligned columns; cells keep their own lines, spans cover what they span."""
    above: list[str] = []
    rows: dict[str, list[tuple[Node, bool]]] = {"thead": [], "tbody": [], "tfoot": []}

    todo = [(iter(node.children), "tbody", seen)]
    while todo:
        children, part, shown = todo[-1]
        c = next(children, None)
        if c is None:
            todo.pop()
        elif isinstance(c, str):
            if shown and c.strip():
                above.append(_space.sub(" ", c).strip())
        elif hidden(c):
            continue
        elif c.tag == "tr":
            rows[part].append((c, visible(c, shown)))
        elif c.tag in rows:
            todo.append((iter(c.children), c.tag, visible(c, shown)))
        elif c.tag not in ("colgroup", "col"):
            above.extend(_block(c, kept, visible(c, shown), tables))

    ordered = rows["thead"] + rows["tbody"] + rows["tfoot"]
    grid: list[list[tuple[int, int, list[str]]]] = []
    free, ends = _Free(), {}
    for number, (row, shown) in enumerate(ordered):
        for first, behind in ends.pop(number, ()):
            free.give(first, behind)
        at, cells, held = 0, [], []
        for c in row.children:
            if isinstance(c, str):
                if shown and c.strip():
                    above.append(_space.sub(" ", c).strip())
                continue
            if hidden(c):
                continue
            at = free.first(at)
            wide, high = _span(c, "colspan"), _span(c, "rowspan")
            cells.append((at, wide, _block(c, kept, visible(c, shown), tables)))
            if high > 1:
                held.append((at, at + wide, number + high))
            at += wide
        for first, behind, until in held:
            ends.setdefault(until, []).extend(free.take(first, behind))
        grid.append(cells)
    return above + _aligned(grid)


class _Free:
    """Columns that no cell of an earlier row covers, as stretches; the last one has no end."""

    def __init__(self):
        self.starts, self.ends = [0], [math.inf]

    def first(self, at: int) -> int:
        """The first free column from ``at`` on."""
        return max(at, self.starts[bisect.bisect_right(self.ends, at)])

    def take(self, first: int, behind: int) -> list[tuple[int, int]]:
        """Cover columns; returns those that were free."""
        out, k = [], bisect.bisect_right(self.ends, first)
        while self.starts[k] < behind:
            lo, hi = self.starts[k], self.ends[k]
            a, b = max(lo, first), min(hi, behind)
            out.append((a, b))
            left = [(x, y) for x, y in ((lo, a), (b, hi)) if x < y]
            self.starts[k : k + 1], self.ends[k : k + 1] = [x for x, _ in left], [y for _, y in left]
            k += bool(left) and left[0][0] < a
        return out

    def give(self, first: int, behind: int) -> None:
        """Free columns again; neighbouring stretches become one."""
        k = bisect.bisect_left(self.starts, first)
        if self.starts[k : k + 1] == [behind]:
            behind = self.ends[k]
            del self.starts[k], self.ends[k]
        if k and self.ends[k - 1] == first:
            self.ends[k - 1] = behind
        else:
            self.starts.insert(k, first)
            self.ends.insert(k, behind)


#: Blanks that align a table: so many for each cell, and for each character in it.
BLANKS = (64, 8)


def _aligned(grid: list[list[tuple[int, int, list[str]]]]) -> list[str]:
    """The lines of rows of cells (column, columns covered, lines), each column as wide as its widest cell.

    A column counts as wide as half of that, a quarter and so on, where the rows would else take more blanks than BLANKS
    allows; longer cells then push aside what stands right of them. So the output grows with the page.
    """
    widths: dict[int, int] = {}
    allowed, rows = 0, []
    for cells in grid:
        row: list[list[tuple[int, str]]] = [[] for _ in range(max((len(lines) for _, _, lines in cells), default=0))]
        for at, wide, lines in cells:
            allowed += BLANKS[0] * max(1, len(lines)) + BLANKS[1] * sum(len(x) - x.count(" ") for x in lines)
            if wide == 1 and lines:
                widths[at] = max(widths.get(at, 0), *map(columns_of, lines))
            for line, part in zip(row, lines, strict=False):
                if part:
                    line.append((at, part))
        rows += row
    columns = sorted(c for c, w in widths.items() if w)
    most = max(widths.values(), default=0)
    while True:
        places = [0]
        for c in columns:
            places.append(places[-1] + min(widths[c], most) + (2 if most else 0))
        place = lambda at, places=places: places[bisect.bisect_left(columns, at)]
        if not most or sum(place(parts[-1][0]) for parts in rows if parts) <= allowed:
            break
        most //= 2
    out: list[str] = []
    for parts in rows:
        line, used = [], 0
        for at, part in parts:
            gap = place(at) - used
            gap = gap if gap > 0 or not line else 2
            line.append(" " * gap + part)
            used += gap + columns_of(part)
        out.append("".join(line).rstrip())
    return out


def render(source: str | None) -> str:
    """The visible text of a page; empty for null."""
    if not source:
        return ""
    root = parse(source)
    if hidden(root):
        return ""
    lines = _block(root, seen=visible(root, True))
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines = lines[1:]
    return "\n".join(lines).replace("\xa0", " ")


def extract_text(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """page_id, text for each row of ``pages``.

    Null and empty pages have empty text; any input has a result, broken markup and any depth of nesting
    included, in time that grows with the page. Lines are indented by INDENT places at most and have marks for twice as many; tables in
    more than TABLES tables are laid out as blocks. Of a closed ``details`` the summary is shown. Whole pages
    are read. Text of formulas and graphics is shown, their titles and annotations are not. Of drop-down
    lists the option marked as selected is shown (none, where the first stands by default), of list boxes
    all. Repeated rows each give a row; only the two named columns are read; an empty table gives
    no rows.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = [render(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    return pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(html_column).cast("string").alias("text")
    ).mapInArrow(run, "page_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select(
        "page_id",
        "text",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("text", 256).alias("text_sha256"),
    )


NAME = "op6_html_layout"
SQL = None
