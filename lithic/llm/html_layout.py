"""Layout-aware text of HTML pages: a tree builder with implied tags, visibility rules, and a renderer of blocks.

All visible text is emitted in document order. Blocks stand on lines of their own with collapsed margins, list
items get markers and hanging indents, table cells are padded to the width of their column, pre keeps its blanks.

Defined results: null html gives a null text, empty html or html without visible text gives ''. Elements nested
deeper than MAX_DEPTH become siblings at that depth, as browsers do, so no text is lost. Repeated rows get equal
texts. Extra columns pass through; one that has the result's name gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

MAX_DEPTH = 200
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(visible|hidden|collapse)", re.I)
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr menu".split())
CLOSES_P = BLOCK - frozenset("body html li dt dd option optgroup legend summary".split())
UNSEEN = frozenset("head script style template noscript iframe object audio video canvas annotation annotation-xml noembed noframes datalist title meta link".split())
#: Parts of drawings that are not drawn where they stand, or not at all.
UNDRAWN = frozenset("defs symbol clippath mask pattern marker metadata desc".split())
#: Inside these, a drawing or formula holds HTML again.
INTEGRATION = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
TABLE_PARTS = frozenset("table caption colgroup thead tbody tfoot tr td th".split())
#: A start tag closes the nearest of these, unless one of the barriers comes first.
IMPLIED_END = {
    "li": (("li",), ("ul", "ol", "menu", "dir", "table", "td", "th")), "dt": (("dt", "dd"), ("dl", "table", "td", "th")), "dd": (("dt", "dd"), ("dl", "table", "td", "th")),
    "option": (("option",), ("select", "datalist")), "optgroup": (("optgroup", "option"), ("select", "datalist")),
    "tr": (("tr", "caption", "colgroup"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)), "tbody": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)), "tfoot": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


def attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTR.finditer(raw):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return found


def build(html: str) -> Node:
    """The element tree, with the end tags that authors may omit put in."""
    root = Node("#root", {})
    stack = [root]
    at = 0
    foreign_met = False

    def close(tags: tuple[str, ...], barriers: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in barriers:
                return

    def foreign() -> int:
        """Where on the stack the innermost drawing or formula begins, 0 outside."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in ("svg", "math"):
                return k
            if stack[k].tag in INTEGRATION:
                return 0
        return 0

    while at < len(html):
        m = TOKEN.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            stack[-1].kids.append(unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].kids.append(Node("br", {}))
            elif tag not in VOID:
                close((tag,), () if tag in TABLE_PARTS else ("table", "td", "th") if tag not in BLOCK else ("td", "th"))
            continue
        raw = m[3] or ""
        node = Node(tag, attributes(raw) if raw.strip(" /\n\t\r") else {})
        within = foreign() if foreign_met else 0
        if within and tag in BLOCK:  # HTML blocks end a drawing or formula that was left open
            del stack[within:]
            within = 0
        foreign_met = foreign_met or tag in ("svg", "math")
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        if tag == "body":
            close(("head",), ())
        if tag in CLOSES_P:
            close(("p",), ("td", "th", "table", "button", "li", "object"))
        if tag in IMPLIED_END:
            close(*IMPLIED_END[tag])
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            stack.pop()
        if tag in ("tr", "td", "th"):
            if tag != "tr" and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                row = Node("tr", {})
                stack[-1].kids.append(row)
                stack.append(row)
        elif stack[-1].tag == "head" and tag not in UNSEEN and tag not in ("base",):
            stack.pop()
        stack[-1].kids.append(node)
        if tag in RAW:
            end = RAW_END[tag].search(html, at)
            body = html[at : end.start() if end else len(html)]
            node.kids.append(unescape(body) if tag in ("textarea", "title") else body)
            at = end.end() if end else len(html)
        elif tag not in VOID and len(stack) < MAX_DEPTH and not ((within or tag in ("svg", "math")) and raw.endswith("/")):
            stack.append(node)  # a slash does not close an HTML element
    if "visibility" in html.lower():
        hide(root, True)
    return root


def hide(node: Node, shown: bool, drawn: bool = False) -> None:
    """Take out the text that visibility hides: it is inherited, and descendants can turn it on again."""
    drawn = drawn or node.tag == "svg"
    if said := VISIBILITY.findall(node.attrs.get("style", "")) or ([node.attrs["visibility"]] if drawn and node.attrs.get("visibility") else []):
        shown = said[-1].lower() == "visible"
    if not shown:
        node.kids = [k for k in node.kids if not isinstance(k, str)]
    for kid in node.kids:
        if not isinstance(kid, str):
            hide(kid, shown, drawn)


def visible(node: Node) -> bool:
    if node.tag in UNSEEN:
        return False
    a = node.attrs
    if not a:
        return True
    return not ("hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden") or ("style" in a and HIDDEN_STYLE.search(a["style"])))


class Flow:
    """Lines of one formatting context; margins between blocks collapse to the larger."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = 0

    def flush(self) -> None:
        if not self.inline:
            return
        line = SPACE.sub(" ", "".join(self.inline)).strip(" ")
        self.inline = []
        if line:
            self.put([line])

    def put(self, lines: list[str]) -> None:
        """Finished lines; SPACE does not apply to them."""
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        self.lines += lines

    def edge(self, margin: int) -> None:
        self.flush()
        self.gap = max(self.gap, margin)


def cell_grid(table: Node) -> tuple[list[list[tuple[int, int, list[str]]]], list[list[str]]]:
    """Rows of (column, columns spanned, lines), and the captions."""
    rows: list[list[tuple[int, int, list[str]]]] = []
    captions: list[list[str]] = []
    taken: dict[int, int] = {}

    def span(node: Node, name: str) -> int:
        v = node.attrs.get(name, "1").strip()
        return min(max(int(v), 1), 1000) if v.isdigit() and len(v) < 6 else 1

    def walk(parent: Node) -> None:
        nonlocal taken
        for kid in parent.kids:
            if isinstance(kid, str):
                if kid.strip():
                    captions.append([SPACE.sub(" ", kid).strip()])
            elif not visible(kid):
                continue
            elif kid.tag == "tr":
                row, col, kept = [], 0, {c: n - 1 for c, n in taken.items() if n > 1}
                for cell in kid.kids:
                    if isinstance(cell, str):
                        if cell.strip():
                            captions.append([SPACE.sub(" ", cell).strip()])
                        continue
                    if not visible(cell):
                        continue
                    if cell.tag not in ("td", "th"):
                        captions.append(lines_of(cell))
                        continue
                    while taken.get(col, 0) > 0:
                        col += 1
                    wide, tall = span(cell, "colspan"), span(cell, "rowspan")
                    row.append((col, wide, lines_of(cell)))
                    if tall > 1:
                        kept |= {c: tall - 1 for c in range(col, col + wide)}
                    col += wide
                taken = {c: n for c, n in kept.items() if n > 0}
                rows.append(row)
            elif kid.tag in ("thead", "tbody", "tfoot"):
                walk(kid)
            else:
                captions.append(lines_of(kid))

    walk(table)
    return rows, [c for c in captions if c]


def table_lines(table: Node) -> list[str]:
    rows, captions = cell_grid(table)
    widths: dict[int, int] = {}
    for row in rows:
        for col, wide, lines in row:
            for c in range(col, col + wide):
                widths.setdefault(c, 0)
            if wide == 1:
                widths[col] = max(widths[col], *(len(x) for x in lines), 0) if lines else widths[col]
    # What a spanning cell needs beyond its columns and their gaps goes to its last column.
    for row in rows:
        for col, wide, lines in row:
            if wide > 1 and lines:
                held = sum(widths[c] + 2 for c in range(col, col + wide)) - 2
                widths[col + wide - 1] += max(0, max(map(len, lines)) - held)
    starts, x = {}, 0
    for col in sorted(widths):
        starts[col] = x
        x += widths[col] + 2
    out = [line for c in captions for line in c]
    for row in rows:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            line = ""
            for col, _, lines in row:
                if k < len(lines):
                    line = line.ljust(starts[col]) if len(line) <= starts[col] else line + "  "
                    line += lines[k]
            out.append(line.rstrip())
    return out


def lines_of(node: Node) -> list[str]:
    flow = Flow()
    render(node, flow, node.tag == "pre")
    flow.flush()
    return flow.lines


def render(node: Node, flow: Flow, pre: bool = False) -> None:
    count = 0
    for kid in node.kids:
        if isinstance(kid, str):
            if not pre:
                flow.inline.append(kid)
            else:
                first, *rest = kid.split("\n")
                flow.inline.append(first)
                for line in rest:
                    flow.put(["".join(flow.inline).rstrip()])
                    flow.inline = [line]
            continue
        tag = kid.tag
        if not visible(kid):
            continue
        if tag == "br":
            if any(s.strip() for s in flow.inline):
                flow.flush()
            else:
                flow.inline = []
                flow.gap = max(flow.gap, 1) if flow.lines else 0
        elif tag == "svg":
            draw(kid, flow)
        elif tag == "table":
            flow.edge(1)
            if lines := table_lines(kid):
                flow.put(lines)
            flow.edge(1)
        elif tag == "li":
            count += 1
            start = node.attrs.get("start", "1")
            marker = f"{count - 1 + (int(start) if start.lstrip('-').isdigit() and len(start) < 9 else 1)}. " if node.tag == "ol" else "- "
            flow.edge(0)
            if lines := lines_of(kid):
                flow.put([marker + lines[0], *((" " * len(marker) + x).rstrip() for x in lines[1:])])
            flow.edge(0)
        elif tag in ("blockquote", "dd"):
            flow.edge(int(tag in SPACED))
            if lines := lines_of(kid):
                flow.put([("  " + x).rstrip() for x in lines])
            flow.edge(int(tag in SPACED))
        elif tag == "pre":
            flow.edge(1)
            own = Flow()
            render(kid, own, True)
            if "".join(own.inline).strip():
                own.put(["".join(own.inline).rstrip()])
            while own.lines and not own.lines[0]:
                own.lines.pop(0)
            while own.lines and not own.lines[-1]:
                own.lines.pop()
            if own.lines:
                flow.put(own.lines)
            flow.edge(1)
        elif tag == "details" and "open" not in kid.attrs:
            flow.edge(0)
            for part in kid.kids:
                if not isinstance(part, str) and part.tag == "summary" and visible(part):
                    render(part, flow, pre)
            flow.edge(0)
        elif tag in BLOCK or tag in TABLE_PARTS:
            nested = int(tag in SPACED and not (tag in ("ul", "ol", "menu") and node.tag == "li"))
            flow.edge(nested)
            render(kid, flow, pre)
            flow.edge(nested)
        else:
            render(kid, flow, pre)


def draw(node: Node, flow: Flow) -> None:
    """The labels of a drawing, each on a line of its own."""
    for kid in node.kids:
        if isinstance(kid, str) or kid.tag in UNDRAWN or kid.attrs.get("display") == "none" or not visible(kid):
            continue
        if kid.tag in ("text", "foreignobject"):
            flow.edge(0)
            render(kid, flow)
            flow.edge(0)
        else:
            draw(kid, flow)


def text_of(html: str | None) -> str | None:
    return None if html is None else "\n".join(lines_of(build(html)))


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages with the rendered text in column out; narrow, one page at a time."""
    at = pages.columns.index(html)
    kept = [k for k, n in enumerate(pages.columns) if n != out]
    schema = StructType([*(pages.schema[k] for k in kept), StructField(out, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array([text_of(h.as_py()) for h in b.column(at)], pa.string())], names=schema.names)

    return pages.mapInArrow(run, schema)
