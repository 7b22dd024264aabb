"""Visible text of HTML pages, laid out: blocks apart, lists marked, table cells aligned.

A tokenizer that follows HTML's states feeds a tree builder that supplies what
pages leave out (ends of paragraphs, items, rows and cells; rows and sections of
tables; heads and bodies).  A pass from the top then settles what shows:
``hidden``, closed ``details`` and ``dialog``, and ``display`` and
``visibility`` of style attributes and style sheets by importance, specificity
and order; visibility is inherited, so a visible part of a hidden one shows.
Selectors are compounds of tag, classes, id and attributes, joined by descent or
childhood; others (siblings, pseudo-classes) match nothing.  Media rules count
as on a screen of 1280 x 800.  Tables are set from the innermost outwards, and
everything else walks the tree without recursion.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE = frozenset("textarea title".split())
UNSEEN = frozenset("head script style template noscript noembed noframes iframe audio video canvas datalist title rp".split())
UNSEEN_SVG = frozenset("desc metadata defs symbol clippath mask pattern marker".split())
UNSEEN_MATH = frozenset("annotation annotation-xml".split())
IN_HEAD = frozenset("base link meta title style script noscript template".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table ul".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr listing ol p pre table ul dir menu".split())
ENDS_P = BLOCKS - {"body", "html", "option", "optgroup", "legend"}
LISTS = frozenset("ul ol dir menu".split())
SECTIONS = frozenset("thead tbody tfoot".split())
CELLS = frozenset(("td", "th"))
PARTS = SECTIONS | CELLS | {"tr", "caption", "colgroup", "col"}
#: What an implied end doesn't reach beyond.
SCOPE = frozenset("html table td th caption template button object marquee applet".split())
#: Elements that a start tag ends, and what keeps it from reaching further up.
ENDS = {
    "li": (frozenset(("li",)), LISTS | SCOPE), "dt": (frozenset(("dt", "dd")), SCOPE | {"dl"}), "dd": (frozenset(("dt", "dd")), SCOPE | {"dl"}),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup")) | SCOPE), "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",)) | SCOPE),
    "rt": (frozenset(("rt", "rp")), frozenset(("ruby",)) | SCOPE), "rp": (frozenset(("rt", "rp")), frozenset(("ruby",)) | SCOPE),
    "td": (CELLS, frozenset(("tr", "table"))), "th": (CELLS, frozenset(("tr", "table"))), "tr": (frozenset(("tr", "caption", "colgroup")), frozenset(("table",))),
    "tbody": (SECTIONS | {"tr", "caption", "colgroup"}, frozenset(("table",))), "thead": (SECTIONS | {"tr", "caption", "colgroup"}, frozenset(("table",))), "tfoot": (SECTIONS | {"tr", "caption", "colgroup"}, frozenset(("table",))),
}

_VALUE = r"\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s\"'>][^\s>]*+"
_TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)|</>|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:{_VALUE})?)?)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s\"'>][^\s>]*+))?)?")
_SPACES = re.compile(r"[ \t\n\r\f]+")
#: Lists and quotes are indented this many levels at most; text further in stands at the last.
INDENTS = 32


class Node:
    __slots__ = ("tag", "attributes", "children", "shown", "visible", "display", "lines")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.shown, self.visible, self.display, self.lines = True, True, None, None


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text" | "start" | "end", text or tag, attributes)."""
    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            yield "text", unescape(page[at:]), {}
            return
        if m.start() > at:
            yield "text", unescape(page[at : m.start()]), {}
        at, tag = m.end(), m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            yield "end", tag, {}
            continue
        attributes: dict[str, str] = {}
        if m[3]:
            for a in _ATTRIBUTE.finditer(m[3]):
                attributes.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
        yield "start", tag, attributes
        if tag in RAW or tag in ESCAPABLE:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            body = page[at : end.start()] if end else page[at:]
            yield "text", unescape(body) if tag in ESCAPABLE else body, {}
            yield "end", tag, {}
            at = end.end() if end else len(page)


class Builder:
    """The tree of a page; ``open`` is the path to where the next node goes, ``places`` where each tag stands in it."""

    def __init__(self):
        self.root = Node("html", {})
        self.open, self.places, self.blocks = [self.root], defaultdict(list), []
        self.body, self.styles = None, []

    def _push(self, tag: str, attributes: dict[str, str]) -> Node:
        node = Node(tag, attributes)
        self.open[-1].children.append(node)
        self.places[tag].append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append(node)
        return node

    def _cut(self, k: int) -> None:
        """Close the elements from the k-th on."""
        while len(self.open) > k:
            tag = self.open.pop().tag
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def _last(self, tags: frozenset | tuple) -> int:
        """Where the innermost open element of these tags stands, 0 if there is none."""
        return max((here[-1] for tag in tags if (here := self.places.get(tag))), default=0)

    def _end(self, ends: frozenset, limits: frozenset) -> None:
        """Close the nearest of ``ends`` again and again, as far as no limit stands in between."""
        while (k := self._last(ends)) and k > self._last(limits - ends):
            self._cut(k)

    def _in_body(self) -> None:
        if self.body is None:
            self._cut(1)
            self.body = self._push("body", {})

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag == "html":
            return
        if tag in ("head", "body"):
            if self.body is None:
                self._cut(1)
                node = self._push(tag, attributes)
                self.body = node if tag == "body" else None
            return
        if self.body is None:
            if tag not in IN_HEAD:
                self._in_body()
            elif len(self.open) == 1:
                self._push("head", {})
        if tag in ENDS_P:
            self._end(_P, SCOPE)
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in PARTS and self._last(("table",)) <= self._last(CELLS):
            return  # parts of tables mean nothing outside one
        if tag in CELLS and self.open[-1].tag != "tr":
            self.start("tr", {})
        elif tag == "tr" and self.open[-1].tag == "table":
            self._push("tbody", {})
        self._push(tag, attributes)
        if tag in VOID:
            self._cut(len(self.open) - 1)

    def end(self, tag: str) -> None:
        if tag == "br":
            return self.start("br", {})
        if tag in ("html", "body"):
            return None
        if tag == "head":
            if self.body is None:
                self._cut(1)
            return None
        k = self._last(_HEADINGS if tag in _HEADINGS else (tag,))
        if tag == "table" or tag in SECTIONS or tag == "tr":
            limit = 0 if tag == "table" else self._last(("table",))
        else:
            limit = self._last(SCOPE | LISTS if tag == "li" else SCOPE)
            if tag not in BLOCKS and tag not in SCOPE and self.blocks:
                limit = max(limit, self.blocks[-1])  # the end of a phrase doesn't close blocks
        if k and k >= limit:
            self._cut(k)
        elif tag == "p":  # an end without a start is an empty paragraph
            self.start("p", {})
            self._cut(len(self.open) - 1)
        return None

    def text(self, text: str) -> None:
        here = self.open[-1]
        if here.tag == "style":
            self.styles.append(text)
        if self.body is None and here.tag not in IN_HEAD:
            if not text.strip():
                return
            self._in_body()
            here = self.open[-1]
        here.children.append(text)


_P = frozenset(("p",))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)[^;!]*(!\s*important)?", re.I)
_COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+|\[[^\]]*\])*)\Z")
_ATTRIBUTE_TEST = re.compile(r"\[\s*([^\s=~^$*|\]]+)\s*(?:([~^$*|]?)=\s*[\"']?([^\"'\]]*?)[\"']?\s*)?\]")
_FEATURE = re.compile(r"\(\s*([a-z-]+)\s*(?::\s*([\w.-]+)\s*)?\)")
SCREEN = {"width": 1280, "height": 800}


def _declared(text: str) -> dict[str, tuple[bool, str]]:
    """display and visibility of a declaration block: (important, value), the last of the more important."""
    found: dict[str, tuple[bool, str]] = {}
    for m in _DECLARATION.finditer(text):
        name, weight = m[1].lower(), bool(m[3])
        if name not in found or weight >= found[name][0]:
            found[name] = (weight, m[2].lower())
    return found


def _on_screen(query: str) -> bool:
    """Whether one of a media query's alternatives holds on the screen assumed."""

    def holds(m: re.Match) -> bool:
        name, value = m[1], m[2]
        side = name.removeprefix("min-").removeprefix("max-")
        if side in SCREEN and value:
            size = re.match(r"([\d.]+)(px|em|rem)?\Z", value)
            if not size:
                return False
            pixels = float(size[1]) * (16 if size[2] in ("em", "rem") else 1)
            return SCREEN[side] >= pixels if name.startswith("min-") else SCREEN[side] <= pixels if name.startswith("max-") else SCREEN[side] == pixels
        return (name, value) in (("orientation", "landscape"), ("prefers-color-scheme", "light"), ("hover", "hover"), ("pointer", "fine"), ("color", None))

    for one in query.lower().split(","):
        kind = re.match(r"\s*(not|only)?\s*([a-z]+)?", one)
        yes = kind[2] in (None, "and", "all", "screen") and all(holds(m) for m in _FEATURE.finditer(one))
        if yes != (kind[1] == "not"):
            return True
    return False


def _rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of a style sheet that apply; blocks of other at-rules are passed over."""
    text = re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet, flags=re.S)
    at, live = 0, [True]
    for m in re.finditer(r"[{};]", text):
        lead = text[at : m.start()].strip()
        if m[0] == "{":
            at = m.end()
            if lead.startswith("@"):
                name, _, rest = lead[1:].partition(" ")
                live.append(live[-1] and (name.lower() in ("supports", "layer") or (name.lower() == "media" and _on_screen(rest))))
            else:
                live.append(live[-1])
                if live[-1]:
                    end = text.find("}", at)
                    yield lead, text[at : end if end >= 0 else len(text)]
        elif m[0] == "}":
            at = m.end()
            if len(live) > 1:
                live.pop()
        elif lead.startswith("@"):
            at = m.end()


class Styles:
    """What style sheets say of display and visibility, found by the parts of their selectors."""

    def __init__(self, sheets: list[str]):
        self.index: dict[str, list] = defaultdict(list)
        order = 0
        for sheet in sheets:
            for selectors, block in _rules(sheet):
                said = _declared(block)
                for selector in selectors.split(",") if said else ():
                    order += 1
                    self._add(selector, said, order)

    def _add(self, selector: str, said: dict, order: int) -> None:
        parts = re.sub(r"\s*>\s*", " > ", selector.strip()).split()
        compounds, child, step = [], [], False
        for part in parts:
            if part == ">":
                step = True
                continue
            m = _COMPOUND.match(part)
            if not m or not part:
                return
            pieces = re.findall(r"[.#][\w-]+|\[[^\]]*\]", m[2])
            tests = [_ATTRIBUTE_TEST.match(x) for x in pieces if x[0] == "["]
            if not all(tests):
                return
            compounds.append(((m[1] or "*").lower(), frozenset(x[1:] for x in pieces if x[0] == "."), [x[1:] for x in pieces if x[0] == "#"], [(t[1].lower(), t[2], t[3]) for t in tests]))
            child.append(step)
            step = False
        if not compounds or step:
            return
        weight = (sum(len(c[2]) for c in compounds), sum(len(c[1]) + len(c[3]) for c in compounds), sum(c[0] != "*" for c in compounds))
        for k, c in enumerate(compounds):
            key = f"#{c[2][0]}" if c[2] else f".{min(c[1])}" if c[1] else c[0]
            self.index[key].append((c, (order, k), child[k], said if k == len(compounds) - 1 else None, (weight, order)))

    def of(self, node: Node, above: frozenset, parent: frozenset) -> tuple[list, frozenset]:
        """Declarations that meet a node as (weight, said), and the selector parts that it fulfils for what lies in it."""
        a, met, said = node.attributes, set(), []
        classes = a.get("class", "").split() if "class" in a else []
        for key in ("*", node.tag, *(f".{c}" for c in set(classes)), f"#{a['id']}" if "id" in a else ""):
            for (tag, names, ids, tests), (order, k), child, block, weight in self.index.get(key, ()):
                if tag not in ("*", node.tag) or not names.issubset(classes) or any(a.get("id") != i for i in ids) or not all(_tested(a, *t) for t in tests):
                    continue
                if k and (order, k - 1) not in (parent if child else above):
                    continue
                met.add((order, k))
                if block:
                    said.append((weight, block))
        return said, frozenset(met)


def _tested(attributes: dict[str, str], name: str, how: str, value: str | None) -> bool:
    has = attributes.get(name)
    if has is None or value is None:
        return has is not None
    tests = {"": has == value, "~": value in has.split(), "^": bool(value) and has.startswith(value), "$": bool(value) and has.endswith(value), "*": bool(value) and value in has, "|": has == value or has.startswith(value + "-")}
    return tests[how]


def settle(root: Node, sheets: list[str]) -> list[Node]:
    """Mark what shows, from the top down; gives the shown tables, outer before inner."""
    styles, tables, none = Styles(sheets), [], frozenset()
    stack = [(root, True, none, none, "")]
    while stack:
        node, seen, above, parent, within = stack.pop()
        a, met = node.attributes, none
        own = within if node.tag not in ("svg", "math") else node.tag
        if node.tag in UNSEEN or (own == "svg" and node.tag in UNSEEN_SVG) or (own == "math" and node.tag in UNSEEN_MATH) or (node.tag == "object" and "data" in a) or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
            node.shown = False
            continue
        display = "none" if "hidden" in a or (node.tag == "dialog" and "open" not in a) else None
        if a.get("style") or styles.index:
            said, met = styles.of(node, above, parent) if styles.index else ([], none)
            best: dict[str, tuple] = {}
            for weight, block in [*[((0, *w), block) for w, block in said], ((1,), _declared(a.get("style", "")))]:
                for name, (important, value) in block.items():
                    if name not in best or best[name][0] <= (important, weight):
                        best[name] = ((important, weight), value)
            if "display" in best:
                display = best["display"][1]
            if "visibility" in best and best["visibility"][1] != "inherit":
                seen = best["visibility"][1] not in ("hidden", "collapse")
        node.shown, node.visible = display != "none", seen
        node.display = display if display not in ("inherit", "initial", "unset", "revert") else None
        if not node.shown:
            continue
        if node.tag == "table":
            tables.append(node)
        below = above if met <= above else above | met
        stack.extend((c, seen, below, met, own) for c in reversed(node.children) if not isinstance(c, str))
    return tables


def parse(page: str) -> tuple[Node, list[Node]]:
    """The tree with what shows marked, and its tables, outer before inner."""
    builder = Builder()
    for kind, value, attributes in tokens(page):
        if kind == "text":
            builder.text(value)
        elif kind == "start":
            builder.start(value, attributes)
        else:
            builder.end(value)
    return builder.root, settle(builder.root, builder.styles)


def columns_of(text: str) -> int:
    """Columns that a line takes: wide characters two, marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines in the making: words with single spaces, blocks apart, indents and markers."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.space, self.filled, self.pre = 0, False, False, 0
        self.indents = [""]
        self.marker = ""

    def indent(self, by: str) -> None:
        self.indents.append(self.indents[-1] + by if len(self.indents) <= INDENTS else self.indents[-1])

    def text(self, text: str) -> None:
        if self.pre:
            for k, part in enumerate(text.replace("\r\n", "\n").split("\n")):
                if k:
                    self.newline()
                if part:
                    self._add(part)
            return
        parts = _SPACES.split(text)
        if not parts[0] and len(parts) > 1:
            self.space = True
        body = " ".join(p for p in parts if p)
        if body:
            if self.space and self.filled:
                self.line.append(" ")
            self._add(body)
            self.space = not parts[-1]

    def _add(self, text: str) -> None:
        if not self.filled:
            if self.gap > 1 and self.lines:
                self.lines.append("")
            indent = self.indents[-1]
            if self.marker:
                indent = indent[: len(indent) - len(self.marker)] + self.marker
                self.marker = ""
            self.line.append(indent)
            self.filled, self.gap = True, 0
        self.line.append(text)
        self.space = False

    def newline(self) -> None:
        if self.filled:
            self.lines.append("".join(self.line).rstrip())
        elif self.lines and self.gap == 0:
            self.lines.append("")
        self.line, self.filled, self.space = [], False, False

    def block(self, gap: int) -> None:
        if self.filled:
            self.newline()
        self.gap, self.space = max(self.gap, gap), False

    def done(self) -> str:
        self.block(1)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


def _number(value: str | None, least: int, most: int) -> int:
    m = re.match(r"\s*(-?\d{1,6})", value or "")
    return min(max(int(m[1]), least), most) if m else least


def _grid(table: Node) -> tuple[list[str], list[list[tuple[int, int, list[str]]]]]:
    """Captions, and rows of (column, columns spanned, lines of the cell); cells that span rows keep their columns free below."""
    captions, rows, stack, busy = [], [], [iter(table.children)], {}
    while stack:
        node = next(stack[-1], None)
        if node is None:
            stack.pop()
        elif isinstance(node, str):
            if node.strip() and table.visible:
                captions.append(" ".join(node.split()))
        elif not node.shown or node.tag in ("colgroup", "col"):
            continue
        elif node.tag in SECTIONS:
            stack.append(iter(node.children))
        elif node.tag == "tr":
            row, column = [], 0
            for cell in node.children:
                if isinstance(cell, str):
                    if not cell.strip():
                        continue
                    loose = Node("td", {})
                    loose.visible = node.visible
                    loose.children.append(cell)
                    cell = loose
                if not cell.shown:
                    continue
                while busy.get(column, 0):
                    column += 1
                lines = render(cell).split("\n")
                wide = _number(cell.attributes.get("colspan"), 1, 1000)
                tall = _number(cell.attributes.get("rowspan"), 1, 10_000)
                row.append((column, wide, lines))
                for c in range(column, column + wide):
                    busy[c] = tall
                column += wide
            rows.append(row)
            busy = {c: n - 1 for c, n in busy.items() if n > 1}
        else:
            shown = render(node)
            if shown:
                captions += shown.split("\n")
    return captions, rows


def _table(table: Node) -> list[str]:
    """Lines of a table: columns as wide as their widest cell, two spaces between them.

    A cell over several columns pushes no column apart; where it runs into the
    next cell, that one follows after two spaces.
    """
    lines, rows = _grid(table)
    width: dict[int, int] = {}
    for row in rows:
        for column, wide, cell in row:
            if wide == 1:
                width[column] = max([width.get(column, 0), *map(columns_of, cell)])
    begins, at = {}, 0
    for c in sorted(width.keys() | {column for row in rows for column, _, _ in row}):
        begins[c] = at
        at += width.get(c, 0) + (2 if width.get(c, 0) else 0)
    for row in rows:
        for k in range(max((len(cell) for _, _, cell in row), default=0)):
            out, at = [], 0
            for column, _, cell in row:
                if k < len(cell) and cell[k]:
                    pad = begins[column] - at if at <= begins[column] else 2
                    out += " " * pad, cell[k]
                    at += pad + columns_of(cell[k])
            lines.append("".join(out).rstrip())
    return lines


_INLINE = frozenset("inline inline-block inline-flex inline-grid contents".split())
_BLOCK = frozenset("block flex grid list-item flow-root".split())


def render(root: Node) -> str:
    """A tree's visible text; tables in it have their lines already."""
    flow = Flow()
    stack: list[tuple] = [("in", root, root.visible)]
    counters: list[int | None] = []
    while stack:
        what, node, seen = stack.pop()
        if isinstance(node, str):
            if seen:
                flow.text(node)
            continue
        tag = node.tag
        blocky = (tag in BLOCKS or tag in ("tr", "caption") or node.display in _BLOCK) and node.display not in _INLINE
        if what == "in":
            if node is not root and not node.shown:
                continue
            seen = node.visible
            if tag == "br":
                flow.newline()
                continue
            if tag == "wbr":
                continue
            if tag == "input":
                if seen and node.attributes.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number"):
                    flow.text(" " + node.attributes.get("value", "") + " ")
                continue
            if node.lines is not None and node is not root:
                flow.block(2)
                flow.pre += 1
                for k, line in enumerate(node.lines):
                    if k:
                        flow.newline()
                    flow.text(line)
                flow.pre -= 1
                flow.block(2)
                continue
            if blocky:
                # A list inside a list, and a paragraph that begins an item, stand close.
                flow.block(2 if tag in SPACED and not (tag in LISTS and counters) and not flow.marker else 1)
            elif tag in CELLS and node is not root:
                flow.text(" ")
            if tag in LISTS:
                counters.append(_number(node.attributes.get("start", "1"), -999_999, 999_999) if tag == "ol" else None)
            elif tag == "li":
                if counters and counters[-1] is not None:
                    if "value" in node.attributes:
                        counters[-1] = _number(node.attributes["value"], -999_999, 999_999)
                    mark = f"{counters[-1]}. "
                    counters[-1] += 1
                else:
                    mark = "- "
                flow.indent(" " * len(mark) if blocky else "")
                flow.marker = mark if seen and blocky else ""
            elif tag in ("dd", "blockquote"):
                flow.indent("  ")
            elif tag in ("pre", "listing", "textarea", "xmp"):
                flow.pre += 1
            elif tag == "q" and seen:
                flow.text("“")
            children = node.children
            if tag == "details" and "open" not in node.attributes:
                children = [c for c in children if not isinstance(c, str) and c.tag == "summary"][:1]
            if tag in ("pre", "listing", "textarea") and children and isinstance(children[0], str):
                first = children[0][1:] if children[0].startswith("\n") else children[0]
                children = [first, *children[1:]]
            stack.append(("out", node, seen))
            stack.extend(("in", c, seen) for c in reversed(children))
            continue
        if tag in LISTS:
            counters.pop()
        elif tag == "li":
            flow.indents.pop()
            if blocky:
                flow.block(1)
            flow.marker = ""
        elif tag in ("dd", "blockquote"):
            flow.block(1)
            flow.indents.pop()
        elif tag in ("pre", "listing", "textarea", "xmp"):
            flow.pre -= 1
        elif tag == "q" and seen:
            flow.text("”")
        if blocky:
            flow.block(2 if tag in SPACED and not (tag in LISTS and counters) else 1)
    return flow.done()


def text_of(page: str | None) -> str:
    """A page's visible text; null and empty pages have none."""
    if not page:
        return ""
    root, tables = parse(page.replace("\0", "\ufffd"))
    for table in reversed(tables):
        table.lines = _table(table)
    return render(root)


def extract_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_chars) for each page, whole.

    A null or empty html has an empty text.  Ids may be null or repeat; each row
    is rendered, in time that grows with the page; a table's lines are as wide as
    its widest cells, however wide.  An empty table gives an empty one.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1000):
                texts = [text_of(x) for x in batch.column("html").slice(a, 1000).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(a, 1000), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, text string, n_chars long")
