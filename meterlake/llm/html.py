"""Layout-aware rendering of HTML as text.

A tokenizer and tree builder yield properly nested events, with the end tags
that HTML lets authors leave out put in, and rows and cells placed in tables.  A
renderer walks them with explicit stacks (no recursion, whatever the depth) and emits all
visible text: blocks on lines of their own, paragraphs, lists, tables and
headings set apart by an empty line, list items marked and indented, table cells
in aligned columns, preformatted text as it is.  What a reader of the page
doesn't see is left out (of drawings and formulas their text elements, foreign
objects and symbols are seen; what ``use`` draws again isn't repeated): the head, scripts and styles, templates, comments,
elements hidden by attribute, by inline style or by the plain rules of the page's
own style sheets as they apply to a screen, closed details and dialogs, and all options of a list but the selected one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
BLOCKS = CLOSES_P | frozenset("html body caption legend optgroup option td th tr tbody thead tfoot".split())
MARGINS = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNSEEN = frozenset("head script style template title datalist audio video canvas object iframe noembed noframes".split())
SECTIONS = frozenset("tbody thead tfoot".split())
#: Inside svg and math: what isn't drawn, what holds HTML again, the HTML that ends them, and parts of formulas that stand apart.
UNDRAWN = frozenset("defs symbol desc metadata title clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml mphantom".split())
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
ENDS_DRAWING = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
APART = frozenset("mfrac msup msub msubsup munder mover munderover mroot mtable mtr".split())
CELLS = frozenset("td th".split())

#: What a start tag ends, and the elements beyond which it ends nothing.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu table td th".split())),
    "dt": (frozenset("dt dd".split()), frozenset("dl table td th".split())),
    "dd": (frozenset("dt dd".split()), frozenset("dl table td th".split())),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "td": (CELLS, frozenset("tr table".split())),
    "th": (CELLS, frozenset("tr table".split())),
    "tr": (frozenset("tr caption".split()), frozenset(["table"])),
    "tbody": (SECTIONS | {"caption", "tr"}, frozenset(["table"])),
    "thead": (SECTIONS | {"caption", "tr"}, frozenset(["table"])),
    "tfoot": (SECTIONS | {"caption", "tr"}, frozenset(["table"])),
    "caption": (SECTIONS | {"caption", "tr"}, frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset(["body"])),
}
P_SCOPE = frozenset("table td th caption button html".split())
END_SCOPE = frozenset("table td th caption".split())
#: Open elements at most; what lies deeper has no layout of its own, as in browsers.
DEEPEST = 512
#: The screen that pages are seen on, in CSS pixels, and what else its media queries may ask; what isn't listed is not known.
SCREEN = {"width": 1280.0, "height": 720.0}
UNITS = {None: 1.0, "px": 1.0, "em": 16.0, "rem": 16.0, "pt": 4 / 3, "cm": 96 / 2.54, "in": 96.0}
FEATURES = {
    "orientation:landscape": True, "orientation:portrait": False, "prefers-color-scheme:light": True, "prefers-color-scheme:dark": False,
    "prefers-reduced-motion:no-preference": True, "prefers-reduced-motion:reduce": False, "prefers-reduced-motion": False, "hover": True, "hover:hover": True, "hover:none": False,
    "pointer": True, "pointer:fine": True, "pointer:coarse": False, "pointer:none": False, "any-hover:hover": True, "any-pointer:fine": True, "color": True, "monochrome": False, "grid": False,
}
#: Valid values of ``display`` by their first word, and of ``visibility``.
VALUES = {
    "display": frozenset("none block inline inline-block flex inline-flex grid inline-grid flow flow-root contents list-item run-in ruby math table inline-table table-row table-cell table-caption table-column table-column-group table-row-group table-header-group table-footer-group -webkit-box -webkit-inline-box -webkit-flex -webkit-inline-flex inherit initial unset revert revert-layer".split()),
    "visibility": frozenset("visible hidden collapse inherit initial unset revert revert-layer".split()),
}
#: Padding that a table's alignment may cost, as a multiple of its text and as a number of characters; beyond it columns are padded to ``WIDEST``.
PADDING, LEAST_PADDING, WIDEST = 8, 10_000, 60

_OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNQUOTED = re.compile(r"/[^\s\"'>=]*\s*=")  # of reversed text
_SPACES = re.compile(r"[ \t\n\r\f]+")
_CSS = re.compile(r"""/\*.*?(?:\*/|\Z)|<!--|-->|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|url\([^)"']{0,256}\)|\\.|[{};]|(?:(?!url\(|<!--|-->|/\*)[^{};"'\\])+|\\""", re.S | re.I)
_STYLE = re.compile(r"<style", re.I)
_MEDIUM = re.compile(r"(?:(not|only) )?([a-z][-a-z]*)(?: and |$)")
_LENGTH = r"([\d.]+)(px|em|rem|pt|cm|in)?"
_EXTENT = re.compile(rf"\( ?(?:(min-|max-)?(?:device-)?(width|height) ?: ?{_LENGTH}|(?:{_LENGTH} ?(<=?|>=?) ?)?(width|height)(?: ?(<=?|>=?|=) ?{_LENGTH})?) ?\)")
_SIMPLE = re.compile(r"^([a-zA-Z][a-zA-Z0-9]*)?([.#][-\w]+)?$")

Event = tuple[str, str, dict[str, str]]


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def _next_token(page: str, at: int, lacks: set[str]) -> tuple[int, int, str, str, str] | None:
    """The next tag, comment or declaration from ``at`` on: start, end, and the name of an end tag, or name and
    attributes of a start tag.  None if there is none.

    A quoted value may hold ``>``.  ``lacks`` remembers quotes that don't end any more, so that no part of a page is searched
    again and again; a tag that has no end even then takes the rest of the page, as in browsers.
    """
    m = _OPEN.search(page, at)
    if m is None:
        return None
    start, sign = m.start(), m[0]
    if sign == "<!--":
        close = _COMMENT_END.search(page, start + 4)
        return start, close.end() if close else len(page), "", "", ""
    if sign in ("<!", "<?"):
        return start, page.find(">", start + 2) + 1 or len(page), "", "", ""
    name = _NAME.match(page, m.end() - 1)
    if sign[1] == "/":
        return start, page.find(">", name.end()) + 1 or len(page), name[0], "", ""
    position = name.end()
    while True:
        stop = _STOP.search(page, position)
        if stop is None:
            if len(lacks) == 2:
                return start, len(page), "", "", ""
            lacks.update("\"'")
            position = name.end()
        elif stop[0] == ">":
            return start, stop.end(), "", name[0], page[name.end() : stop.start()]
        else:
            position, before = stop.end(), stop.start() - 1
            while before >= name.end() and page[before].isspace():
                before -= 1
            if stop[0] not in lacks and before >= name.end() and page[before] == "=":
                close = page.find(stop[0], position)
                if close < 0:
                    lacks.add(stop[0])
                else:
                    position = close + 1


def events(page: str) -> Iterator[Event]:
    """Nested ("open", tag, attributes), ("close", tag, {}), ("text", text, {}) and ("raw", content, {}) events of a page.

    An element beyond ``DEEPEST`` is closed at once; ("within", tag, attributes) and ("without", tag, {}) events enclose its content.
    """
    stack: list[str] = []
    deep: list[str] = []  # open elements beyond the deepest of the stack
    counts: Counter[str] = Counter()  # of them
    at, size, lower, lacks = 0, len(page), None, set()

    def rise(position: int) -> Iterator[Event]:
        while len(deep) > position:
            counts[deep[-1]] -= 1
            yield "without", deep.pop(), {}

    def ended(wanted: frozenset[str], stop: frozenset[str] = frozenset()) -> Iterator[Event]:
        """End the innermost wanted element among the deep ones near the end."""
        if deep and any(counts[t] for t in wanted):
            for i in range(len(deep) - 1, max(len(deep) - DEEPEST, 0) - 1, -1):
                if deep[i] in wanted:
                    yield from rise(i)
                    break
                if deep[i] in stop:
                    break

    def pop_to(position: int) -> Iterator[Event]:
        yield from rise(0)
        while len(stack) > position:
            yield "close", stack.pop(), {}

    def find(wanted: frozenset[str] | set[str], stop: frozenset[str]) -> int:
        """Position of the outermost wanted element that is open inside ``stop``; -1: none."""
        found = -1
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] in wanted:
                found = i
            elif stack[i] in stop:
                break
        return found

    while at < size:
        found = _next_token(page, at, lacks)
        if found is None:
            yield "text", unescape(page[at:]), {}
            break
        start, end, ends, begins, rest = found
        if start > at:
            yield "text", unescape(page[at:start]), {}
        at = end
        if ends:
            tag = ends.lower()
            if tag == "br":
                yield "open", "br", {}
                yield "close", "br", {}
            elif counts[tag]:
                while deep[-1] != tag:
                    yield from rise(len(deep) - 1)
                yield from rise(len(deep) - 1)
            elif tag in HEADINGS:
                i = find(HEADINGS, END_SCOPE)
                yield from pop_to(i) if i >= 0 else ()
            elif tag not in ("html", "body"):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i] == tag:
                        yield from pop_to(i)
                        break
                    if stack[i] in END_SCOPE and tag not in ("table", "tr", *SECTIONS):
                        break
                    if stack[i] == "table":
                        break
        elif begins:
            tag, attributes = begins.lower(), _attributes(rest) if rest else {}
            drawing = next((i for i in range(len(stack) - 1, -1, -1) if stack[i] in ("svg", "math") or stack[i] in HOLDS_HTML), -1) if "svg" in stack or "math" in stack else -1
            if drawing >= 0 and stack[drawing] in HOLDS_HTML:
                drawing = -1
            if drawing >= 0 and tag in ENDS_DRAWING:
                yield from pop_to(drawing)
                drawing = -1
            if drawing >= 0 or (tag in ("svg", "math") and rest):
                if rest.endswith("/") and not _UNQUOTED.match(rest[::-1]):
                    yield "open", tag, attributes
                    yield "close", tag, {}
                    continue
            if deep and drawing < 0:
                if tag in CLOSES_P:
                    yield from ended(frozenset(["p"]), P_SCOPE)
                if tag in ENDS:
                    yield from ended(*ENDS[tag])
            if tag in CLOSES_P and "p" in stack:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i] == "p":
                        yield from pop_to(i)
                        break
                    if stack[i] in P_SCOPE:
                        break
            if tag in ENDS:
                i = find(*ENDS[tag])
                if i >= 0:
                    yield from pop_to(i)
            elif tag in HEADINGS and stack and stack[-1] in HEADINGS:
                yield from pop_to(len(stack) - 1)
            if tag in CELLS or tag == "tr" or tag in SECTIONS or tag == "caption":
                if "table" not in stack:
                    continue  # outside a table these tags mean nothing
                if tag in CELLS and find(frozenset(["tr"]), frozenset(["table"])) < 0:
                    stack.append("tr")
                    yield "open", "tr", {}
            if tag in ("html", "body") and tag in stack:
                continue
            if "head" in stack and tag not in VOID and tag not in RAW and tag not in ("template", "noscript", "head"):
                yield from pop_to(stack.index("head"))  # content begins
            yield "open", tag, attributes
            if tag in VOID:
                yield "close", tag, {}
            elif tag in RAW and (drawing < 0 or tag in ("script", "style")):
                if lower is None:
                    lower = page.lower()
                    if len(lower) != size:
                        lower = re.sub("[A-Z]", lambda x: x[0].lower(), page)
                end = lower.find(f"</{tag}", at)
                while 0 <= end < size - len(tag) - 2 and lower[end + len(tag) + 2] not in " \t\n\r\f/>":
                    end = lower.find(f"</{tag}", end + 2)  # a longer name
                end = size if end < 0 else end
                yield "raw", page[at:end], {}
                yield "close", tag, {}
                close = page.find(">", end)
                at = size if close < 0 else close + 1
            elif len(stack) >= DEEPEST:
                yield "close", tag, {}
                deep.append(tag)
                counts[tag] += 1
                yield "within", tag, attributes
            else:
                stack.append(tag)
    yield from pop_to(0)


class _Flow:
    """Lines of text under construction."""

    __slots__ = ("gap", "indent", "lines", "marker", "pending", "piece")

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.piece: list[str] = []
        self.gap, self.pending, self.marker, self.indent = 0, False, "", ""

    def text(self, words: str) -> None:
        words = _SPACES.sub(" ", words)
        if words[:1] == " ":
            self.pending, words = True, words[1:]
        if not words:
            return
        tail = words[-1] == " "
        if self.piece and self.pending:
            self.piece.append(" ")
        self.piece.append(words[:-1] if tail else words)
        self.pending = tail

    def end_line(self) -> None:
        self.pending = False
        if self.piece:
            self.line("".join(self.piece))
            self.piece = []

    def line(self, content: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = 0
        self.lines.append((self.indent + self.marker + content.replace("\xa0", " ")).rstrip())
        if self.marker:
            self.indent, self.marker = self.indent + " " * len(self.marker), ""

    def block(self, margin: bool) -> None:
        self.end_line()
        self.gap |= margin

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


Cell = tuple[list[str], int, int]  # lines, columns, rows


def _table(rows: list[list[Cell]]) -> Iterator[str]:
    """Lines of a table: columns as wide as their widest line, two spaces apart; cells keep their columns beside those that span rows."""
    placed: list[list[tuple[int, Cell]]] = []
    taken: dict[int, int] = {}  # columns that cells of rows above reach into, and for how many rows more
    wide: dict[int, int] = {}
    for row in rows:
        column, own, reach = 0, [], {}
        for cell in row:
            while taken.get(column):
                column += 1
            own.append((column, cell))
            if cell[1] == 1:
                wide[column] = max(wide.get(column, 0), max(map(len, cell[0]), default=0))
            if cell[2] > 1:
                reach |= dict.fromkeys(range(column, column + cell[1]), cell[2] - 1)
            column += cell[1]
        placed.append(own)
        taken = {c: n - 1 for c, n in taken.items() if n > 1} | reach
    columns = max(wide, default=-1) + 1

    def edges(most: int | None) -> list[int]:
        out = [0]
        for c in range(columns):
            width = wide.get(c, 0)
            out.append(out[-1] + (width if most is None else min(width, most)) + 2)
        return out

    edge = edges(None)
    text = sum(len(line) for row in rows for lines, _, _ in row for line in lines)
    if sum(edge[min(own[-1][0], columns)] * max(len(lines) for _, (lines, _, _) in own) for own in placed if own) > PADDING * text + LEAST_PADDING:
        edge = edges(WIDEST)
    for own in placed:
        for k in range(max((len(lines) for _, (lines, _, _) in own), default=0)):
            out = ""
            for column, (lines, _, _) in own:
                if k < len(lines) and lines[k]:
                    out = out.ljust(edge[min(column, columns)])
                    out += ("  " if out and not out.endswith("  ") else "") + lines[k]
            yield out.rstrip()


def _span(attributes: dict[str, str], name: str, most: int) -> int:
    value = attributes.get(name, "1")
    return min(max(int(value), 1), most) if value.isascii() and value.isdigit() and len(value) < 6 else 1


class _Rules(dict[str, dict[str, tuple]]):
    """By selector and property: the rank of the winning rule, and its value."""

    count = 0


def _compared(a: float, sign: str, b: float) -> bool:
    return a < b if sign == "<" else a <= b if sign == "<=" else a > b if sign == ">" else a >= b if sign == ">=" else a == b


def _feature(text: str) -> bool | None:
    """Whether the screen has a feature; None: not known."""
    m = _EXTENT.fullmatch(text)
    if m is None:
        return FEATURES.get(re.sub(r"[() ]", "", text)) if text[:1] == "(" and text[-1:] == ")" and text.count("(") == 1 else None
    try:
        if m[2]:
            return _compared(SCREEN[m[2]], {"min-": ">=", "max-": "<=", None: "="}[m[1]], float(m[3]) * UNITS[m[4]])
        if m[5] and not _compared(float(m[5]) * UNITS[m[6]], m[7], SCREEN[m[8]]):
            return False
        return not m[9] or _compared(SCREEN[m[8]], m[9], float(m[10]) * UNITS[m[11]])
    except ValueError:
        return None


def _on_screen(media: str) -> bool:
    """Whether a list of media queries surely applies to the screen."""
    for query in media.lower().split(",") if media.strip() else ():
        query = " ".join(query.split())
        m = _MEDIUM.match(query)
        if m:
            turned, answers, rest = m[1] == "not", [m[2] in ("screen", "all")], query[m.end() :]
        else:
            turned, answers, rest = query[:4] == "not ", [], query.removeprefix("not ")
        if rest and " or " in rest:
            parts = [_feature(p) for p in rest.split(" or ")]
            answers.append(True if True in parts else None if None in parts else False)
        elif rest or not m:
            answers += [_feature(p) for p in rest.split(" and ")]
        answer = False if False in answers else None if None in answers else True
        if answer is not None and answer != turned:
            return True
    return not media.strip()


def _declared(text: str) -> tuple[str, str, bool] | None:
    """Property, value and importance of a valid declaration of display or visibility."""
    name, _, value = text.partition(":")
    name, value = name.strip().lower(), value.strip().lower()
    important = value.endswith("!important") or value.endswith("! important")
    value = value.rpartition("!")[0].strip() if important else value
    return (name, value, important) if name in VALUES and value and value.split()[0] in VALUES[name] else None


def _inline(style: str) -> Iterator[tuple[str, str, bool]]:
    return filter(None, map(_declared, re.sub(r"/\*.*?(?:\*/|\Z)", "", style, flags=re.S).split(";")))


def _add_rules(sheet: str, rules: _Rules) -> None:
    """Add what the plain rules of a style sheet say on the screen."""
    # of each open block: selectors (None: not in a rule), whether it applies, whether in a layer
    stack: list[tuple[list[str] | None, bool, bool]] = [(None, True, False)]
    piece: list[str] = []

    def declare() -> None:
        selectors, applies, layered = stack[-1]
        found = _declared("".join(piece)) if selectors and applies else None
        if found:
            name, value, important = found
            for s in selectors:
                own = rules.setdefault(s, {})
                rank = (important, layered == important, "#" in s, "." in s, s[0] not in "#.", rules.count)
                if name not in own or rank > own[name][0]:
                    own[name] = (rank, value)
            rules.count += 1

    for token in _CSS.findall(sheet):
        selectors, applies, layered = stack[-1]
        if token[:2] == "/*" or token in ("<!--", "-->"):
            continue
        if token == "{":
            prelude, piece = "".join(piece).strip(), []
            at = re.match(r"@([-\w]+)(.*)", prelude, re.S)
            if at:
                kind = at[1].lower()
                applies = applies and (_on_screen(at[2]) if kind == "media" else not re.search(r"\bnot\b", at[2].lower()) if kind == "supports" else kind == "layer")
                stack.append((selectors, applies, layered or kind == "layer"))
            elif selectors is None:
                names = [s.strip() for s in prelude.split(",")]
                valid = all(names) and not set(prelude) & set(";}")  # one that isn't makes the whole rule void
                simple = [_SIMPLE.match(s) for s in names] if valid else []
                stack.append(([(m[1] or "").lower() + (m[2] or "") for m in simple if m], applies, layered))
            else:
                stack.append(([], applies, layered))  # a nested rule isn't a plain one
        elif token == "}" and len(stack) > 1:
            declare()
            stack.pop()
            piece = []
        elif token == ";" and (selectors is not None or next((t.lstrip()[0] for t in piece if t.strip()), "") == "@"):
            declare()
            piece = []
        else:
            piece.append(token)
    declare()


def _sheets(found: list[Event]) -> _Rules:
    """The rules of all style sheets of a page, wherever they stand."""
    rules = _Rules()
    inert, media = 0, None
    for kind, name, attributes in found:
        if kind == "open":
            inert += name == "template"
            media = attributes.get("media", "") if name == "style" else None
        elif kind == "close":
            inert -= name == "template"
        elif kind == "raw" and media is not None and not inert and _on_screen(media):
            _add_rules(name, rules)
    return rules


def _said(name: str, attributes: dict[str, str], rules: _Rules, style: str) -> dict[str, str]:
    """Display and visibility of an element as its own style and the page's plain rules say, by importance, specificity and order."""
    best: dict[str, tuple] = {}
    if rules:
        tests = {name, *(f"{p}.{c}" for c in attributes.get("class", "").split() for p in ("", name)), *(f"{p}#{attributes['id']}" for p in ("", name) if "id" in attributes)}
        for t in tests & rules.keys():
            for key, own in rules[t].items():
                best[key] = max(best.get(key, own), own)
    for key, value, important in _inline(style):
        if key not in best or important or not best[key][0][0]:
            own = ((important, True, True, True, True, float("inf")), value)
            if key not in best or own[0] >= best[key][0]:
                best[key] = own
    return {key: value for key, (_, value) in best.items()}


def render(page: str | None) -> str:
    """All visible text of a page."""
    if not page:
        return ""
    found = events(page)
    rules = _Rules()
    if _STYLE.search(page):
        found = list(found)
        rules = _sheets(found)
    flow, flows = _Flow(), []
    tables: list[list[list[Cell]]] = []
    # of each open element: tag, not displayed, hidden, what to undo at its end, and whether text is drawn (None: not inside svg)
    stack: list[tuple] = []
    pre = 0
    lists: list[int | None] = []
    select: list[list[tuple[bool, str]]] = []
    for kind, name, attributes in found:
        gone, unseen, drawn = (stack[-1][1], stack[-1][2], stack[-1][4]) if stack else (False, False, None)
        if kind == "text":
            if gone or unseen or drawn is False or (stack and stack[-1][3] == "closed"):
                continue
            if stack and (stack[-1][0] == "table" or stack[-1][0] in SECTIONS or stack[-1][0] == "tr"):
                if not name.strip():
                    continue
                flow.text(name)  # stands before the table
            elif pre:
                first, *rest = name.replace("\r\n", "\n").split("\n")
                flow.piece.append(first)
                for line in rest:
                    flow.line("".join(flow.piece))
                    flow.piece = [line]
            else:
                flow.text(name)
        elif kind == "raw":
            if stack[-1][0] in ("textarea", "xmp") and not (gone or unseen or drawn is False):
                flow.text(unescape(name) if stack[-1][0] == "textarea" else name)
        elif kind == "without":
            if not stack.pop()[1] and name in BLOCKS:
                flow.block(False)
        elif kind in ("open", "within"):
            style = attributes.get("style", "")
            said = _said(name, attributes, rules, style) if rules or style else {}
            own_gone = gone or name in UNSEEN or (name == "input" and attributes.get("type", "").lower() == "hidden")
            if not own_gone and stack and stack[-1][0] == "details" and stack[-1][3] == "closed" and name != "summary":
                own_gone = True
            if name == "svg":
                drawn = False
            elif drawn is not None:
                own_gone = own_gone or name in UNDRAWN or ("display" not in said and attributes.get("display") == "none")
                if attributes.get("visibility") in VALUES["visibility"]:
                    said.setdefault("visibility", attributes["visibility"])
                drawn = drawn or name in ("text", "foreignobject")
            elif name in UNDRAWN and any(s[0] == "math" for s in stack):
                own_gone = True
            if "display" in said:
                own_gone = own_gone or said["display"] == "none"
            else:
                own_gone = own_gone or "hidden" in attributes or (name == "dialog" and "open" not in attributes)
            if said.get("visibility") in ("hidden", "collapse"):
                unseen = True
            elif said.get("visibility") in ("visible", "initial"):
                unseen = False
            undo = None
            if name == "details" and "open" not in attributes:
                undo = "closed"
            if kind == "within":
                stack.append(("" if name == "table" or name in SECTIONS or name == "tr" else name, own_gone, unseen, undo, drawn))
                continue
            if not own_gone:
                if (drawn and name == "text") or (stack and stack[-1][0] in APART):
                    flow.pending = True
                if name == "br":
                    if flow.piece or pre:
                        flow.line("".join(flow.piece))
                        flow.piece, flow.pending = [], False
                elif name in CELLS or name == "caption":
                    flows.append(flow)
                    flow, undo = _Flow(), (pre, lists, _span(attributes, "colspan", 1000), _span(attributes, "rowspan", 65_534))
                    pre, lists = 0, []
                elif name == "table":
                    flow.block(True)
                    tables.append([])
                elif name == "tr":
                    if tables:
                        tables[-1].append([])
                elif name in BLOCKS:
                    flow.block(name in MARGINS and not (name in ("ul", "ol", "menu") and lists))
                    if name in ("ul", "ol", "menu"):
                        start = attributes.get("start", "1")
                        lists.append(int(start) if name == "ol" and start.isascii() and start.isdigit() and len(start) < 10 else 1 if name == "ol" else None)
                    elif name == "li":
                        undo = (flow.indent, flow.marker)
                        if flow.marker:
                            flow.indent += " " * len(flow.marker)
                        number = lists[-1] if lists else None
                        flow.marker = "- " if number is None else f"{number}. "
                        if number is not None:
                            lists[-1] = number + 1
                    elif name in ("blockquote", "dd"):
                        undo = (flow.indent, flow.marker)
                        flow.indent += "  "
                    elif name == "pre":
                        pre += 1
                    elif name == "option":
                        undo = "selected" in attributes
                elif name == "select":
                    flows.append(flow)
                    flow = _Flow()
                    select.append([])
            stack.append((name, own_gone, unseen, undo, drawn))
        else:
            tag, own_gone, _, undo, drawn = stack.pop()
            if own_gone:
                continue
            if drawn and tag == "text":
                flow.pending = True
            if tag in CELLS:
                lines, flow = flow.done(), flows.pop()
                pre, lists, columns, rows = undo
                if tables:
                    if not tables[-1]:
                        tables[-1].append([])
                    tables[-1][-1].append((lines, columns, rows))
            elif tag == "caption":
                lines, flow = flow.done(), flows.pop()
                pre, lists, *_ = undo
                for line in lines:
                    flow.line(line)
            elif tag == "table":
                flow.end_line()
                for line in _table(tables.pop()):
                    flow.line(line)
                flow.block(True)
            elif tag in BLOCKS and tag not in ("tr", *SECTIONS):
                if tag == "pre":
                    pre -= 1
                    while flow.piece and not flow.piece[-1].strip():
                        flow.piece.pop()
                flow.end_line()
                if tag == "option" and select:
                    select[-1].append((undo, " ".join(flow.lines)))
                    flow.lines = []
                if tag in ("li", "blockquote", "dd"):
                    flow.indent, flow.marker = undo
                elif tag in ("ul", "ol", "menu"):
                    lists.pop()
                flow.block(tag in MARGINS and not (tag in ("ul", "ol", "menu") and lists))
            elif tag == "select":
                flow, options = flows.pop(), select.pop()
                shown = [text for chosen, text in options if chosen][-1:] or [text for _, text in options[:1]]
                flow.text(" ".join(shown))
    return "\n".join(flow.done())


def rendered(pages: DataFrame) -> DataFrame:
    """``page_id, text``: the visible text of each page, one row per input row.

    Inputs ``page_id`` and ``html``, others are ignored.  A null page has a
    null text, an empty one or one without visible text an empty text.  An
    empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if h is None else render(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["page_id", "text"])

    arrow_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, "page_id long, text string")
