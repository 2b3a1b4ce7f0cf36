"""Links of a Markdown text (the CommonMark grammar, without extensions), with their places in the source.

Two phases. ``_Blocks`` builds the tree of blocks line by line: quotes and list items hold others; code (indented or
fenced) and HTML blocks hold no links; paragraphs and headings leave their lines, each with its place, to the second
phase; a paragraph's first lines may be definitions. ``_inline`` then goes over such lines once, with a stack of open
brackets: escapes, code spans, autolinks and tags are stepped over; a closing bracket makes a link or an image of what
follows it or of a definition; a link switches off the brackets that were open around it, as links hold no links.

Destinations keep their place (without angle brackets), so that rewriting leaves all other bytes alone."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass, field

_PUNCTUATION = re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_ESCAPED = re.compile(rf"\\([{_PUNCTUATION}])|(&(?:#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z][A-Za-z0-9]*);)")
_FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
_RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_TICKS = re.compile(r"`+")
_UNDERLINE = re.compile(r"(?:=+|-+)[ \t]*$")
_HEADING = re.compile(r"#{1,6}(?:[ \t]+|$)")
_ITEM = re.compile(r"(?:[-+*]|([0-9]{1,9})[.)])(?=[ \t]|$)")
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\x00-\x20<>]*)>")
_MAIL = re.compile(r"<[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*>")
_ATTRIBUTE = r"""(?:\s+[A-Za-z_:][A-Za-z0-9_.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)"""
_TAG = rf"<[A-Za-z][A-Za-z0-9-]*{_ATTRIBUTE}*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>"
_RAW = re.compile(rf"{_TAG}|<!---?>|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
# Tags that begin an HTML block (the grammar's own list).
_BLOCK_TAGS = """address article aside base basefont blockquote body caption center col colgroup dd details dialog dir
div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link
main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr
track ul""".split()
#: How an HTML block begins and what ends it; null ends at a blank line. The last kind cannot interrupt a paragraph.
_HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{'|'.join(_BLOCK_TAGS)})(?:[\s>]|/>|$)", re.I), None),
    (re.compile(rf"(?:{_TAG})[ \t]*$"), None),
]


@dataclass(frozen=True)
class Link:
    """``dest`` is the destination's value; ``start`` and ``end`` its place, or that of the definition it comes from."""

    kind: str  # link, image or auto
    at: int
    dest: str
    start: int
    end: int
    label: str | None = None


def unescaped(raw: str) -> str:
    """A destination's value: backslashes before punctuation go, entities become their characters."""
    return _ESCAPED.sub(lambda m: m[1] or html.unescape(m[2]), raw)


def label_of(text: str) -> str:
    return " ".join(text.split()).casefold()


def _destination(text: str, i: int) -> tuple[int, int, int] | None:
    """(start, end, where to go on) of a destination at ``i``."""
    if text[i : i + 1] == "<":
        j = i + 1
        while j < len(text) and text[j] not in "<>\n":
            j += 2 if text[j] == "\\" and text[j + 1 : j + 2] != "\n" else 1
        return (i + 1, j, j + 1) if text[j : j + 1] == ">" else None
    j, depth = i, 0
    while j < len(text) and text[j] > " " and text[j] != "\x7f":
        if text[j] == "\\" and j + 1 < len(text) and text[j + 1] > " ":
            j += 2
            continue
        if text[j] == "(":
            depth += 1
        elif text[j] == ")":
            if not depth:
                break
            depth -= 1
        j += 1
    return None if depth else (i, j, j)


def _title(text: str, i: int) -> int | None:
    """Where a title at ``i`` ends, or null where there is none."""
    close = {'"': '"', "'": "'", "(": ")"}.get(text[i : i + 1])
    if close is None:
        return None
    j = i + 1
    while j < len(text) and text[j] != close:
        if close == ")" and text[j] == "(":
            return None
        j += 2 if text[j] == "\\" else 1
    return j + 1 if j < len(text) else None


def _blank(text: str, i: int) -> int:
    while i < len(text) and text[i] in " \t\n":
        i += 1
    return i


def _label(text: str, i: int) -> int | None:
    """Where the label whose bracket opens at ``i`` closes, or null where it is none."""
    j = i + 1
    while j < len(text) and text[j] not in "[]":
        j += 2 if text[j] == "\\" else 1
    return j if text[j : j + 1] == "]" and j - i <= 1000 and text[i + 1 : j].strip() else None


@dataclass
class _Text:
    """Lines of a paragraph or heading, joined by line feeds, with each line's place in the source."""

    lines: list[str] = field(default_factory=list)
    places: list[int] = field(default_factory=list)

    def joined(self) -> tuple[str, list[tuple[int, int]]]:
        starts, at = [], 0
        for line, place in zip(self.lines, self.places, strict=True):
            starts.append((at, place))
            at += len(line) + 1
        return "\n".join(self.lines), starts


def _place(starts: list[tuple[int, int]], i: int) -> int:
    at, place = starts[bisect_right(starts, i, key=lambda s: s[0]) - 1]
    return place + i - at


@dataclass
class _Item:
    """A container: a quote, or a list item with the column its content begins at."""

    quote: bool
    indent: int = 0
    empty: bool = False


class _Blocks:
    def __init__(self, source: str) -> None:
        self.texts: list[tuple[str, list[tuple[int, int]]]] = []
        self.definitions: dict[str, tuple[str, int, int]] = {}
        self.holds: list[_Item] = []
        self.paragraph: _Text | None = None
        self.code: tuple[str, int] | None = None  # an open fence and its length
        self.html: re.Pattern | None | bool = False  # what ends an open HTML block; null for a blank line
        at = 0
        for line in source.split("\n"):
            self._line(line.removesuffix("\r"), at)
            at += len(line) + 1
        self._close()

    # a line is read with a place and a column, which differ after tabs
    def _indent(self) -> int:
        i, col = self.i, self.col
        while i < len(self.line) and self.line[i] in " \t":
            col += 4 - col % 4 if self.line[i] == "\t" else 1
            i += 1
        self.next, self.rest = i, self.line[i:]
        return col - self.col

    def _skip(self, columns: int) -> None:
        while columns > 0 and self.i < len(self.line):
            if self.line[self.i] == "\t" and 4 - self.col % 4 > columns:
                self.col += columns
                return
            wide = 4 - self.col % 4 if self.line[self.i] == "\t" else 1
            self.i, self.col, columns = self.i + 1, self.col + wide, columns - wide

    def _line(self, line: str, at: int) -> None:
        self.line, self.at, self.i, self.col = line, at, 0, 0
        held = self._continued()
        whole = held == len(self.holds)
        if whole and self._in_leaf():
            return
        lazy = self.paragraph is not None and not whole
        opened = False
        while True:
            indent = self._indent()
            if not self.rest:
                self._blank_line(held)
                return
            if indent >= 4 or not self._container(held, indent, lazy, opened):
                break
            held, opened, lazy = len(self.holds), True, False
        self._leaf(held, indent, lazy)

    def _continued(self) -> int:
        """How many of the open containers hold this line."""
        for k, own in enumerate(self.holds):
            indent = self._indent()
            if own.quote:
                if indent > 3 or not self.rest.startswith(">"):
                    return k
                self._skip(indent + 1)
                self._optional_blank()
            elif not self.rest:
                if own.empty:
                    return k
            elif indent >= own.indent:
                self._skip(own.indent)
            else:
                return k
        return len(self.holds)

    def _optional_blank(self) -> None:
        if self.line[self.i : self.i + 1] in (" ", "\t"):
            self._skip(1)

    def _in_leaf(self) -> bool:
        """Whether the line belongs to open code or HTML."""
        indent = self._indent()
        if self.code is not None:
            m = re.match(r"(`+|~+)[ \t]*$", self.rest)
            if indent < 4 and m and m[1][0] == self.code[0] and len(m[1]) >= self.code[1]:
                self.code = None
            return True
        if self.html is not False:
            if self.html is None and not self.rest:
                self.html = False
                return False
            if self.html is not None and self.html.search(self.rest):
                self.html = False
            return True
        return False

    def _blank_line(self, held: int) -> None:
        self._close()
        # a quote ends at a blank line; an item goes on, but not one that has begun with it
        for k in range(held, len(self.holds)):
            if self.holds[k].quote or self.holds[k].empty:
                del self.holds[k:]
                break

    def _drop(self, held: int) -> None:
        """Containers that do not hold the line end, and what is open in them."""
        if held < len(self.holds):
            self._close()
            del self.holds[held:]

    def _container(self, held: int, indent: int, lazy: bool, opened: bool) -> bool:
        if self.rest.startswith(">"):
            self._drop(held)
            self._close()
            self._skip(indent + 1)
            self._optional_blank()
            self.holds.append(_Item(True))
            return True
        m = _ITEM.match(self.rest)
        if not m or _RULE.match(self.rest):
            return False
        empty = not self.rest[m.end() :].strip()
        if self.paragraph is not None and held == len(self.holds) and not opened and (empty or m[1] not in (None, "1")):
            return False  # such an item cannot interrupt a paragraph
        if lazy and (empty or m[1] not in (None, "1")) and not any(not x.quote for x in self.holds[held:]):
            return False
        self._drop(held)
        self._close()
        self._skip(indent + m.end())
        after = self._indent()
        if empty or after > 4:
            after = 1
        self._skip(after)
        self.holds.append(_Item(False, indent + m.end() + after, empty))
        return True

    def _leaf(self, held: int, indent: int, lazy: bool) -> None:
        interrupts = self.paragraph is not None
        for own in self.holds[:held]:
            own.empty = False
        if indent >= 4:
            if interrupts:
                self._add()  # no code inside a paragraph
            else:
                self._drop(held)
            return
        if not lazy and interrupts and _UNDERLINE.match(self.rest) and held == len(self.holds):
            self._close(heading=True)
            return
        m = _HEADING.match(self.rest)
        if m:
            self._drop(held)
            self._close()
            text = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", self.rest[m.end() :])
            self.texts.append((text, [(0, self.at + self.next + m.end())]))
            return
        m = _FENCE.match(self.rest)
        if m:
            self._drop(held)
            self._close()
            mark = m[1] or m[3]
            self.code = (mark[0], len(mark))
            return
        if _RULE.match(self.rest):
            self._drop(held)
            self._close()
            return
        for begins, ends in _HTML[: 6 if interrupts else 7]:
            if begins.match(self.rest):
                self._drop(held)
                self._close()
                self.html = False if ends is not None and ends.search(self.rest, 2) else ends
                return
        if not interrupts:
            self._drop(held)
        self._add()

    def _add(self) -> None:
        if self.paragraph is None:
            self.paragraph = _Text()
        self.paragraph.lines.append(self.rest)
        self.paragraph.places.append(self.at + self.next)

    def _close(self, heading: bool = False) -> None:
        """Ends the open leaf; a paragraph's definitions are taken off first."""
        self.code, self.html = None, False
        own, self.paragraph = self.paragraph, None
        if own is None:
            return
        text, starts = own.joined()
        i = 0
        while text[i : i + 1] == "[" and (found := self._definition(text, i)):
            label, start, end, i = found
            self.definitions.setdefault(label, (text[start:end], _place(starts, start), _place(starts, end)))
        if i < len(text):
            self.texts.append((text[i:], [(max(s - i, 0), p + max(i - s, 0)) for k, (s, p) in enumerate(starts) if k + 1 == len(starts) or starts[k + 1][0] > i]))
        elif heading:
            self.paragraph = _Text([self.rest], [self.at + self.next])  # the underline is a paragraph of its own then

    @staticmethod
    def _definition(text: str, i: int) -> tuple[str, int, int, int] | None:
        """(label, place of the destination, where to go on) of a definition at ``i``."""
        j = _label(text, i)
        if j is None or text[j + 1 : j + 2] != ":":
            return None
        found = _destination(text, _blank(text, j + 2))
        if found is None:
            return None
        start, end, k = found
        if start == end and text[start - 1] != "<":
            return None
        line_end = re.compile(r"[ \t]*(?:\n|$)")
        t = _blank(text, k)
        if t > k and (after := _title(text, t)) is not None and (m := line_end.match(text, after)):
            return label_of(text[i + 1 : j]), start, end, m.end()
        m = line_end.match(text, k)
        return (label_of(text[i + 1 : j]), start, end, m.end()) if m else None


@dataclass
class _Open:
    at: int
    image: bool
    active: bool = True


def _inline(text: str, starts: list[tuple[int, int]], definitions: dict[str, tuple[str, int, int]]) -> list[Link]:
    found: list[Link] = []
    stack: list[_Open] = []
    unclosed: set[int] = set()  # lengths of runs of backticks that nothing closes any more
    i = 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            end = _TICKS.match(text, i).end()
            close = None if end - i in unclosed else next((m for m in _TICKS.finditer(text, end) if len(m[0]) == end - i), None)
            if close is None:
                unclosed.add(end - i)
            i = close.end() if close else end
        elif c == "<":
            m = _AUTOLINK.match(text, i)
            if m:
                found.append(Link("auto", _place(starts, i), m[1], _place(starts, m.start(1)), _place(starts, m.end(1) - 1) + 1))
            m = m or _MAIL.match(text, i) or _RAW.match(text, i)
            i = m.end() if m else i + 1
        elif c == "[" or c == "!" and text[i + 1 : i + 2] == "[":
            stack.append(_Open(i, c == "!"))
            i += 1 + (c == "!")
        elif c == "]" and stack:
            top = stack.pop()
            made = _closed(text, starts, definitions, top, i) if top.active else None
            i += 1
            if made is not None:
                link, i = made
                found.append(link)
                if not top.image:
                    for other in stack:
                        other.active = other.active and other.image
        else:
            i += 1
    return sorted(found, key=lambda x: x.at)


def _closed(text: str, starts: list, definitions: dict, top: _Open, i: int) -> tuple[Link, int] | None:
    """The link that the bracket at ``i`` closes, and where to go on."""
    kind, at = "image" if top.image else "link", _place(starts, top.at)
    if text[i + 1 : i + 2] == "(" and (dest := _destination(text, _blank(text, i + 2))):
        start, end, k = dest
        t = _blank(text, k)
        after = _title(text, t) if t > k else None
        t = _blank(text, after) if after is not None else t
        if text[t : t + 1] == ")":
            raw = text[start:end]
            first = _place(starts, start)
            return Link(kind, at, unescaped(raw), first, first + len(raw)), t + 1
    own = top.at + 1 + top.image
    label, k = text[own:i], i + 1
    if text[k : k + 1] == "[":
        j = _label(text, k)
        if j is not None:
            label, k = text[k + 1 : j], j + 1
            known = definitions.get(label_of(label))
            return (Link(kind, at, unescaped(known[0]), known[1], known[2], label_of(label)), k) if known else None
        if text[k : k + 2] == "[]":
            k += 2
    if _label(text, own - 1) != i:
        return None  # a label holds no brackets
    known = definitions.get(label_of(label))
    return (Link(kind, at, unescaped(known[0]), known[1], known[2], label_of(label)), k) if known else None


def links(source: str) -> list[Link]:
    """Every link, image and autolink in the order of the document's tree: an outer one before those inside it."""
    blocks = _Blocks(source)
    return [x for text, starts in blocks.texts for x in _inline(text, starts, blocks.definitions)]


def spans(source: str) -> list[tuple[int, int, str]]:
    """(start, end, value) of the destinations that can be rewritten: those of inline links and images, and of the first
    definition of each label that is used; by place."""
    found = {(x.start, x.end): x.dest for x in links(source) if x.kind != "auto" and x.end > x.start}
    return sorted((a, b, d) for (a, b), d in found.items())
