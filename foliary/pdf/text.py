"""Text of content streams: tokens, the graphics and text state, and code-to-Unicode mapping."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from copy import copy
from typing import NamedTuple

from . import glyphs
from .document import Document
from .syntax import Keyword, Lexer, Name, Stream, text_of

MAX_FORMS = 12
Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def times(a: Matrix, b: Matrix) -> Matrix:
    """What ``a`` does, followed by ``b``."""
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


def tokens(content: bytes) -> Iterator[tuple[list, bytes]]:
    """(operands, operator) in order; inline images are passed over."""
    lexer, operands = Lexer(content, references=False), []
    while not lexer.done:
        token = lexer.read()
        if not isinstance(token, Keyword):
            operands.append(token)
            continue
        if token == b"BI":
            end = re.compile(rb"\sEI(?=\s|\Z)").search(content, lexer.at)
            lexer.at = end.end() if end else len(content)
        else:
            yield operands, bytes(token)
        operands = []


class CMap:
    """Code ranges, and what codes map to: text (ToUnicode) or character ids."""

    def __init__(self, body: bytes):
        self.map: dict[int, str] = {}
        self.cids: dict[int, int] = {}
        self.sizes: list[tuple[bytes, bytes]] = []
        self.vertical = bool(re.search(rb"/WMode\s+1\b", body))
        pattern = rb"begin(codespacerange|bfchar|bfrange|cidchar|cidrange)(.*?)end(?:codespacerange|bfchar|bfrange|cidchar|cidrange)"
        for kind, block in re.findall(pattern, body, re.S):
            lexer, items = Lexer(block, references=False), []
            while not lexer.done:
                items.append(lexer.read())
            if kind == b"codespacerange":
                pairs = zip(items[::2], items[1::2], strict=False)
                self.sizes += [(a, b) for a, b in pairs if isinstance(a, bytes) and isinstance(b, bytes) and 0 < len(a) == len(b)]
            elif kind in (b"bfchar", b"cidchar"):
                for code, to in zip(items[::2], items[1::2], strict=False):
                    if isinstance(code, bytes):
                        self._put(int.from_bytes(code, "big"), to, 0)
            else:
                for low, high, to in zip(items[::3], items[1::3], items[2::3], strict=False):
                    if not isinstance(low, bytes) or not isinstance(high, bytes):
                        continue
                    a, b = int.from_bytes(low, "big"), int.from_bytes(high, "big")
                    for k in range(min(b - a + 1, 65536)):
                        if isinstance(to, list):
                            if k < len(to):
                                self._put(a + k, to[k], 0)
                        else:
                            self._put(a + k, to, k)

    def _put(self, code: int, to, step: int) -> None:
        if isinstance(to, bytes) and to:
            whole = ((int.from_bytes(to, "big") + step) & (1 << 8 * len(to)) - 1).to_bytes(len(to), "big")
            self.map[code] = whole.decode("utf-16-be" if len(to) > 1 else "latin-1", "replace")
        elif isinstance(to, int):
            self.cids[code] = to + step

    @property
    def size(self) -> int:
        return max([1, *(len(a) for a, _ in self.sizes)])

    def codes(self, raw: bytes) -> Iterator[tuple[int, int]]:
        """(code, bytes) by the code ranges; bytes in none make codes of the longest size."""
        at, longest = 0, self.size
        while at < len(raw):
            size = next((len(a) for a, b in self.sizes if all(x <= y <= z for x, y, z in zip(a, raw[at : at + len(a)].ljust(len(a)), b, strict=True))), longest)
            yield int.from_bytes(raw[at : at + size], "big"), size
            at += size

    def text(self, raw: bytes) -> str:
        return "".join([self.map.get(c) or chr(c) for c, _ in self.codes(raw)])


class Font:
    """Codes of shown strings, and each code's text and width in thousandths."""

    def __init__(self, doc: Document, font: dict):
        self.name = str(doc.get(font.get("BaseFont")) or "")
        kind = str(doc.get(font.get("Subtype")))
        cmap = doc.get(font.get("ToUnicode"))
        self.cmap = CMap(doc.decoded(cmap)) if isinstance(cmap, Stream) else None
        encoding = doc.get(font.get("Encoding"))
        self.wide = kind == "Type0"
        self.vertical, self.unit = False, 0.001
        if self.wide:
            self._wide(doc, font, encoding)
            return
        base = doc.get(encoding.get("BaseEncoding")) if isinstance(encoding, dict) else encoding
        named = str(base) if base else "Symbol" if "Symbol" in self.name else "StandardEncoding" if kind in ("Type1", "MMType1") or isinstance(encoding, dict) else "WinAnsiEncoding"
        self.table = list(glyphs.encoding(named))
        code = 0
        for item in map(doc.get, doc.list_of(encoding.get("Differences")) if isinstance(encoding, dict) else []):
            if isinstance(item, Name):
                if 0 <= code < 256:
                    self.table[code] = glyphs.glyph(str(item))
                code += 1
            elif isinstance(item, int):
                code = item
        first, widths = doc.get(font.get("FirstChar")) or 0, doc.list_of(font.get("Widths"))
        plain = {int, float}.issuperset(map(type, widths))
        self.widths = dict(enumerate(widths, first)) if plain else {first + i: w for i, w in enumerate(map(doc.get, widths)) if isinstance(w, (int, float))}
        missing = doc.get(doc.dict_of(font.get("FontDescriptor")).get("MissingWidth"))
        self.missing = missing if isinstance(missing, (int, float)) and missing else 600 if "Courier" in self.name else 500
        matrix = [x for x in map(doc.get, doc.list_of(font.get("FontMatrix"))) if isinstance(x, (int, float))]
        if kind == "Type3" and len(matrix) == 6:
            self.unit = abs(matrix[0])

    def _wide(self, doc: Document, font: dict, encoding) -> None:
        below = doc.dict_of((doc.list_of(font.get("DescendantFonts")) or [None])[0])
        self.code_map = CMap(doc.decoded(encoding)) if isinstance(encoding, Stream) else None
        self.vertical = self.code_map.vertical if self.code_map else str(encoding).endswith("-V")
        default = doc.get(below.get("DW"))
        self.missing = default if isinstance(default, (int, float)) else 1000
        self.widths = {}
        items = list(map(doc.get, doc.list_of(below.get("W"))))
        while items:
            first, items = items[0], items[1:]
            if not isinstance(first, int) or not items:
                continue
            if isinstance(items[0], list):
                self.widths |= {first + i: w for i, w in enumerate(map(doc.get, items[0])) if isinstance(w, (int, float))}
                items = items[1:]
            elif len(items) > 1 and isinstance(items[0], int) and isinstance(items[1], (int, float)):
                self.widths |= dict.fromkeys(range(first, min(items[0], first + 65535) + 1), items[1])
                items = items[2:]

    def codes(self, raw: bytes) -> Iterator[tuple[int, int]]:
        if not self.wide:
            return ((c, 1) for c in raw)
        if self.code_map and self.code_map.sizes:
            return self.code_map.codes(raw)
        return ((int.from_bytes(raw[i : i + 2], "big"), 2) for i in range(0, len(raw), 2))

    def code_text(self, code: int) -> str:
        if self.cmap and (found := self.cmap.map.get(code)):
            return found
        if not self.wide:
            return self.table[code]
        return chr(code) if code < 0x110000 else glyphs.UNKNOWN

    def code_width(self, code: int) -> float:
        if self.wide and self.code_map:
            code = self.code_map.cids.get(code, code)
        return self.widths.get(code, self.missing)

    def text(self, raw: bytes) -> str:
        """A whole string's text; UTF-16 pairs in two codes are one character."""
        if self.wide and not self.cmap and not self.code_map:
            return raw.decode("utf-16-be", "replace")
        return joined("".join([self.code_text(c) for c, _ in self.codes(raw)]))

    def width(self, raw: bytes) -> float:
        return sum([self.code_width(c) for c, _ in self.codes(raw)]) * self.unit


def joined(text: str) -> str:
    """Surrogates in pairs as the character that they make; lone ones as U+FFFD."""
    if re.search("[\ud800-\udfff]", text):
        return text.encode("utf-16-be", "surrogatepass").decode("utf-16-be", "replace")
    return text


class Glyph(NamedTuple):
    """A character on the page: its origin, its advance along the line, and the size it is shown in."""

    ch: str
    x: float
    y: float
    w: float
    h: float
    angle: float
    font: str
    vertical: bool


class Run(NamedTuple):
    text: str
    x: float
    y: float
    size: float
    fresh: bool
    glyphs: list[Glyph]


class State:
    """What q saves and Q brings back."""

    def __init__(self, ctm: Matrix = IDENTITY):
        self.ctm, self.font, self.size = ctm, None, 0.0
        self.char = self.word = self.leading = self.rise = 0.0
        self.scale = 1.0


#: How much of a string is worked out: its text, also the advance past it, also each character's place.
TEXT, ADVANCE, PLACES = range(3)


def shown(doc: Document, page: dict, detail: int = PLACES) -> Iterator[Run]:
    """Each string that a page shows, in order, in the page's own coordinates.

    TJ arrays show all their strings, and a font set before BT stays, as the specification says.
    """
    yield from _interpret(doc, doc.contents(page), doc.dict_of(page.get("Resources")), 0, State(), detail)


def runs(doc: Document, page: dict) -> Iterator[tuple[str, float, float, float, bool]]:
    """(text, x, y, size, begins a line) for each string that a page shows."""
    return (r[:5] for r in shown(doc, page, ADVANCE))


def page_glyphs(doc: Document, page: dict) -> Iterator[Glyph]:
    """Every character with its place, a glyph of several characters cut into equal parts."""
    for run in shown(doc, page):
        yield from run.glyphs


def _spread(text: str, x: float, y: float, dx: float, dy: float, like: Glyph) -> list[Glyph]:
    """The characters of a text evenly between two points."""
    n = max(len(text), 1)
    w = math.hypot(dx, dy) / n
    return [like._replace(ch=c, x=x + dx * i / n, y=y + dy * i / n, w=w) for i, c in enumerate(text)]


def _interpret(doc: Document, content: bytes, resources: dict, depth: int, state: State, detail: int) -> Iterator[Run]:
    fonts, found = doc.dict_of(resources.get("Font")), {}
    saved: list[State] = []
    fresh = True
    tlm = tm = IDENTITY
    actual: list[str | None] = []
    covered: list[Glyph] = []

    def font_of(ref) -> Font:
        key = ref if isinstance(ref, str) else id(ref)
        if key not in found:
            held = doc.dict_of(fonts.get(ref)) if isinstance(ref, str) else ref
            found[key] = Font(doc, held) if held else None
        return found[key]

    def show(raw) -> tuple[str, list[Glyph]]:
        """Place a string and move on past it."""
        nonlocal tm
        out, text, font = [], [], state.font
        if detail < PLACES:
            if detail == ADVANCE:
                spaces = raw.count(32) if not (font and font.wide) else 0
                wide = (font.width(raw) if font else 0.5 * len(raw)) * state.size + state.char * (len(raw) // 2 if font and font.wide else len(raw)) + state.word * spaces
                tm = times((1.0, 0.0, 0.0, 1.0, wide * state.scale, 0.0), tm)
            return (font.text(raw) if font else raw.decode("latin-1")), out
        for code, size in font.codes(raw) if font else ((c, 1) for c in raw):
            ch = font.code_text(code) if font else chr(code)
            wide = font.code_width(code) * font.unit if font else 0.5
            at = times((state.size * state.scale, 0.0, 0.0, state.size, 0.0, state.rise), times(tm, state.ctm))
            gap = state.char + (state.word if size == 1 and code == 32 else 0.0)
            vertical = bool(font and font.vertical)
            if vertical:
                move, length = (0.0, -state.size + gap), math.hypot(at[2], at[3])
            else:
                move, length = ((wide * state.size + gap) * state.scale, 0.0), wide * math.hypot(at[0], at[1])
            angle = math.degrees(math.atan2(at[1], at[0])) % 360
            like = Glyph(ch, at[4], at[5], length, math.hypot(at[2], at[3]), angle, font.name if font else "", vertical)
            if len(ch) == 1:
                out.append(like)
            elif ch:
                turn = math.radians(angle)
                out += _spread(ch, at[4], at[5], length * math.cos(turn), length * math.sin(turn), like)
            text.append(ch)
            tm = times((1.0, 0.0, 0.0, 1.0, *move), tm)
        return "".join(text), out

    def merged(placed: list[Glyph]) -> list[Glyph]:
        """Two glyphs that are halves of one character as that."""
        if not any("\ud800" <= g.ch <= "\udfff" for g in placed):
            return placed
        out: list[Glyph] = []
        for g in placed:
            if out and "\ud800" <= out[-1].ch <= "\udbff" and "\udc00" <= g.ch <= "\udfff":
                out[-1] = out[-1]._replace(ch=joined(out[-1].ch + g.ch), w=out[-1].w + g.w)
            else:
                out.append(g)
        return [g._replace(ch=joined(g.ch)) for g in out]

    def place() -> tuple[float, float, float]:
        at = times(tm, state.ctm)
        return at[4], at[5], state.size * math.hypot(at[2], at[3])

    def next_line() -> None:
        nonlocal tlm, tm
        tlm = tm = times((1.0, 0.0, 0.0, 1.0, 0.0, -state.leading), tlm)

    for args, op in tokens(content):
        nums = [float(a) if isinstance(a, (int, float)) else 0.0 for a in args]
        if op == b"q":
            saved.append(copy(state))
        elif op == b"Q":
            state = saved.pop() if saved else state
        elif op == b"cm" and len(nums) > 5:
            state.ctm = times(tuple(nums[:6]), state.ctm)
        elif op == b"Tf" and len(args) > 1:
            state.font, state.size = font_of(str(args[0])), nums[1]
        elif op == b"gs" and args:
            held = doc.list_of(doc.dict_of(doc.dict_of(resources.get("ExtGState")).get(str(args[0]))).get("Font"))
            if len(held) > 1 and isinstance(doc.get(held[1]), (int, float)):
                state.font, state.size = font_of(doc.dict_of(held[0])), float(doc.get(held[1]))
        elif op in (b"Tc", b"Tw", b"TL", b"Ts", b"Tz") and nums:
            name = {b"Tc": "char", b"Tw": "word", b"TL": "leading", b"Ts": "rise", b"Tz": "scale"}[op]
            setattr(state, name, nums[0] / 100 if op == b"Tz" else nums[0])
        elif op == b"BT":
            tlm = tm = IDENTITY
            fresh = True
        elif op == b"ET":
            fresh = True
        elif op in (b"Td", b"TD") and len(nums) > 1:
            if op == b"TD":
                state.leading = -nums[1]
            fresh = fresh or nums[1] < 0
            tlm = tm = times((1.0, 0.0, 0.0, 1.0, nums[0], nums[1]), tlm)
        elif op == b"Tm" and len(nums) > 5:
            fresh = fresh or nums[5] != tm[5]
            tlm = tm = tuple(nums[:6])
        elif op == b"T*":
            fresh = True
            next_line()
        elif op in (b"Tj", b"TJ", b"'", b'"') and args:
            if op == b'"' and len(nums) > 2:
                state.word, state.char = nums[0], nums[1]
            if op in (b"'", b'"'):
                fresh = True
                next_line()
            x, y, size = place()
            said, placed = "", []
            for p in args[-1] if isinstance(args[-1], list) else [args[-1]]:
                if isinstance(p, (int, float)):
                    step = -p / 1000 * state.size
                    tm = times((1.0, 0.0, 0.0, 1.0, *((0.0, step) if state.font and state.font.vertical else (step * state.scale, 0.0))), tm)
                elif isinstance(p, bytes):
                    text, more = show(p)
                    said += text
                    placed += more
            if any(a is not None for a in actual):
                covered += placed
            else:
                yield Run(joined(said), x, y, size, fresh, merged(placed))
                fresh = False
        elif op in (b"BDC", b"BMC"):
            props = args[1] if len(args) > 1 else None
            props = doc.dict_of(doc.dict_of(resources.get("Properties")).get(str(props))) if isinstance(props, Name) else props
            actual.append(text_of(doc.get(props.get("ActualText"))) if isinstance(props, dict) and "ActualText" in props else None)
        elif op == b"EMC" and actual:
            said = actual.pop()
            if said is not None and not any(a is not None for a in actual):
                x, y, size = place()
                if covered:
                    first, last = covered[0], covered[-1]
                    turn = math.radians(last.angle)
                    dx, dy = last.x + last.w * math.cos(turn) - first.x, last.y + last.w * math.sin(turn) - first.y
                    yield Run(said, first.x, first.y, size, fresh, _spread(said, first.x, first.y, dx, dy, first))
                else:
                    like = Glyph("", x, y, 0.0, size, 0.0, state.font.name if state.font else "", False)
                    yield Run(said, x, y, size, fresh, _spread(said, x, y, 0.0, 0.0, like))
                covered, fresh = [], False
        elif op == b"Do" and args and depth < MAX_FORMS:
            form = doc.get(doc.dict_of(resources.get("XObject")).get(str(args[0])))
            if isinstance(form, Stream) and form.dict.get("Subtype") == "Form":
                matrix = [float(v) for v in map(doc.get, doc.list_of(form.dict.get("Matrix"))) if isinstance(v, (int, float))]
                inner = copy(state)
                inner.ctm = times(tuple(matrix), state.ctm) if len(matrix) == 6 else state.ctm
                yield from _interpret(doc, doc.decoded(form), doc.dict_of(form.dict.get("Resources")) or resources, depth + 1, inner, detail)


def placements(doc: Document, content: bytes, resources: dict, ctm: Matrix = IDENTITY, depth: int = 0) -> Iterator[tuple[str, Matrix]]:
    """(name, matrix of the unit square) for each image that is painted, in order, in forms too."""
    held = doc.dict_of(resources.get("XObject"))
    saved: list[Matrix] = []
    for args, op in tokens(content):
        if op == b"q":
            saved.append(ctm)
        elif op == b"Q":
            ctm = saved.pop() if saved else ctm
        elif op == b"cm" and len(args) > 5:
            ctm = times(tuple(float(a) if isinstance(a, (int, float)) else 0.0 for a in args[:6]), ctm)
        elif op == b"Do" and args:
            painted = doc.get(held.get(str(args[0])))
            if not isinstance(painted, Stream):
                continue
            if painted.dict.get("Subtype") == "Image":
                yield str(args[0]), ctm
            elif painted.dict.get("Subtype") == "Form" and depth < MAX_FORMS:
                matrix = [float(v) for v in map(doc.get, doc.list_of(painted.dict.get("Matrix"))) if isinstance(v, (int, float))]
                inner = times(tuple(matrix), ctm) if len(matrix) == 6 else ctm
                yield from placements(doc, doc.decoded(painted), doc.dict_of(painted.dict.get("Resources")) or resources, inner, depth + 1)


def page_text(doc: Document, page: dict) -> str:
    """Strings in order, with a line feed where a new line begins."""
    out: list[str] = []
    for text, _, _, _, fresh, _ in shown(doc, page, TEXT):
        if fresh and out:
            out.append("\n")
        out.append(text)
    return "".join(out)
