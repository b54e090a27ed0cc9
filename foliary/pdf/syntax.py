"""PDF objects: a lexer that never raises on bad input, and their serialisation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

WHITE = b"\x00\t\n\x0c\r "
DELIMITERS = b"()<>[]{}/%"
MAX_DEPTH = 100
NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
SKIPPED = frozenset(bytes([c]) for c in WHITE + b"%")
REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]*")
SPACE = re.compile(rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*)*")
REFERENCE = re.compile(rb"(\d{1,7})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
NUMBERS = re.compile(rb"\[((?:[\t\n\x0c\r ]*+[+-]?(?:\d{1,18}+(?:\.\d*+)?|\.\d++)(?=[\t\n\x0c\r \]]))*+)[\t\n\x0c\r ]*+\]")
#: A key and a name, a reference or a whole number.
PAIR = re.compile(
    rb"[\t\n\x0c\r ]*+/([^\x00\t\n\x0c\r ()<>\[\]{}/%#]++)(?!#)[\t\n\x0c\r ]*+(?:/([^\x00\t\n\x0c\r ()<>\[\]{}/%#]*+)(?!#)"
    rb"|(\d{1,7})[\t\n\x0c\r ]++(\d{1,5})[\t\n\x0c\r ]++R(?=[\t\n\x0c\r />])|([+-]?\d{1,18}+)(?=[\t\n\x0c\r ]*+[/>]))"
)
HEX = re.compile(rb"[0-9A-Fa-f]*+")
PLAIN = re.compile(rb"\(([^()\\]*+)\)")
ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}


class Name(str):
    __slots__ = ()


@dataclass(frozen=True)
class Ref:
    num: int
    gen: int


class Keyword(bytes):
    """An operator or keyword; also what can't be read."""

    __slots__ = ()


@dataclass
class Stream:
    dict: dict
    raw: bytes
    num: int = 0
    gen: int = 0
    extra: dict = field(default_factory=dict)


def numbers(text: bytes) -> list[int | float]:
    """Numbers apart by white space."""
    return [float(t) if b"." in t else int(t) for t in text.split()] if b"." in text else list(map(int, text.split()))


class Lexer:
    """Reads objects from ``data`` at ``at``. Ends of input give None, unknown words a Keyword."""

    def __init__(self, data: bytes, at: int = 0, references: bool = True):
        self.data, self.at, self.references = data, at, references

    def skip(self) -> None:
        if self.data[self.at : self.at + 1] in SKIPPED:
            self.at = SPACE.match(self.data, self.at).end()

    @property
    def done(self) -> bool:
        self.skip()
        return self.at >= len(self.data)

    def read(self, depth: int = 0):
        self.skip()
        data, at = self.data, self.at
        if at >= len(data) or depth > MAX_DEPTH:
            self.at = len(data)
            return None
        c = data[at : at + 1]
        if c == b"/":
            return self._name()
        if c == b"(":
            return self._string()
        if c == b"<":
            return self._dict(depth) if data[at + 1 : at + 2] == b"<" else self._hex()
        if c == b"[":
            if depth < MAX_DEPTH and (m := NUMBERS.match(data, at)):
                self.at = m.end()
                return numbers(m[1])
            self.at += 1
            out = []
            while not self.done and self.data[self.at : self.at + 1] != b"]":
                out.append(self.read(depth + 1))
            self.at += 1
            return out
        if c in b"0123456789+-.":
            if self.references and (m := REFERENCE.match(data, at)):
                self.at = m.end()
                return Ref(int(m[1]), int(m[2]))
            if m := NUMBER.match(data, at):
                self.at = m.end()
                text = m[0]
                return float(text) if b"." in text else int(text) if len(text) < 20 else float(text)
        word = REGULAR.match(data, at)[0]
        self.at = at + max(1, len(word))
        return {b"true": True, b"false": False}.get(word, None if word == b"null" else Keyword(word or c))

    def _name(self) -> Name:
        word = REGULAR.match(self.data, self.at + 1)[0]
        self.at += 1 + len(word)
        if b"#" in word:
            word = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), word)
        return Name(word.decode("latin-1"))

    def _string(self) -> bytes:
        if m := PLAIN.match(self.data, self.at):
            self.at = m.end()
            return m[1]
        data, at, depth, out = self.data, self.at + 1, 1, bytearray()
        while at < len(data):
            c = data[at]
            at += 1
            if c == 0x28:
                depth += 1
            elif c == 0x29:
                depth -= 1
                if not depth:
                    break
            elif c == 0x5C and at < len(data):
                c = data[at]
                at += 1
                if c in ESCAPES:
                    c = ESCAPES[c]
                elif 0x30 <= c <= 0x37:
                    m = re.compile(rb"[0-7]{0,2}").match(data, at)
                    c = int(bytes([c]) + m[0], 8) & 255
                    at = m.end()
                elif c in (10, 13):
                    at += c == 13 and data[at : at + 1] == b"\n"
                    continue
            out.append(c)
        self.at = at
        return bytes(out)

    def _hex(self) -> bytes:
        end = self.data.find(b">", self.at)
        end = len(self.data) if end < 0 else end
        digits = self.data[self.at + 1 : end]
        self.at = end + 1
        if not HEX.fullmatch(digits):
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", digits)
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def _dict(self, depth: int) -> dict:
        self.at += 2
        out: dict = {}
        plain = self.references and depth < MAX_DEPTH
        while True:
            if plain and (m := PAIR.match(self.data, self.at)):
                self.at = m.end()
                out[m[1].decode("latin-1")] = Name(m[2].decode("latin-1")) if m[2] is not None else int(m[5]) if m[5] else Ref(int(m[3]), int(m[4]))
                continue
            if self.done:
                break
            if self.data[self.at : self.at + 2] == b">>":
                self.at += 2
                break
            key = self.read(depth + 1)
            if isinstance(key, Keyword) and key in (b"endobj", b"stream"):
                self.at -= len(key)
                break
            if isinstance(key, Name):
                if self.done or self.data[self.at : self.at + 2] == b">>":
                    break
                out[str(key)] = self.read(depth + 1)
        return out


def escape(raw: bytes) -> bytes:
    for a, b in ((b"\\", b"\\\\"), (b"(", b"\\("), (b")", b"\\)"), (b"\r", b"\\r"), (b"\n", b"\\n")):
        raw = raw.replace(a, b)
    return b"(" + raw + b")"


@lru_cache(4096)
def _named(name: str) -> bytes:
    return b"/" + re.sub(rb"[^!-~]|[#()<>\[\]{}/%]", lambda m: b"#%02X" % m[0][0], name.encode("latin-1", "replace"))


def dump(value) -> bytes:
    """An object in PDF syntax."""
    if value is None:
        return b"null"
    if value is True or value is False:
        return b"true" if value else b"false"
    if isinstance(value, Ref):
        return b"%d %d R" % (value.num, value.gen)
    if isinstance(value, Name):
        return _named(value)
    if isinstance(value, str):
        return dump(text_string(value))
    if isinstance(value, Keyword):
        return bytes(value)
    if isinstance(value, (bytes, bytearray)):
        return escape(bytes(value))
    if isinstance(value, float):
        return f"{value:.6f}".rstrip("0").rstrip(".").encode() or b"0"
    if isinstance(value, int):
        return b"%d" % value
    if isinstance(value, dict):
        return b"<< " + b" ".join([_named(k) + b" " + dump(v) for k, v in value.items()]) + b" >>"
    if isinstance(value, Stream):
        return dump({**value.dict, "Length": len(value.raw)}) + b"\nstream\n" + value.raw + b"\nendstream"
    if set(map(type, value)) == {int}:
        return b"[" + " ".join(map(str, value)).encode() + b"]"
    return b"[" + b" ".join(map(dump, value)) + b"]"


def text_string(text: str) -> bytes:
    """Latin-1 where that does, else UTF-16BE with its mark."""
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return b"\xfe\xff" + text.encode("utf-16-be")


def text_of(raw) -> str | None:
    """The text of a PDF text string."""
    if not isinstance(raw, bytes):
        return str(raw) if isinstance(raw, Name) else None
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace")
    return raw.decode("latin-1")
