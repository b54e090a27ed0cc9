"""CCITT fax: groups 3 (one and two dimensional) and 4."""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np

# Code words of run lengths 0 to 63 for white and for black, as the standard lists them.
WHITE = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111
0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000
00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001
01011010 01011011 01001010 01001011 00110010 00110011 00110100""".split()
BLACK = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111
00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001
000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011
000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111
000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111""".split()
# Code words of the lengths 64, 128, ... 1728 for either, and of 1792 to 2560 for both.
WHITE_MORE = """11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110
011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011""".split()
BLACK_MORE = """0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011
0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100
0000001010101 0000001011010 0000001011011 0000001100100 0000001100101""".split()
BOTH_MORE = """00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101
000000011110 000000011111""".split()
# The modes of two-dimensional lines; vertical ones by how far they lie to the right.
PASS, HORIZONTAL = "0001", "001"
VERTICAL = {0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}
END = "000000000001"


def _lengths(short: list[str], more: list[str]) -> dict[int, str]:
    return dict(enumerate(short)) | {64 * k: c for k, c in enumerate([*more, *BOTH_MORE], 1)}


CODES = (_lengths(WHITE, WHITE_MORE), _lengths(BLACK, BLACK_MORE))
LONGEST = 13


def _table(codes: dict[str, object]) -> list[tuple[object, int] | None]:
    """For each 13 bits, what the code word that they begin with means, and its length."""
    table: list[tuple[object, int] | None] = [None] * (1 << LONGEST)
    for code, meaning in codes.items():
        rest = LONGEST - len(code)
        first = int(code, 2) << rest
        table[first : first + (1 << rest)] = [(meaning, len(code))] * (1 << rest)
    return table


RUNS = tuple(_table({c: n for n, c in codes.items()}) for codes in CODES)
MODES = _table({PASS: "pass", HORIZONTAL: "horizontal"} | {c: n for n, c in VERTICAL.items()})


class Damaged(ValueError):
    pass


class Bits:
    """``windows`` has the 13 bits that begin at each bit, zeros after the last."""

    def __init__(self, data: bytes):
        self.size, self.at = 8 * len(data), 0
        at = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
        three = at[:-2] << np.uint32(16) | at[1:-1] << np.uint32(8) | at[2:]  # of each byte and the two after it
        shifts = np.arange(24 - LONGEST, 16 - LONGEST, -1, dtype=np.uint32)
        found = three[:, None] >> shifts & np.uint32((1 << LONGEST) - 1)
        self.windows = array("H", found.astype(np.uint16).ravel()[: self.size + 1].tobytes())

    def bit(self, at: int) -> int:
        return self.windows[at] >> LONGEST - 1

    def word(self, table: list[tuple[object, int] | None]):
        found = table[self.windows[self.at]] if self.at <= self.size else None
        if found is None or self.at + found[1] > self.size:
            raise Damaged
        self.at += found[1]
        return found[0]

    def run(self, colour: int) -> int:
        total = 0
        while True:
            n = self.word(RUNS[colour])
            total += n
            if n < 64:
                return total

    def end_of_line(self) -> bool:
        """Pass an end-of-line code and the fill before it, if they come next."""
        at = self.at
        if at >= self.size or self.windows[at] >> LONGEST - 11:
            return False
        while at < self.size and not self.bit(at):
            at += 1
        if at - self.at >= 11 and at < self.size:
            self.at = at + 1
            return True
        return False

    def align(self) -> None:
        self.at += -self.at % 8


def _two(bits: Bits, above: list[int], columns: int) -> list[int]:
    """Changes of a line coded against the one above: even ones turn to black.

    ``k`` is the place above of the first change right of ``at`` to the other colour; as lines are
    read from the left, none before it comes again. Three changes at the end stand for none.
    """
    line: list[int] = []
    above = [*above, columns, columns, columns]
    at, colour, k, last = -1, 0, 0, 0
    windows, size, modes, place = bits.windows, bits.size, MODES, bits.at
    while at < columns:
        if k & 1 != colour:
            k += -1 if k else 1
        while above[k] <= at:
            k += 2
        found = modes[windows[place]] if place <= size else None
        if found is None or place + found[1] > size:
            raise Damaged
        mode, length = found
        place += length
        if mode == "pass":
            at = above[k + 1]
        elif mode == "horizontal":
            bits.at = place
            first, second = bits.run(colour), bits.run(1 - colour)
            place = bits.at
            at = max(at, 0) + first
            line.append(min(at, columns))
            at += second
            last = min(at, columns)
            line.append(last)
        else:
            at = above[k] + mode
            if at < last:
                raise Damaged
            last = at if at < columns else columns
            line.append(last)
            colour = 1 - colour
    bits.at = place
    return line


def _one(bits: Bits, columns: int) -> list[int]:
    line, at, colour = [], 0, 0
    while at < columns:
        at += bits.run(colour)
        line.append(min(at, columns))
        colour = 1 - colour
    return line


def _after(size: int, at: int) -> int:
    """All bits of a line of bytes from a place on."""
    return (1 << 8 * size - at) - 1


@lru_cache(8)
def _masks(columns: int) -> list[int]:
    return [_after((columns + 7) // 8, at) for at in range(columns + 1)]


#: Lines up to so many columns have their masks ready.
NARROW = 1024


def _bytes(line: list[int], columns: int, black: bool) -> bytes:
    """A line of bits from its changes, each of which turns all that follows."""
    size, value = (columns + 7) // 8, 0
    if columns <= NARROW:
        masks = _masks(columns)
        for at in line:
            value ^= masks[at]
    else:
        for at in line:
            value ^= _after(size, at)
    if len(line) % 2:
        value ^= _after(size, columns)
    if not black:
        value ^= (1 << columns) - 1 << 8 * size - columns
    return value.to_bytes(size, "big")


def decode(data: bytes, params: dict, most: int) -> bytes:
    """Lines of bits; damage ends them, and lines that are missing are white."""
    k, columns, rows = int(params.get("K") or 0), int(params.get("Columns") or 1728), int(params.get("Rows") or 0)
    black, aligned = bool(params.get("BlackIs1")), bool(params.get("EncodedByteAlign"))
    if not 0 < columns <= 1 << 16:
        return b""
    bits, above, out = Bits(data), [], []
    size = (columns + 7) // 8
    try:
        while (not rows or len(out) < rows) and bits.at < bits.size and size * len(out) < most:
            if aligned:
                bits.align()
            ended = bits.end_of_line()
            if ended and (k < 0 or bits.end_of_line()):
                break  # the end of the block
            if k > 0:
                flat = bits.at < bits.size and bits.bit(bits.at) == 1
                bits.at += 1
                line = _one(bits, columns) if flat else _two(bits, above, columns)
            else:
                line = _two(bits, above, columns) if k < 0 else _one(bits, columns)
            out.append(_bytes(line, columns, black))
            above = _turns(line, columns)
    except Damaged:
        pass
    out += [_bytes([], columns, black)] * (rows - len(out) if rows and size * rows <= most else 0)
    return b"".join(out)


def _turns(line: list[int], columns: int) -> list[int]:
    """Changes that are changes: runs of no length are taken out in pairs."""
    if len(set(line)) == len(line):  # they don't fall, so none stands beside its like
        return line[:-1] if line and line[-1] == columns else line
    out: list[int] = []
    for x in line:
        if out and out[-1] == x:
            out.pop()
        else:
            out.append(x)
    return [x for x in out if x < columns]


def _word(colour: int, length: int) -> str:
    out = ""
    while length > 2560:
        out += CODES[colour][2560]
        length -= 2560
    if length >= 64:
        out += CODES[colour][length // 64 * 64]
    return out + CODES[colour][length % 64]


WORDS = tuple([_word(colour, length) for length in range(2561)] for colour in (0, 1))
#: Where the bits of a byte are set.
SET = [[i for i in range(8) if byte >> 7 - i & 1] for byte in range(256)]


def _changes(row: bytes, columns: int) -> list[int]:
    """Places of a line of bits whose bit differs from the one before, white before the first; a row cut short is white from there on."""
    value = int.from_bytes(row.ljust((columns + 7) // 8, b"\0"), "big")
    turns = (value ^ value >> 1).to_bytes((columns + 7) // 8, "big")
    found = [8 * i + j for i, byte in enumerate(turns) if byte for j in SET[byte]]
    while found and found[-1] >= columns:
        found.pop()
    return found


def encode(data: bytes, columns: int, k: int) -> bytes:
    """Lines of bits (one for black) as fax: K below zero is group 4, zero one dimensional, above it every K-th line is."""
    size, above, out = (columns + 7) // 8, [], []
    for number, at in enumerate(range(0, len(data), size)):
        line = _changes(data[at : at + size], columns)
        flat = k == 0 or k > 0 and number % k == 0
        if k >= 0:
            out.append(END)
        if k > 0:
            out.append("1" if flat else "0")
        if flat:
            out.append(_coded_one(line, columns))
        else:
            _coded_two(line, above, columns, out)
        above = line
    out.append(END * 2 if k < 0 else END * 6)
    joined = "".join(out)
    joined += "0" * (-len(joined) % 8)
    return int(joined, 2).to_bytes(len(joined) // 8, "big") if joined else b""


def _run(colour: int, length: int) -> str:
    return WORDS[colour][length] if length <= 2560 else _word(colour, length)


def _coded_one(line: list[int], columns: int) -> str:
    edges = [0, *line, columns]
    return "".join([_run(i & 1, b - a) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def _coded_two(line: list[int], above: list[int], columns: int, out: list[str]) -> None:
    """Adds the code words of a line against the one above; ``k`` and ``j`` are as in ``_two``."""
    line, above = [*line, columns, columns, columns], [*above, columns, columns, columns]
    at, colour, j, k = -1, 0, 0, 0
    while at < columns:
        if k & 1 != colour:
            k += -1 if k else 1
        while above[k] <= at:
            k += 2
        if j & 1 != colour:
            j += -1 if j else 1
        while line[j] <= at:
            j += 2
        a1, b1 = line[j], above[k]
        if above[k + 1] < a1:
            out.append(PASS)
            at = above[k + 1]
        elif -3 <= a1 - b1 <= 3:
            out.append(VERTICAL[a1 - b1])
            at, colour = a1, 1 - colour
        else:
            a2 = line[j + 1]
            out += (HORIZONTAL, _run(colour, a1 - max(at, 0)), _run(1 - colour, a2 - a1))
            at = a2
