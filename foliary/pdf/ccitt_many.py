"""Many fax blocks at once, their lines side by side in arrays.

The results are those of ``ccitt``. Lines are coded from their own bits and those above alone, so all
changes of all lines go at once. Reading finds where lines begin by their end-of-line codes, then reads
all lines that are coded by themselves, all below such a line, and so on, the next code word of each line
in a step. A block that isn't plainly
of that form (group 4, damage, a line that doesn't end just before the next end-of-line code, runs
of no length inside a line) is read by ``ccitt.decode``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np

from . import ccitt

#: Wider lines go one by one: theirs may be runs of several words of 2560.
WIDEST = 2560
#: Blocks are taken together up to so many bits of lines (twice as many to be read), and lines are read in steps up to so many.
TOGETHER, ABREAST = 3 << 20, 16384
#: Words are packed so many at a time, which the processor's cache holds.
BLOCK = 16384
#: So many lines are written against the ones above at a time.
LINES = 2048
#: A line in a step of its own costs more than one read by itself.
FEW = 32
END_BITS = len(ccitt.END)

# Words are held as code << 8 | length, for run lengths by colour and for vertical modes from -3 to 3.
_word = np.vectorize(lambda text: int(text, 2) << 8 | len(text), otypes=[np.int64])
RUN_WORDS = _word(np.array(ccitt.WORDS))
LENGTHS = RUN_WORDS.shape[1]
VERTICAL_WORDS = _word(np.array([ccitt.VERTICAL[d] for d in range(-3, 4)]))
PASS_WORD = int(ccitt.PASS, 2) << 8 | len(ccitt.PASS)

# What the first 13 bits of a run say, as length of the run << 4 | length of the word.
NO_RUN = 4095 << 4
RUNS = np.array([[NO_RUN if found is None else found[0] << 4 | found[1] for found in table] for table in ccitt.RUNS], np.int64)
VERTICAL, PASSED, HORIZONTAL, NO_MODE = range(4)
_modes = ccitt.MODES[:: 1 << ccitt.LONGEST - 7]
_kinds = {None: NO_MODE, "pass": PASSED, "horizontal": HORIZONTAL}
KIND = np.array([_kinds.get(m and m[0], VERTICAL) for m in _modes], np.uint8)
DELTA = np.array([m[0] if m and isinstance(m[0], int) else 0 for m in _modes], np.int64)
LENGTH = np.array([m[1] if m else 0 for m in _modes], np.int64)

LEADING = np.array([8 - byte.bit_length() for byte in range(256)], np.uint8)
TRAILING = np.array([8 if not byte else (byte & -byte).bit_length() - 1 for byte in range(256)], np.uint8)
#: A byte of changes as the bits between them, if it begins white.
FILLED = np.array([sum(((byte >> 7 - i).bit_count() & 1) << 7 - i for i in range(8)) for byte in range(256)], np.uint8)


def spans(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges whose sizes add up to at most so much, or of one."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > most:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


class Changes:
    """Changes of lines that lie one after another, ``stride`` bits each.

    Three changes at the end stand for none, as in ``ccitt``. Where they would make the number of a
    line's changes odd there is one more, so the even ones of all lines turn to black.
    """

    def __init__(self, bits: np.ndarray, columns: int):
        stride = bits.shape[1]
        bits[:, columns:] = 0
        odd = np.bitwise_xor.reduce(bits, axis=1)
        bits[:, columns : columns + 3] = 1
        bits[:, columns + 3] = 1 - odd
        flags = bits.ravel().view(bool)
        self.at = np.flatnonzero(flags)
        self.before = np.zeros(flags.size + 1, np.int32)  # how many lie before a place
        np.cumsum(flags, dtype=np.int32, out=self.before[1:])
        self.first = self.before[:-1:stride].astype(np.int64)
        self.ends = self.before[columns::stride].astype(np.int64)
        self.at[self.ends + 1] -= 1
        self.at[self.ends + 2] -= 2


# --- writing ----------------------------------------------------------------------------------------


def encode_many(many: list[bytes], columns: int, k: int) -> list[bytes]:
    """``ccitt.encode`` of each."""
    if not 0 < columns <= WIDEST:
        return [ccitt.encode(data, columns, k) for data in many]
    size = (columns + 7) // 8
    most = max(1, TOGETHER // (8 * size + 8))
    pieces = []  # number of the block, its first line, the line after its last
    for n, data in enumerate(many):
        lines = -(-len(data) // size)
        pieces += [(n, first, min(first + most, lines)) for first in range(0, max(lines, 1), most)]
    out, held = [b""] * len(many), 0
    for a, b in spans([last - first + 1 for _, first, last in pieces], most):
        for (n, first, _), (found, bits) in zip(pieces[a:b], _encode(many, pieces[a:b], columns, k), strict=True):
            if first and held % 8:  # goes on within a byte
                moved = (int.from_bytes(found, "big") << 8 >> held % 8).to_bytes(len(found) + 1, "big")
                found = bytes([out[n][-1] | moved[0]]) + moved[1:]
                out[n] = out[n][:-1]
            held = bits + (held % 8 if first else 0)
            out[n] += found[: (held + 7) // 8]
    return out


def _encode(many: list[bytes], pieces: list[tuple[int, int, int]], columns: int, k: int) -> list[tuple[bytes, int]]:
    """Bits of each piece and their number; a block's last piece has its end too."""
    size = (columns + 7) // 8
    parts, ends, numbers = [], [], []
    for n, first, last in pieces:  # the line above goes first
        parts.append(many[n][(first - 1) * size : last * size] if first else b"\0" * size + many[n][: last * size])
        parts[-1] = parts[-1].ljust((last - first + 1) * size, b"\0")
        ends.append(last * size >= len(many[n]))
        numbers.append(np.arange(first - 1, last))
    lines = np.concatenate([[0], np.cumsum([len(x) for x in numbers])])
    heads, number = lines[:-1], np.concatenate(numbers)
    x = np.zeros((lines[-1], size + 1), np.uint8)
    x[:, :size] = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, size)
    x[:, size - 1] &= 0xFF << 8 * size - columns & 0xFF
    stride, flat = 8 * size + 8, x.ravel()
    turns = flat ^ flat >> 1
    turns[1:] ^= flat[:-1] << 7
    changes = Changes(np.unpackbits(turns).reshape(-1, stride), columns)

    coded = np.ones(len(x), bool)
    coded[heads] = False
    alone = coded if k == 0 else coded & (number % k == 0) if k > 0 else np.zeros(len(x), bool)
    alone, below = np.flatnonzero(alone), np.flatnonzero(coded & ~alone)
    counts = np.zeros(len(x) + 1, np.int64)
    runs = changes.ends - changes.first + 1
    counts[alone] = runs[alone]
    against = [_against(changes, below[at : at + LINES], columns, stride) for at in range(0, len(below), LINES)]
    if against:
        counts[below] = np.concatenate([n for _, n in against])
    marks = int(k >= 0)
    counts[:-1][coded] += marks
    # The end of a block stands where the head of the next is.
    end = [int(ccitt.END * 3, 2) << 8 | 3 * END_BITS] * 2 if k >= 0 else [int(ccitt.END * 2, 2) << 8 | 2 * END_BITS]
    closed = lines[1:][np.array(ends)]
    counts[closed] = len(end)
    starts = np.concatenate([[0], np.cumsum(counts)])

    words = np.empty(starts[-1], np.int64)
    for i, word in enumerate(end):
        words[starts[closed] + i] = word
    if k >= 0:
        words[starts[:-2][coded]] = 1 << 8 | END_BITS
        if k > 0:
            words[starts[below]] = 2 << 8 | END_BITS + 1
            words[starts[alone]] = 3 << 8 | END_BITS + 1
    if len(alone):
        total = np.cumsum(runs[alone])
        place = np.arange(total[-1]) - np.repeat(total - runs[alone], runs[alone])
        its = np.repeat(changes.first[alone], runs[alone]) + place
        before = changes.at.take(its - 1, mode="clip")
        before[total - runs[alone]] = alone * stride
        words[np.repeat(starts[alone] + marks, runs[alone]) + place] = RUN_WORDS.take((place & 1) * LENGTHS + changes.at[its] - before, mode="clip")
    for number, (found, n) in enumerate(against):
        its = below[number * LINES : (number + 1) * LINES]
        words[np.repeat(starts[its] + marks - np.cumsum(n) + n, n) + np.arange(len(found))] = found
    return _packed(words, starts[np.append(heads, len(x)) + 1])


def _against(changes: Changes, lines: np.ndarray, columns: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of lines against the ones above, line after line, and how many each line has.

    Each change is taken by itself, as the next one right of the change before it: pass modes are the
    pairs of changes above that lie between, ``k`` is the change above after those. A horizontal mode
    takes the next change too, so of horizontal changes in a row every second is none.
    """
    at, before = changes.at, changes.before
    n = changes.ends[lines] - changes.first[lines] + 1
    tops = np.cumsum(n) - n
    number = np.arange(n.sum())
    j = number + np.repeat(changes.first[lines] - tops, n)
    a1 = at.take(j, mode="clip")
    after = np.empty_like(a1)
    np.add(a1[:-1], 1, out=after[1:])
    after[tops] = lines * stride
    k = before.take(after - stride, mode="clip").astype(np.int64)
    k += (k ^ j) & 1
    passes = before.take(a1 - stride, mode="clip") - k
    np.maximum(passes, 0, out=passes)
    passes >>= 1
    k += passes
    k += passes
    far = a1 - at.take(k, mode="clip")
    far += 3 - stride
    words = VERTICAL_WORDS.take(far, mode="clip")
    wide = far.view(np.uint64) > 6
    fresh = np.ones(len(number), bool)
    np.logical_not(wide[:-1], out=fresh[1:])
    fresh[tops] = True
    taken = (number - np.maximum.accumulate(number * fresh)) & 1
    across = np.flatnonzero(wide > taken)
    begin = after - 1
    begin[tops] += 1
    j, one = j[across], a1[across]
    begin = np.where(passes[across], at.take(k[across] - 1, mode="clip") + stride, begin[across])
    colour = (j & 1) * LENGTHS
    two = RUN_WORDS.take(LENGTHS - colour + at.take(j + 1, mode="clip") - one, mode="clip")
    one = RUN_WORDS.take(colour + one - begin, mode="clip")
    length = two & 255
    code = ((1 << (one & 255) | one >> 8) << length) | two >> 8  # after the mode, whose last bit is one
    words[across] = code << 8 | length + (one & 255) + len(ccitt.HORIZONTAL)
    passes += 1
    passes *= 1 - taken
    ends = np.cumsum(passes)
    out = np.full(ends[-1], PASS_WORD)
    keep = np.flatnonzero(passes)
    out[ends[keep] - 1] = words[keep]
    return out, np.add.reduceat(passes, tops)


def _packed(words: np.ndarray, bounds: np.ndarray) -> list[tuple[bytes, int]]:
    """Bits of the words between bounds, and their number; each begins in a whole word of 64 bits."""
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(words & 255, out=at[1:])
    bits = np.diff(at[bounds])
    begin = np.concatenate([[0], np.cumsum((bits + 63) // 64)]) * 64
    moved = np.repeat(begin[:-1] - at[bounds[:-1]], np.diff(bounds))
    out = np.zeros(begin[-1] // 64 + 1, np.uint64)
    for first in range(0, len(words), BLOCK):
        part = words[first : first + BLOCK]
        code, start = (part >> 8).view(np.uint64), at[first : first + len(part)] + moved[first : first + BLOCK]
        cell, left = start >> 6, 64 - (start & 63) - (part & 255)
        over = np.flatnonzero(left < 0)
        spilt, rest = code[over], -left[over]
        left[over] = 0
        value = code << left.view(np.uint64)
        value[over] = spilt >> rest.view(np.uint64)
        news = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1])
        out[cell[news]] |= np.bitwise_or.reduceat(value, news)
        out[cell[over] + 1] |= spilt << (64 - rest).view(np.uint64)
    data = out.byteswap().tobytes()
    return [(data[a // 8 : a // 8 + (n + 7) // 8], n) for a, n in zip(begin.tolist(), bits.tolist(), strict=False)]


# --- reading ----------------------------------------------------------------------------------------


def decode_many(many: list[bytes], params: list[dict], most: int) -> list[bytes]:
    """``ccitt.decode`` of each."""
    alike: defaultdict[tuple[bool, int, bool], list[int]] = defaultdict(list)
    for n, own in enumerate(params):
        k, columns = int(own.get("K") or 0), int(own.get("Columns") or 1728)
        if k >= 0 and 0 < columns <= WIDEST and not own.get("EncodedByteAlign"):
            alike[k > 0, columns, bool(own.get("BlackIs1"))].append(n)
    out: dict[int, bytes] = {}
    for (mixed, columns, black), its in alike.items():
        for a, b in spans([8 * len(many[n]) for n in its], 2 * TOGETHER):
            rows = [int(params[n].get("Rows") or 0) for n in its[a:b]]
            found = _decode([many[n] for n in its[a:b]], rows, mixed, columns, black, most)
            out |= {n: data for n, data in zip(its[a:b], found, strict=True) if data is not None}
    return [out[n] if n in out else ccitt.decode(data, params[n], most) for n, data in enumerate(many)]


def _ends_of_line(data: np.ndarray) -> np.ndarray:
    """Places of ones that stand after eleven zeros or more."""
    zeros = TRAILING[data[:-1]]
    none = np.flatnonzero(data[:-1] == 0)
    zeros[none] += TRAILING[data[none - 1]]
    zeros += LEADING[data[1:]]
    found = np.flatnonzero((zeros >= END_BITS - 1) & (data[1:] != 0)) + 1
    return found * 8 + LEADING[data[found]]


def _zeros(ahead: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether at least eleven bits, 56 at most, lie between, and are zeros."""
    n = to - at
    bits = ahead.take(at >> 3, mode="clip") << (at & 7).view(np.uint64)
    return (n >= END_BITS - 1) & (n <= 56) & (bits >> (64 - np.clip(n, 1, 56)).view(np.uint64) == 0)


def _decode(many: list[bytes], rows: list[int], mixed: bool, columns: int, black: bool, most: int) -> list[bytes | None]:
    """None for a block that isn't plain."""
    size, edge = (columns + 7) // 8, b"\xff"
    joined = edge + edge.join(many) + edge * 16
    data = np.frombuffer(joined, np.uint8)
    ahead = np.ndarray((len(joined) - 8,), ">u8", joined, strides=(1,)).astype(np.uint64)  # 64 bits from each byte on
    begin = 8 * np.array([1, *accumulate(len(x) + 1 for x in many[:-1])])
    begin[1:] += 8
    end = begin + 8 * np.array([len(x) for x in many])
    marks = _ends_of_line(data)
    owner = np.searchsorted(begin, marks, "right") - 1
    inside = (owner >= 0) & (marks < end[owner])
    marks, owner = marks[inside], owner[inside]
    first = np.searchsorted(owner, np.arange(len(many)))
    last = np.searchsorted(owner, np.arange(len(many)), "right")
    closing = np.zeros(len(marks) + 1, bool)  # a mark right after which another comes
    closing[:-2] = _zeros(ahead, marks[:-1] + 1, marks[1:]) & (owner[:-1] == owner[1:]) if len(marks) > 1 else False
    closings = np.flatnonzero(closing)
    done = np.append(closings, len(marks))[np.searchsorted(closings, first)]

    wanted = np.array([min(n or 1 << 60, -(-most // size)) for n in rows])
    lines = np.where(done < last, np.minimum(done - first, wanted), wanted)
    plain = (last > first) & ((done < last) | (first + wanted < last))
    plain[plain] = _zeros(ahead, begin[plain], marks[first[plain]])
    lines[~plain] = 0
    bounds = np.concatenate([[0], np.cumsum(lines)])
    its = np.arange(bounds[-1]) + np.repeat(first - bounds[:-1], lines)
    start, limit = marks[its] + 1, marks[its + 1] if len(its) else its
    alone = np.ones(len(its), bool)
    if mixed:
        alone = ahead[start >> 3] << (start & 7).view(np.uint64) >> np.uint64(63) == 1
        start = start + 1
    top = np.zeros(len(its), bool)
    top[bounds[:-1][lines > 0]] = True

    found, good = np.empty((len(its), size), np.uint8), np.empty(len(its), bool)
    cuts = np.append(np.flatnonzero(alone | top), len(its))
    for a, b in spans(np.diff(cuts).tolist(), TOGETHER // (8 * size + 8)):
        part = slice(cuts[a], cuts[b])
        found[part], good[part] = _lines(ahead, start[part], limit[part], alone[part], top[part], columns)
    found[:, -1] &= 0xFF << 8 * size - columns & 0xFF
    if not black:
        found ^= 0xFF
        found[:, -1] &= 0xFF << 8 * size - columns & 0xFF
    white, out = ccitt._bytes([], columns, black), []
    for n, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if not plain[n] or not good[a:b].all():
            out.append(None)
            continue
        missing = rows[n] - int(b - a) if rows[n] and size * rows[n] <= most else 0
        out.append(found[a:b].tobytes() + white * missing)
    return out


def _lines(ahead: np.ndarray, start: np.ndarray, limit: np.ndarray, alone: np.ndarray, top: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of lines, one for black, and whether each was read and ended where the next begins."""
    size, numbers = (columns + 7) // 8, np.arange(len(start))
    stride = 8 * size + 8
    bits = np.zeros((len(start) + 1, stride), np.uint8)  # changes; the last line is a white one
    stop = np.zeros(len(start), np.int64)
    anchor = np.maximum.accumulate(np.where(alone | top, numbers, 0))
    depth = numbers - anchor + ~alone[anchor]
    order = np.argsort(depth, kind="stable")
    levels = np.bincount(depth)
    if len(start) < FEW * len(levels):
        return np.zeros((len(start), size), np.uint8), np.zeros(len(start), bool)
    for level, (b, n) in enumerate(zip(np.cumsum(levels).tolist(), levels.tolist(), strict=True)):
        for at in range(b - n, b, ABREAST):
            its = order[at : min(at + ABREAST, b)]
            if level:
                above = bits[np.where(top[its], len(start), its - 1)]
                bits[its], stop[its] = _two(ahead, start[its], above, columns)
            else:
                bits[its], stop[its] = _one(ahead, start[its], stride, columns)
    bits[:, columns:] = 0
    turns = np.packbits(bits[:-1, : 8 * size], axis=1)
    found = FILLED[turns]
    odd = np.bitwise_xor.accumulate(found & 1, axis=1)  # whether a byte ends black
    found[:, 1:] ^= odd[:, :-1] * np.uint8(255)
    return found, (stop > 0) & _zeros(ahead, stop, limit)


def _run(ahead: np.ndarray, at: np.ndarray, colour: np.ndarray | int, found: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Goes on with runs whose first words are ``found``: their lengths, the places after them, and whether they are runs."""
    n, at, good = found >> 4, at + (found & 15), found != NO_RUN
    more = np.flatnonzero((n >= 64) & good)
    while len(more):
        bits = ahead.take(at[more] >> 3, mode="clip") << (at[more] & 7).view(np.uint64)
        found = RUNS[colour if isinstance(colour, int) else colour[more], bits >> np.uint64(64 - ccitt.LONGEST)]
        n[more] += found >> 4
        at[more] += found & 15
        good[more] = (found != NO_RUN) & (n[more] <= 2 * most)
        more = more[(found >= 64 << 4) & good[more]]
    return n, at, good


def _one(ahead: np.ndarray, at: np.ndarray, stride: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Changes of lines coded by themselves, as bits, and where their words end (zero where they don't)."""
    count, stop = len(at), np.zeros(len(at), np.int64)
    bits = np.zeros(count * stride, np.uint8)
    lanes, place = np.arange(count), np.arange(count) * stride
    end, colour, first = place + columns, 0, True
    while len(lanes):
        found = RUNS[colour].take((ahead.take(at >> 3, mode="clip") << (at & 7).view(np.uint64) >> np.uint64(64 - ccitt.LONGEST)).view(np.int64), mode="clip")
        n, wrong = found >> 4, found < 16 if not first else np.zeros(len(found), bool)
        more = np.flatnonzero(found >= 64 << 4)
        at += found & 15
        if len(more):
            n[more], at[more], good = _run(ahead, at[more] - (found[more] & 15), colour, found[more], columns)
            wrong[more] = ~good
        place = np.minimum(place + n, end)
        bits[place] = 1
        open_ = (place < end) & ~wrong
        keep = np.flatnonzero(open_)
        if len(keep) < len(lanes):
            done = np.flatnonzero(~open_ & ~wrong)
            stop[lanes[done]] = at[done]
            lanes, at, place, end = lanes[keep], at[keep], place[keep], end[keep]
        colour, first = 1 - colour, False
    return bits.reshape(count, stride), stop


def _two(ahead: np.ndarray, at: np.ndarray, above: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``_one``, of lines coded against the ones above; ``after`` is where the next change may lie."""
    count, stride = above.shape
    changes, stop = Changes(above, columns), np.zeros(count, np.int64)
    turns, before = changes.at, changes.before
    bits = np.zeros(count * stride, np.uint8)
    lanes, after = np.arange(count), np.arange(count) * stride
    end, colour = after + columns, np.zeros(count, np.int64)
    while len(lanes):
        word = ahead.take(at >> 3, mode="clip") << (at & 7).view(np.uint64)
        mode = (word >> np.uint64(57)).view(np.int64)
        kind = KIND.take(mode, mode="clip")
        k = before.take(after, mode="clip").astype(np.int64)
        k += (k ^ colour) & 1
        place = turns.take(k, mode="clip")
        place += DELTA.take(mode, mode="clip")
        at += LENGTH.take(mode, mode="clip")
        other = np.flatnonzero(kind != VERTICAL)
        passed = other[:0]
        if len(other):
            its = kind[other]
            across, passed = other[np.flatnonzero(its == HORIZONTAL)], other[np.flatnonzero(its == PASSED)]
            place[across], at[across] = _across(ahead, bits, word[across], at[across], after[across], end[across], colour[across], columns)
            place[other[np.flatnonzero(its == NO_MODE)]] = -1
            later = turns.take(k[passed] + 1, mode="clip")
            place[passed] = end[passed]
        bits[place] = 1
        place[passed] = later if len(passed) else 0
        colour ^= kind == VERTICAL
        right = place >= after
        open_ = place < end
        if not right.all():
            open_ &= right
        keep = np.flatnonzero(open_)
        if len(keep) < len(lanes):
            done = np.flatnonzero(~open_ & right)
            stop[lanes[done]] = at[done]
            lanes, at, place, end, colour = lanes[keep], at[keep], place[keep], end[keep], colour[keep]
        after = place + 1
    return bits.reshape(count, stride), stop


def _across(
    ahead: np.ndarray, bits: np.ndarray, word: np.ndarray, at: np.ndarray, after: np.ndarray, end: np.ndarray, colour: np.ndarray, columns: int
) -> tuple[np.ndarray, np.ndarray]:
    """Two runs after a horizontal mode: sets the change between them, and gives the one after them (-1 if they are no runs) and where their words end."""
    begin = np.maximum(after - 1, end - columns)
    rest = word << np.uint64(len(ccitt.HORIZONTAL))
    colours = (colour << ccitt.LONGEST).view(np.uint64)
    found = RUNS.take((rest >> np.uint64(64 - ccitt.LONGEST) | colours).view(np.int64), mode="clip")
    rest <<= (found & 15).view(np.uint64)
    again = RUNS.take((rest >> np.uint64(64 - ccitt.LONGEST) | colours ^ np.uint64(1 << ccitt.LONGEST)).view(np.int64), mode="clip")
    one, two, stop = found >> 4, again >> 4, at + (found & 15) + (again & 15)
    wrong = np.zeros(len(at), bool)
    long = np.flatnonzero((found >= 64 << 4) | (again >= 64 << 4))
    if len(long):  # runs of several words, or none
        one[long], stop[long], good = _run(ahead, at[long], colour[long], found[long], columns)
        rest = ahead.take(stop[long] >> 3, mode="clip") << (stop[long] & 7).view(np.uint64)
        again = RUNS[colour[long] ^ 1, (rest >> np.uint64(64 - ccitt.LONGEST)).view(np.int64)]
        two[long], stop[long], fine = _run(ahead, stop[long], colour[long] ^ 1, again, columns)
        wrong[long] = ~(good & fine)
    middle = np.minimum(begin + one, end)
    place = np.minimum(middle + two, end)
    wrong |= (one == 0) & (after > end - columns) | (two == 0) & (place < end)
    bits[middle] = 1
    place[np.flatnonzero(wrong)] = -1
    return place, stop
