"""PDF functions: sampled, exponential, stitching and calculator."""

from __future__ import annotations

import math

from .document import Document
from .syntax import Keyword, Lexer, Stream

MAX_DEPTH = 16


def clamp(x: float, low: float, high: float) -> float:
    return min(max(x, low), high)


def evaluate(doc: Document, function, inputs: list[float], depth: int = 0) -> list[float]:
    """Outputs of a function object; an unknown kind gives none."""
    value = doc.get(function)
    held = value.dict if isinstance(value, Stream) else value if isinstance(value, dict) else {}
    if depth > MAX_DEPTH:
        return []
    numbers = lambda key: [float(x) for x in map(doc.get, doc.list_of(held.get(key))) if isinstance(x, (int, float))]
    domain, codomain, kind = numbers("Domain"), numbers("Range"), doc.get(held.get("FunctionType"))
    x = [clamp(v, *domain[2 * i : 2 * i + 2]) if len(domain) >= 2 * i + 2 else v for i, v in enumerate(inputs)]
    if kind == 0 and isinstance(value, Stream):
        out = _sampled(doc, value, held, x, domain, codomain, numbers)
    elif kind == 2:
        low, high = (domain + [0.0, 1.0])[:2] if len(domain) >= 2 else (0.0, 1.0)
        # The variable runs from 0 to 1 over the domain.
        at = (x[0] - low) / (high - low) if high > low else 0.0
        n, c0, c1 = doc.get(held.get("N")) or 1, numbers("C0") or [0.0], numbers("C1") or [1.0]
        out = [a + at**n * (b - a) for a, b in zip(c0, c1, strict=False)]
    elif kind == 3:
        out = _stitched(doc, held, x[0], domain, numbers, depth)
    elif kind == 4 and isinstance(value, Stream):
        out = calculate(doc.decoded(value), x)
    else:
        return []
    return [clamp(v, *codomain[2 * i : 2 * i + 2]) if len(codomain) >= 2 * i + 2 else v for i, v in enumerate(out)]


def _sampled(doc: Document, stream: Stream, held: dict, x: list[float], domain: list[float], codomain: list[float], numbers) -> list[float]:
    """Multilinear interpolation between samples; the first input varies fastest."""
    size, bits, n = [int(s) for s in numbers("Size")], doc.get(held.get("BitsPerSample")), len(codomain) // 2
    if not size or bits not in (1, 2, 4, 8, 12, 16, 24, 32) or not n or len(x) < len(size) or len(domain) < 2 * len(size):
        return []
    encode = numbers("Encode") or [v for s in size for v in (0.0, s - 1.0)]
    decode = numbers("Decode") or codomain
    data = doc.decoded(stream)
    whole = int.from_bytes(data, "big")

    def sample(place: list[int], j: int) -> float:
        at, step = 0, 1
        for p, s in zip(place, size, strict=True):
            at, step = at + p * step, step * s
        first = (at * n + j) * bits
        shift = 8 * len(data) - first - bits
        raw = whole >> shift & (1 << bits) - 1 if shift >= 0 else 0
        return decode[2 * j] + raw * (decode[2 * j + 1] - decode[2 * j]) / ((1 << bits) - 1)

    corners: list[tuple[list[int], float]] = [([], 1.0)]
    for i, s in enumerate(size):
        low, high = domain[2 * i : 2 * i + 2]
        at = encode[2 * i] + (x[i] - low) * (encode[2 * i + 1] - encode[2 * i]) / (high - low) if high > low else encode[2 * i]
        at = clamp(at, 0.0, s - 1.0)
        below = min(int(at), max(s - 2, 0))
        part = at - below
        corners = [([*c, below + k], w * (part if k else 1 - part)) for c, w in corners for k in (0, 1) if (part if k else 1 - part) > 0]
    return [sum(w * sample(c, j) for c, w in corners) for j in range(n)]


def _stitched(doc: Document, held: dict, x: float, domain: list[float], numbers, depth: int) -> list[float]:
    parts, bounds, encode = doc.list_of(held.get("Functions")), numbers("Bounds"), numbers("Encode")
    if not parts or len(domain) < 2 or len(bounds) < len(parts) - 1 or len(encode) < 2 * len(parts):
        return []
    k = sum(x >= b for b in bounds[: len(parts) - 1])
    edges = [domain[0], *bounds[: len(parts) - 1], domain[1]]
    low, high, a, b = edges[k], edges[k + 1], encode[2 * k], encode[2 * k + 1]
    at = a + (x - low) * (b - a) / (high - low) if high > low else a
    return evaluate(doc, parts[k], [at], depth + 1)


def _program(tokens: list) -> list:
    """Nested lists for braces."""
    out: list = []
    while tokens:
        t = tokens.pop()
        if t == b"{":
            out.append(_program(tokens))
        elif t == b"}":
            break
        else:
            out.append(t)
    return out


def _tokens(source: bytes) -> list:
    out = []
    for word in source.replace(b"{", b" { ").replace(b"}", b" } ").split():
        if word in (b"{", b"}"):
            out.append(word)
            continue
        value = Lexer(word).read()
        out.append(bytes(value) if isinstance(value, Keyword) else value)
    return out[::-1]


def _int(a) -> int:
    return int(a)


ONE = {
    b"abs": abs, b"neg": lambda a: -a, b"ceiling": math.ceil, b"floor": math.floor, b"round": lambda a: math.floor(a + 0.5), b"truncate": math.trunc,
    b"sqrt": lambda a: math.sqrt(max(a, 0.0)), b"sin": lambda a: math.sin(math.radians(a)), b"cos": lambda a: math.cos(math.radians(a)),
    b"ln": lambda a: math.log(a) if a > 0 else 0.0, b"log": lambda a: math.log10(a) if a > 0 else 0.0, b"cvi": math.trunc, b"cvr": float,
    b"not": lambda a: not a if isinstance(a, bool) else ~_int(a),
}
TWO = {
    b"add": lambda a, b: a + b, b"sub": lambda a, b: a - b, b"mul": lambda a, b: a * b, b"div": lambda a, b: a / b if b else 0.0,
    b"idiv": lambda a, b: math.trunc(a / b) if b else 0, b"mod": lambda a, b: math.fmod(a, b) if b else 0, b"exp": lambda a, b: a**b if a > 0 or b == int(b) and (a or b > 0) else 0.0,
    b"atan": lambda a, b: math.degrees(math.atan2(a, b)) % 360, b"eq": lambda a, b: a == b, b"ne": lambda a, b: a != b, b"gt": lambda a, b: a > b,
    b"ge": lambda a, b: a >= b, b"lt": lambda a, b: a < b, b"le": lambda a, b: a <= b, b"and": lambda a, b: a & b, b"or": lambda a, b: a | b, b"xor": lambda a, b: a ^ b,
    b"bitshift": lambda a, b: _int(a) << min(_int(b), 64) if b >= 0 else _int(a) >> min(-_int(b), 64),
}


def calculate(source: bytes, inputs: list[float]) -> list[float]:
    """The stack that a calculator program leaves; too few operands end it."""
    stack: list = list(inputs)

    def run(program: list) -> None:
        for i, t in enumerate(program):
            if isinstance(t, list):
                continue
            if not isinstance(t, bytes):
                stack.append(t)
            elif t in ONE:
                stack.append(ONE[t](stack.pop()))
            elif t in TWO:
                b, a = stack.pop(), stack.pop()
                stack.append(TWO[t](a, b))
            elif t in (b"true", b"false"):
                stack.append(t == b"true")
            elif t == b"pop":
                stack.pop()
            elif t == b"exch":
                stack[-1], stack[-2] = stack[-2], stack[-1]
            elif t == b"dup":
                stack.append(stack[-1])
            elif t == b"copy":
                n = _int(stack.pop())
                stack.extend(stack[len(stack) - n :] if 0 < n <= len(stack) else [])
            elif t == b"index":
                stack.append(stack[-1 - _int(stack.pop())])
            elif t == b"roll":
                by, n = _int(stack.pop()), _int(stack.pop())
                if 0 < n <= len(stack):
                    part = stack[-n:]
                    stack[-n:] = part[-by % n :] + part[: -by % n]
            elif t == b"if":
                if stack.pop():
                    run(program[i - 1])
            elif t == b"ifelse":
                run(program[i - 2] if stack.pop() else program[i - 1])

    try:
        program = _program(_tokens(source))
        run(program[0] if program and isinstance(program[0], list) else program)
    except (IndexError, TypeError, OverflowError):
        return []
    return [float(v) for v in stack]
