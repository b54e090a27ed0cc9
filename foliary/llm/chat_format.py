"""Chat transcripts to canonical turns: a hidden Markov model recovers who speaks.

The hidden states are the roles; the observations are lines of text with a speaker marker (from
the line's own prefix, such as "User:", or else the role recorded with its row), whether the line
begins a row or is marked itself, its length and its punctuation. The model's tables are smoothed
counts over all rows with a recognised marker, gathered by partial aggregation into a table of
bounded size. Viterbi finds the most likely roles of each conversation's lines, and successive
lines of one role in one row become a turn of the canonical form.

Words that often begin a plain line as well ("Result:", "Model:") are markers only in rows without
a known role. A marker's text goes only where the decoded role is the one it names; nothing else of
a text is dropped.

Rows are dealt by ranges of (conversation, turn, role, text hash) that drawn keys cut, so one
conversation with a third of all rows spreads over many tasks. Decoding is exact in any length:
every range that a conversation runs through gives the best scores from each role before it to
each role at its end, the driver composes these 4 x 4 tables, a few for each range, into the roles
at the cuts, and each range is decoded between its fixed ends. Scores are integers and ties go to
the path that one pass would take, so the result doesn't depend on the cuts.

Edge cases: a null or empty text is one empty line; null conv_id and turn sort first and are keys
like any other (a null turn counts as number zero); rows with one conversation and turn are
ordered by role and a hash of the text; repeated rows are all rendered; an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, texts_of

ROLES = ("system", "user", "assistant", "tool")
UNMARKED = len(ROLES)
#: Codes of markers: a role's, none, and from here on those that are hints only.
HINT = UNMARKED + 1
#: Bytes of text for each range, at most about so many beside one row's.
RANGE_BYTES = 24 << 20
#: Keys drawn for each range to find the cuts: what the driver holds grows with the ranges only.
DRAWN = 20

# Names that speakers go by, those that begin plain lines too, and words of the sort.
ALIASES = {
    "system": "system instruction instructions developer",
    "user": "user human person customer client question q prompt me you student visitor usuario utilisateur nutzer",
    "assistant": "assistant ai bot chatbot model gpt answer a response agent support teacher asistente",
    "tool": "tool function observation result output",
}
CERTAIN = frozenset("system user human assistant ai bot chatbot tool usuario utilisateur nutzer asistente".split())
NAMES = {name: i for i, role in enumerate(ROLES) for name in ALIASES[role].split()}
MARKER = re.compile(
    r"\s*(?:<\|(?:im_start\|>)?\s*([A-Za-z]+)\s*(?:\|>)?|\[([A-Za-z]+)\]|#{1,4}\s*([A-Za-z]+)\s*:?(?=\s*$)|\*{0,2}([A-Za-z]+)\*{0,2}\s*:\*{0,2})[ \t]*"
)
TURN_SCHEMA = "conv_id long, turn long, part int, role string, content string, rendered string"
#: Buckets: length (5) x ends with a question mark (2) x looks like code or a list (2).
SHAPES = 20
#: Chance that a marker, or a hint, names the role of its line.
TRUST, HINTED = 0.98, 0.6
#: Scores are logarithms in units of 2 ** -20.
UNIT = 1 << 20


def marker_of(line: str) -> tuple[int, bool, int]:
    """The role that a line's prefix names or ``UNMARKED``, whether it is certain, and the prefix's length."""
    m = MARKER.match(line) if line[:1] in "<[#* \t" or ":" in line[:40] else None
    if m:
        name = next(g for g in m.groups() if g).lower()
        if name in NAMES:
            return NAMES[name], m[4] is None or name in CERTAIN, m.end()
    return UNMARKED, False, 0


def shape_of(line: str) -> int:
    size = len(line)
    length = 0 if size < 40 else 1 if size < 120 else 2 if size < 300 else 3 if size < 700 else 4
    tail = line.rstrip()
    listed = tail.lstrip()[:2] in ("- ", "* ", "1.", "2.", "3.", "``", ">>")
    return 4 * length + 2 * tail.endswith("?") + listed


class Seen:
    """A line: its marker code, whether it begins a turn, its shape, and the role and length of its prefix."""

    __slots__ = ("mark", "begins", "shape", "names", "prefix", "line")

    def __init__(self, line: str, first: bool, recorded: int):
        role, certain, prefix = marker_of(line)
        if recorded != UNMARKED and not certain:
            role, prefix = UNMARKED, 0  # a row whose speaker is known: plain text
        self.line, self.names, self.prefix = line, role, prefix
        self.mark = role if certain or role == UNMARKED else HINT + role
        self.begins = int(first or role != UNMARKED)  # a marker in the text begins a turn like a row does
        if first and self.mark == UNMARKED:
            self.mark = recorded
        self.shape = shape_of(line[prefix:])

    def code(self) -> bytes:
        return bytes((self.mark, self.begins, self.shape))


def observe(role: str | None, text: str | None) -> list[Seen]:
    """Each line of a row."""
    recorded = NAMES.get((role or "").strip().lower(), UNMARKED)
    return [Seen(line, not k, recorded) for k, line in enumerate((text or "").split("\n"))]


class Model:
    """Log-probabilities of an HMM over roles, as integers; from tables of counts plus one."""

    def __init__(self, starts: np.ndarray, moves: np.ndarray, shapes: np.ndarray):
        n = len(ROLES)
        whole = lambda p: np.rint(np.log(p) * UNIT).astype(np.int64)
        self.start = whole((starts + 1) / (starts.sum() + n))
        # moves[b]: from role to role where the next line begins a turn (1) or not (0).
        moves = moves + np.stack([np.eye(n) * 50 + 0.1, np.ones((n, n))])
        self.move = whole(moves / moves.sum(2, keepdims=True))
        # shapes[b]: of a role's line at the beginning of a turn (1) or further on (0).
        shapes = shapes + 1
        shape = whole(shapes / shapes.sum(2, keepdims=True))
        named = lambda trust: np.where(np.eye(n) > 0, trust, (1 - trust) / (n - 1))
        mark = whole(np.vstack([named(TRUST), np.ones((1, n)), named(HINTED)]))
        # emit[mark, begins, shape] has a score for each role.
        self.emit = mark[:, None, None, :] + np.moveaxis(shape, 1, 2)[None]

    def viterbi(self, lines: list[tuple[int, int, int]], before: int | None = None, after: int | None = None) -> list[int]:
        """The most likely role of each line, given the role of the line before and of the last one, if fixed.

        Of equally likely paths, the one with the least role at the last place where they differ.
        """
        if not lines:
            return []
        m, b, s = lines[0]
        best, back = (self.start if before is None else self.move[b][before]) + self.emit[m, b, s], []
        for m, b, s in lines[1:]:
            paths = best[:, None] + self.move[b]
            back.append(paths.argmax(0))
            best = paths.max(0) + self.emit[m, b, s]
        role = int(best.argmax()) if after is None else after
        out = [role]
        for b in reversed(back):
            role = int(b[role])
            out.append(role)
        return out[::-1]

    def opening(self, lines: list[tuple[int, int, int]]) -> np.ndarray:
        """The best score of a conversation's beginning for each role of its last line."""
        m, b, s = lines[0]
        best = self.start + self.emit[m, b, s]
        for m, b, s in lines[1:]:
            best = (best[:, None] + self.move[b]).max(0) + self.emit[m, b, s]
        return best

    def transfer(self, lines: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """best[i, s]: the best score of these lines after a role i, ending in s; and how such paths rank.

        rank[s, i] is smaller for the path that ``viterbi`` prefers if total scores are equal.
        """
        m, b, s = lines[0]
        n = len(ROLES)
        best, rank = self.move[b] + self.emit[m, b, s], np.tile(np.arange(n), (n, 1))
        each = np.arange(n)
        for m, b, s in lines[1:]:
            paths = best[:, :, None] + self.move[b]  # from i over r to s
            over = paths.argmax(1)  # [i, s]
            best = paths.max(1) + self.emit[m, b, s]
            key = over.T * n + rank[over.T, each[None, :]]  # [s, i]
            rank = key.argsort(1, kind="stable").argsort(1, kind="stable")
        return best, rank


def join_ranges(pieces: list[tuple[np.ndarray, np.ndarray | None]]) -> list[int]:
    """The roles at the cuts of a conversation, from its opening scores and the transfer tables that follow."""
    score, back = pieces[0][0], []
    for best, rank in pieces[1:]:
        paths = score[:, None] + best
        top = paths.max(0)
        back.append(np.where(paths == top, rank.T, len(ROLES)).argmin(0))
        score = top
    role, out = int(score.argmax()), []
    for b in reversed(back):
        role = int(b[role])
        out.append(role)
    return out[::-1]


ORDER = ("conv_id", "number", "speaker", "hash", "salt")


def keyed(turns: DataFrame) -> DataFrame:
    """Rows with the key of their place; ``salt`` parts repeated rows, so that they can be cut too."""
    text = F.coalesce("text", F.lit(""))
    return pick(turns, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("number"),
        F.coalesce("role", F.lit("")).alias("speaker"),
        F.xxhash64(text, F.col("turn"), F.col("role")).alias("hash"),
        F.monotonically_increasing_id().alias("salt"),
        F.col("turn").cast("long").alias("turn"),
        "role",
        "text",
    )


def sortable(conv_id: int | None, *rest) -> tuple:
    """A key that Python orders as Spark does: null first."""
    return (conv_id is not None, conv_id or 0, *rest)


def cuts(rows: DataFrame, ranges: int | None) -> list[tuple]:
    """Sorted keys, each the first of a range, from keys drawn by their hash."""
    total, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    ranges = ranges or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // RANGE_BYTES))
    share = min(1.0, DRAWN * ranges / max(total, 1))
    drawn = F.pmod(F.xxhash64(*ORDER), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)
    found = sorted(sortable(*r) for r in rows.select(*ORDER).filter(drawn).collect())
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []


def deal(rows: DataFrame, bounds: list[tuple]) -> DataFrame:
    """Rows of each range in a partition, in order."""
    sent = rows.sparkSession.sparkContext.broadcast(bounds)  # at most a key for each range

    @F.arrow_udf("int")
    def place(conv_id: pa.Array, number: pa.Array, speaker: pa.Array, hashed: pa.Array, salt: pa.Array) -> pa.Array:
        keys = zip(*[c.to_pylist() for c in (conv_id, number, speaker, hashed, salt)], strict=True)
        return pa.array([bisect_right(sent.value, sortable(*k)) for k in keys], pa.int32())

    placed = rows.withColumn("range", place(*ORDER))
    return placed.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", *ORDER)


def codes(rows: DataFrame) -> DataFrame:
    """The place of each row with three bytes for each of its lines, in place of its text."""
    schema = "conv_id long, number long, speaker string, hash long, salt long, seen binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(5), batch.column(6), strict=True)
            seen = [b"".join([x.code() for x in observe(r.as_py(), t.as_py())]) for r, t in both]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seen, pa.binary())], names=[*ORDER, "seen"])

    return texts_of(rows, *ORDER, "role", "text").mapInArrow(run, schema)


def segments(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, int | None, list[tuple]]]:
    """(range, conv_id, rows) for each conversation's rows in each range, from sorted batches."""
    key, rows = None, []
    for batch in batches:
        found = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("range", "conv_id", *columns)]
        for at, conv, *row in zip(*found, strict=True):
            if rows and (at, conv) != key:
                yield *key, rows
                rows = []
            key = (at, conv)
            rows.append(row)
    if rows:
        yield *key, rows


def _lines(rows: list) -> list[tuple[int, int, int]]:
    joined = b"".join([r[0] for r in rows])
    return list(zip(joined[::3], joined[1::3], joined[2::3], strict=True))


def _batch(rows: list[tuple], names: list[str], kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


COUNTED = "what string, a long, b long, c long, n long"


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of starts, moves and shapes over lines whose role is marked, one batch for a task.

    What lies on either side of a range's edges is told as it is: ("edge", range, first or last, ...).
    """
    counts: dict[tuple, int] = {}
    edges: dict[int, list] = {}
    for at, conv, rows in segments(batches, ["seen"]):
        before, opens = None, True
        for (seen,) in rows:
            role = UNMARKED
            for mark, begins, shape in zip(seen[::3], seen[1::3], seen[2::3], strict=True):
                role = mark if mark < UNMARKED else role
                known = None if role == UNMARKED else role
                keys = [] if known is None else [("shape", begins, role, shape)]
                if opens:
                    if at not in edges:
                        edges[at] = [conv, begins, known]  # the range before may hold the beginning
                    elif known is not None:
                        keys.append(("start", 0, 0, role))
                elif before is not None and known is not None:
                    keys.append(("move", begins, before, role))
                for k in keys:
                    counts[k] = counts.get(k, 0) + 1
                before, opens = known, False
        edges[at][3:] = [conv, before]
    code = lambda x: UNMARKED if x is None else x
    rows = [(*k, n) for k, n in counts.items()]
    for at, (conv, begins, known, last, role) in edges.items():
        rows += [("first", at, conv, begins, code(known)), ("last", at, last, 0, code(role))]
    yield _batch(rows, ["what", "a", "b", "c", "n"], (pa.string(), *[pa.int64()] * 4))


def learn(dealt: DataFrame) -> Model:
    """From the sums of all tasks' counts: at most 4 + 32 + 160 rows, and two for each range, reach the driver."""
    found = dealt.mapInArrow(count, COUNTED)
    inner = found.filter("what not in ('first', 'last')").groupBy("what", "a", "b", "c").agg(F.sum("n").alias("n"))
    rows = cut(inner.unionByName(found.filter("what in ('first', 'last')")), "chat-counts").collect()
    n = len(ROLES)
    starts, moves, shapes = np.zeros(n), np.zeros((2, n, n)), np.zeros((2, n, SHAPES))
    first, last = {}, {}
    for what, a, b, c, k in rows:
        if what == "start":
            starts[c] += k
        elif what == "move":
            moves[a, b, c] += k
        elif what == "shape":
            shapes[a, b, c] += k
        else:
            (first if what == "first" else last)[a] = (b, c, k)
    held = None
    for at in sorted(first):
        conv, begins, role = first[at]
        if held is None or held[0] != conv:
            if role != UNMARKED:
                starts[role] += 1
        elif held[2] != UNMARKED and role != UNMARKED:
            moves[begins, held[2], role] += 1
        held = last[at]
    return Model(starts, moves, shapes)


def fixed_ends(dealt: DataFrame, model: Model) -> dict[int, list[int | None]]:
    """For each range that a conversation runs into or out of: the roles before its first and of its last line."""
    sent = dealt.sparkSession.sparkContext.broadcast(model)
    n = len(ROLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for at, conv, rows in segments(batches, ["seen"]):
            if at not in held:
                best, rank = sent.value.transfer(_lines(rows))
                opening = sent.value.opening(_lines(rows))
                held[at] = [(at, conv, True, [*opening.tolist(), *best.ravel().tolist(), *rank.ravel().tolist()]), None]
            else:
                held[at][1] = (at, conv, rows)
        rows = []
        for head, tail in held.values():
            rows.append(head)
            if tail:
                rows.append((tail[0], tail[1], False, sent.value.opening(_lines(tail[2])).tolist()))
        kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
        yield _batch(rows, ["range", "conv_id", "head", "scores"], kinds)

    found = dealt.mapInArrow(run, "range int, conv_id long, head boolean, scores array<long>").collect()  # two for each range
    ends: dict[int, list[int | None]] = {}
    chain: list[tuple[int, np.ndarray, np.ndarray | None]] = []
    conv: tuple = ()

    def close() -> None:
        for (left, *_), (right, *_), role in zip(chain, chain[1:], join_ranges([c[1:] for c in chain]) if len(chain) > 1 else [], strict=False):
            ends.setdefault(left, [None, None])[1] = role
            ends.setdefault(right, [None, None])[0] = role

    for at, mine, head, scores in sorted(found, key=lambda r: (r["range"], not r["head"])):
        table = np.array(scores, np.int64)
        if head and chain and conv == (mine,):
            chain.append((at, table[n : n + n * n].reshape(n, n), table[n + n * n :].reshape(n, n)))
            continue
        close()
        chain, conv = [(at, table[:n], None)], (mine,)
    close()
    return ends


def render(role: str, content: str) -> str:
    return f"<|{role}|>\n{content}\n<|end|>\n"


def decode(model: Model, rows: list[list], conv: int | None, before: int | None = None, after: int | None = None) -> Iterator[tuple]:
    """Canonical turns of a conversation's rows (turn, role, text)."""
    seen = [observe(role, text) for _, role, text in rows]
    roles = iter(model.viterbi([(x.mark, x.begins, x.shape) for lines in seen for x in lines], before, after))
    for (turn, _, _), lines in zip(rows, seen, strict=True):
        part, parts = -1, []
        for x in lines:
            role = next(roles)
            # A marker opens a turn of its own even after the same role, if it is what it says.
            marked = x.names != UNMARKED and x.names == role
            if part < 0 or marked or parts[-1][0] != role:
                part += 1
                parts.append((role, []))
            parts[-1][1].append(x.line[x.prefix :] if marked else x.line)
        for part, (role, content) in enumerate(parts):
            text = "\n".join(content)
            yield conv, turn, part, ROLES[role], text, render(ROLES[role], text)


def format_chats(turns: DataFrame, ranges: int | None = None) -> DataFrame:
    """Canonical turns: conv_id, turn, part within the row, role, content and rendered form.

    ``ranges`` defaults to the shuffle partitions, or more if the texts are large.
    """
    rows = keyed(turns)
    bounds = cuts(rows, ranges)
    seen = deal(cut(codes(rows), "chat-codes"), bounds)
    model = learn(seen)
    sent = turns.sparkSession.sparkContext.broadcast((model, fixed_ends(seen, model)))  # under 2000 numbers, and two for each range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
        names = ["conv_id", "turn", "part", "role", "content", "rendered"]
        model, ends = sent.value
        done: list[tuple] = []
        last = None
        pending: tuple | None = None

        def settle(segment: tuple, first: bool, final: bool) -> None:
            at, conv, mine = segment
            before, after = ends.get(at, (None, None))
            done.extend(decode(model, mine, conv, before if first else None, after if final else None))

        first = False
        for segment in segments(batches, ["turn", "role", "text"]):
            if pending:
                settle(pending, first, segment[0] != pending[0])
            first, last, pending = segment[0] != last, segment[0], segment
            while len(done) >= 2000:
                yield _batch(done[:2000], names, kinds)
                del done[:2000]
        if pending:
            settle(pending, first, True)
        for k in range(0, len(done), 2000):
            yield _batch(done[k : k + 2000], names, kinds)

    return texts_of(deal(rows, bounds), "*").mapInArrow(run, TURN_SCHEMA)
