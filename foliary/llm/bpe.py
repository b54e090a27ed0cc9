"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Each Arrow batch is a shard of the corpus: its distinct words are laid out as one chain of byte
symbols, an inverted index maps each mergeable rank to the positions where it applies, and merges
are applied in rank order over the whole shard, touching only the merged symbols' neighbours.
Words do not interact, so shards give the ids that the corpus as a whole would give.

Edge cases: a null text counts as empty; an empty text has no ids, and the digests of the empty
string; unpaired surrogates cannot occur in Spark strings; repeated rows are encoded alike; other
columns are never read. The vocabulary file is read on the driver and broadcast: it is a
fixed file of under 1 MB, whatever the size of the data.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, texts_of

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Bytes of words and their ids that a Python worker remembers, with what Python adds to each.
REMEMBERED, EACH = 64 << 20, 150
#: UTF-8 bytes of the texts that are taken at a time; one longer text makes a slice of its own.
SLICE = 4 << 20
#: Characters of a text beyond which its words are made one by one, not as a list.
LISTED = 1 << 20

# The letters and digits below U+0100, and white space there.
LATIN_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
LATIN_NUMBERS = "0-9²³¹¼½¾"
LATIN_SPACE = " \t\n\x0b\x0c\r\x85\xa0"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Pretokenizer:
    """Matches of ``pattern``; texts within Latin-1 take an equivalent of it for the stdlib engine."""

    def __init__(self, pattern: str):
        import regex

        self.general = regex.compile(pattern)
        narrow = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{LATIN_SPACE}{LATIN_LETTERS}{LATIN_NUMBERS}]")
        narrow = narrow.replace(r"\p{L}", f"[{LATIN_LETTERS}]").replace(r"\p{N}", f"[{LATIN_NUMBERS}]")
        narrow = narrow.replace(r"\s", f"[{LATIN_SPACE}]").replace(r"\S", f"[^{LATIN_SPACE}]")
        self.narrow = None if r"\p" in narrow else re.compile(narrow)
        self.beyond = re.compile("[^\x00-\xff]").search

    def __call__(self, text: str) -> Iterable[str]:
        found = self.narrow if self.narrow and not self.beyond(text) else self.general
        if len(text) > LISTED:
            return (m.group() for m in found.finditer(text))
        return found.findall(text)


class MergeReplay:
    """Encodes sets of words by replaying merges over all of them at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of = {v: k for k, v in ranks.items()}
        self.named = {r: str(r) for r in self.of}.__getitem__
        self.byte = [ranks[bytes([i])] for i in range(256)]
        # Every way to make a token of two others, under one number for the pair.
        self.pairs = {
            ranks[token[:k]] << 24 | ranks[token[k:]]: r
            for token, r in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        }

    def encode(self, words: list[bytes], shard: int = 8_000) -> list[list[int]]:
        """Ids of each word; ``shard`` words are laid out at a time, which keeps to the CPU's cache."""
        return [ids for at in range(0, len(words), shard) for ids in self._replay(words[at : at + shard])]

    def _replay(self, words: list[bytes]) -> list[list[int]]:
        byte, known, rank = self.byte, self.ranks, self.pairs.get
        push, pop = heapq.heappush, heapq.heappop
        symbols: list[int] = []
        starts: list[int] = []
        for w in words:
            starts.append(len(symbols))
            r = known.get(w)
            if r is not None:
                symbols.append(r)
            else:
                symbols.extend([byte[c] for c in w])
        n = len(symbols)
        # A word's ends are marked by links to n, which holds no symbol.
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # The rank at which a symbol and the one after it merge; None where they don't.
        worth = [rank(a << 24 | b) for a, b in zip(symbols, symbols[1:], strict=False)]
        worth.extend([None] * (n - len(worth)))
        for s in starts:
            if s < n:
                before[s] = n
            if s:
                after[s - 1], worth[s - 1] = n, None
        index: dict[int, list[int]] = {}
        for i, r in enumerate(worth):
            if r is not None:
                if r in index:
                    index[r].append(i)
                else:
                    index[r] = [i]
        heap = list(index)
        heapq.heapify(heap)

        def enter(r: int, places: list[int]) -> None:
            if r in index:
                index[r].extend(places)
            else:
                index[r] = places
                push(heap, r)

        while heap:
            now = pop(heap)
            places = index.pop(now, None)
            if not places:
                continue
            places.sort()
            for k, i in enumerate(places, 1):
                if worth[i] != now:  # a symbol went or changed since the position was indexed
                    continue
                j = after[i]
                h = after[i] = after[j]
                symbols[i], symbols[j], worth[j] = now, -1, None
                early = False
                if h != n:
                    before[h] = i
                    r = worth[i] = rank(now << 24 | symbols[h])
                    if r is not None:
                        enter(r, [i])
                        early = r < now
                else:
                    worth[i] = None
                g = before[i]
                if g != n:
                    r = worth[g] = rank(symbols[g] << 24 | now)
                    if r is not None:
                        enter(r, [g])
                        early = early or r < now
                if early:
                    # The merge made an earlier one possible: that one goes first in its word.
                    if rest := places[k:]:
                        enter(now, rest)
                    break
        ends = [*starts[1:], n]
        return [[x for x in symbols[s:e] if x >= 0] for s, e in zip(starts, ends, strict=True)]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.of.__getitem__, ids))


class Held:
    """Ids of words, packed as 32-bit numbers, of the words asked for last: two halves of ``REMEMBERED`` bytes.

    When the newer half is full the older one is forgotten, so frequent words stay.
    """

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def put(self, word: str, packed: bytes) -> None:
        if self.size > REMEMBERED // 2:
            self.new, self.old, self.size = {}, self.new, 0
        self.new[word] = packed
        self.size += len(word) + len(packed) + EACH

    def get(self, word: str) -> bytes | None:
        found = self.new.get(word)
        if found is None and (found := self.old.get(word)) is not None:
            self.put(word, found)
        return found


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def encode_texts(texts: list[str], split: Pretokenizer, replay: MergeReplay, held: Held) -> Iterator[list[int]]:
    """Ids of each text. ``held`` remembers words from one call to the next."""
    numbers = Numbers()
    cuts = [array("I", map(numbers.__getitem__, split(t))) for t in texts]
    packed = {w: held.get(w) for w in numbers}
    fresh = [w for w, ids in packed.items() if ids is None]
    for w, ids in zip(fresh, replay.encode([w.encode() for w in fresh]), strict=True):
        packed[w] = array("I", ids).tobytes()
        held.put(w, packed[w])
    packed = list(packed.values())
    for words in cuts:
        yield np.frombuffer(b"".join([packed[i] for i in words]), np.uint32).tolist()


_STATE: dict[str, tuple] = {}


def worker_state(key: str, pattern: str, ranks) -> tuple[Pretokenizer, MergeReplay, Held]:
    """What a Python worker keeps between its tasks: the vocabulary that ``key`` names, and a bounded number of words."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = (Pretokenizer(pattern), MergeReplay(ranks.value), Held())
    return _STATE[key]


def tokenize(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes decoded from them.

    ``with_ids`` adds the ids themselves.
    """
    table = read_ranks(vocabulary)
    ranks = docs.sparkSession.sparkContext.broadcast(table)
    key = hashlib.sha256(repr((pattern, sorted(table.items()))).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, replay, held = worker_state(key, pattern, ranks)
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                counts, digests, decoded, kept = [], [], [], []
                for ids in encode_texts(texts, split, replay, held):
                    counts.append(len(ids))
                    if with_ids:
                        kept.append(np.array(ids, np.int32))
                    digests.append(hashlib.sha256(",".join(map(replay.named, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(replay.decode(ids)).hexdigest())
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = SCHEMA + ", ids array<int>" * with_ids
    return texts_of(pick(docs, "doc_id", "text"), F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of ``most`` bytes of text, so that what is held beside it stays small."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def token_ids(texts: list[str], vocabulary: str, pattern: str) -> list[list[int]]:
    """Ids of each text, on one machine; for use beside Spark."""
    split, replay = Pretokenizer(pattern), MergeReplay(read_ranks(vocabulary))
    return list(encode_texts(texts, split, replay, Held()))
