"""Quality score from zstandard dictionaries built of good and of bad labelled text.

Every piece of a whole text is compressed with either dictionary; the difference of the sizes,
normalised by the text's length, goes through a logistic calibration. Nothing else is an input.

Fitting reads at most ``FIT_ROWS`` labelled rows of each class with texts up to ``FIT_CHARS``
(documented bounds; which rows is decided by a hash of their id). Half of them make the
dictionaries, the other half the calibration. Scoring reads the whole of every text.

Edge cases: null and empty texts get the calibration's score for no difference; labels other than
0 and 1 are ignored, as are labels without a document and ids with both labels; of documents
sharing a labelled id the least text is fitted; with no labelled rows of a class every score is
0.5; repeated rows are scored alike; an empty table gives an empty result; no other column of the
documents is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, texts_of

FIT_ROWS = 1500
FIT_CHARS = 40_000
DICTIONARY = 65_536
PIECE = 1_024
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def in_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the plain text where there is too little to train on."""
    samples = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    size = min(DICTIONARY, sum(map(len, samples)) // 8)
    if len(samples) >= 32 and size >= 1024:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            pass  # too uniform to train on
    return b"".join(samples)[-DICTIONARY:]


class Sizer:
    """Compressed sizes of a text under both dictionaries."""

    def __init__(self, model: Model):
        def tool(content: bytes) -> zstandard.ZstdCompressor:
            held = zstandard.ZstdCompressionDict(content)
            held.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_dict_id=False)

        self.tools = [tool(model.good).compress, tool(model.bad).compress]
        self.empty = [len(f(b"")) for f in self.tools]

    def __call__(self, text: str | None) -> tuple[int, int, int]:
        data = (text or "").encode()
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        good, bad = (sum([len(f(p)) for p in pieces]) - e * len(pieces) for f, e in zip(self.tools, self.empty, strict=True))
        return len(data), good, bad


def features(sizes: np.ndarray) -> np.ndarray:
    """From rows of (length, good, bad): a constant and the size difference normalised by the length."""
    n, good, bad = sizes.T.astype(float)
    return np.column_stack([np.ones(len(n)), 20 * (bad - good) / np.maximum(n, 1)])


def score(sizes: np.ndarray, weights) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features(sizes) @ np.asarray(weights), -30, 30)))


def _calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Logistic regression by Newton steps, either class with half of the weight."""
    w, weight = np.zeros(x.shape[1]), np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(
            (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w
        )
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """From rows outside the held-out third."""
    marked = pick(labels, "doc_id", "quality").filter(F.col("quality").isin(0, 1) & ~in_held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other")
    chosen = None
    for q in (0, 1):
        some = marked.filter(F.col("quality") == q).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(FIT_ROWS)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = pick(docs, "doc_id", "text").filter(F.length("text").between(1, FIT_CHARS))
    joined = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    rows = sorted(tuple(r) for r in joined.collect())  # one text of each chosen id
    # One row of a text: copies would be in both halves.
    rows = list({r[1]: r for r in rows}.values())
    half = [hashlib.md5(str(r[0]).encode()).digest()[0] % 2 for r in rows]
    parts = {(q, h): [t.encode() for (_, t, y), z in zip(rows, half, strict=True) if (y, z) == (q, h)] for q in (0, 1) for h in (0, 1)}
    if not all(parts.values()):
        return Model(b"", b"", (0.0,) * 2)
    model = Model(_dictionary(parts[1, 0]), _dictionary(parts[0, 0]), ())
    sizer = Sizer(model)
    sizes = np.array([sizer(t.decode()) for q in (0, 1) for t in parts[q, 1]])
    y = np.array([q for q in (0, 1) for _ in parts[q, 1]])
    return Model(model.good, model.bad, tuple(_calibrate(features(sizes), y)))


def scorer(docs: DataFrame, model: Model):
    """A function of the text column that gives the score, in Arrow batches."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of 64 KB

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizer, weights = Sizer(sent.value), sent.value.weights
        for texts in batches:
            sizes = np.array([sizer(t.as_py()) for t in texts], np.int64).reshape(-1, 3)
            yield pa.array(score(sizes, weights))

    return scored


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = texts_of(pick(docs, "doc_id", "text"), F.col("doc_id").cast("long").alias("doc_id"), scorer(docs, model)("text").alias("score"))
    return rows.select(
        "doc_id",
        F.coalesce(in_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The input rows predicted good, all columns; each is decided where it is read."""
    return texts_of(docs, "*").filter(scorer(docs, fit(docs, labels))(F.col("text")) >= 0.5)
