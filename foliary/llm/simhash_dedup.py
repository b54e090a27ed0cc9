"""SimHash near-duplicates linked through deletion-variant signatures.

Two 64-bit fingerprints that differ in at most three bits differ in at most one bit within one of
their two 32-bit segments. So each distinct fingerprint is indexed under every segment with one bit
left out; equal keys propose pairs, and the full distance verifies them.

A bucket holds distinct fingerprints only. One that outgrows ``BUCKET`` is not paired: its free
bits are cut into four pieces, of which two linked members share one, and each piece becomes a
bucket of its own. Free bits run out at 2**10 members, so every bucket is settled exactly.

Edge cases: null and blank texts have fingerprint zero and are linked like any other; texts under
three words are one shingle; a null doc_id is never a component's id unless all its members' ids
are null; repeated rows are returned as often as they occur; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FILE, ROW, cut, discard, locate, pick, scratch, texts_of, without

WORDS = 3
SEED = 42
DISTANCE = 3
BUCKET = 1024
PIECES = DISTANCE + 1
SEGMENT = 32


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    buffer, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < WORDS:
        return digest(buffer, SEED)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends[:-WORDS]]
    hashes = np.array([digest(buffer[a : b - 1], SEED) for a, b in zip(starts, ends[WORDS - 1 :], strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):  # bounds the unpacked bits of a very long text
        part = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and locator of a located table's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(3)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found)], names=["doc_id", FILE, ROW, "fp"])

    rows = texts_of(pick(docs, "doc_id", FILE, ROW, "text"), F.col("doc_id").cast("long").alias("doc_id"), FILE, ROW, "text")
    return rows.mapInArrow(run, f"doc_id long, {FILE} string, {ROW} long, fp long")


def variants(distinct: DataFrame) -> DataFrame:
    """(mask, fp) for each segment and each bit left out of it; a bucket is (mask, fp & mask)."""
    masks = [((1 << SEGMENT) - 1 & ~(1 << bit)) << SEGMENT * s for s in range(2) for bit in range(SEGMENT)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return distinct.select(F.explode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("mask"), "fp")


def _members(near: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each index in a symmetric matrix of links."""
    label = np.arange(len(near))
    while True:
        least = np.where(near, label, len(near)).min(1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _pieces(mask: int) -> list[int]:
    free = [b for b in range(64) if not mask >> b & 1]
    parts = np.array_split(free, PIECES)
    return [mask | sum(1 << int(b) for b in p) for p in parts]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def settle(batches: Iterator[pa.RecordBatch], bucket: int = BUCKET) -> Iterator[pa.RecordBatch]:
    """Links from rows sorted by bucket; members of an oversized bucket come back under its pieces.

    Rows out: (hot, a, b). A link has hot false and two fingerprints of one group, a the lesser;
    otherwise a is a finer mask and b a fingerprint. Holds one bucket at most.
    """
    held, key, pieces = [], None, None

    def close() -> list[tuple[np.ndarray, np.ndarray]]:
        fp = np.unique(np.concatenate(held)) if held else np.empty(0, np.int64)
        if len(fp) < 2:
            return []
        u = fp.view(np.uint64)
        label = _members(np.bitwise_count(u[:, None] ^ u[None, :]) <= DISTANCE)
        other = label != np.arange(len(fp))
        return [(fp[label[other]], fp[other])] if other.any() else []

    def rows(hot: bool, found) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), hot)), pa.array(a), pa.array(b)], names=["hot", "a", "b"])

    for batch in batches:
        mask, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        value = mask & fp
        at = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
        bounds = np.concatenate(([0], at, [len(mask)]))
        sizes = np.diff(bounds)
        links, hot = [], []
        # All buckets but the batch's first and last are whole; most hold one, many two.
        inner = np.flatnonzero(sizes[1:-1] == 2) + 1 if len(sizes) > 2 else np.empty(0, np.int64)
        if len(inner):
            a, b = fp[bounds[inner]], fp[bounds[inner] + 1]
            near = (np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= DISTANCE) & (a != b)
            links.append((a[near], b[near]))
        last = len(sizes) - 1
        for k in [0, *(np.flatnonzero(sizes[1:-1] > 2) + 1).tolist(), *([last] if last else [])]:
            s, e = int(bounds[k]), int(bounds[k + 1])
            if s == e:
                continue
            mine = (int(mask[s]), int(value[s]))
            if mine != key:
                links += close()
                held, key, pieces = [], mine, None
            held.append(fp[s:e])
            if pieces is None and sum(map(len, held)) > bucket:
                pieces = [_signed(m) for m in _pieces(mine[0] & (1 << 64) - 1)]
            if pieces:
                for h in held:
                    hot += [(np.full(len(h), m, np.int64), h) for m in pieces]
                held = []
        if links:
            yield rows(False, links)
        if hot:
            yield rows(True, hot)
    if done := close():
        yield rows(False, done)


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b: pairs that join every two fingerprints within the distance, directly or by steps."""
    if bucket < 16:
        raise ValueError("a bucket of under 16 could not be cut further")
    level, found = variants(distinct), None
    value = F.col("mask").bitwiseAND(F.col("fp"))
    while True:
        dealt = level.repartition("mask", value).sortWithinPartitions("mask", value)
        out = cut(dealt.mapInArrow(lambda x: settle(x, bucket), "hot boolean, a long, b long"), "simhash-level")
        here = out.filter("not hot").select("a", "b").distinct()
        found = here if found is None else found.unionByName(here)
        level = out.filter("hot").select(F.col("a").alias("mask"), F.col("b").alias("fp"))
        if level.isEmpty():
            return found


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for every node that isn't its component's smallest.

    Alternating large-star and small-star steps, with group minima found by partial aggregation;
    each round ends in a table in the shared folder. Ends when a round changes nothing.
    """
    def kept(rows: DataFrame) -> tuple[DataFrame, str]:
        path = scratch(spark, "edges")
        rows.distinct().write.parquet(path)
        return spark.read.schema("u long, v long").parquet(path), path

    edges, path = kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"))
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), total).first())
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        large = (
            both.join(least, F.col("u") == F.col("k"))
            .filter("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        least = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        pairs = large.join(least, F.col("u") == F.col("k"))
        small = pairs.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old = path
        edges, path = kept(small.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))))
        discard(spark, old)  # the round before is not read again


def group(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    prints, held = _grouped(locate(docs), bucket)
    return prints.join(held, F.col("fp") == F.col("held")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id")
    )


def _grouped(located: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and for each distinct one its component's first row.

    The first row has the least doc_id, null after all others, and the least locator.
    """
    spark = located.sparkSession
    prints = cut(fingerprints(located), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", FILE, ROW)
    distinct = cut(prints.groupBy("fp").agg(F.min(row).alias("first")), "distinct")
    linked = components(spark, links(distinct.select("fp"), bucket))
    rooted = distinct.join(linked, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    ids = rooted.groupBy(F.col("root").alias("k")).agg(F.min("first").alias("first"))
    held = rooted.drop("first").join(ids, F.col("root") == F.col("k")).select(F.col("fp").alias("held"), "first")
    return prints, held


def deduplicate(docs: DataFrame) -> DataFrame:
    """Of each component the first row: the least doc_id, and of rows repeating it one; all columns."""
    located = locate(docs)
    prints, held = _grouped(located, BUCKET)
    joined = prints.join(held, F.col("fp") == F.col("held"))
    return without(located, joined.filter(~((F.col(FILE) == F.col(f"first.{FILE}")) & (F.col(ROW) == F.col(f"first.{ROW}")))))
