import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from foliary.llm import exact_dedup, simhash_dedup
from foliary.llm.common import FILE, ROW, locate

from .helpers import SCHEMA, documents, empty, row, rows_of


def expected_exact(docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = ids.index(keep)  # one row, though others may repeat it
        out += [(i, keep, len(ids), k == kept, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_matches_brute_force(spark):
    docs = documents(spark)
    assert rows_of(exact_dedup.mark(docs), *COLUMNS) == expected_exact(docs)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((r[0] for r in expected_exact(docs) if r[3]), key=repr)


REPEATS = [(1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, "q"), (7, "z"), (7, "z"), (None, None), (None, "")]


def multiset(df):
    return sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=repr)


def test_one_row_of_each_group_stays(spark, tmp_path):
    """Ids that repeat with other texts, null ids and fully repeated rows; from memory and from files."""
    docs = spark.createDataFrame([row(i, t) for i, t in REPEATS], SCHEMA)
    docs.write.parquet(str(tmp_path / "docs"))
    for table in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        assert multiset(exact_dedup.deduplicate(table)) == sorted([(2, "a"), (1, "b"), (None, "q"), (7, "z"), (None, "")], key=repr)
        assert multiset(simhash_dedup.deduplicate(table)) == sorted([(1, "a"), (1, "b"), (None, "q"), (7, "z"), (None, "")], key=repr)
    assert exact_dedup.mark(docs).filter("kept").count() == 5


def test_locators_lead_to_the_rows(spark, tmp_path):
    docs = spark.createDataFrame([row(i, t) for i, t in REPEATS], SCHEMA)
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    located = locate(spark.read.parquet(str(tmp_path / "docs")))
    assert located.select(FILE, ROW).distinct().count() == len(REPEATS)
    twice = locate(spark.read.parquet(str(tmp_path / "docs")).withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))))
    assert twice.select(FILE, ROW).distinct().count() == 2 * len(REPEATS)


def test_exact_checks_full_texts_on_a_shared_digest(spark):
    """With a digest of the length alone, different texts meet; the full check parts them."""
    docs = documents(spark)
    weak = lambda text: F.length(text).cast("string").cast("binary")
    assert rows_of(exact_dedup.mark(docs, weak), *COLUMNS) == expected_exact(docs)


def test_exact_empty(spark):
    assert exact_dedup.mark(empty(spark)).collect() == []


def test_state_resumes(spark, tmp_path):
    """A second run reads only new files and updates the groups that they touch."""
    keys, state, out = (str(tmp_path / x) for x in ("keys", "state", "out"))

    def add(rows):
        schema = f"doc_id long, digest binary, {FILE} string, {ROW} long"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(keys)
        exact_dedup.update_state(spark, keys, state, out)

    add([(1, b"a", "f", 5), (2, b"b", "f", 6)])
    add([(7, b"a", "g", 8), (9, b"c", "g", 9)])
    held = {bytes(r["digest"]): (*r["best"], r["group_size"]) for r in exact_dedup.read_state(spark, out).collect()}
    assert held == {b"a": (7, "g", 8, 2), b"b": (2, "f", 6, 1), b"c": (9, "g", 9, 1)}


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    """prints: {key: fingerprint}; the keys reachable over distances up to three, as sets."""
    keys, seen, out = list(prints), set(), []
    for k in keys:
        if k in seen:
            continue
        todo, part = [k], {k}
        while todo:
            x = todo.pop()
            for y in keys:
                if y not in part and (prints[x] ^ prints[y]).bit_count() <= 3:
                    part.add(y)
                    todo.append(y)
        seen |= part
        out.append(part)
    return out


def test_fingerprints(spark):
    texts = ["", " \x1c ", "A", "one TWO", "Ä b c d", "a b c " * 50, "x\x85y z w"] + [r["text"] for r in documents(spark).collect()]
    assert [simhash_dedup.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_simhash_matches_brute_force(spark):
    docs = documents(spark)
    rows = docs.collect()
    prints = {i: plain_fingerprint(r["text"]) for i, r in enumerate(rows)}
    want = []
    for part in components(prints):
        least = min((rows[i]["doc_id"] for i in part if rows[i]["doc_id"] is not None), default=None)
        want += [(rows[i]["doc_id"], f"{prints[i]:016x}", least) for i in part]
    assert rows_of(simhash_dedup.group(docs), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    assert simhash_dedup.deduplicate(docs).columns == docs.columns
    assert simhash_dedup.group(empty(spark)).collect() == []


@pytest.mark.parametrize("bucket", [16, 1024])
def test_links_join_what_is_near(spark, bucket):
    """Dense balls around a few centres: small buckets force the oversized path."""
    rnd = random.Random(bucket)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = rnd.getrandbits(64)
        for _ in range(40):
            x = centre
            for _ in range(rnd.randrange(5)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r["node"]: r["root"] for r in simhash_dedup.components(spark, simhash_dedup.links(distinct, bucket)).collect()}
    found = defaultdict(set)
    for x in signed:
        found[roots.get(x, x)].add(x & (1 << 64) - 1)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, components({x: x for x in prints})))


def test_oversized_bucket_over_batches():
    """A bucket that spans batches comes back whole under its pieces."""
    fp = np.arange(10, dtype=np.int64)
    mask = np.full(10, ~np.int64(15))
    batches = [pa.RecordBatch.from_arrays([pa.array(mask[s:e]), pa.array(fp[s:e])], names=["mask", "fp"]) for s, e in ((0, 3), (3, 4), (4, 10))]
    out = [r for b in simhash_dedup.settle(iter(batches), 4) for r in b.to_pylist()]
    assert all(r["hot"] for r in out) and sorted({r["b"] for r in out}) == list(range(10)) and len(out) == 40


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash_dedup.components(spark, edges).collect()}
    assert roots == {**{i: 0 for i in range(1, 201)}, 501: 500}
