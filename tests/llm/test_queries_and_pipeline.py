"""Registration, and the pipeline against its stages done plainly on the smallest tables."""

import os

import pytest

from foliary.llm import mixing, queries, quality_classifier

from .helpers import SCHEMA, documents, empty, row
from .test_dedup import components, plain_fingerprint

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_pipeline_matches_brute_force(spark):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    from foliary.llm.bpe import read_ranks

    docs = queries.table(spark, SF, "documents")
    model = quality_classifier.fit(docs, queries.table(spark, SF, "labels"))
    sizer, rows = quality_classifier.Sizer(model), {}
    import numpy as np

    for r in docs.collect():
        if quality_classifier.score(np.array([sizer(r["text"])]), model.weights)[0] >= 0.5:
            rows[r["doc_id"]] = r
    last = {}
    for i in sorted(rows):
        last[rows[i]["text"] or ""] = i
    rows = {i: rows[i] for i in last.values()}
    prints = {i: plain_fingerprint(r["text"]) for i, r in rows.items()}
    rows = {min(part): rows[min(part)] for part in components(prints)}
    kept = spark.createDataFrame(list(rows.values()), docs.schema)
    drawn = {r["doc_id"] for r in mixing.mix(kept).collect() if r["selected"]}
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=read_ranks(queries.vocabulary()[0]), special_tokens={})
    want = sorted((i, own.encode_ordinary(rows[i]["text"] or "")) for i in drawn)
    got = sorted((r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mixed", "tokens"]


def stored(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_bears_odd_rows(spark, tmp_path):
    """Null and repeated ids, repeated rows, blank texts and clashing columns, without labels: only copies go."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    base = documents(spark).collect()
    more = [row(1, "another text under an id that is taken"), row(None, "another text without an id"), *base[:3], row(16, "near " + base[1]["text"])]
    docs = spark.createDataFrame([*base, *more], SCHEMA)
    sf = stored(spark, tmp_path, docs, [(1, 1, 0), (5000, 0, 0)])
    now, rows = spark.read.parquet(f"{sf}/documents.parquet"), [(r["doc_id"], r["text"]) for r in docs.collect()]
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == docs.columns, name
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        now = spark.read.parquet(path)
        after[name] = sorted(((r["doc_id"], r["text"]) for r in now.collect()), key=repr)
    assert after["quality"] == sorted(rows, key=repr)  # labels of one kind only: nothing is rejected
    texts = [t or "" for _, t in after["exact"]]
    assert sorted(texts) == sorted({t or "" for _, t in rows})
    best = {t: max((i for i, u in rows if (u or "") == t and i is not None), default=None) for t in texts}
    assert all(best[t or ""] == i for i, t in after["exact"])
    prints = {k: plain_fingerprint(t) for k, (_, t) in enumerate(after["exact"])}
    firsts = [min((after["exact"][k] for k in part), key=lambda r: (r[0] is None, r[0] or 0)) for part in components(prints)]
    assert [r[0] for r in after["near"]] == sorted((r[0] for r in firsts), key=lambda i: repr((i,)))
    assert set(after["mixed"]) <= set(after["near"])
    assert corpus_pipeline.run(spark, sf).count() == len(after["mixed"])


def test_pipeline_of_nothing(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    sf = stored(spark, tmp_path, empty(spark), [(1, 1, 0)])
    assert corpus_pipeline.run(spark, sf).collect() == []


def test_held_out_accuracy(spark):
    """Labels that fitting never saw."""
    sf = SF.replace("0.001", "0.1")
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    found = quality_classifier.classify(docs, quality_classifier.fit(docs, labels))
    both = found.join(labels, "doc_id").filter("held_out")
    right = both.filter("predicted = quality").count() / both.count()
    assert right > 0.98
