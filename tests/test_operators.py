import glob
import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import parity
from foliary.functions import numbering
from foliary.functions import text as tx
from foliary.operators import layout, pages, search, spatial
from foliary.pdf.writer import build
from foliary.plans import catalog, files  # noqa: F401
from foliary.sources import pdf as source
from foliary.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, name):
    con = parity.views(SF)
    mine, other = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.SQL[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert parity.canonical(mine) == parity.canonical(other)


def test_entry_registers_everything():
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def one(spark, column, *row):
    return spark.createDataFrame([row], ", ".join(f"c{i} {'string' if isinstance(v, str) else 'long'}" for i, v in enumerate(row))).select(column.alias("v")).first()["v"]


def test_numbering(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 4, 9, 26, 27, 52, 53, 702, 703, 3999, 4000)], "n long")
    got = [tuple(r) for r in rows.select(numbering.roman(F.col("n")), numbering.letters(F.col("n"))).collect()]
    assert got == [("0", ""), ("I", "A"), ("IV", "D"), ("IX", "I"), ("XXVI", "Z"), ("XXVII", "AA"), ("LII", "AZ"), ("LIII", "BA"), ("DCCII", "ZZ"), ("DCCIII", "AAA"), ("MMMCMXCIX", "EWU"), ("4000", "EWV")]


def test_positions(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aabé.") for _ in range(rnd.randrange(30))) for _ in range(200)] + ["", "aaa"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for term in ("aa", "aba", ".", "é"):
        for overlapping in (True, False):
            for r in rows.select("t", tx.positions(F.col("t"), term, overlapping).alias("p")).collect():
                want, at = [], r["t"].find(term)
                while at >= 0:
                    want.append(at)
                    at = r["t"].find(term, at + (1 if overlapping else len(term)))
                assert r["p"] == want, (r["t"], term, overlapping)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def plain_fuzzy(text, query):
    n, edits = len(query), max(1, len(query) // 4)
    grams = [query[i : i + 3] for i in range(n - 2)]
    votes = {}
    for i in range(len(text) - 2):
        for k, g in enumerate(grams):
            if text[i : i + 3] == g and i >= k:
                votes[i - k] = votes.get(i - k, 0) + 1
    best = sorted((k for k in votes if votes[k] >= max(1, len(grams) // 3)), key=lambda k: (-votes[k], k))[:64]
    out = []
    for s in sorted(best):
        for size in range(n - edits, n + edits + 1):
            piece = text[s : s + size]
            if len(piece) < size:
                continue
            d, mine = levenshtein(piece, query), {piece[i : i + 3] for i in range(len(piece) - 2)}
            both = mine | set(grams)
            tri = len(mine & set(grams)) / len(both) if both else 0
            score = 0.55 * (1 - d / max(n, size)) + 0.45 * tri
            if d <= edits and tri >= 0.25 and score >= 0.55:
                out.append((s, size, round(score, 6)))
                break
    return out


def test_fuzzy_matches_brute_force(spark):
    rnd = random.Random(7)
    query, rows = "hello fuzzy world", []
    for i in range(60):
        near = list(query)
        for _ in range(rnd.randrange(5)):
            near[rnd.randrange(len(near))] = rnd.choice("helo wrdfuzy")
        rows.append((i, "".join(rnd.choice("helo wrd") for _ in range(rnd.randrange(40))) + "".join(near) + " tail " * rnd.randrange(3)))
    rows += [(100, None), (101, ""), (102, "he")]
    got = sorted((r["doc_id"], r["start"], r["length"], r["score"]) for r in search.fuzzy(spark.createDataFrame(rows, "doc_id long, text string"), query).collect())
    want = sorted((i, *hit) for i, t in rows for hit in plain_fuzzy(t or "", query))
    assert len(want) > 20 and [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=2e-6)


def test_overlap_finds_each_pair_once(spark):
    rnd = random.Random(2)
    box = lambda: (x := rnd.uniform(-200, 200), y := rnd.uniform(-200, 200), x + rnd.choice([0, 5, 300]), y + rnd.choice([0, 9, 150]))
    a, b = [(i, i % 3, *box()) for i in range(60)], [(i, i % 3, *box()) for i in range(60)]
    schema = "id long, k long, x1 double, y1 double, x2 double, y2 double"
    got = sorted((r["a_id"], r["b_id"]) for r in spatial.overlap(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ("k",)).collect())
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5])
    assert got == want


def boxes_of_pages(spark, rnd):
    """Boxes of pages with one mark and of one with hundreds, words with the same number among them, and missing keys and sides."""
    box = lambda: (x := float(rnd.randrange(-200, 200)), y := float(rnd.randrange(-200, 200)), x + rnd.choice([0, 5, 90]), y + rnd.choice([0, 9, 60]))
    words = [(k, i // 2, *box()) for k in (*range(30), 99) for i in range(9 if k < 99 else 200)] + [(None, 1, 0.0, 0.0, 9.0, 9.0), (1, 99, None, 0.0, 9.0, 9.0)]
    marks = [(k, k, *box()) for k in range(30)] + [(99, 1000 + i, *box()) for i in range(300)] + [(None, 1, 0.0, 0.0, 9.0, 9.0)]
    sides = "x1 double, y1 double, x2 double, y2 double"
    meet = lambda p, q: None not in (*p, *q) and p[0] == q[0] and p[2] < q[4] and q[2] < p[4] and p[3] < q[5] and q[3] < p[5]
    return words, marks, meet, spark.createDataFrame(words, f"doc_id long, word_id long, {sides}"), spark.createDataFrame(marks, f"doc_id long, mark_id long, {sides}")


def no_broadcast(df):
    """Nothing of the join goes through the driver, as planned and as run."""
    df.collect()
    return "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_redact_drops_words_by_box_and_broadcasts_nothing(spark):
    words, marks, meet, w, m = boxes_of_pages(spark, random.Random(5))
    got = pages.redact(w, m)
    order = lambda rows: sorted(map(repr, rows))
    assert order(tuple(r) for r in got.collect()) == order(p for p in words if not any(meet(p, q) for q in marks))
    assert no_broadcast(got)


def test_overlap_by_key_and_by_cells_broadcasts_nothing(spark):
    words, marks, meet, w, m = boxes_of_pages(spark, random.Random(6))
    got = spatial.overlap(w, m, ("doc_id",), closed=False)
    found = sorted((r["doc_id"], r["a_word_id"], r["a_x1"], r["a_y1"], r["b_mark_id"]) for r in got.collect())
    assert found == sorted((p[0], p[1], p[2], p[3], q[1]) for p in words for q in marks if meet(p, q))
    assert no_broadcast(got)


def test_words_break_at_spaces_and_gaps(spark):
    text = [("H", 0.0), ("i", 7.0), (" ", 14.0), ("y", 21.0), ("o", 28.0), ("u", 60.0)]
    rows = [(1, 0, i, c, x, 100.0, 7.0, 12.0) for i, (c, x) in enumerate(text)] + [(1, 0, 9, "z", 0.0, 50.0, 7.0, 12.0)]
    chars = spark.createDataFrame(rows, "doc_id long, page_no int, ord long, ch string, x double, y double, w double, h double")
    words = layout.words(layout.pack(chars)).orderBy("line_index", "word_index").collect()
    assert [(r["line_index"], r["text"]) for r in words] == [(0, "Hi"), (0, "yo"), (0, "u"), (1, "z")]


def test_sources(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.pdf").write_bytes(build([f"file {i}", "two"]))
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4 nothing here")
    (tmp_path / "none.pdf").write_bytes(b"")
    rows = source.read_folder(spark, str(tmp_path)).collect()
    assert sorted(r["text"] for r in rows if r["status"] == "OK") == ["file 0", "file 1", "file 2", "two", "two", "two"]
    assert sorted(r["status"] for r in rows if r["status"] != "OK") == ["MALFORMED"]  # Spark passes over empty files
    source.register(spark)
    df = spark.read.format("pdf").option("section", "documents").load(str(tmp_path))
    assert sorted((r["n_pages"] or 0) for r in df.collect()) == [0, 0, 2, 2, 2]


def test_streaming_equals_batch(spark, tmp_path):
    there, out, held = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    there.mkdir()
    for i in range(2):
        (there / f"{i}.pdf").write_bytes(build([f"file {i}"]))
    for extra in ("", "late"):
        if extra:
            (there / "late.pdf").write_bytes(build([extra]))
        ingest.append_sections(ingest.arriving(spark, str(there)), out, held, ("pages",)).awaitTermination()
    stored = spark.read.parquet(f"{out}/pages")
    assert sorted(r["text"] for r in stored.collect()) == sorted(r["text"] for r in source.read_folder(spark, str(there)).collect())
    assert stored.count() == 3 and len(glob.glob(f"{out}/pages/batch=*")) == 2


def test_streams_keep_one_of_each_file(spark, tmp_path):
    there = tmp_path / "in"
    there.mkdir()
    for i, text in enumerate(("same", "same", "other")):
        (there / f"{i}.pdf").write_bytes(build([text]))
    held = str(tmp_path / "state")
    stream = ingest.distinct_files(ingest.arriving(spark, str(there))).select("sha256")
    query = stream.writeStream.format("memory").queryName("kept_files").option("checkpointLocation", held).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("kept_files").count() == 2


def test_latest_revisions(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "path string, modificationTime long, v string")
    assert sorted((r["path"], r["v"]) for r in ingest.latest_revisions(rows).collect()) == [("a", "y"), ("b", "z")]


def test_catalogue_from_tab_separated_text(spark, tmp_path):
    from foliary.operators import audit

    (tmp_path / "rules.tsv").write_text("Key\tType\tRequired\nType\tname\tTRUE\nLang\tstring\tFALSE\nPages\tdictionary\tTRUE\n")
    rules = audit.read_catalogue(spark, str(tmp_path / "rules.tsv"), "Catalog")
    keys = spark.createDataFrame([("d", 1, "Catalog", "Type", "string"), ("d", 1, "Catalog", "Lang", "string"), ("d", 2, "Page", "Type", "name")], "doc_id string, obj int, type string, key string, kind string")
    assert sorted((r["key"], r["found"]) for r in audit.missing_keys(keys, rules).collect()) == [("Pages", "missing"), ("Type", "string")]


def test_merge_numbers_over_ranges(spark):
    from foliary.operators import pages

    a = spark.createDataFrame([(i,) for i in (5, 1, 1, 9, 7)], "page_no long")
    b = spark.createDataFrame([(i,) for i in range(300)], "page_no long")
    rows = pages.merge([a, b, a.limit(0)], ranges=4).orderBy("merged_no").collect()
    assert [r["merged_no"] for r in rows] == list(range(305)) and [r["page_no"] for r in rows[:5]] == [1, 1, 5, 7, 9]
    assert [r["page_no"] for r in rows[5:]] == list(range(300))


def test_derived_keys(spark):
    from foliary.functions import values

    found = one(spark, F.lower(F.hex(values.pbkdf2_sha256(F.col("c0").cast("binary"), F.col("c1").cast("binary"), 2))), "password", "salt")
    assert found == "ae4d0c95af6b46d32d0adff928f06dd02a303f8ef3c251dfd6e2d85a95474c43"


def test_overview_is_the_join_of_its_parts_from_one_parse(spark):
    from foliary.plans import samples
    from foliary.sources.documents import Documents

    made = [(1, samples.three_pages("a", "b")), (2, build(["one page"])), (3, b"no file"), (4, b""), (5, None), (6, build([f"p{i}" for i in range(5)]))]
    d = Documents(spark.createDataFrame(made, "path long, content binary"))
    for first, last in ((0, 1), (2, 3)):
        fonts = d.fonts().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_fonts"))
        parts = d.page_count().join(d.page_info(first).drop("page_no"), "doc_id").join(d.text(first, last), "doc_id").join(fonts, "doc_id")
        got = d.overview(first, last)
        assert got.columns == parts.columns and sorted(map(repr, got.collect())) == sorted(map(repr, parts.collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_drained_stream_is_a_table_of_files(spark, tmp_path):
    """Executors write the result, and several batches give what one does."""
    rows = [(i % 7, 3600 * (i // 3)) for i in range(300)]
    events = spark.createDataFrame(rows, "k long, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    for most in (1, 100):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", most).parquet(str(tmp_path / "events"))
        got = ingest.drained(ingest.tagged_sessions(stream, "k", "ts", "7199.999999 seconds", delay="100 days"))
        assert got.inputFiles()  # not rows that the driver holds
        want, last = {}, {}
        for k, s in rows:
            if k not in last or s - last[k] >= 7200:
                want[k, s] = 0
                last[k, "at"] = (k, s)
            last[k] = s
            want[last[k, "at"]] += 1
        assert {(r["k"], int(r["start"].timestamp())): r["n"] for r in got.collect()} == want
    latest = ingest.drained(ingest.counts_by_window(stream, "ts", "k", delay="100 days"), "update")
    assert latest.inputFiles() and latest.agg(F.sum("n")).collect()[0][0] == len(rows)
