import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliary.llm import bpe, mixing, pii, quality_classifier, quality_rules, secrets

from .helpers import documents, empty, row, rows_of, SCHEMA


def test_bpe_matches_library(spark):
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    docs = documents(spark)
    found = rows_of(bpe.tokenize(docs, path, public.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in docs.collect():
        ids = own.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids)).encode()), sha((r["text"] or "").encode())))
    assert found == sorted(want, key=repr)
    assert bpe.tokenize(empty(spark), path, public.PATTERN).collect() == []
    rnd = random.Random(1)
    odd = ["".join(rnd.choice("abé ñ\x1c\x85\xa0\n\t'slltreve0²½œΩ漢🙂.,!ſK ") for _ in range(rnd.randrange(150))) for _ in range(500)] + ["ab" * 5000]
    assert bpe.token_ids(odd, path, public.PATTERN) == [own.encode_ordinary(t) for t in odd]


def test_replay_takes_an_earlier_merge_first():
    """A merge that makes a lower-ranked pair possible: it goes first within the word."""
    ranks = {bytes([i]): i for i in range(256)}
    ranks |= {b"abc": 300, b"ab": 500, b"cab": 400}
    replay = bpe.MergeReplay(ranks)

    def plain(word):
        if word in ranks:
            return [ranks[word]]
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if not best:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rnd = random.Random(2)
    words = [bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 12))) for _ in range(2000)]
    assert replay.encode(words) == [plain(w) for w in words]


BASE = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(pii.digits_of(m)) <= 19 and pii.luhn(pii.digits_of(m))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(pii.digits_of(m)) <= 15),
)


def test_pii_base_spans_match_patterns():
    rnd = random.Random(2)
    for _ in range(4000):
        letters = rnd.choice(["a1.@-+ ", "ab@.-_é1", "0123456789 -+().", "12.5 ", "4 0-1", "a@b.c_@."])
        t = "".join(rnd.choice(letters) for _ in range(rnd.randrange(60)))
        assert pii.base_spans(t) == [[m.span() for m in re.finditer(p, t) if ok(m.group())] for p, ok in BASE], t
    assert pii.base_spans("0" * 5000 + "1.2.3.4")[1] == [(0, 5007)]
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_pii_keeps_base_and_adds_loose_forms(spark):
    text = "write bob@site.com or +1 (212) 555-1234, card 4111 1111 1111 1111 from 10.1.2.3"
    loose = "mail bob [at] site [dot] com"
    docs = spark.createDataFrame([row(i, text) for i in range(30)] + [row(50 + i, loose) for i in range(5)] + [row(90, None), row(91, "")], SCHEMA)
    rows = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert [rows[0][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1]
    named = rows[0]["spans"]
    assert rows[0]["base_sha256"] == hashlib.sha256(named.encode()).hexdigest()
    assert [s.split(":")[0] for s in named.split(",")] == list(pii.KINDS)
    assert rows[50]["n_email"] == 0 and rows[50]["spans"] == "email:5:28"
    assert rows[90]["spans"] == "" and rows[90]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find(empty(spark)).collect() == []
    assert pii.find(documents(spark)).count() == documents(spark).count()


def test_reliabilities_favour_the_labeler_that_agrees():
    counts = {(1, 1, 1): 400.0, (-1, -1, 1): 150.0, (-1, -1, -1): 250.0, (1, 1, -1): 200.0}
    share, table = pii.reliabilities(counts)
    assert 0.5 < share < 0.7 and table[1][0][2] > 0.9 and table[1][2][2] < 0.8


def brute_secrets(text):
    out = []
    for kind, (p, group, least, flags) in enumerate((
        (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, re.A),
        (r"AKIA[A-Z0-9]+", 0, 18, 0),
        (r"[0-9a-f]+", 0, 16, 0),
    )):
        out += [(m.start(), kind, m.end()) for m in re.finditer(p, text, flags) if len(m.group(group)) >= least]
    return sorted(out)


def test_secrets_match_brute_force(spark):
    rnd = random.Random(6)
    pieces = ["token=", "PassWord: '", "secret = \"", "apikey:", "AKIA", "ABCDEFGH12", "deadbeef0123", "é🙂", " ", "'", "=", "xyz.-_/+"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(14))) for _ in range(300)] + [None, "", "K=toKen=abcdefghijklmnop"]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)] + [row(None, "token=abcdefghijklm"), row(7, texts[7])], SCHEMA)
    found = secrets.find(docs, secrets.Ledger(spark, secrets_path(spark)))
    names = ("assign", "access", "hex")
    for r in found.collect():
        text = "token=abcdefghijklm" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        base = brute_secrets(text)
        spelt = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in base)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in base) for i in range(3)], text
        assert r["base_sha256"] == hashlib.sha256(spelt.encode()).hexdigest() and r["spans"] == spelt, text
    assert found.count() == len(texts) + 2
    assert secrets.find(empty(spark), secrets.Ledger(spark, secrets_path(spark))).collect() == []


def secrets_path(spark):
    from foliary.llm.common import scratch

    return scratch(spark, "ledger")


def test_ledger_scans_only_what_is_unseen(spark):
    ledger = secrets.Ledger(spark, secrets_path(spark))
    first = spark.createDataFrame([row(1, "token=abcdefghijklm"), row(2, "clean"), row(3, "clean")], SCHEMA)
    secrets.find(first, ledger)
    assert ledger.entries().count() == 2
    more = first.unionByName(spark.createDataFrame([row(4, "AKIA" + "A" * 16), row(5, "clean")], SCHEMA))
    found = {r["doc_id"]: r["spans"] for r in secrets.find(more, ledger).collect()}
    assert found == {1: "assign:0:19", 2: "", 3: "", 4: "access:0:20", 5: ""}
    assert ledger.entries().count() == 3  # one new blob
    newer = tuple(secrets.Rule(r.name, 2, r.pattern, r.group, r.least, r.hints) if r.name == "hex" else r for r in secrets.RULES)
    secrets.find(more, ledger, newer)
    assert [tuple(r["scanned"]) for r in ledger.entries().collect()].count(("hex@2",)) == 3


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else set(grams)
    covered = {j for i, g in enumerate(grams) if g in often for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, r, n < 50 or 100 * r > 50 * n


def test_rules_match_brute_force(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(["a ", "b ", "c\n", "#\t", "é ", "\n", "a b c "]) for _ in range(rnd.randrange(120))) for _ in range(150)]
    docs = documents(spark).unionByName(spark.createDataFrame([row(100 + i, t) for i, t in enumerate(texts)], SCHEMA))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = sorted(((r["doc_id"], *brute_rules(r["text"])) for r in docs.collect()), key=repr)
    assert rows_of(quality_rules.apply_rules(docs), *columns) == want
    assert quality_rules.apply_rules(empty(spark)).collect() == []


def test_bad_hosts_lose_their_documents(spark):
    """One host fails each rule far oftener than the others; its good documents go with it."""
    good = "\n".join(f"word{i} other{i} third{i}" for i in range(40))
    bad = {
        "words": "short", "repeats": "one two three four " * 20, "symbols": good + " #" * 40,
        "lines": good + "\n" + "\n".join(f"line number {i % 5}" for i in range(40)), "length": " ".join("x" * (20 + i) for i in range(60)),
    }
    rows = [row(100 + i, good, source=f"h{i % 9}") for i in range(300)] + [row(500, good, source=None), row(501, "short", source="h1")]
    for k, (name, text) in enumerate(bad.items()):
        rows += [row(1000 * (k + 1) + i, text, source=name) for i in range(60)] + [row(1000 * (k + 1) + 60, good, source=name)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r["doc_id"]: r for r in quality_rules.apply_rules(docs).collect()}
    for k, name in enumerate(bad):
        r = found[1000 * (k + 1) + 60]
        assert not r["base_failed"] and not r["kept"] and name in r["host_failed"].split(","), (name, r)
    assert found[100]["kept"] and found[500]["kept"] and not found[501]["kept"]
    only = quality_rules.apply_rules(docs.filter("source = 'words'"))
    assert only.filter("kept").count() == 1  # without other hosts there is no prior


def test_classifier_separates_and_ignores_held_out_labels(spark):
    rnd = random.Random(9)
    prose = lambda: " ".join(rnd.choice(["river", "stone", "under", "light", "gentle", "morning", "the", "of"]) for _ in range(60))
    noise = lambda: " ".join(rnd.choice(["$$$", "BUY!!", "###", "win&&", "|", "click%%"]) for _ in range(60))
    rows = [row(i, prose() if i % 2 else noise()) for i in range(300)] + [row(900, None), row(901, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    labels = spark.createDataFrame([(i, i % 2 if not held(i) else 1 - i % 2, 0) for i in range(300)] + [(5000, 1, 0), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality_classifier.classify(docs, quality_classifier.fit(docs, labels)).collect()}
    assert all(found[i]["predicted"] == i % 2 and found[i]["held_out"] == held(i) for i in range(300))
    assert 0 <= found[900]["score"] <= 1 and found[900]["score"] == found[901]["score"]
    none = quality_classifier.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality_classifier.classify(docs, none).collect()} == {0.5}
    assert quality_classifier.classify(empty(spark), none).collect() == []
    assert quality_classifier.accept(docs, labels).columns == docs.columns


def test_mixing_meets_the_targets(spark):
    rows = [row(i, "w " * (5 + i % 7), "en" if i % 3 else "de", "big" if i % 4 else "small") for i in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    targets = {"source": {"big": 0.5, "small": 0.5}, "lang": {"en": 0.5, "de": 0.5}}
    found = mixing.mix(docs, targets).collect()
    weight = sum(r["tokens"] * r["probability"] for r in found)
    for axis, value in (("source", "small"), ("lang", "de")):
        assert abs(sum(r["tokens"] * r["probability"] for r in found if r[axis] == value) / weight - 0.5) < 1e-6
    assert max(r["probability"] for r in found) == 1.0
    drawn = [r for r in found if r["selected"]]
    assert abs(sum(r["tokens"] for r in drawn) / weight - 1) < 0.05
    again = mixing.mix(docs.repartition(7), targets)
    assert rows_of(again, "doc_id", "selected") == sorted(((r["doc_id"], r["selected"]) for r in found), key=repr)
    assert {r["doc_id"] for r in again.filter("selected").collect()} == {r["doc_id"] for r in drawn}


def test_every_source_has_a_target_of_its_own(spark, monkeypatch):
    """A hot source among hundreds of small ones, raked on the driver and as tables."""
    rows = [row(i, "w " * 10, "en", "hot") for i in range(400)] + [row(1000 + i, "w " * 10, "en", f"s{i % 400:03}") for i in range(800)]
    rows += [row(5000, "", "de", "blank"), row(5001, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mix(docs).collect()
    weight = sum(r["tokens"] * r["probability"] for r in found)
    share = lambda name: sum(r["tokens"] * r["probability"] for r in found if r["source"] == name) / weight
    root = 400**0.5 + 400 * 2**0.5
    assert len({r["source"] for r in found}) == 403
    assert abs(share("hot") - 400**0.5 / root) < 1e-6 and abs(share("s007") - 2**0.5 / root) < 1e-6
    monkeypatch.setattr(mixing, "LOCAL_CELLS", 0)
    chance = {r["doc_id"]: r["probability"] for r in mixing.mix(docs).collect()}
    assert len(chance) == len(found) and all(abs(chance[r["doc_id"]] - r["probability"]) < 1e-6 for r in found)
    lumped = mixing.mix(docs, least_share={"source": 0.01}).collect()
    assert {r["source"] for r in lumped} == {"hot", "(other)"} and len(lumped) == len(rows)


def test_mixing_bears_odd_rows(spark):
    docs = documents(spark)
    assert mixing.mix(docs).count() == docs.count()
    assert mixing.sample(docs).columns == docs.columns
    assert mixing.mix(empty(spark)).collect() == []
    assert mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).count() == docs.count()


def plain_rake(cells, targets, rounds=400):
    """Iterative proportional fitting by dictionaries: {cell: weight} and a target share for every value of each axis."""
    total = sum(cells.values())
    w = {c: v / total for c, v in cells.items()}
    for _ in range(rounds):
        for axis, goal in enumerate(targets):
            have = {}
            for c, v in w.items():
                have[c[axis]] = have.get(c[axis], 0) + v
            w = {c: v * goal[c[axis]] / have[c[axis]] if have[c[axis]] else 0.0 for c, v in w.items()}
    return {c: w[c] / (v / total) if v else None for c, v in cells.items()}


def test_mixing_matches_brute_force(spark):
    rnd = random.Random(21)
    texts = ["a license here " * 9, "mail x@y.example", "### symbols ###", "w " * 500, "short one", "  ", None]
    rows = [row(i, rnd.choice(texts), rnd.choice(["en", "de", None]), rnd.choice("abbbbccd")) for i in range(600)] + [row(7, "w " * 500, "en", "a"), row(None, "x y", "de", "b")]

    def topic(t, n):
        return "legal" if "license" in t else "contact" if "@" in t else "markup" if "###" in t else "long" if n >= 400 else "short"

    cells = {}
    for i, text, lang, source, *_ in rows:
        words = (text or "").split()
        cell = (source or "(none)", lang or "(none)", topic(text or "", len(words)))
        cells[cell] = cells.get(cell, 0) + len(words)
    goals = []
    for axis, power in enumerate((0.5, 0.7, 0.9)):
        have = {}
        for c, v in cells.items():
            have[c[axis]] = have.get(c[axis], 0) + v
        whole = sum(v**power for v in have.values())
        goals.append({k: v**power / whole for k, v in have.items()})
    factors = plain_rake(cells, goals)
    top = max(f for f in factors.values() if f is not None)
    found = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    for r in found:
        want = factors[r["source"], r["lang"], r["topic"]]
        assert abs(r["probability"] - (1.0 if want is None else want / top)) < 1e-6
    taken = {(r["doc_id"], r["source"], r["lang"], r["topic"]) for r in found if r["selected"]}
    kept = mixing.sample(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(kept) == sum(r["selected"] for r in found) and {(r["doc_id"], r["source"] or "(none)", r["lang"] or "(none)") for r in kept} == {t[:3] for t in taken}


def test_targets_that_exclude_each_other_warn():
    weights, codes = np.array([1.0, 1.0]), np.array([[0, 0], [1, 1]])
    with pytest.warns(UserWarning, match="exclude"):
        mixing.rake(weights, codes, [np.array([0.9, 0.1]), np.array([0.1, 0.9])])


def test_scores_are_the_size_difference_alone(spark):
    """Recomputed with zstandard from the model's dictionaries; the score rises with the difference."""
    import zstandard

    docs = documents(spark)
    model = quality_classifier.Model(b"alpha beta gamma delta " * 60, b"same line\n word word one two " * 60, (0.3, 2.0))
    tools = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), level=quality_classifier.LEVEL, write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    size = lambda t, data: len(t.compress(data)) - len(t.compress(b""))
    want = {}
    for r in docs.collect():
        data = (r["text"] or "").encode()
        pieces = [data[i : i + quality_classifier.PIECE] for i in range(0, len(data), quality_classifier.PIECE)]
        good, bad = (sum(size(t, p) for p in pieces) for t in tools)
        want[r["doc_id"], r["text"]] = 1 / (1 + np.exp(-(0.3 + 2.0 * 20 * (bad - good) / max(len(data), 1))))
    found = quality_classifier.classify(docs, model).collect()
    ids = {}
    for (i, _), v in want.items():
        ids.setdefault(i, set()).add(round(float(v), 9))
    assert all(round(r["score"], 9) in ids[r["doc_id"]] for r in found) and len(found) == docs.count()


def test_conflicting_and_repeated_labels(spark):
    rows = [row(i, f"{'good prose here ' if i % 2 else 'bad $$$ junk '}{i} " * 20) for i in range(200)]
    docs = spark.createDataFrame(rows + rows[:40], SCHEMA)
    plain = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    noisy = plain.unionByName(plain).unionByName(spark.createDataFrame([(500, 0), (500, 1), (1, None), (2, 7)], "doc_id long, quality int"))
    assert quality_classifier.fit(docs, noisy) == quality_classifier.fit(docs, plain)


def test_reliabilities_match_brute_force():
    """Expectation-maximisation of three labelers by plain loops over every item."""
    from foliary.llm import pii

    rnd = random.Random(31)
    totals = {}
    for _ in range(400):
        true = rnd.random() < 0.5
        votes = tuple((1 if true else -1) if rnd.random() < p else rnd.choice([-1, 0, 1]) for p in (0.9, 0.8, 0.6))
        totals[votes] = totals.get(votes, 0) + 1
    share, table = pii.reliabilities(totals)
    p, q = 0.5, [[[0.5, 0.3, 0.2]] * 3, [[0.2, 0.3, 0.5]] * 3]
    for _ in range(400):
        belief = {}
        for v in totals:
            one, zero = p, 1 - p
            for j, x in enumerate(v):
                one, zero = one * q[1][j][x + 1], zero * q[0][j][x + 1]
            belief[v] = one / (one + zero)
        n = sum(totals.values())
        p = (sum(totals[v] * belief[v] for v in totals) + 1) / (n + 2)
        for y in (0, 1):
            weight = {v: totals[v] * (belief[v] if y else 1 - belief[v]) for v in totals}
            q[y] = [[(sum(w for v, w in weight.items() if v[j] == x - 1) + 1) / (sum(weight.values()) + 3) for x in range(3)] for j in range(3)]
    assert share == pytest.approx(p, abs=1e-3) and np.allclose(table, q, atol=2e-3)
