"""Functions against plain Python: glyph names, fax, calculator, keyed digests, signatures, and files made of files."""

import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from foliary.functions import values
from foliary.operators import layout, spatial, tables
from foliary.pdf import ccitt, ccitt_many, der, filters, functions, glyphs, writer
from foliary.pdf.document import Document
from foliary.pdf.syntax import Name, Stream
from foliary.pdf.text import page_glyphs, page_text
from foliary.plans import samples
from foliary.sources import pdf as source


def texts(data):
    doc = Document(data)
    return [page_text(doc, p) for p in doc.pages()]


def test_glyph_names():
    names = "one zero ampersand parenleft eacute bar Scaron Lslash dcroat Gcommaaccent alpha Omega lambda f_f_i a.sc uni00410042 u1F600 afii10017 afii10023 afii10097 fi quotesingle"
    assert [glyphs.glyph(n) for n in names.split()] == ["1", "0", "&", "(", "é", "|", "Š", "Ł", "đ", "Ģ", "α", "Ω", "λ", "ffi", "a", "AB", "😀", "А", "Ё", "я", "fi", "'"]
    assert {glyphs.glyph(n) for n in ("nonsense", ".notdef", "u110000", "Q12")} == {glyphs.UNKNOWN}
    standard = glyphs.encoding("StandardEncoding")
    assert standard[0x27] == "’" and standard[0x60] == "‘" and standard[0xAE] == "fi" and standard[0xFB] == "ß" and standard[0x80] == glyphs.UNKNOWN
    assert glyphs.encoding("Symbol")[0x61] == "α" and glyphs.encoding("WinAnsiEncoding")[0x80] == "€"


def placed(content, **more):
    doc = Document(samples.one_page(content, {"Font": {"F1": samples.simple_font()}}, **more))
    return [(g.ch, round(g.x, 4), round(g.y, 4), round(g.w, 4), round(g.h, 4), round(g.angle, 4)) for g in page_glyphs(doc, next(doc.pages()))]


def test_text_state():
    """Scaling, spacing, rise, rotation, and what q saves."""
    assert placed(b"BT /F1 10 Tf 50 Tz 2 Tc 3 Tw (a b) Tj ET") == [("a", 0, 0, 3, 10, 0), (" ", 4, 0, 3, 10, 0), ("b", 9.5, 0, 3, 10, 0)]
    assert placed(b"q 2 0 0 2 0 0 cm Q BT /F1 10 Tf 4 Ts (a) Tj ET") == [("a", 0, 4, 6, 10, 0)]
    assert placed(b"BT /F1 10 Tf 0 1 -1 0 5 6 Tm (ab) Tj ET") == [("a", 5, 6, 6, 10, 90), ("b", 5, 12, 6, 10, 90)]
    assert placed(b"q BT /F1 10 Tf ET Q BT /F1 20 Tf [(a) -500 (b)] TJ ET") == [("a", 0, 0, 12, 20, 0), ("b", 22, 0, 12, 20, 0)]
    assert placed(b"BT /F1 10 Tf 12 TL (a) ' 1 2 (b c) \" ET")[1][:3] == ("b", 0, -24)


def test_actual_text_covers_what_it_replaces():
    found = placed(b"BT /F1 10 Tf /Span << /ActualText (xyz) >> BDC (ab) Tj EMC ET")
    assert [(c, x, w) for c, x, _, w, _, _ in found] == [("x", 0, 4), ("y", 4, 4), ("z", 8, 4)]


def test_maps_of_mixed_code_sizes():
    from foliary.pdf.text import CMap

    cmap = CMap(b"2 begincodespacerange <00> <7f> <8000> <ffff> endcodespacerange 1 begincidrange <8000> <8002> 5 endcidrange 1 begincidchar <41> 9 endcidchar /WMode 1 def")
    assert list(cmap.codes(b"A\x80\x01B")) == [(0x41, 1), (0x8001, 2), (0x42, 1)]
    assert cmap.cids == {0x8000: 5, 0x8001: 6, 0x8002: 7, 0x41: 9} and cmap.vertical


def test_fax_survives_and_bears_anything():
    rnd = random.Random(1)
    for trial in range(200):
        width, rows = rnd.choice([8, 60, 64, 1728, 3000]), []
        size = (width + 7) // 8
        for _ in range(rnd.randrange(1, 5)):
            dense = rnd.choice([0, 0.02, 0.5, 0.98, 1])
            bits = "".join("1" if rnd.random() < dense else "0" for _ in range(width)).ljust(8 * size, "0")
            rows.append(rows[-1] if rows and rnd.random() < 0.3 else int(bits, 2).to_bytes(size, "big"))
        data, k = b"".join(rows), rnd.choice([-1, 0, 4])
        assert ccitt.decode(ccitt.encode(data, width, k), {"K": k, "Columns": width, "BlackIs1": True}, 1 << 20) == data, trial
        ccitt.decode(rnd.randbytes(60), {"K": k, "Columns": width}, 1 << 16)
    for codes in ccitt.CODES:  # no code word begins another
        assert not any(a != b and b.startswith(a) for a in codes.values() for b in codes.values())


def test_fax_bits_are_held_as_windows():
    """Each bit's window, which a code word is looked up by, without text of bits; and a last row that is cut short."""
    data = random.Random(3).randbytes(300)
    bits = ccitt.Bits(data)
    text = "".join(map("{:08b}".format, data)) + "0" * ccitt.LONGEST
    assert list(bits.windows) == [int(text[i : i + ccitt.LONGEST], 2) for i in range(8 * len(data) + 1)]
    assert list(ccitt.Bits(b"").windows) == [0]
    for k in (-1, 0, 4):
        back = ccitt.decode(ccitt.encode(data[:12], 64, k), {"K": k, "Columns": 64, "BlackIs1": True}, 1 << 20)
        assert back == data[:12] + b"\0" * 4


def test_mixed_fax_keeps_rows_cut_short():
    """Every fourth line is coded by itself, the others against the one above; the last row may be short."""
    rnd = random.Random(8)
    for n in range(1, 90, 7):
        data = rnd.randbytes(n)
        back = ccitt.decode(ccitt.encode(data, 64, 4), {"K": 4, "Columns": 64, "BlackIs1": True}, 1 << 20)
        assert back == data.ljust(-(-n // 8) * 8, b"\0")


def _fax_blocks(rnd, width):
    """Blocks of lines like the ones above them, full, bare and of noise; the last line may be cut short."""
    size, blocks = (width + 7) // 8, [b""]
    for _ in range(12):
        rows = []
        for _ in range(rnd.randrange(12)):
            row = rnd.choice([bytes(size), b"\xff" * size, rnd.randbytes(size), rnd.randbytes(1) * size])
            rows.append(bytes(x ^ (rnd.random() < 0.1) << rnd.randrange(8) for x in rows[-1]) if rows and rnd.random() < 0.5 else row)
        data = b"".join(rows)
        blocks.append(data[: rnd.randrange(len(data) + 1)] if rnd.random() < 0.3 else data)
    return blocks


def test_fax_side_by_side_is_fax_one_by_one(monkeypatch):
    """Lines of many blocks at once, in parts of any size, damaged ones too."""
    monkeypatch.setattr(ccitt_many, "FEW", 0)
    rnd = random.Random(6)
    for trial in range(60):
        width, k = rnd.choice([1, 7, 8, 60, 64, 100, 1728, 2560, 3000]), rnd.choice([-1, 0, 1, 2, 4, 9])
        monkeypatch.setattr(ccitt_many, "TOGETHER", rnd.choice([3 << 20, 20000, 2000]))
        monkeypatch.setattr(ccitt_many, "ABREAST", rnd.choice([8192, 7]))
        blocks = _fax_blocks(rnd, width)
        coded = ccitt_many.encode_many(blocks, width, k)
        assert coded == [ccitt.encode(x, width, k) for x in blocks], trial
        hurt = [bytes(x ^ (rnd.random() < 0.03) << rnd.randrange(8) for x in c) for c in coded]
        short = [c[: rnd.randrange(len(c) + 1)] + b"\0" * rnd.randrange(9) for c in coded]
        for some in (coded, hurt, short, [rnd.choice([b"", b"\0\x10"]) + rnd.randbytes(40) for _ in coded]):
            params = [{"K": k, "Columns": width, "BlackIs1": rnd.random() < 0.5, "Rows": rnd.choice([0, len(x) // 8, 9])} for x in blocks]
            most = rnd.choice([1 << 20, 100])
            assert ccitt_many.decode_many(some, params, most) == [ccitt.decode(c, p, most) for c, p in zip(some, params, strict=True)], trial


def test_mixed_fax_is_read_side_by_side(monkeypatch):
    """No plain block is read line by line, whose cost a gigabyte of texts can't bear."""
    rnd = random.Random(7)
    texts = [("".join(rnd.choices("etaoin shrdlu.\n", k=rnd.randrange(3000)))).encode() for _ in range(40)]
    texts = [x.ljust(-(-len(x) // 8) * 8, b"\0") for x in texts]
    slow = lambda *_: pytest.fail("read line by line")
    monkeypatch.setattr(ccitt, "decode", slow)
    monkeypatch.setattr(ccitt, "encode", slow)
    for k in (0, 4):
        coded = ccitt_many.encode_many(texts, 64, k)
        assert filters.decode_many(coded, ["CCF"], [[{"K": k, "Columns": 64, "Rows": len(x) // 8, "BlackIs1": True}] for x in texts]) == texts


def test_calculator():
    run = functions.calculate
    assert run(b"{ 3 1 roll }", [1, 2, 3]) == [3, 1, 2] and run(b"{ 2 copy add }", [1, 2]) == [1, 2, 3] and run(b"{ 1 index }", [4, 5]) == [4, 5, 4]
    assert run(b"{ dup 0 lt { neg } if }", [-3]) == [3] and run(b"{ 90 sin exch pop }", [0]) == [1] and run(b"{ add }", [1]) == []
    assert run(b"{ 7 2 idiv 7 2 mod 1 3 bitshift }", []) == [3, 1, 8] and run(b"{ 1 0 atan 2.5 round -2.5 truncate }", []) == [90, 3, -2]


def test_sampled_functions_of_two_inputs():
    stream = Stream({"FunctionType": 0, "Domain": [0, 1, 0, 1], "Range": [0, 255], "Size": [2, 2], "BitsPerSample": 8}, bytes([0, 100, 200, 40]))
    at = lambda x, y: functions.evaluate(samples.function_host(), stream, [x, y])[0]
    assert [at(0, 0), at(1, 0), at(0, 1), at(1, 1)] == [0, 100, 200, 40] and at(0.5, 0.5) == pytest.approx(85) and at(9, -9) == 100


def test_keyed_and_long_digests(spark):
    rows = [(b"k", b"m"), (b"", b""), (b"x" * 64, b"y" * 200), (b"z" * 65, b"long key"), (bytes(range(256)), bytes(range(256)))]
    found = spark.createDataFrame(rows, "k binary, m binary").select("k", "m", values.hmac_sha256(F.col("k"), F.col("m")).alias("mac"), F.sha2("m", 384).alias("a"), F.sha2("m", 512).alias("b"))
    for r in found.collect():
        assert r["mac"] == hmac.new(bytes(r["k"]), bytes(r["m"]), "sha256").hexdigest()
        assert (r["a"], r["b"]) == (hashlib.sha384(r["m"]).hexdigest(), hashlib.sha512(r["m"]).hexdigest())


def test_signatures():
    rows = [next(source.rows_of(samples.signed("p", n), "signatures")) for n in range(3)]
    assert [r[9] for r in rows] == ["INTACT", "DIGEST_MISMATCH", "BAD_SIGNATURE"]
    assert der.check(b"junk", [b"x"])["verdict"] == "NO_SIGNED_DIGEST" and der.check(b"", [])["digest_ok"] is None
    assert der.oid(der.put_oid("2.16.840.1.101.3.4.2.1")[2:]) == "2.16.840.1.101.3.4.2.1"
    rnd, whole = random.Random(2), samples._KEY[0].cms(b"data")
    for _ in range(300):  # damage gives a verdict, whatever it is
        broken = bytearray(whole)
        broken[rnd.randrange(len(broken))] = rnd.randrange(256)
        try:
            der.check(bytes(broken), [b"data"])
        except (IndexError, ValueError):
            pass  # one row's status


def test_files_of_files():
    a, b = writer.build(["a1", "a2", "a3"], notes=[(1, "n")]), writer.build(["b1"])
    both = writer.merge([a, b])
    assert texts(both) == ["a1", "a2", "a3", "b1"] and [x["contents"] for x in Document(both).annotations()] == ["n"]
    assert [texts(p) for p in writer.split(both, 3)] == [["a1", "a2", "a3"], ["b1"]]
    with pytest.raises(ValueError):
        writer.assemble([(a, [3])])


def test_forms_are_filled():
    data = writer.build(["x"], fields=[{"type": "Tx", "name": "t", "value": "v", "max_length": 4}, {"type": "Ch", "name": "c", "options": ["a", "b"]}, {"type": "Btn", "name": "p", "flags": 1 << 16}])
    new, refused = writer.fill(data, {"t": "éé", "c": [0, 1], "p": True, "q": ""})
    assert refused == {"c": "one option only", "p": "push button", "q": "no such field"}
    assert {f["full_name"]: f["value"] for f in Document(new).fields()}["t"] == "éé"
    assert writer.fill(data, {"t": "ééé"})[1] == {"t": "too long"} and writer.fill(data, {"c": 2})[1] == {"c": "not an option"}


def test_sink(spark, tmp_path):
    source.register(spark)
    rows = spark.createDataFrame([("a.pdf", ["one", "two"]), ("b.pdf", None), ("../c.pdf", ["three"])], "name string, pages array<string>")
    folder = tmp_path / "out"
    folder.mkdir()
    rows.write.format("pdf").mode("append").save(str(folder))
    assert sorted(p.name for p in folder.iterdir()) == ["a.pdf", "b.pdf", "c.pdf"]
    assert texts((folder / "a.pdf").read_bytes()) == ["one", "two"]


def test_one_bad_page_costs_one_page():
    w = writer.Writer()
    root, tree = w.add(), w.add()
    bad, good = w.add(Stream({"Filter": Name("Nope")}, b"x")), w.add(Stream({}, b"BT (good) Tj ET"))
    kids = [w.add({"Type": Name("Page"), "Parent": tree, "Contents": c}) for c in (bad, good)]
    w.put(tree, {"Type": Name("Pages"), "Kids": kids, "Count": 2})
    w.put(root, {"Type": Name("Catalog"), "Pages": tree})
    found = list(source.rows_of(w.save(root), "pages"))
    assert [(r[5], r[6]) for r in found] == [(None, "PARTIAL"), ("good", "OK")]


def test_several_sections_of_one_parse(spark):
    files = spark.createDataFrame([("a", writer.build(["x", "y"])), ("b", b"%PDF-1.4 broken"), ("c", None)], "path string, content binary")
    parsed = source.parse(files, ("documents", "pages"))
    assert sorted((r["path"], r["status"], r["n_pages"]) for r in source.rows(parsed, "documents").collect()) == [("a", "OK", 2), ("b", "MALFORMED", None), ("c", "EMPTY", None)]
    assert sorted((r["path"], r["text"]) for r in source.rows(parsed, "pages").filter("status = 'OK'").collect()) == [("a", "x"), ("a", "y")]


def test_groups_of_files():
    assert source.packed([("a", 5), ("b", 9), ("c", 1), ("d", 4)], 6) == [["b"], ["a"], ["d", "c"]]
    assert source.packed([], 6) == []


def glyph_rows(spark, rows):
    schema = "doc_id long, page_no int, ord long, ch string, x double, y double, w double, h double"
    return layout.pack(spark.createDataFrame(rows, schema))


def test_layout_against_plain_python(spark):
    """Random glyphs: lines by the definition, one glyph at a time."""
    rnd, rows = random.Random(3), []
    for page in range(20):
        for i in range(rnd.randrange(1, 60)):
            rows.append((1, page, i, rnd.choice("ab 漢🙂"), rnd.randrange(40) * 5.0, 100.0 - rnd.randrange(20) * 1.5, rnd.choice([4.0, 7.0]), 6.0))
    want = {}
    for page in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == page), key=lambda r: (-r[5], r[4], r[2]))
        bands, n, before = {}, -1, None
        for r in mine:
            n += before is None or before - r[5] > 2.0
            before = r[5]
            bands[r[2]] = n
        mine.sort(key=lambda r: (bands[r[2]], r[4], r[2]))
        number, last = -1, None
        for r in mine:
            wide = last is None or bands[last[2]] != bands[r[2]] or r[4] - last[4] - last[6] >= 10.0 * max(r[6], r[7])
            number += wide
            want[page, number] = want.get((page, number), "") + r[3]
            last = r
    found = {(r["page_no"], r["line_index"]): r["text"] for r in layout.lines(glyph_rows(spark, rows)).collect()}
    assert found == want
    assert layout.words(glyph_rows(spark, rows)).filter("text = ''").count() == 0


def test_packing_over_batches(spark):
    """Pages that end within, at and beyond a batch of seven rows; null keys are a page of their own."""
    sizes = {(1, 0): 7, (1, 1): 20, (2, 0): 1, (None, 0): 3, (3, None): 9, (4, 5): 14}
    rows = [(d, p, i, chr(97 + i), float(i), 0.0, 1.0, 1.0) for (d, p), n in sizes.items() for i in reversed(range(n))]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "7")
    try:
        found = {(r["doc_id"], r["page_no"]): r for r in glyph_rows(spark, rows).collect()}
    finally:
        spark.conf.unset(key)
    assert {k: len(r["glyphs"]) for k, r in found.items()} == sizes
    assert all(r["glyphs"] == "".join(chr(97 + i) for i in range(len(r["x"]))) and r["x"] == [float(i) for i in range(len(r["x"]))] for r in found.values())


def test_selections_and_cells(spark):
    rows = [(1, 0, i, c, 10.0 * i, 50.0, 8.0, 10.0) for i, c in enumerate("abcde")] + [(1, 0, 9, "z", 0.0, 20.0, 8.0, 10.0), (2, 0, 0, " ", 0.0, 0.0, 1.0, 1.0)]
    pages = glyph_rows(spark, rows)
    assert [r["text"] for r in spatial.select_rect(pages, 12, 45, 31, 65).collect()] == ["bcd"]
    assert [r["text"] for r in spatial.select_rect(pages, 12, 45, 31, 65, centre=True).collect()] == ["bc"]
    assert [(r["ord"], r["ch"]) for r in spatial.hit_test(pages, 21, 55).collect()] == [(2, "c")] and spatial.hit_test(pages, 500, 5).collect() == []
    assert [(r["start"], r["x1"], r["x2"]) for r in spatial.hit_boxes(pages, "bc").collect()] == [(1, 10.0, 28.0)]
    assert tables.cells(pages).collect() == []  # one column, and one glyph
    assert layout.lines(pages.filter("doc_id = 9")).collect() == []
