import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliary.pdf import filters
from foliary.pdf.document import Document, Malformed
from foliary.pdf.syntax import Keyword, Lexer, Name, Ref, Stream, dump, text_of, text_string
from foliary.pdf.text import CMap, page_text, tokens
from foliary.pdf.writer import Writer, build, split, update
from foliary.plans import samples
from foliary.sources.pdf import SECTIONS, rows_of


def read(data):
    return Lexer(data).read()


def test_objects():
    assert read(b"<< /A#20B [1 -2.5 (a\\(b\\)\\101\\n(c)) <4142F> true null 3 0 R] /C /D >>") == {
        "A B": [1, -2.5, b"a(b)A\n(c)", b"AB\xf0", True, None, Ref(3, 0)], "C": "D",
    }
    assert read(b"") is None and read(b"% only\n") is None
    assert isinstance(read(b"]"), Keyword) and read(b"[" * 5000) is not None


scalars = st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.binary(max_size=30) | st.text(st.characters(min_codepoint=33, max_codepoint=255), max_size=8).map(Name)
values = st.recursive(scalars, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("abcXYZ", min_size=1, max_size=4), x, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(values)
def test_objects_survive_writing(value):
    assert read(dump(value)) == value


@settings(max_examples=100, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_text_strings_survive(text):
    raw = text_string(text)
    assert text_of(raw) == text or raw[:2] in (b"\xfe\xff", b"\xef\xbb")


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000))
def test_filters_survive(data):
    assert filters.lzw(filters.lzw_encode(data)) == data
    assert filters.run_length(filters.run_length_encode(data)) == data
    assert filters.decode(data.hex().encode() + b">", ["AHx"], []) == data
    packed = zlib.compress(filters.predict_up(data, 7))
    assert filters.decode(packed, ["Fl"], [{"Predictor": 12, "Columns": 7}])[: len(data)] == data


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=400))
def test_decoders_bear_anything(data):
    for f in (filters.flate, filters.lzw, filters.run_length, filters.ascii_hex):
        f(data)


def test_known_filter_outputs():
    assert filters.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == b"-----A---B"
    assert filters.ascii85(b"<~87cURD]i,\"Ebo80~>") == b"Hello World!"
    assert filters.run_length(bytes([2, 65, 66, 67, 254, 68, 128, 1])) == b"ABCDDD"
    sub = bytes([1, 1, 2, 3, 1, 1, 1, 1])
    assert filters.predict(sub, {"Predictor": 15, "Columns": 3}) == bytes([1, 3, 6, 1, 2, 3])
    paeth = bytes([0, 1, 2, 3, 4, 1, 1, 1])
    assert filters.predict(paeth, {"Predictor": 15, "Columns": 3}) == bytes([1, 2, 3, 2, 3, 4])
    assert filters.predict(bytes([1, 1, 1, 5, 1, 1]), {"Predictor": 2, "Columns": 3}) == bytes([1, 2, 3, 5, 6, 7])
    long = random.Random(1).randbytes(50_000)
    assert filters.lzw(filters.lzw_encode(long)) == long
    with pytest.raises(filters.FilterError, match="step 2/2"):
        filters.decode(b"00>", ["AHx", "Nope"], [])


def test_documents_survive_and_repair():
    texts = ["first\npage é", "漢字 🙂", ""]
    data = build(texts, info={"Title": "T é", "Author": "€"}, outline=[("a", [("b", [("c", [])])]), ("d", [])], notes=[(1, "note")], attachments={"x.txt": b"abc"},
                 fields=[{"type": "Tx", "name": "n", "value": "v", "flags": 2}], labels=[(0, "r", "", 1), (2, "D", "A-", 5)])
    doc = Document(b"junk" + data)
    assert [page_text(doc, p) for p in doc.pages()] == texts and not doc.repaired
    assert doc.info() == {"Title": "T é", "Author": "€"}
    assert [x[:2] for x in doc.outline()] == [([0], "a"), ([0, 0], "b"), ([0, 0, 0], "c"), ([1], "d")]
    assert [(a["page_no"], a["contents"]) for a in doc.annotations()] == [(1, "note")]
    assert [(f["full_name"], f["value"]) for f in doc.fields()] == [("n", "v")]
    assert [a["content"] for a in doc.attachments()] == [b"abc"]
    assert [x["prefix"] for x in doc.labels()] == ["", "A-"]
    cut = data[: data.rfind(b"xref\n")]
    assert [page_text(d, p) for d in [Document(cut)] for p in d.pages()] == texts
    with pytest.raises(Malformed):
        Document(cut, repair=False)
    rnd = random.Random(3)
    for _ in range(150):  # damage becomes a status, whatever it is
        broken = bytearray(data)
        for _ in range(20):
            broken[rnd.randrange(len(broken))] = rnd.randrange(256)
        for name in SECTIONS:
            assert list(rows_of(bytes(broken), name)) is not None


def test_updates_are_revisions():
    data = build(["x"], info={"Title": "old"})
    doc = Document(data)
    newer = update(data, {doc.trailer["Info"].num: {"Title": b"new"}})
    assert Document(newer).info() == {"Title": "new"}
    assert [r["end_offset"] for r in Document(newer).revisions()] == [len(data), len(newer)]


def test_compressed_objects_and_cross_reference_streams():
    body = b"<< /Type /Catalog /Pages 2 0 R >> << /Type /Pages /Kids [3 0 R] /Count 1 >> << /Type /Page /Parent 2 0 R /Contents 5 0 R >>"
    at = [0, body.index(b"<< /Type /Pages"), body.index(b"<< /Type /Page /")]
    head = b" ".join(b"%d %d" % (n + 1, a) for n, a in enumerate(at)) + b" "
    out, offsets = bytearray(b"%PDF-1.5\n"), {}
    for num, stream in ((4, Stream({"Type": Name("ObjStm"), "N": 3, "First": len(head)}, head + body)), (5, Stream({}, b"BT (hi) Tj [(a) -20 (b)] TJ ET"))):
        offsets[num] = len(out)
        out += b"%d 0 obj\n" % num + dump(stream) + b"\nendobj\n"
    start = len(out)
    rows = [(0, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, offsets[4], 0), (1, offsets[5], 0), (1, start, 0)]
    table = b"".join(bytes([a]) + b.to_bytes(2, "big") + bytes([c]) for a, b, c in rows)
    out += b"6 0 obj\n" + dump(Stream({"Type": Name("XRef"), "W": [1, 2, 1], "Size": 7, "Root": Ref(1, 0), "Filter": Name("FlateDecode")}, zlib.compress(table)))
    out += b"\nendobj\nstartxref\n%d\n%%%%EOF" % start
    doc = Document(bytes(out))
    assert not doc.repaired and [page_text(doc, p) for p in doc.pages()] == ["hiab"]


def test_content_and_maps():
    assert list(tokens(b"BI /W 1 ID \x00(Tj EI (a) Tj")) == [([b"a"], b"Tj")]
    cmap = CMap(b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <0041> endbfchar 2 beginbfrange <0002> <0003> <0061> <0005> <0006> [<0078> <0079>] endbfrange")
    assert cmap.text(b"\0\1\0\2\0\3\0\5\0\6") == "Aabxy"


def test_actual_text_and_forms():
    w = Writer()
    root, tree, page, body, form = (w.add() for _ in range(5))
    w.put(root, {"Type": Name("Catalog"), "Pages": tree})
    w.put(tree, {"Type": Name("Pages"), "Kids": [page, tree], "Count": 1})
    w.put(page, {"Type": Name("Page"), "Resources": {"XObject": {"X": form}}, "Contents": body})
    w.put(body, Stream({}, b"BT /Span << /ActualText (said) >> BDC (shown) Tj EMC ET /X Do"))
    w.put(form, Stream({"Subtype": Name("Form"), "Resources": {"XObject": {"X": form}}}, b"BT (in) Tj ET /X Do"))
    doc = Document(w.save(root))
    assert page_text(doc, next(doc.pages())).split("\n")[:2] == ["said", "in"]


def test_further_sections():
    w = Writer()
    root, tree, page, image, layer, hidden, meta, sig, elem = (w.add() for _ in range(9))
    link = {"Subtype": Name("Link"), "A": {"S": Name("URI"), "URI": b"http://x.example"}}
    w.put(root, {
        "Type": Name("Catalog"), "Pages": tree, "Metadata": meta, "OpenAction": [page, Name("Fit")], "Dests": {"top": [page, Name("XYZ"), 0, 0, 0]},
        "Names": {"Dests": {"Names": [b"n", {"D": [page, Name("Fit")]}]}}, "OCProperties": {"OCGs": [layer, hidden], "D": {"OFF": [hidden]}},
        "StructTreeRoot": {"RoleMap": {"Headline": Name("H1")}, "K": elem}, "OutputIntents": [{"S": Name("GTS_PDFA1"), "OutputConditionIdentifier": b"sRGB"}],
    })
    w.put(tree, {"Type": Name("Pages"), "Kids": [page], "Count": 1})
    w.put(page, {"Type": Name("Page"), "Resources": {"XObject": {"I": image}}, "Annots": [link], "AA": {"O": {"S": Name("Named"), "N": Name("NextPage")}}})
    w.put(image, Stream({"Subtype": Name("Image"), "Width": 2, "Height": 3, "BitsPerComponent": 8, "ColorSpace": Name("DeviceRGB"), "Filter": Name("DCTDecode")}, b"jpeg"))
    w.put(layer, {"Type": Name("OCG"), "Name": b"shown"})
    w.put(hidden, {"Type": Name("OCG"), "Name": b"hidden"})
    w.put(meta, Stream({"Type": Name("Metadata")}, b"<x:xmpmeta/>"))
    w.put(sig, {"Type": Name("Sig"), "SubFilter": Name("adbe.pkcs7.detached"), "ByteRange": [0, 5, 8, 4], "Contents": b"\x30"})
    w.put(elem, {"S": Name("Headline"), "Alt": b"alt", "K": [0, {"S": Name("Span"), "K": 1}]})
    data = w.save(root)
    rows = {name: [r[:-2] for r in rows_of(data, name)] for name in SECTIONS}
    assert rows["actions"] == [(None, "OpenAction", "GoTo", "0"), (0, "O", "Named", "NextPage"), (0, "A", "URI", "http://x.example")]
    assert rows["destinations"] == [("n", 0, "Fit"), ("top", 0, "XYZ")]
    assert rows["layers"] == [(5, "shown", True), (6, "hidden", False)]
    assert rows["images"] == [(0, "I", 2, 3, 8, "DeviceRGB", "DCTDecode", b"jpeg")]
    assert rows["structure"] == [([0], "H1", "alt", None, [0]), ([0, 1], "Span", None, None, [1])]
    assert rows["intents"] == [("GTS_PDFA1", "sRGB", None)] and rows["xmp"] == [("<x:xmpmeta/>",)]
    assert rows["signatures"][0][:4] == (8, "adbe.pkcs7.detached", [0, 5, 8, 4], 12)


def test_split_parses_a_file_once(monkeypatch):
    data, made = samples.three_pages("a", "b"), []
    begun = Document.__init__
    monkeypatch.setattr(Document, "__init__", lambda self, *a, **k: (made.append(1), begun(self, *a, **k))[1])
    parts = split(data, 2)
    assert len(made) == 1
    assert [[page_text(d, p) for p in d.pages()] for d in map(Document, parts)] == [["a", "b"], ["ab"]]


def test_quick_paths_of_the_lexer_read_as_the_slow_one():
    """Plain arrays and pairs are read by one expression each; a null byte after every token puts both out of use."""
    rnd = random.Random(4)
    parts = [b"1", b"-2", b"3.5", b".5", b"4.", b"123456789012345678901", b"/A", b"/B#20", b"1 0 R", b"12 3 Rx", b"(a)", b"<41>", b"true", b"null"]
    for _ in range(3000):
        items = [rnd.choice(parts) for _ in range(rnd.randrange(8))]
        for wrap in (b"[%s]", b"<</K%s>>"):
            body = [rnd.choice((b"/K", b"/L")) + b" " * (x[:1] not in b"/(<") + x for x in items] if wrap[0] == 60 else items
            quick, slow = Lexer(wrap % b" ".join([b"", *body])).read(), Lexer(wrap % b" \0".join([b"\0", *body, b""])).read()
            assert repr(quick) == repr(slow), body
    assert Lexer(b"[" + b"1 " * 99999 + b"]").read() == [1] * 99999 and dump([True, 1, -2]) == b"[true 1 -2]" and dump([1, -2]) == b"[1 -2]"
