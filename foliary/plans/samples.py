"""Sample files that the queries write from rows, with one page unless they say otherwise."""

from __future__ import annotations

import hashlib
import zlib

from ..pdf import der
from ..pdf.crypt import Aes, Handler, rc4
from ..pdf.syntax import Name, Ref, Stream, dump
from ..pdf.writer import Writer, build, sign, update

N = Name


def one_page(content: bytes = b"", resources=None, page=None, catalog=None, info: dict | None = None) -> bytes:
    """``resources``, ``page`` and ``catalog`` are dictionaries, or functions of the writer and the page that make them."""
    w = Writer()
    root, tree, leaf = w.add(), w.add(), w.add()
    made = lambda x: x(w, leaf) if callable(x) else x or {}
    body = w.add(Stream({"Filter": N("FlateDecode")}, zlib.compress(content)))
    w.put(leaf, {"Type": N("Page"), "Parent": tree, "MediaBox": [0, 0, 612, 792], "Contents": body, "Resources": made(resources)} | made(page))
    w.put(tree, {"Type": N("Pages"), "Kids": [leaf], "Count": 1})
    w.put(root, {"Type": N("Catalog"), "Pages": tree} | made(catalog))
    return w.save(root, w.add({k: v.encode() for k, v in info.items()}) if info else None)


def simple_font(**more) -> dict:
    """A font of one-byte codes, 600 thousandths wide from the space on."""
    return {"Type": N("Font"), "Subtype": N("Type1"), "BaseFont": N("Sample"), "FirstChar": 32, "Widths": [600] * 224} | more


def literal(text: str) -> bytes:
    return dump(text.encode("latin-1", "replace"))


def moved(name: str, x: int, y: int) -> bytes:
    """A name at a place that a doubled and shifted coordinate system moves, after a state that is put back."""
    content = b"q 9 0 0 9 500 500 cm Q q 2 0 0 2 10 20 cm BT /F1 5 Tf 0.5 Tc 1 0 0 1 %d %d Tm %s Tj ET Q" % (x, y, literal(name))
    return one_page(content, {"Font": {"F1": simple_font()}})


def scattered(lines: list[str]) -> bytes:
    """Lines from the bottom up, each by a text matrix of its own."""
    parts = [b"1 0 0 1 50 %d Tm %s Tj" % (700 - 20 * i, literal(t)) for i, t in reversed(list(enumerate(lines)))]
    return one_page(b"1 0 0 1 5 -5 cm BT /F1 10 Tf " + b" ".join(parts) + b" ET", {"Font": {"F1": simple_font()}})


def table(rows: list[list[str]]) -> bytes:
    """Cells by text matrices, columns 250 points apart."""
    parts = [b"1 0 0 1 %d %d Tm %s Tj" % (40 + 250 * c, 700 - 20 * r, literal(t)) for c in range(len(rows[0])) for r, t in enumerate(x[c] for x in rows)]
    return one_page(b"BT /F1 10 Tf " + b" ".join(parts) + b" ET", {"Font": {"F1": simple_font()}})


def differences(name: str) -> bytes:
    """Digits under the codes of letters, by glyph names."""
    names = "zero one two three four five six seven eight nine ampersand eacute Scaron".split()
    encoding = {"Type": N("Encoding"), "Differences": [65, *map(N, names)]}
    return one_page(b"BT /F1 10 Tf %s Tj ET" % literal(name), {"Font": {"F1": simple_font(Encoding=encoding)}})


def wide_font(name: str) -> bytes:
    """Two-byte codes with widths by list and by range."""

    def resources(w, _):
        below = w.add({"Type": N("Font"), "Subtype": N("CIDFontType2"), "BaseFont": N("Wide"), "DW": 1000, "W": [48, [100 * k for k in range(1, 11)], 65, 90, 700]})
        return {"Font": {"F1": w.add({"Type": N("Font"), "Subtype": N("Type0"), "BaseFont": N("Wide"), "Encoding": N("Identity-H"), "DescendantFonts": [below]})}}

    return one_page(b"BT /F1 10 Tf 0 100 Td <%s> Tj ET" % name.encode("utf-16-be").hex().encode(), resources)


def sections_file(name: str, segment: str, number: int) -> bytes:
    """Links, actions, layers, images, colour spaces, graphics states, structure, intents and a metadata packet."""

    def resources(w, _):
        image = w.add(Stream({"Type": N("XObject"), "Subtype": N("Image"), "Width": number % 7 + 1, "Height": 2, "BitsPerComponent": 8, "ColorSpace": N("DeviceRGB"), "Filter": N("DCTDecode")}, b"jpeg"))
        inner = w.add(Stream({"Type": N("XObject"), "Subtype": N("Form"), "Matrix": [1, 0, 0, 1, 100, 0], "Resources": {"XObject": {"I": image}}}, b"q 10 0 0 20 5 6 cm /I Do Q"))
        return {
            "XObject": {"I": image, "Fm": inner}, "ExtGState": {"G": {"Type": N("ExtGState"), "ca": (number % 4) / 4, "BM": N("Multiply"), "SMask": N("None")}},
            "ColorSpace": {"C": [N("Indexed"), [N("ICCBased"), w.add(Stream({"N": 3}, b""))], 1, b"abc"], "D": [N("DeviceN"), [N("A"), N("B")], N("DeviceCMYK"), w.add(Stream({}, b""))]},
        }

    def page(w, leaf):
        link = {"Type": N("Annot"), "Subtype": N("Link"), "Rect": [0, 0, 9, 9], "A": {"S": N("URI"), "URI": f"http://x.example/{number}".encode()}}
        return {"Annots": [link], "CropBox": [10, 20, 110 + number % 3, 220], "AA": {"O": {"S": N("Named"), "N": N("NextPage")}}}

    def catalog(w, leaf):
        shown, hidden = w.add({"Type": N("OCG"), "Name": name.encode()}), w.add({"Type": N("OCG"), "Name": segment.encode()})
        packet = f"<x:xmpmeta><dc:title><rdf:Alt><rdf:li xml:lang='x-default'>{name}</rdf:li></rdf:Alt></dc:title><pdfaid:part>{number % 3 + 1}</pdfaid:part><pdf:Producer>{segment}</pdf:Producer></x:xmpmeta>"
        part = w.add({"Type": N("StructElem"), "S": N("Headline"), "Alt": segment.encode(), "K": [0, {"S": N("Span"), "K": 1}]})
        return {
            "Metadata": w.add(Stream({"Type": N("Metadata"), "Subtype": N("XML")}, packet.encode())), "OpenAction": [leaf, N("Fit")],
            "Names": {"Dests": {"Names": [segment.encode(), {"D": [leaf, N("XYZ"), 0, 0, 0]}]}}, "OCProperties": {"OCGs": [shown, hidden], "D": {"OFF": [hidden]}},
            "StructTreeRoot": {"RoleMap": {"Headline": N("H1")}, "K": part}, "OutputIntents": [{"S": N("GTS_PDFA1" if number % 2 else "GTS_PDFX"), "OutputConditionIdentifier": b"sRGB"}],
        }

    return one_page(b"q 30 40 -40 30 7 8 cm /I Do Q /Fm Do (Tj) pop", resources, page, catalog)


def three_pages(name: str, segment: str) -> bytes:
    """The same font name on every page, embedded on all but the first."""
    w = Writer()
    root, tree = w.add(), w.add()
    kids = []
    for i, text in enumerate((name, segment, name + segment)):
        font = simple_font(BaseFont=N(f"Font{i}"))
        if i:
            font["FontDescriptor"] = w.add({"Type": N("FontDescriptor"), "FontFile": w.add(Stream({}, b"x"))})
        body = w.add(Stream({}, b"BT /F1 10 Tf %s Tj ET" % literal(text)))
        kids.append(w.add({"Type": N("Page"), "Parent": tree, "Contents": body, "Resources": {"Font": {"F1": w.add(font), f"G{i}": w.add(simple_font())}}}))
    w.put(tree, {"Type": N("Pages"), "Kids": kids, "Count": 3, "MediaBox": [0, 0, 200, 300], "Rotate": 90})
    labels = {"Nums": [0, {"S": N("r")}, 2, {"S": N("D"), "P": segment.encode(), "St": 7}]}
    w.put(root, {"Type": N("Catalog"), "Pages": tree, "PageLabels": labels})
    return w.save(root)


def revised(priority: str, number: int) -> bytes:
    """A form, then a revision that changes a field, adds a note and, for some, changes the page too."""
    data = build(["x"], fields=[{"type": "Tx", "name": "f", "value": "a"}])
    from ..pdf.document import Document

    doc = Document(data)
    field = next(num for num, v in ((n, doc.get(Ref(n, 0))) for n in doc.offsets) if isinstance(v, dict) and "FT" in v)
    page = next(p for p in doc.pages())
    changed = {field: {"FT": N("Tx"), "T": b"f", "V": priority.encode()}, 50: {"Type": N("Annot"), "Subtype": N("Text"), "Rect": [0, 0, 1, 1]}}
    if number % 3 == 0:
        changed[page["_num"]] = {k: v for k, v in page.items() if k != "_num"} | {"Rotate": 90}
    return update(data, changed)


E = 65537


def _prime(seed: int) -> int:
    """The first probable prime from a hashed seed on."""
    n = int.from_bytes(hashlib.sha512(b"%d" % seed).digest(), "big") | 1 << 511 | 1

    def passes(n: int) -> bool:
        d, r = n - 1, 0
        while not d & 1:
            d, r = d >> 1, r + 1
        for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29):
            x = pow(a, d, n)
            if x in (1, n - 1):
                continue
            for _ in range(r - 1):
                x = x * x % n
                if x == n - 1:
                    break
            else:
                return False
        return True

    while not (all(n % p for p in (3, 5, 7, 11, 13, 17)) and passes(n)):
        n += 2
    return n


class SampleKey:
    """An RSA key from fixed seeds and a certificate around it; it protects nothing."""

    def __init__(self):
        p, q = _prime(1), _prime(2)
        self.n, self.d = p * q, pow(E, -1, (p - 1) * (q - 1))
        self.issuer = der.put(0x30, der.put(0x31, der.put(0x30, der.put_oid("2.5.4.3"), der.put(0x0C, b"Sample"))))
        info = der.put(0x30, der.put(0x30, der.put_oid(der.RSA_KEY), der.put(5)), der.put(3, b"\0", der.put(0x30, der.put_int(self.n), der.put_int(E))))
        times = der.put(0x30, der.put(0x17, b"200101000000Z"), der.put(0x17, b"400101000000Z"))
        body = der.put(0x30, der.put_int(7), der.put(0x30, der.put_oid("1.2.840.113549.1.1.11")), self.issuer, times, self.issuer, info)
        self.certificate = der.put(0x30, body, der.put(0x30, der.put_oid("1.2.840.113549.1.1.11")), der.put(3, b"\0"))

    def cms(self, signed: bytes, wrong: bool = False) -> bytes:
        """A detached signature over signed attributes; ``wrong``: one that doesn't fit them."""
        attribute = lambda name, value: der.put(0x30, der.put_oid(name), der.put(0x31, value))
        listed = attribute(der.CONTENT_TYPE, der.put_oid(der.DATA)) + attribute(der.MESSAGE_DIGEST, der.put(4, hashlib.sha256(signed).digest()))
        size = (self.n.bit_length() + 7) // 8
        inner = der.encoded_digest("sha256", hashlib.sha256(der.put(0x31, listed)).digest())
        block = b"\x00\x01" + b"\xff" * (size - len(inner) - 3) + b"\x00" + inner
        value = pow(int.from_bytes(block, "big") ^ wrong, self.d, self.n).to_bytes(size, "big")
        sha = der.put(0x30, der.put_oid("2.16.840.1.101.3.4.2.1"))
        signer = der.put(
            0x30, der.put_int(1), der.put(0x30, self.issuer, der.put_int(7)), sha, der.put(0xA0, listed), der.put(0x30, der.put_oid(der.RSA_KEY)), der.put(4, value)
        )
        body = der.put(0x30, der.put_int(1), der.put(0x31, sha), der.put(0x30, der.put_oid(der.DATA)), der.put(0xA0, self.certificate), der.put(0x31, signer))
        return der.put(0x30, der.put_oid(der.SIGNED_DATA), der.put(0xA0, body))


_KEY: list[SampleKey] = []


def signed(priority: str, number: int) -> bytes:
    """Signed files: intact, changed after signing, or with a signature that doesn't fit."""
    if not _KEY:
        _KEY.append(SampleKey())
    data = sign(build([priority]), lambda held: _KEY[0].cms(held, number % 3 == 2))
    return data.replace(b"MediaBox [0 0 612", b"MediaBox [0 0 613", 1) if number % 3 == 1 else data


def protected(title: str, number: int) -> bytes:
    """A file under the user password "p"; RC4 or AES by the parity of its number."""
    version = 4 if number % 2 else 2
    entry = {"Filter": N("Standard"), "V": version, "R": version if version == 4 else 3, "Length": 128, "P": -44, "O": bytes(range(32)), "U": b""}
    if version == 4:
        entry |= {"CF": {"StdCF": {"CFM": N("AESV2")}}, "StmF": N("StdCF"), "StrF": N("StdCF")}
    file_id = b"0123456789abcdef"
    handler = Handler(entry, file_id)
    handler.key = handler._derive(b"p")
    entry["U"] = handler.user_entry(handler.key).ljust(32, b"\0")

    def sealed(data: bytes, num: int) -> bytes:
        key = handler.object_key(num, 0, handler.stream)
        n = 16 - len(data) % 16
        return rc4(key, data) if handler.stream == "V2" else b"i" * 16 + Aes(key).cbc_encrypt(data + bytes([n]) * n, b"i" * 16)

    w = Writer()
    root, tree, leaf, body, info, lock = (w.add() for _ in range(6))
    w.put(root, {"Type": N("Catalog"), "Pages": tree})
    w.put(tree, {"Type": N("Pages"), "Kids": [leaf], "Count": 1})
    w.put(leaf, {"Type": N("Page"), "Parent": tree, "Contents": body})
    w.put(body, Stream({}, sealed(b"BT %s Tj ET" % literal(title), body.num)))
    w.put(info, {"Title": sealed(title.encode(), info.num)})
    w.put(lock, entry)
    data = w.save(root, info)
    extra = b" /Encrypt %d 0 R /ID [%s %s] >>\nstartxref" % (lock.num, dump(file_id), dump(file_id))
    head, tail = data.rsplit(b">>\nstartxref", 1)
    return head + extra.lstrip() + tail


def linear(name: str, n: int) -> bytes:
    """A file that begins with the dictionary of fast viewing."""
    data = build([name] * n)
    first = data.index(b"1 0 obj")
    return data[:first] + b"90 0 obj\n<< /Linearized 1 /L %d /O 5 /E 900 /N %d /T 1000 >>\nendobj\n" % (len(data), n) + data[first:]


def function_host():
    """A file to evaluate function objects in."""
    from ..pdf.document import Document

    return Document(build(["x"]))


def functions() -> list:
    """An exponential, a stitched, a calculated and a sampled function over 0 to 1."""
    rising = {"FunctionType": 2, "Domain": [0, 1], "N": 1, "C0": [0], "C1": [1]}
    falling = {"FunctionType": 2, "Domain": [0, 1], "N": 2, "C0": [1], "C1": [0]}
    return [
        {"FunctionType": 2, "Domain": [0, 1], "N": 2, "C0": [1], "C1": [5]},
        {"FunctionType": 3, "Domain": [0, 1], "Functions": [rising, falling], "Bounds": [0.5], "Encode": [0, 1, 0, 1]},
        Stream({"FunctionType": 4, "Domain": [0, 1], "Range": [0, 1]}, b"{ dup 0.5 gt { 1 exch sub } { 2 mul } ifelse }"),
        Stream({"FunctionType": 0, "Domain": [0, 1], "Range": [0, 3], "Size": [4], "BitsPerSample": 8}, bytes([0, 85, 170, 255])),
    ]


def png_rows(data: bytes, size: int, step: int) -> bytes:
    """Rows under None, Sub, Up, Average and Paeth in turn, by the specification's formulas."""
    out, above = bytearray(), bytes(size)
    for k, at in enumerate(range(0, len(data), size)):
        row = data[at : at + size].ljust(size, b"\0")
        kind = k % 5
        out.append(kind)
        for j, v in enumerate(row):
            a, b, c = row[j - step] if j >= step else 0, above[j], above[j - step] if j >= step else 0
            near = a + b - c
            paeth = a if abs(near - a) <= min(abs(near - b), abs(near - c)) else b if abs(near - b) <= abs(near - c) else c
            out.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        above = row
    return bytes(out)


def tiff_rows(data: bytes, columns: int, colours: int) -> bytes:
    """16-bit samples less those of the pixel before, row by row."""
    size = 2 * columns * colours
    out = bytearray()
    for at in range(0, len(data), size):
        row = data[at : at + size].ljust(size, b"\0")
        held = [int.from_bytes(row[i : i + 2], "big") for i in range(0, size, 2)]
        out += b"".join(((v - (held[i - colours] if i >= colours else 0)) & 0xFFFF).to_bytes(2, "big") for i, v in enumerate(held))
    return bytes(out)


def by_hand(name: str) -> bytes:
    """A file laid out here byte by byte: objects in an object stream, a cross-reference stream, odd spacing and strings."""
    inside = [
        (1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Type /Pages /Kids[ 3 0 R ] /Count 1 % a comment\n/MediaBox [0 0 300.0 +400]>>"),
        (3, b"<</Type/Pa#67e/Parent 2 0 R/Contents[5 0 R 6 0 R]/Resources<</Font<</F#31 7 0 R>>>>>>"), (7, b"<</Type/Font/Subtype/TrueType/BaseFont/X/Encoding/MacRomanEncoding>>"),
    ]
    head, body = b"", b""
    for num, text in inside:
        head += b"%d %d " % (num, len(body))
        body += text + b"\n"
    hexed = name.encode("latin-1", "replace").hex().upper()
    if len(hexed) > 3:
        hexed = hexed[:3] + "\n " + hexed[3:]
    parts = {
        4: b"<</Type/ObjStm/N %d/First %d/Length %d>>stream\r\n%s\nendstream" % (len(inside), len(head), len(head + body), head + body),
        5: b"<</Length 34>>\nstream\nBT/F1 12 Tf 10 20 Td(a\\(b\\)\\101\\\n(c)\n\nendstream",
        6: b"<</Length 8 0 R>>\nstream\n) Tj T* <%s> Tj (\\212) Tj ET\nendstream" % hexed.encode(),
        8: b"%d" % (len(hexed) + len(b") Tj T* <> Tj (\\212) Tj ET")),
    }
    # The page's two contents are joined by a line feed, which here falls within a string.
    out, at = bytearray(b"%PDF-1.5\r\n%\xff\xff\xff\xff\r\n"), {}
    for num, text in parts.items():
        at[num] = len(out)
        out += b"%d  0\tobj\r%s\rendobj\r" % (num, text)
    start = len(out)
    rows = [(0, 0, 255)] + [(2, 4, 0), (2, 4, 1), (2, 4, 2), (1, at[4], 0), (1, at[5], 0), (1, at[6], 0), (2, 4, 3), (1, at[8], 0), (1, start, 0)]
    table = b"".join(bytes([a]) + b.to_bytes(3, "big") + bytes([c]) for a, b, c in rows)
    out += b"9 0 obj <</Type/XRef/W[1 3 1]/Size 10/Root 1 0 R/Length %d>>stream\n%s\nendstream endobj\nstartxref %d %%%%EOF" % (len(table), table, start)
    return bytes(out)


def nested_fields(name: str, segment: str) -> bytes:
    """Fields within fields: type and value come from above, and a kid without a name is its parent's widget."""

    def catalog(w, _):
        group = w.add()
        first = w.add({"T": b"first", "Parent": group, "V": name.encode()})
        inner = w.add()
        second = w.add({"T": b"second", "Parent": inner, "FT": N("Ch"), "Opt": [b"x", segment.encode()], "V": segment.encode()})
        w.put(inner, {"T": b"inner", "Parent": group, "Kids": [second]})
        w.put(group, {"T": b"group", "FT": N("Tx"), "Ff": 2, "V": b"above", "Kids": [first, inner, w.add({"T": b"third", "Parent": group})]})
        button = w.add()
        w.put(button, {"T": b"button", "FT": N("Btn"), "V": N("Yes"), "Kids": [w.add({"Subtype": N("Widget"), "Parent": button})]})
        return {"AcroForm": {"Fields": [group, button]}}

    return one_page(b"", None, None, catalog)


def mapped(name: str) -> bytes:
    """One-byte codes that a map turns into text: a range shifts letters, a list and single codes name others."""
    body = b"""1 begincodespacerange <00> <FF> endcodespacerange
2 beginbfrange <41> <5A> <0391> <30> <32> [<0078> <00660066> <D83DDE42>] endbfrange
2 beginbfchar <23> <2013> <20> <0020> endbfchar"""
    return one_page(b"BT /F1 9 Tf %s Tj ET" % literal(name), lambda w, _: {"Font": {"F1": simple_font(ToUnicode=w.add(Stream({}, body)))}})


def drawn(x: int) -> bytes:
    """A page by the builder: a frame, a path, an image and a word."""
    from ..pdf.writer import PageBuilder

    b = PageBuilder().save().fill_colour(1, 0.5, 0).rectangle(x, 20, 30, 40).restore().line_width(2).path([(0, 0), (x, 9), (5, 5)], True)
    content = b.image("I", 10, 20, 30 + x, 40).text(50, 60, "F1", 12, b"built").content()
    image = {"Type": N("XObject"), "Subtype": N("Image"), "Width": 1, "Height": 1, "BitsPerComponent": 8, "ColorSpace": N("DeviceGray")}
    return one_page(content, lambda w, _: {"Font": {"F1": simple_font()}, "XObject": {"I": w.add(Stream(image, b"\0"))}})


def book(name: str, segment: str) -> bytes:
    """Bookmarks to a page, by a name, and to an address."""

    def catalog(w, leaf):
        top, a, b, c = (w.add() for _ in range(4))
        w.put(top, {"Type": N("Outlines"), "First": a, "Last": c, "Count": 3})
        w.put(a, {"Title": name.encode(), "Parent": top, "Next": b, "Dest": [leaf, N("Fit")]})
        w.put(b, {"Title": segment.encode(), "Parent": top, "Prev": a, "Next": c, "A": {"S": N("GoTo"), "D": b"here"}})
        w.put(c, {"Title": b"web", "Parent": top, "Prev": b, "A": {"S": N("URI"), "URI": b"http://x.example/" + segment.encode()}})
        return {"Outlines": top, "Names": {"Dests": {"Names": [b"here", [leaf, N("Fit")]]}}}

    return one_page(b"", None, None, catalog)
