"""Minimal files: text pages, metadata, outline, notes, fields and attachments; and updates to them."""

from __future__ import annotations

import zlib

from .syntax import Keyword, Name, Ref, Stream, dump, text_string

WIDTH, HEIGHT, STEP = 612, 792, 14


def page_content(text: str) -> bytes:
    """A text's lines from the top down, each as UTF-16 codes in a string of its own."""
    out = [b"BT /F1 12 Tf 14 TL 36 756 Td"]
    for i, line in enumerate(text.split("\n")):
        out.append(b"<%s> Tj" % line.encode("utf-16-be").hex().encode() if not i else b"T* <%s> Tj" % line.encode("utf-16-be").hex().encode())
    return b"\n".join([*out, b"ET"])


class PageBuilder:
    """A page's content, operator by operator; numbers as they are written, text in the font's codes."""

    def __init__(self):
        self.parts: list[bytes] = []

    def op(self, name: str, *operands) -> PageBuilder:
        self.parts.append(b" ".join([*(dump(float(x) if isinstance(x, float) else x) for x in operands), name.encode()]))
        return self

    def save(self) -> PageBuilder:
        return self.op("q")

    def restore(self) -> PageBuilder:
        return self.op("Q")

    def transform(self, a, b, c, d, e, f) -> PageBuilder:
        return self.op("cm", a, b, c, d, e, f)

    def fill_colour(self, r, g, b) -> PageBuilder:
        return self.op("rg", r, g, b)

    def stroke_colour(self, r, g, b) -> PageBuilder:
        return self.op("RG", r, g, b)

    def line_width(self, width) -> PageBuilder:
        return self.op("w", width)

    def rectangle(self, x, y, width, height, fill: bool = True) -> PageBuilder:
        return self.op("re", x, y, width, height).op("f" if fill else "S")

    def path(self, points: list[tuple[float, float]], close: bool = False) -> PageBuilder:
        for i, (x, y) in enumerate(points):
            self.op("l" if i else "m", x, y)
        return self.op("s" if close else "S")

    def text(self, x, y, font: str, size, shown: bytes) -> PageBuilder:
        return self.op("BT").op("Tf", Name(font), size).op("Td", x, y).op("Tj", shown).op("ET")

    def image(self, name: str, x, y, width, height) -> PageBuilder:
        return self.save().transform(width, 0, 0, height, x, y).op("Do", Name(name)).restore()

    def content(self) -> bytes:
        return b"\n".join(self.parts)


class Writer:
    """Objects by number; ``save`` lays them out with a cross-reference table."""

    def __init__(self):
        self.objects: dict[int, object] = {}

    def add(self, value=None) -> Ref:
        num = len(self.objects) + 1
        self.objects[num] = value
        return Ref(num, 0)

    def put(self, ref: Ref, value) -> None:
        self.objects[ref.num] = value

    def save(self, root: Ref, info: Ref | None = None) -> bytes:
        out = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n")
        at = {}
        for num, value in self.objects.items():
            at[num] = len(out)
            out += b"%d 0 obj\n" % num + dump(value) + b"\nendobj\n"
        start = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(at) + 1)
        out += b"".join(b"%010d 00000 n \n" % at[n] for n in sorted(at))
        trailer = {"Size": len(at) + 1, "Root": root} | ({"Info": info} if info else {})
        return bytes(out + b"trailer\n" + dump(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % start)


def build(
    pages: list[str],
    info: dict[str, str] | None = None,
    outline: list[tuple[str, list]] | None = None,
    notes: list[tuple[int, str]] | None = None,
    attachments: dict[str, bytes] | None = None,
    fields: list[dict] | None = None,
    labels: list[tuple[int, str, str, int]] | None = None,
) -> bytes:
    w = Writer()
    root, tree = w.add(), w.add()
    below = w.add({"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("Plain"), "CIDSystemInfo": {"Registry": b"Adobe", "Ordering": b"Identity", "Supplement": 0}})
    font = w.add({"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Plain"), "Encoding": Name("Identity-H"), "DescendantFonts": [below]})
    kids = []
    for number, text in enumerate(pages):
        body = w.add(Stream({"Filter": Name("FlateDecode")}, zlib.compress(page_content(text))))
        annots = [
            w.add({"Type": Name("Annot"), "Subtype": Name("Text"), "Rect": [36, 700, 56, 720], "Contents": text_string(note), "F": 4})
            for at, note in notes or []
            if at == number
        ]
        page = {"Type": Name("Page"), "Parent": tree, "Resources": {"Font": {"F1": font}}, "Contents": body}
        kids.append(w.add(page | ({"Annots": annots} if annots else {})))
    w.put(tree, {"Type": Name("Pages"), "Kids": kids, "Count": len(kids), "MediaBox": [0, 0, WIDTH, HEIGHT]})
    catalog: dict = {"Type": Name("Catalog"), "Pages": tree}
    if outline:
        top = w.add()
        refs = _outline(w, outline, top)
        w.put(top, {"Type": Name("Outlines"), "First": refs[0], "Last": refs[-1], "Count": len(refs)})
        catalog["Outlines"] = top
    if attachments:
        names: list = []
        for name, content in sorted(attachments.items()):
            body = w.add(Stream({"Type": Name("EmbeddedFile"), "Filter": Name("FlateDecode")}, zlib.compress(content)))
            names += [text_string(name), w.add({"Type": Name("Filespec"), "F": text_string(name), "UF": text_string(name), "EF": {"F": body, "UF": body}})]
        catalog["Names"] = {"EmbeddedFiles": {"Names": names}}
    if fields:
        refs = [w.add(_field(f)) for f in fields]
        catalog["AcroForm"] = {"Fields": refs}
    if labels:
        nums: list = []
        for start, style, prefix, value in labels:
            nums += [start, {"S": Name(style), "P": text_string(prefix), "St": value}]
        catalog["PageLabels"] = {"Nums": nums}
    w.put(root, catalog)
    described = w.add({k: text_string(v) for k, v in info.items()}) if info else None
    return w.save(root, described)


def _field(f: dict) -> dict:
    made = {"FT": Name(f["type"]), "T": text_string(f["name"]), "Ff": f.get("flags", 0), "V": text_string(f.get("value", ""))}
    if f.get("max_length"):
        made["MaxLen"] = f["max_length"]
    if f.get("options"):
        made["Opt"] = [text_string(o) for o in f["options"]]
    return made


def _outline(w: Writer, items: list[tuple[str, list]], parent: Ref) -> list[Ref]:
    refs = [w.add() for _ in items]
    for i, (title, kids) in enumerate(items):
        node = {"Title": text_string(title), "Parent": parent}
        if i:
            node["Prev"] = refs[i - 1]
        if i + 1 < len(refs):
            node["Next"] = refs[i + 1]
        if kids:
            inner = _outline(w, kids, refs[i])
            node |= {"First": inner[0], "Last": inner[-1], "Count": len(inner)}
        w.put(refs[i], node)
    return refs


def update(data: bytes, changed: dict[int, object]) -> bytes:
    """Append a revision that replaces or adds these objects."""
    before = int(data[data.rfind(b"startxref") + 9 :].split(b"%", 1)[0])
    from .document import Document

    doc = Document(data)
    out = bytearray(data)
    at = {}
    for num, value in changed.items():
        at[num] = len(out)
        out += b"%d 0 obj\n" % num + dump(value) + b"\nendobj\n"
    start = len(out)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, at[n]) for n in sorted(at))
    trailer = {**doc.trailer, "Prev": before, "Size": max([*doc.offsets, *at]) + 1}
    return bytes(out + b"trailer\n" + dump(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % start)


NUMERIC = frozenset((int, float))


def bring(w: Writer, doc, numbers: list[int], tree: Ref) -> list[Ref]:
    """Copies of a document's pages with all that they refer to, under new numbers.

    What points to a page that isn't copied points to nothing.
    """
    pages = list(doc.pages())
    if any(not 0 <= n < len(pages) for n in numbers):
        raise ValueError(f"pages {numbers} of {len(pages)}")
    every = {p["_num"] for p in pages}
    found: dict[int, Ref] = {}
    todo: list[tuple[Ref, object]] = []

    def copied(value):
        if isinstance(value, Ref):
            if value.num in every and value.num not in found:
                return None
            if value.num not in found:
                found[value.num] = w.add()
                todo.append((found[value.num], doc.get(value)))
            return found[value.num]
        if isinstance(value, list):
            return value if NUMERIC.issuperset(map(type, value)) else [copied(v) for v in value]
        if isinstance(value, dict):
            return {k: copied(v) for k, v in value.items() if k != "Parent"}
        if isinstance(value, Stream):
            return Stream({k: copied(v) for k, v in value.dict.items() if k != "Length"}, value.raw)
        return value

    refs = []
    for n in numbers:
        ref = w.add()
        refs.append(ref)
        if pages[n]["_num"] is not None:
            found.setdefault(pages[n]["_num"], ref)
    for n, ref in zip(numbers, refs, strict=True):
        w.put(ref, {k: copied(v) for k, v in pages[n].items() if k not in ("Parent", "_num")} | {"Type": Name("Page"), "Parent": tree})
    while todo:
        ref, value = todo.pop()
        w.put(ref, copied(value))
    return refs


def assemble(parts: list[tuple]) -> bytes:
    """One file of pages taken from several (bytes or documents), in order; None takes all of a file's pages."""
    from .document import Document

    w = Writer()
    root, tree = w.add(), w.add()
    kids: list[Ref] = []
    for data, numbers in parts:
        doc = data if isinstance(data, Document) else Document(data)
        kids += bring(w, doc, list(range(sum(1 for _ in doc.pages()))) if numbers is None else numbers, tree)
    w.put(tree, {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)})
    w.put(root, {"Type": Name("Catalog"), "Pages": tree})
    return w.save(root)


def merge(files: list[bytes]) -> bytes:
    return assemble([(f, None) for f in files])


def split(data: bytes, size: int) -> list[bytes]:
    """Files of ``size`` pages each."""
    from .document import Document

    doc = Document(data)
    n = sum(1 for _ in doc.pages())
    return [assemble([(doc, list(range(i, min(i + size, n))))]) for i in range(0, n, size)]


READ_ONLY, PUSH_BUTTON, MULTI_SELECT = 1, 1 << 16, 1 << 21


def fill(data: bytes, values: dict[str, object]) -> tuple[bytes, dict[str, str]]:
    """A revision with new field values, and why others were refused.

    Texts are bounded by MaxLen in bytes, check boxes take true or false, choices take positions
    among their options, several only where the field allows it. Read-only fields take nothing.
    """
    from .document import Document

    doc, changed, refused = Document(data), {}, {}
    there = {name: (num, node, held) for name, num, node, held in doc.field_nodes()}
    for name, value in values.items():
        if name not in there or there[name][0] is None:
            refused[name] = "no such field"
            continue
        num, node, held = there[name]
        kind, flags = str(doc.get(held.get("FT"))), doc.get(held.get("Ff")) or 0
        options, most = doc.list_of(held.get("Opt")), doc.get(held.get("MaxLen"))
        if flags & READ_ONLY:
            refused[name] = "read only"
        elif kind == "Tx":
            raw = text_string(str(value))
            if isinstance(most, int) and most > 0 and len(str(value).encode()) > most:
                refused[name] = "too long"
            else:
                changed[num] = {**node, "V": raw}
        elif kind == "Btn":
            if flags & PUSH_BUTTON:
                refused[name] = "push button"
            else:
                state = Name("Yes" if value else "Off")
                changed[num] = {**node, "V": state, "AS": state}
        elif kind == "Ch":
            at = list(value) if isinstance(value, (list, tuple)) else [value]
            if any(not isinstance(i, int) or not 0 <= i < len(options) for i in at):
                refused[name] = "not an option"
            elif len(at) > 1 and not flags & MULTI_SELECT:
                refused[name] = "one option only"
            else:
                taken = [doc.get(options[i]) for i in at]
                changed[num] = {**node, "V": taken[0] if len(taken) == 1 else taken, "I": at}
        else:
            refused[name] = "not a value field"
    return (update(data, changed) if changed else data), refused


def sign(data: bytes, attributes_of, size: int = 4096) -> bytes:
    """Append a signature dictionary whose byte range leaves out its contents alone.

    ``attributes_of`` gets the signed bytes and returns the CMS to embed. What keys are used and
    kept is the caller's business.
    """
    from .document import Document

    doc = Document(data)
    num = max(doc.offsets) + 1
    blank = b"0" * (2 * size)
    marker = Keyword(b"<" + blank + b">")
    holes = Keyword(b"[" + b" ".join([b"%010d" % 0] * 4) + b"]")
    body = {"Type": Name("Sig"), "Filter": Name("Adobe.PPKLite"), "SubFilter": Name("adbe.pkcs7.detached"), "ByteRange": holes, "Contents": marker}
    out = update(data, {num: body})
    at = out.rindex(b"<" + blank)
    spans = [0, at, at + len(blank) + 2, len(out) - at - len(blank) - 2]
    out = out.replace(bytes(holes), b"[" + b" ".join(b"%010d" % n for n in spans) + b"]")
    cms = attributes_of(out[: spans[1]] + out[spans[2] :])
    return out[: at + 1] + cms.hex().encode().ljust(2 * size, b"0") + out[spans[2] - 1 :]


def stamp(data: bytes, lines: list[tuple[float, float, float, str]], skip: tuple[int, ...] = ()) -> bytes:
    """A revision with text over every page but some: (x, y, size, text), where "{page}" and "{pages}" are numbers."""
    from .document import Document

    doc = Document(data)
    pages, changed = list(doc.pages()), {}
    free = max(doc.offsets) + 1
    changed[free] = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}
    font, free = Ref(free, 0), free + 1
    for i, page in enumerate(pages):
        if i in skip or page["_num"] is None:
            continue
        shown = [(x, y, size, text.replace("{pages}", str(len(pages))).replace("{page}", str(i + 1))) for x, y, size, text in lines]
        body = b"\n".join(b"BT /Stamp %s Tf 1 0 0 1 %s %s Tm %s Tj ET" % (dump(float(size)), dump(float(x)), dump(float(y)), dump(text.encode("cp1252", "replace"))) for x, y, size, text in shown)
        before = doc.get(page.get("Contents"))
        held = before if isinstance(before, list) else [page["Contents"]] if page.get("Contents") is not None else []
        changed[free], changed[free + 1] = Stream({}, b"q"), Stream({}, b"Q\n" + body)
        resources = doc.dict_of(page.get("Resources"))
        fonts = {**doc.dict_of(resources.get("Font")), "Stamp": font}
        changed[page["_num"]] = {k: v for k, v in page.items() if k != "_num"} | {
            "Contents": [Ref(free, 0), *held, Ref(free + 1, 0)], "Resources": {**resources, "Font": fonts},
        }
        free += 2
    return update(data, changed)
