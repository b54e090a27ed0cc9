"""A parsed file: cross-references, objects, pages, and the sections that rows are made of."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from . import filters
from .crypt import Handler
from .syntax import Keyword, Lexer, Name, Ref, Stream, text_of

OBJ = re.compile(rb"(?<!\d)(\d{1,6})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj\b")
EOF = re.compile(rb"%%EOF(?:\r\n|\r|\n)?")
ENTRIES = re.compile(rb"(?:\d{10} \d{5} [nf](?: \n| \r|\r\n))*+")
MAX_OBJECT = 999_999
INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")


class Malformed(ValueError):
    pass


class Encrypted(ValueError):
    pass


class Document:
    """Objects are loaded as they are asked for. ``repair`` rebuilds a broken cross-reference."""

    def __init__(self, data: bytes, repair: bool = True, password: str = ""):
        start = data.find(b"%PDF-", 0, 4096)
        if start < 0:
            raise Malformed("no header")
        self.data = data[start:]  # offsets count from the header
        self.version = self.data[5:8].decode("latin-1")
        self.held: dict[int, object] = {}
        self.packed: dict[int, dict[int, object]] = {}
        self.loading: set[int] = set()
        self.repaired = False
        self.handler: Handler | None = None
        try:
            self._index()
            if not self.pages_root():
                raise Malformed("no pages")
        except (Malformed, ValueError, IndexError, TypeError, AttributeError, RecursionError):
            if not repair:
                raise Malformed("broken cross-reference") from None
            self._rebuild()
            if not self.pages_root():
                raise Malformed("no pages after repair") from None
        self.encryption = self.dict_of(self.trailer.get("Encrypt"))
        if self.encryption:
            self._unlock(password)

    def _unlock(self, password: str) -> None:
        """Set up decryption; what was loaded before is forgotten, as it was loaded as it lies."""
        plain = {k: self.get(v) for k, v in self.encryption.items()}
        ids = self.list_of(self.trailer.get("ID"))
        file_id = self.get(ids[0]) if ids else b""
        handler = Handler(plain, file_id if isinstance(file_id, bytes) else b"", password.encode("utf-8"))
        if handler.key is None:
            raise Encrypted("the password opens nothing")
        ref = self.trailer.get("Encrypt")
        self.held = {ref.num: self.encryption} if isinstance(ref, Ref) else {}
        self.packed.clear()
        self.handler = handler

    # Cross-references: the newest entry of an object wins.

    def _index(self) -> None:
        at = self.data.rfind(b"startxref")
        if at < 0:
            raise Malformed("no startxref")
        where = Lexer(self.data, at + 9).read()
        self.offsets: dict[int, tuple] = {}
        self.trailer: dict = {}
        seen: set[int] = set()
        todo = [where]
        while todo:
            where = todo.pop(0)
            if not isinstance(where, int) or where in seen or not 0 <= where < len(self.data):
                if not seen:
                    raise Malformed("bad startxref")
                continue
            seen.add(where)
            lexer = Lexer(self.data, where)
            trailer = self._table(lexer) if self.data[where : where + 4] == b"xref" else self._xref_stream(where)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            todo += [trailer[k] for k in ("XRefStm", "Prev") if k in trailer]

    def _table(self, lexer: Lexer) -> dict:
        lexer.at += 4
        while True:
            first = lexer.read()
            if isinstance(first, Keyword):
                trailer = lexer.read() if first == b"trailer" else None
                if not isinstance(trailer, dict):
                    raise Malformed("no trailer")
                return trailer
            count = lexer.read()
            if not isinstance(first, int) or not isinstance(count, int) or count > MAX_OBJECT:
                raise Malformed("bad section")
            lexer.skip()
            whole = self.data[lexer.at : lexer.at + 20 * count]
            if len(whole) == 20 * count and ENTRIES.fullmatch(whole):
                lexer.at += len(whole)
                for i in range(count):
                    if first + i not in self.offsets:
                        self.offsets[first + i] = ("at", int(whole[20 * i : 20 * i + 10])) if whole[20 * i + 17] == 0x6E else ("free", 0)
                continue
            for num in range(first, first + count):
                offset, _, kind = lexer.read(), lexer.read(), lexer.read()
                if num not in self.offsets:
                    self.offsets[num] = ("at", offset) if kind == b"n" else ("free", 0)

    def _xref_stream(self, where: int) -> dict:
        stream = self._object_at(where)
        if not isinstance(stream, Stream) or stream.dict.get("Type") != "XRef":
            raise Malformed("no cross-reference here")
        body, widths = self.decoded(stream), stream.dict["W"]
        index = stream.dict.get("Index") or [0, stream.dict["Size"]]
        at, size = 0, sum(widths)
        for first, count in zip(index[::2], index[1::2], strict=False):
            for num in range(first, first + count):
                fields, p = [], at
                for w in widths:
                    fields.append(int.from_bytes(body[p : p + w], "big") if w else None)
                    p += w
                at += size
                if at > len(body):
                    return stream.dict
                kind = 1 if fields[0] is None else fields[0]
                if num not in self.offsets:
                    self.offsets[num] = {1: ("at", fields[1]), 2: ("in", fields[1], fields[2] or 0)}.get(kind, ("free", 0))
        return stream.dict

    def _rebuild(self) -> None:
        """Take every "N G obj" of the file, the last of a number; then look for the catalog."""
        self.offsets, self.trailer, self.repaired = {}, {}, True
        self.held.clear()
        for m in OBJ.finditer(self.data):
            self.offsets[int(m[1])] = ("at", m.start())
        for m in re.finditer(rb"trailer", self.data):
            found = Lexer(self.data, m.end()).read()
            if isinstance(found, dict):
                self.trailer.update(found)
        for num in list(self.offsets):
            value = self.get(Ref(num, 0))
            if isinstance(value, Stream) and value.dict.get("Type") == "ObjStm":
                for inner in self._unpack(num):
                    self.offsets.setdefault(inner, ("in", num, 0))
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            for num in list(self.offsets):
                value = self.get(Ref(num, 0))
                if isinstance(value, dict) and value.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref(num, 0)

    def _object_at(self, offset: int, num: int | None = None):
        m = OBJ.match(self.data, offset) or OBJ.search(self.data, offset, offset + 64)
        if not m or num is not None and int(m[1]) != num:
            return None
        lexer = Lexer(self.data, m.end())
        value = lexer.read()
        if isinstance(value, dict):
            lexer.skip()
            if self.data[lexer.at : lexer.at + 6] == b"stream":
                begin = lexer.at + 6
                begin += 2 if self.data[begin : begin + 2] == b"\r\n" else 1 if self.data[begin : begin + 1] in (b"\n", b"\r") else 0
                length = self.get(value.get("Length"))
                end = begin + length if isinstance(length, int) and length >= 0 else -1
                if end < 0 or not re.compile(rb"\s*endstream").match(self.data, end):
                    end = self.data.find(b"endstream", begin)
                    end = len(self.data) if end < 0 else end
                    end -= 2 if self.data[end - 2 : end] == b"\r\n" else 1 if self.data[end - 1 : end] in (b"\n", b"\r") else 0
                return self._opened(Stream(value, self.data[begin:end], int(m[1]), int(m[2])))
        if isinstance(value, Keyword):
            return None
        return self.handler.value(value, int(m[1]), int(m[2])) if self.handler else value

    def _opened(self, stream: Stream) -> Stream:
        """Decrypted, but for cross-references and streams that say they are plain."""
        kind, handler = stream.dict.get("Type"), self.handler
        if not handler or kind == "XRef" or kind == "Metadata" and not handler.metadata:
            return stream
        filters_of = stream.dict.get("Filter")
        method = "None" if filters_of == "Crypt" or isinstance(filters_of, list) and "Crypt" in filters_of else handler.stream
        plain = handler.value(stream.dict, stream.num, stream.gen)
        return Stream(plain, handler.decrypt(stream.raw, stream.num, stream.gen, method), stream.num, stream.gen)

    def _unpack(self, num: int) -> dict[int, object]:
        if num not in self.packed:
            self.packed[num] = {}
            stream = self.get(Ref(num, 0))
            if isinstance(stream, Stream):
                body, first = self.decoded(stream), self.get(stream.dict.get("First")) or 0
                head = Lexer(body, references=False)
                for _ in range(min(self.get(stream.dict.get("N")) or 0, MAX_OBJECT)):
                    n, at = head.read(), head.read()
                    if isinstance(n, int) and isinstance(at, int):
                        self.packed[num][n] = Lexer(body, first + at).read()
        return self.packed[num]

    def get(self, value):
        """Follow references; a loop or a missing object is None."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            num = value.num
            if num not in self.held:
                entry = self.offsets.get(num)
                if entry is None or num in self.loading:
                    return None
                self.loading.add(num)
                try:
                    if entry[0] == "at":
                        self.held[num] = self._object_at(entry[1], num)
                    elif entry[0] == "in":
                        self.held[num] = self._unpack(entry[1]).get(num)
                    else:
                        self.held[num] = None
                finally:
                    self.loading.discard(num)
            value = self.held[num]
        return None

    def decoded(self, stream: Stream) -> bytes:
        names, params = self.get(stream.dict.get("Filter", stream.dict.get("F"))), self.get(stream.dict.get("DecodeParms", stream.dict.get("DP")))
        names = [names] if isinstance(names, Name) else [self.get(n) for n in names or []]
        params = [params] if isinstance(params, dict) else [self.get(p) for p in params or []]
        return filters.decode(stream.raw, [str(n) for n in names], [{k: self.get(v) for k, v in p.items()} if isinstance(p, dict) else {} for p in params])

    def dict_of(self, value) -> dict:
        value = self.get(value)
        return value.dict if isinstance(value, Stream) else value if isinstance(value, dict) else {}

    def list_of(self, value) -> list:
        value = self.get(value)
        return value if isinstance(value, list) else []

    # Structure.

    def pages_root(self) -> dict:
        return self.dict_of(self.dict_of(self.trailer.get("Root")).get("Pages"))

    @property
    def catalog(self) -> dict:
        return self.dict_of(self.trailer.get("Root"))

    def pages(self) -> Iterator[dict]:
        """Page dictionaries in order with what they inherit; a node is visited once."""
        seen: set[int] = set()
        stack = [(self.catalog.get("Pages"), {})]
        while stack:
            ref, above = stack.pop()
            if isinstance(ref, Ref):
                if ref.num in seen:
                    continue
                seen.add(ref.num)
            node = self.dict_of(ref)
            merged = {**above, **{k: node[k] for k in INHERITED if k in node}}
            kids = self.list_of(node.get("Kids"))
            if kids and node.get("Type") != "Page":
                stack += [(k, merged) for k in reversed(kids)]
            elif node and (node.get("Type") == "Page" or not kids and "Contents" in node):
                yield {**merged, **node, "_num": ref.num if isinstance(ref, Ref) else None}

    def contents(self, page: dict) -> bytes:
        parts = self.get(page.get("Contents"))
        parts = [parts] if isinstance(parts, Stream) else [self.get(p) for p in parts or []]
        return b"\n".join(self.decoded(p) for p in parts if isinstance(p, Stream))

    def info(self) -> dict[str, str]:
        found = {k: text_of(self.get(v)) for k, v in self.dict_of(self.trailer.get("Info")).items()}
        return {k: v for k, v in found.items() if v is not None}

    def outline(self) -> Iterator[tuple[list[int], str, int | None, str | None]]:
        """(path of positions, title, page it leads to, address it leads to), depth first."""
        numbers = self.page_numbers()
        named: dict[str, object] | None = None
        seen: set[int] = set()
        stack = [(self.dict_of(self.catalog.get("Outlines")).get("First"), [0])]
        while stack:
            ref, path = stack.pop()
            if not isinstance(ref, Ref) or ref.num in seen:
                continue
            seen.add(ref.num)
            item = self.dict_of(ref)
            action = self.dict_of(item.get("A"))
            dest = self.get(item.get("Dest", action.get("D")))
            if isinstance(dest, (bytes, Name)):
                if named is None:
                    named = dict(self._destinations())
                dest = named.get(text_of(dest) or "")
            yield path, text_of(self.get(item.get("Title"))) or "", self._target(dest, numbers)[0], text_of(self.get(action.get("URI")))
            stack.append((item.get("Next"), [*path[:-1], path[-1] + 1]))
            stack.append((item.get("First"), [*path, 0]))

    def annotations(self) -> Iterator[dict]:
        for number, page in enumerate(self.pages()):
            for ref in self.list_of(page.get("Annots")):
                a = self.dict_of(ref)
                if a:
                    action = self.dict_of(a.get("A"))
                    yield {
                        "page_no": number, "type": str(a.get("Subtype", "")), "contents": text_of(self.get(a.get("Contents"))),
                        "rect": [float(x) for x in map(self.get, self.list_of(a.get("Rect"))) if isinstance(x, (int, float))],
                        "flags": self.get(a.get("F")) or 0, "uri": text_of(self.get(action.get("URI"))),
                    }

    def field_nodes(self) -> Iterator[tuple[str, int | None, dict, dict]]:
        """(dotted name, object, own dictionary, inherited entries) of each terminal form field."""
        seen: set[int] = set()
        stack = [(r, "", {}) for r in reversed(self.list_of(self.dict_of(self.catalog.get("AcroForm")).get("Fields")))]
        while stack:
            ref, above, held = stack.pop()
            if isinstance(ref, Ref):
                if ref.num in seen:
                    continue
                seen.add(ref.num)
            node = self.dict_of(ref)
            own = text_of(self.get(node.get("T")))
            name = above if own is None else f"{above}.{own}" if above else own
            held = {**held, **{k: node[k] for k in ("FT", "Ff", "V", "MaxLen", "Opt") if k in node}}
            kids = [k for k in self.list_of(node.get("Kids")) if "T" in self.dict_of(k)]
            if kids:
                stack += [(k, name, held) for k in reversed(kids)]
            elif node:
                yield name, ref.num if isinstance(ref, Ref) else None, node, held

    def fields(self) -> Iterator[dict]:
        """Terminal form fields with dotted names; type, flags and value are inherited."""
        for name, _, _, held in self.field_nodes():
            yield {
                "full_name": name, "type": str(self.get(held.get("FT")) or ""), "flags": self.get(held.get("Ff")) or 0,
                "value": text_of(self.get(held.get("V"))), "max_length": self.get(held.get("MaxLen")),
                "options": [text_of(self.get(o)) or "" for o in self.list_of(held.get("Opt"))],
            }

    def _names(self, root) -> Iterator[tuple[str, object]]:
        """Pairs of a name tree."""
        seen: set[int] = set()
        stack = [root]
        while stack:
            ref = stack.pop()
            if isinstance(ref, Ref):
                if ref.num in seen:
                    continue
                seen.add(ref.num)
            node = self.dict_of(ref)
            pairs = self.list_of(node.get("Names"))
            for k, v in zip(pairs[::2], pairs[1::2], strict=False):
                yield text_of(self.get(k)) or "", v
            stack += reversed(self.list_of(node.get("Kids")))

    def attachments(self) -> Iterator[dict]:
        for name, spec in self._names(self.dict_of(self.catalog.get("Names")).get("EmbeddedFiles")):
            spec = self.dict_of(spec)
            files = self.dict_of(spec.get("EF"))
            stream = self.get(files.get("UF", files.get("F")))
            if isinstance(stream, Stream):
                body = self.decoded(stream)
                yield {"name": text_of(self.get(spec.get("UF", spec.get("F")))) or name, "size": len(body), "md5": hashlib.md5(body).hexdigest(), "content": body}

    def fonts(self) -> Iterator[dict]:
        for number, page in enumerate(self.pages()):
            for name, ref in self.dict_of(self.dict_of(page.get("Resources")).get("Font")).items():
                font = self.dict_of(ref)
                below = self.dict_of((self.list_of(font.get("DescendantFonts")) or [None])[0])
                descriptor = self.dict_of(font.get("FontDescriptor", below.get("FontDescriptor")))
                yield {
                    "page_no": number, "name": name, "base_font": str(self.get(font.get("BaseFont")) or ""),
                    "subtype": str(self.get(font.get("Subtype")) or ""), "embedded": any(k in descriptor for k in ("FontFile", "FontFile2", "FontFile3")),
                }

    def labels(self) -> Iterator[dict]:
        stack = [self.catalog.get("PageLabels")]
        for _ in range(MAX_OBJECT):
            if not stack:
                return
            node = self.dict_of(stack.pop())
            pairs = self.list_of(node.get("Nums"))
            for k, v in zip(pairs[::2], pairs[1::2], strict=False):
                v = self.dict_of(v)
                yield {"start_index": self.get(k), "style": self.get(v.get("S")), "prefix": text_of(self.get(v.get("P"))), "start_value": self.get(v.get("St")) or 1}
            stack += reversed(self.list_of(node.get("Kids")))

    def xmp(self) -> str | None:
        stream = self.get(self.catalog.get("Metadata"))
        return self.decoded(stream).decode("utf-8", "replace") if isinstance(stream, Stream) else None

    def page_numbers(self) -> dict[int, int]:
        return {p["_num"]: i for i, p in enumerate(self.pages()) if p["_num"] is not None}

    def _target(self, dest, numbers: dict[int, int]) -> tuple[int | None, str | None]:
        """Page number and fit of a destination; a dictionary holds it under D."""
        dest = self.get(dest)
        dest = self.list_of(dest.get("D")) if isinstance(dest, dict) else dest
        if not isinstance(dest, list) or not dest:
            return None, None
        page = dest[0].num if isinstance(dest[0], Ref) else None
        number = numbers.get(page) if page is not None else dest[0] if isinstance(dest[0], int) else None
        return number, str(self.get(dest[1])) if len(dest) > 1 else None

    def destinations(self) -> Iterator[dict]:
        """Named destinations of the name tree and of the older dictionary."""
        numbers = self.page_numbers()
        for name, dest in self._destinations():
            page, fit = self._target(dest, numbers)
            yield {"name": name, "page_no": page, "fit": fit}

    def _destinations(self) -> Iterator[tuple[str, object]]:
        yield from self._names(self.dict_of(self.catalog.get("Names")).get("Dests"))
        yield from self.dict_of(self.catalog.get("Dests")).items()

    def actions(self) -> Iterator[dict]:
        """What happens on opening the file, on its and its pages' events, and on links."""
        numbers = self.page_numbers()

        def row(page, trigger, action):
            action = self.get(action)
            if isinstance(action, list):
                yield {"page_no": page, "trigger": trigger, "type": "GoTo", "target": str(self._target(action, numbers)[0])}
            elif isinstance(action, dict):
                kind = str(self.get(action.get("S")) or "")
                key = {"URI": "URI", "Launch": "F", "GoToR": "F", "Named": "N", "JavaScript": "JS"}.get(kind)
                value = self.get(action.get(key)) if key else None
                value = self.decoded(value) if isinstance(value, Stream) else value
                target = str(self._target(action.get("D"), numbers)[0]) if kind == "GoTo" else text_of(value)
                yield {"page_no": page, "trigger": trigger, "type": kind, "target": target}

        yield from row(None, "OpenAction", self.catalog.get("OpenAction"))
        for trigger, action in self.dict_of(self.catalog.get("AA")).items():
            yield from row(None, trigger, action)
        for number, page in enumerate(self.pages()):
            for trigger, action in self.dict_of(page.get("AA")).items():
                yield from row(number, trigger, action)
            for ref in self.list_of(page.get("Annots")):
                annotation = self.dict_of(ref)
                yield from row(number, "A", annotation.get("A"))

    def layers(self) -> Iterator[dict]:
        """Optional content groups. Off beats on, both beat the base state; visible otherwise."""
        held = self.dict_of(self.catalog.get("OCProperties"))
        config = self.dict_of(held.get("D"))
        sets = {k: {r.num for r in self.list_of(config.get(k)) if isinstance(r, Ref)} for k in ("OFF", "ON")}
        for ref in self.list_of(held.get("OCGs")):
            num = ref.num if isinstance(ref, Ref) else None
            visible = num not in sets["OFF"] and (num in sets["ON"] or self.get(config.get("BaseState")) != "OFF")
            yield {"obj": num, "name": text_of(self.get(self.dict_of(ref).get("Name"))), "visible": visible}

    def images(self) -> Iterator[dict]:
        """Images of each page's own resources: header facts and raw bytes, not pixels."""
        for number, page in enumerate(self.pages()):
            for name, ref in self.dict_of(self.dict_of(page.get("Resources")).get("XObject")).items():
                stream = self.get(ref)
                if isinstance(stream, Stream) and stream.dict.get("Subtype") == "Image":
                    space, codec = self.get(stream.dict.get("ColorSpace")), self.get(stream.dict.get("Filter"))
                    yield {
                        "page_no": number, "name": name, "width": self.get(stream.dict.get("Width")), "height": self.get(stream.dict.get("Height")),
                        "bits": self.get(stream.dict.get("BitsPerComponent")), "color_space": str(space[0] if isinstance(space, list) and space else space or ""),
                        "codec": " ".join(map(str, codec)) if isinstance(codec, list) else str(codec or ""), "raw": stream.raw,
                    }

    def structure(self) -> Iterator[dict]:
        """Tagged elements, depth first, with standard types through the role map."""
        root = self.dict_of(self.catalog.get("StructTreeRoot"))
        roles = {k: str(self.get(v)) for k, v in self.dict_of(root.get("RoleMap")).items()}
        kids = lambda node: v if isinstance(v := self.get(node.get("K")), list) else [node["K"]] if "K" in node else []
        seen: set[int] = set()
        stack = [(k, [i]) for i, k in reversed(list(enumerate(kids(root))))]
        while stack:
            ref, path = stack.pop()
            if isinstance(ref, Ref):
                if ref.num in seen:
                    continue
                seen.add(ref.num)
            node = self.get(ref)
            if isinstance(node, dict) and "S" in node:
                tag = str(self.get(node["S"]))
                marks = [k for k in map(self.get, kids(node)) if isinstance(k, int)]
                yield {"path": path, "type": roles.get(tag, tag), "alt": text_of(self.get(node.get("Alt"))), "lang": text_of(self.get(node.get("Lang"))), "mcids": marks}
                stack += [(k, [*path, i]) for i, k in reversed(list(enumerate(kids(node))))]

    def intents(self) -> Iterator[dict]:
        for ref in self.list_of(self.catalog.get("OutputIntents")):
            x = self.dict_of(ref)
            yield {"subtype": str(self.get(x.get("S")) or ""), "identifier": text_of(self.get(x.get("OutputConditionIdentifier"))), "info": text_of(self.get(x.get("Info")))}

    def box_of(self, value) -> list[float] | None:
        box = [float(x) for x in map(self.get, self.list_of(value)) if isinstance(x, (int, float))]
        return box if len(box) == 4 else None

    def linearization(self) -> dict | None:
        """The dictionary that a file for fast viewing begins with."""
        m = OBJ.search(self.data, 0, 1024)
        found = Lexer(self.data, m.end()).read() if m else None
        return found if isinstance(found, dict) and "Linearized" in found else None

    def linearized(self) -> Iterator[dict]:
        if found := self.linearization():
            yield {name: found.get(key) for name, key in (("length", "L"), ("first_object", "O"), ("first_page_end", "E"), ("n_pages", "N"), ("main_table", "T"))}

    def signatures(self) -> Iterator[dict]:
        """Signed fields: byte ranges, the digest of those bytes, how far they reach, and whether they hold."""
        from .der import check

        for num in sorted(self.offsets):
            node = self.get(Ref(num, 0))
            if isinstance(node, dict) and node.get("Type") == "Sig":
                ranges = [x for x in map(self.get, self.list_of(node.get("ByteRange"))) if isinstance(x, int)]
                parts = [self.data[a : a + n] for a, n in zip(ranges[::2], ranges[1::2], strict=False)]
                contents = self.get(node.get("Contents"))
                yield {
                    "obj": num, "sub_filter": str(self.get(node.get("SubFilter")) or ""), "byte_range": ranges,
                    "coverage_end": max([0, *(a + n for a, n in zip(ranges[::2], ranges[1::2], strict=False))]),
                    "sha256": hashlib.sha256(b"".join(parts)).hexdigest(), "signed_at": text_of(self.get(node.get("M"))),
                    "permission": self._permission(node), "contents": contents, **check(contents if isinstance(contents, bytes) else b"", parts),
                }

    def _permission(self, node: dict) -> int | None:
        """The DocMDP level of a certifying signature."""
        for ref in self.list_of(node.get("Reference")):
            held = self.dict_of(ref)
            if held.get("TransformMethod") == "DocMDP":
                level = self.get(self.dict_of(held.get("TransformParams")).get("P"))
                return level if isinstance(level, int) else 2
        return None

    def revisions(self) -> Iterator[dict]:
        """One for each end-of-file mark: where it ends, and digests of the file up to there."""
        md5, sha256, at = hashlib.md5(), hashlib.sha256(), 0
        for rev, m in enumerate(EOF.finditer(self.data)):
            part = self.data[at : m.end()]
            md5.update(part)
            sha256.update(part)
            at = m.end()
            yield {"rev": rev, "end_offset": at, "md5": md5.hexdigest(), "sha256": sha256.hexdigest()}

    def objects(self) -> Iterator[dict]:
        """The entries that each revision writes: object, offset, whether in use, and what it is.

        Only a revision's own cross-reference section counts, not those that it follows.
        """
        whole, held = self.offsets, dict(self.trailer)
        try:
            for rev, m in enumerate(EOF.finditer(self.data)):
                at = self.data.rfind(b"startxref", 0, m.end())
                where = Lexer(self.data, at + 9).read() if at >= 0 else None
                if not isinstance(where, int) or not 0 <= where < len(self.data):
                    continue
                self.offsets = {}
                if self.data[where : where + 4] == b"xref":
                    self._table(Lexer(self.data, where))
                else:
                    self._xref_stream(where)
                own, self.offsets = self.offsets, whole
                for num, entry in sorted(own.items()):
                    if num:
                        value = self._object_at(entry[1], num) if entry[0] == "at" else self.get(Ref(num, 0)) if entry[0] == "in" else None
                        yield {"rev": rev, "obj": num, "offset": entry[1], "in_use": entry[0] != "free", "class": kind_of(value)}
        finally:
            self.offsets, self.trailer = whole, held

    def conformance(self) -> Iterator[dict]:
        """What the archival rules look at, one row."""
        packet = self.xmp() or ""
        part = re.search(r"pdfaid:part(?:>|\s*=\s*[\"'])\s*(\d+)", packet)
        title = re.search(r"(?s)<dc:title>.*?<rdf:li[^>]*>(.*?)</rdf:li>", packet)
        states = list(self.gstates())
        fonts = {f["base_font"] for f in self.fonts() if not f["embedded"] and f["subtype"] != "Type3"}
        alphas = [a for s in states for a in (s["ca"], s["stroke_ca"]) if a is not None]
        yield {
            "pdfa_part": int(part[1]) if part else None, "has_intent": any(i["subtype"] == "GTS_PDFA1" for i in self.intents()), "unembedded_fonts": len(fonts),
            "encrypted": bool(self.encryption), "title": title[1].strip() if title else self.info().get("Title"), "ca": min([1.0, *alphas]),
            "smask": any(s["smask"] for s in states),
        }

    def gstates(self) -> Iterator[dict]:
        """Each page's named graphics states: opacities, blend mode, and whether there is a soft mask."""
        number_of = lambda v: float(x) if isinstance(x := self.get(v), (int, float)) and not isinstance(x, bool) else None
        for number, page in enumerate(self.pages()):
            for name, ref in self.dict_of(self.dict_of(page.get("Resources")).get("ExtGState")).items():
                g = self.dict_of(ref)
                mode, mask = self.get(g.get("BM")), self.get(g.get("SMask"))
                mode = self.get(mode[0]) if isinstance(mode, list) and mode else mode
                yield {
                    "page_no": number, "name": name, "ca": number_of(g.get("ca")), "stroke_ca": number_of(g.get("CA")),
                    "blend": str(mode) if isinstance(mode, Name) else "Normal", "smask": mask is not None and mask != "None",
                }

    def spaces(self) -> Iterator[dict]:
        """Each page's named colour spaces: family, what they build on, and their components."""
        for number, page in enumerate(self.pages()):
            for name, ref in self.dict_of(self.dict_of(page.get("Resources")).get("ColorSpace")).items():
                family, base, n = self.space(ref)
                yield {"page_no": number, "name": name, "family": family, "base": base, "components": n}

    def space(self, value, depth: int = 0) -> tuple[str, str | None, int]:
        """Family, base space and number of components of a colour space."""
        value = self.get(value)
        parts = value if isinstance(value, list) else [value]
        family = str(self.get(parts[0]) or "") if parts else ""
        family = {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed"}.get(family, family)
        fixed = {"DeviceGray": 1, "CalGray": 1, "DeviceRGB": 3, "CalRGB": 3, "Lab": 3, "DeviceCMYK": 4, "Indexed": 1, "Separation": 1, "Pattern": 0}
        n = fixed.get(family, 0)
        if family == "ICCBased" and len(parts) > 1:
            held = self.get(self.dict_of(parts[1]).get("N"))
            n = held if isinstance(held, int) else 0
        if family == "DeviceN" and len(parts) > 1:
            n = len(self.list_of(parts[1]))
        under = {"Indexed": 1, "Pattern": 1, "Separation": 2, "DeviceN": 2}.get(family)
        if under and len(parts) > under and depth < 8:
            return family, self.space(parts[under], depth + 1)[0], n
        return family, None, n

    def operators(self) -> Iterator[dict]:
        """How often each operator occurs in a page's content."""
        from collections import Counter

        from .text import tokens

        for number, page in enumerate(self.pages()):
            for op, n in sorted(Counter(op for _, op in tokens(self.contents(page))).items()):
                yield {"page_no": number, "op": op.decode("latin-1"), "n": n}

    def placements(self) -> Iterator[dict]:
        """Where images are painted: the corner and the sides of each one's unit square."""
        from .text import placements

        for number, page in enumerate(self.pages()):
            for i, (name, m) in enumerate(placements(self, self.contents(page), self.dict_of(page.get("Resources")))):
                yield {"page_no": number, "ord": i, "name": name, "x": m[4], "y": m[5], "width": (m[0] ** 2 + m[1] ** 2) ** 0.5, "height": (m[2] ** 2 + m[3] ** 2) ** 0.5}

    def keys(self) -> Iterator[dict]:
        """The keys of every dictionary object, its type, and the kind of each value, for checks against a catalogue."""
        for num in sorted(self.offsets):
            value = self.get(Ref(num, 0))
            held = value.dict if isinstance(value, Stream) else value
            if isinstance(held, dict):
                kind = str(self.get(held.get("Type")) or "")
                for key, v in held.items():
                    yield {"obj": num, "type": kind, "key": key, "kind": value_kind(self.get(v))}


def value_kind(value) -> str:
    """A value's basic type by the name that schema catalogues use."""
    for kind, name in (
        (bool, "boolean"), (int, "integer"), (float, "number"), (Name, "name"), ((bytes, bytearray, str), "string"), (list, "array"), (dict, "dictionary"), (Stream, "stream"),
    ):
        if isinstance(value, kind):
            return name
    return "null"


def kind_of(value) -> str:
    """What an object is to a certified document: by its field type first, then its type."""
    held = value.dict if isinstance(value, Stream) else value
    if not isinstance(held, dict):
        return "unknown"
    if "FT" in held:
        return "signature" if held["FT"] == "Sig" else "form_field"
    kind, below = str(held.get("Type") or ""), str(held.get("Subtype") or "")
    known = {"Sig": "signature", "Page": "page", "Pages": "page", "Catalog": "catalog", "Annot": "annotation", "Font": "font", "XObject": "xobject", "Metadata": "metadata"}
    if kind in known:
        return "form_field" if kind == "Annot" and below == "Widget" else known[kind]
    if below in ("Text", "Link", "Highlight", "Widget", "FreeText", "Stamp", "Popup") and "Rect" in held:
        return "form_field" if below == "Widget" else "annotation"
    if {"Title", "Author", "Producer", "Creator", "ModDate"} & set(held):
        return "metadata"
    return "unknown"
