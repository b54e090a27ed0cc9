"""PDF files as rows: one table for each section, from any DataFrame with a binary column.

``sections`` parses each file once in an Arrow batch function on the executors. A file that can't
be read becomes one row with its status, so it is seen and counted, and a job never fails on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

STATUS = "status string, error string"
SECTIONS: dict[str, tuple[str, Callable]] = {}


def section(schema: str):
    def add(f):
        SECTIONS[f.__name__] = (schema, f)
        return f

    return add


class Partial(tuple):
    """A row of which a part could not be read; ``error`` says why."""

    error = ""


@section("version string, n_pages int, repaired boolean, linearized boolean, info map<string,string>")
def documents(doc) -> Iterator[tuple]:
    yield doc.version, sum(1 for _ in doc.pages()), doc.repaired, bool(doc.linearization()), list(doc.info().items())


@section("page_no int, width double, height double, rotate double, crop array<double>, text string")
def pages(doc) -> Iterator[tuple]:
    from ..pdf.filters import FilterError
    from ..pdf.text import page_text

    for number, page in enumerate(doc.pages()):
        box = doc.box_of(page.get("MediaBox")) or [0.0, 0.0, 612.0, 792.0]
        facts = (number, box[2] - box[0], box[3] - box[1], float(doc.get(page.get("Rotate")) or 0), doc.box_of(page.get("CropBox")) or box)
        try:
            yield (*facts, page_text(doc, page))
        except FilterError as e:  # this page's content only
            row = Partial((*facts, None))
            row.error = str(e)
            yield row


@section("page_no int, ord int, ch string, x double, y double, w double, h double, angle double, font string, vertical boolean")
def chars(doc) -> Iterator[tuple]:
    """Every character with its box; ``foliary.operators.layout.pack`` makes pages of them."""
    from ..pdf.text import page_glyphs

    for number, page in enumerate(doc.pages()):
        for i, g in enumerate(page_glyphs(doc, page)):
            yield number, i, g.ch, g.x, g.y, g.w, g.h, round(g.angle, 6), g.font, g.vertical


@section("page_no int, glyphs string, x array<double>, y array<double>, w array<double>, h array<double>, fonts array<string>")
def glyph_pages(doc) -> Iterator[tuple]:
    """Pages of glyphs as ``foliary.operators.layout`` takes them: a row for each page."""
    from ..pdf.text import page_glyphs

    for number, page in enumerate(doc.pages()):
        found = list(page_glyphs(doc, page))
        yield number, "".join([g.ch for g in found]), *[[g[k] for g in found] for k in (1, 2, 3, 4)], [g.font for g in found]


@section("page_no int, ord int, text string, x double, y double, font_size double")
def text_runs(doc) -> Iterator[tuple]:
    from ..pdf.text import runs

    for number, page in enumerate(doc.pages()):
        for i, (text, x, y, size, _) in enumerate(runs(doc, page)):
            yield number, i, text, x, y, size


@section("path array<int>, depth int, title string, page_no int, uri string")
def outline(doc) -> Iterator[tuple]:
    for path, title, page, uri in doc.outline():
        yield path, len(path) - 1, title, page, uri


@section("page_no int, type string, contents string, rect array<double>, flags int, uri string")
def annotations(doc) -> Iterator[tuple]:
    for a in doc.annotations():
        yield a["page_no"], a["type"], a["contents"], a["rect"], a["flags"], a["uri"]


@section("full_name string, type string, flags int, value string, max_length int, options array<string>")
def fields(doc) -> Iterator[tuple]:
    for f in doc.fields():
        yield f["full_name"], f["type"], f["flags"], f["value"], f["max_length"], f["options"]


@section("name string, size long, md5 string, content binary")
def attachments(doc) -> Iterator[tuple]:
    for a in doc.attachments():
        yield a["name"], a["size"], a["md5"], a["content"]


@section("page_no int, name string, base_font string, subtype string, embedded boolean")
def fonts(doc) -> Iterator[tuple]:
    for f in doc.fonts():
        yield f["page_no"], f["name"], f["base_font"], f["subtype"], f["embedded"]


@section("start_index int, style string, prefix string, start_value int")
def labels(doc) -> Iterator[tuple]:
    for x in doc.labels():
        yield x["start_index"], x["style"], x["prefix"], x["start_value"]


@section("rev int, end_offset long, md5 string, sha256 string")
def revisions(doc) -> Iterator[tuple]:
    for x in doc.revisions():
        yield x["rev"], x["end_offset"], x["md5"], x["sha256"]


def _table(name: str, schema: str) -> None:
    """A section whose rows are dictionaries keyed by its columns."""
    columns = [c.split(" ")[0] for c in schema.split(", ")]
    SECTIONS[name] = (schema, lambda doc: (tuple(r[c] for c in columns) for r in getattr(doc, name)()))


_table("destinations", "name string, page_no int, fit string")
_table("actions", "page_no int, trigger string, type string, target string")
_table("layers", "obj int, name string, visible boolean")
_table("images", "page_no int, name string, width int, height int, bits int, color_space string, codec string, raw binary")
_table("structure", "path array<int>, type string, alt string, lang string, mcids array<int>")
_table("objects", "rev int, obj int, offset long, in_use boolean, class string")
_table("conformance", "pdfa_part int, has_intent boolean, unembedded_fonts long, encrypted boolean, title string, ca double, smask boolean")
_table("gstates", "page_no int, name string, ca double, stroke_ca double, blend string, smask boolean")
_table("spaces", "page_no int, name string, family string, base string, components int")
_table("operators", "page_no int, op string, n long")
_table("placements", "page_no int, ord int, name string, x double, y double, width double, height double")
_table("keys", "obj int, type string, key string, kind string")
_table("linearized", "length long, first_object long, first_page_end long, n_pages long, main_table long")
_table("intents", "subtype string, identifier string, info string")
_table("signatures", "obj int, sub_filter string, byte_range array<long>, coverage_end long, sha256 string, signed_at string, permission int, digest_ok boolean, signature_ok boolean, verdict string, contents binary")


@section("xmp string")
def xmp(doc) -> Iterator[tuple]:
    """The packet; ``foliary.operators.structure.metadata`` reads its fields."""
    yield (doc.xmp(),)


def rows_of(content: bytes | None, name: str, repair: bool = True, password: str = "", document=None) -> Iterator[tuple]:
    """A file's rows of a section as they are read, each followed by status and error.

    ``document`` is the parsed file, if there is one already.
    """
    from ..pdf.document import Document, Encrypted, Malformed

    schema, make = SECTIONS[name]
    blank = (None,) * len(schema.split(", "))
    if not content:
        yield (*blank, "EMPTY", "no bytes")
        return
    try:
        for row in make(document or Document(bytes(content), repair, password)):
            yield (*row, "PARTIAL", row.error) if isinstance(row, Partial) else (*row, "OK", None)
    except Encrypted as e:
        yield (*blank, "ENCRYPTED", str(e))
    except Malformed as e:
        yield (*blank, "MALFORMED", str(e))
    except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError, OverflowError) as e:
        yield (*blank, "INTERNAL", f"{type(e).__name__}: {e}"[:200])  # after the rows that came before


def parse(files: DataFrame, names: tuple[str, ...], key: str = "path", content: str = "content", repair: bool = True, password: str = "") -> DataFrame:
    """Several sections of every file from one parse: a column of rows for each, for ``rows``.

    The table is read once for each section taken from it, so write it first if there are many.
    """
    kind = dict(files.dtypes)[key]
    columns = ", ".join(f"{n} array<struct<{SECTIONS[n][0]}, {STATUS}>>" for n in names)
    full = StructType.fromDDL(f"{key} {kind}, {columns}")
    from pyspark.sql.pandas.types import to_arrow_schema

    from ..pdf.document import Document

    arrow = to_arrow_schema(full)
    fields = {n: [f.name for f in full[n].dataType.elementType.fields] for n in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part = batch.slice(at, 50)
                done = [[part.column(0)[i].as_py(), *found(part.column(1)[i].as_py())] for i in range(part.num_rows)]
                yield _batch(done, arrow)

    def found(data: bytes | None) -> list[list[dict]]:
        try:
            document = Document(bytes(data), repair, password) if data else None
        except ValueError:
            document = None  # rows_of meets the failure again and names it
        return [[dict(zip(fields[n], row, strict=True)) for row in rows_of(data, n, repair, password, document)] for n in names]

    return files.select(key, F.col(content).alias("content")).mapInArrow(run, full)


def rows(parsed: DataFrame, name: str, key: str = "path") -> DataFrame:
    """A section's rows from a table that ``parse`` made."""
    return parsed.select(key, F.explode(name).alias("__row")).select(key, "__row.*")


def sections(files: DataFrame, name: str, key: str = "path", content: str = "content", repair: bool = True, password: str = "") -> DataFrame:
    """The section's rows of every file, with the file's key, status and error.

    ``password`` is tried on protected files; it stays an option and is never a column.
    """
    schema = SECTIONS[name][0]
    kind = dict(files.dtypes)[key]
    full = StructType.fromDDL(f"{key} {kind}, {schema}, {STATUS}")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: list[tuple] = []
            for k, body in zip(batch.column(0), batch.column(1), strict=True):
                done += [(k.as_py(), *row) for row in rows_of(body.as_py(), name, repair, password)]
                if len(done) >= 2000:
                    yield _batch(done, arrow)
                    done = []
            if done:
                yield _batch(done, arrow)

    return files.select(key, F.col(content).alias("content")).mapInArrow(run, full)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class PdfSource(DataSource):
    """``spark.read.format("pdf").option("section", "pages").load(folder)`` for files on a shared path.

    ``df.write.format("pdf").save(folder)`` writes a file for each row: name, and pages as an array
    of texts. Paths are those of a file system that every executor mounts; for other stores use
    ``read_folder``, which reads through Spark.
    """

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return f"path string, {SECTIONS[self.options.get('section', 'pages')][0]}, {STATUS}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PdfReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PdfWriter(self.options, schema, overwrite)


def packed(sizes: list[tuple[str, int]], most: int) -> list[list[str]]:
    """Paths in groups of at most ``most`` bytes, or one larger file; the largest first."""
    groups: list[list[str]] = []
    room = 0
    for path, size in sorted(sizes, key=lambda f: (-f[1], f[0])):
        if not groups or size > room:
            groups.append([])
            room = most
        groups[-1].append(path)
        room -= size
    return groups


class PdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        """Files in groups by their bytes (option ``bytes``, 32 MB)."""
        from pathlib import Path

        top = Path(self.options["path"].removeprefix("file://"))
        files = [(str(p), p.stat().st_size) for p in ([top] if top.is_file() else top.rglob("*.pdf"))]
        return [InputPartition(g) for g in packed(files, int(self.options.get("bytes", 32 << 20)))] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.value:
            with open(path, "rb") as f:
                content = f.read()
            name = self.options.get("section", "pages")
            for row in rows_of(content, name, self.options.get("mode", "REPAIR") == "REPAIR", self.options.get("password", "")):
                # Arrow takes a map as pairs, a Python row as a dict.
                yield (path, *[dict(v) if isinstance(v, list) and name == "documents" else v for v in row])


class PdfWriter(DataSourceWriter):
    """Files appear under their names when the whole job has succeeded; a failed job leaves none."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.overwrite = dict(options)["path"].removeprefix("file://"), overwrite
        if not {"name", "pages"} <= set(schema.names):
            raise ValueError("a table of files has the columns name and pages")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        import os
        import uuid

        from ..pdf.writer import build

        staged = os.path.join(self.path, f"_temporary-{uuid.uuid4().hex}")
        os.makedirs(staged)
        names = []
        for row in iterator:
            name = os.path.basename(row["name"])
            with open(os.path.join(staged, name), "wb") as f:
                f.write(build(list(row["pages"] or [""])))
            names.append(name)
        return Written(staged, names)

    def commit(self, messages: list) -> None:
        import os
        import shutil

        done = [m for m in messages if m]
        if self.overwrite:
            kept = {m.staged for m in done}
            for old in os.scandir(self.path):
                if old.path not in kept and old.name.endswith(".pdf"):
                    os.remove(old.path)
        for m in done:
            for name in m.names:
                os.replace(os.path.join(m.staged, name), os.path.join(self.path, name))
            shutil.rmtree(m.staged)

    def abort(self, messages: list) -> None:
        import shutil

        for m in messages:
            if m:
                shutil.rmtree(m.staged, ignore_errors=True)


@dataclass
class Written(WriterCommitMessage):
    staged: str
    names: list[str]


def read_folder(spark: SparkSession, path: str, name: str = "pages", repair: bool = True) -> DataFrame:
    """A section of all files below a path that Spark can reach, local or remote."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return sections(files, name, repair=repair)


def from_base64(files: DataFrame, key: str = "path", text: str = "base64") -> DataFrame:
    """Files as bytes from a column of base64, which may hold line breaks and lack its padding."""
    from ..functions.values import from_base64 as decoded

    return files.select(key, decoded(F.col(text)).alias("content"))


def register(spark: SparkSession) -> None:
    """The source "pdf", and a table function for each section: ``SELECT f.path, p.* FROM f, LATERAL pdf_pages(f.content) p``."""
    spark.dataSource.register(PdfSource)
    for name, (schema, _) in SECTIONS.items():
        spark.udtf.register(f"pdf_{name}", F.udtf(_function(name), returnType=f"{schema}, {STATUS}"))


def _function(name: str) -> type:
    class Section:
        def eval(self, content):
            for row in rows_of(content, name):
                # A map comes as pairs for Arrow; a table function takes a dict.
                yield tuple(dict(v) if isinstance(v, list) and name == "documents" else v for v in row)

    return Section
