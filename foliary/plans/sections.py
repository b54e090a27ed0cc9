"""Queries over sections of sample files, each beside SQL over the rows that the files were written from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..operators import audit, forms, layout, spatial, structure, tables
from ..pdf import writer
from ..sources.documents import Documents
from ..sources.pdf import from_base64, parse, register, rows, sections
from ..sources.writing import to_pdf, to_pdfs
from . import samples
from .catalog import query, read

KEY = "c_custkey"


def customer_files(spark, sf, make, *columns: str) -> DataFrame:
    """A file for each customer from some of its columns."""
    return to_pdf(read(spark, sf, "customer").select(KEY, *[F.expr(c).alias(f"v{i}") for i, c in enumerate(columns)]), KEY, make)


def rich(spark, sf) -> DataFrame:
    return customer_files(spark, sf, samples.sections_file, "c_name", "c_mktsegment", KEY)


def glyph_pages(files: DataFrame) -> DataFrame:
    return sections(files, "glyph_pages", KEY).withColumnRenamed(KEY, "doc_id")


# --- text with its place --------------------------------------------------------------------------


@query("""SELECT c_custkey, CAST(i AS INT) AS ord, substring(c_name, CAST(i AS INT) + 1, 1) AS ch, 10 + 2.0 * (c_custkey % 50) + 7.0 * i AS x, 20 + 2.0 * (c_custkey % 90) AS y, 6.0::DOUBLE AS w, 10.0::DOUBLE AS h
FROM (SELECT *, unnest(range(0, length(c_name))) AS i FROM customer)""")
def pdf_chars(spark, sf):
    """Each character's box under a coordinate system that is scaled and shifted."""
    files = customer_files(spark, sf, samples.moved, "c_name", "c_custkey % 50", "c_custkey % 90")
    return sections(files, "chars", KEY).select(KEY, "ord", "ch", *[F.round(c, 6).alias(c) for c in ("x", "y", "w", "h")])


LINES_SQL = """WITH l AS (SELECT c_custkey AS doc_id, 0 AS line_index, c_name AS text FROM customer UNION ALL SELECT c_custkey, 1, c_mktsegment || ' of ' || c_nationkey FROM customer
UNION ALL SELECT c_custkey, 2, 'last line ' || c_custkey FROM customer)
"""


def scattered(spark, sf) -> DataFrame:
    make = lambda name, second, third: samples.scattered([name, second, third])
    return glyph_pages(customer_files(spark, sf, make, "c_name", "concat(c_mktsegment, ' of ', c_nationkey)", "concat('last line ', c_custkey)"))


@query(LINES_SQL + "SELECT doc_id, CAST(line_index AS BIGINT) AS line_index, text, 55.0::DOUBLE AS x, 695.0 - 20 * line_index AS y, 6.0 * length(text) AS w FROM l")
def pdf_line_text(spark, sf):
    """Lines found by position in files that show them in another order."""
    return layout.lines(scattered(spark, sf)).select("doc_id", "line_index", "text", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("w", 6).alias("w"))


@query(LINES_SQL + "SELECT doc_id, CAST(line_index AS BIGINT) AS line_index, unnest(string_split(text, ' ')) AS word FROM l")
def pdf_words(spark, sf):
    return layout.words(scattered(spark, sf)).select("doc_id", "line_index", F.col("text").alias("word"))


@query("""SELECT c_custkey AS doc_id, '"Name","Segment"' || chr(10) || '"' || c_name || '","' || c_mktsegment || '"' || chr(10) || '"Nation","' || c_nationkey || '"' || chr(10) AS content FROM customer""")
def pdf_table_csv(spark, sf):
    """A table from a file's glyphs to CSV: file, glyphs, cells, text."""
    make = lambda name, segment, nation: samples.table([["Name", "Segment"], [name, segment], ["Nation", nation]])
    cells = tables.cells(glyph_pages(customer_files(spark, sf, make, "c_name", "c_mktsegment", "string(c_nationkey)")))
    return tables.to_csv(cells, ("doc_id",))


@query("""SELECT c_custkey AS doc_id, CAST(0 AS BIGINT) AS line_index, CAST(strpos(c_name, '#') AS INT) AS start, 55.0 + 6 * strpos(c_name, '#') AS x1, 695.0::DOUBLE AS y1, 55.0 + 6 * strpos(c_name, '#') + 18 AS x2, 705.0::DOUBLE AS y2
FROM customer WHERE strpos(c_name, '#000') > 0""")
def pdf_hit_boxes(spark, sf):
    """Where the three zeros after the sign lie on the page."""
    found = spatial.hit_boxes(scattered(spark, sf), "#000").withColumn("start", F.col("start") + 1)
    # The sign itself is left out of the box.
    return found.select("doc_id", "line_index", "start", *[F.round(F.expr(c), 6).alias(n) for n, c in (("x1", "x1 + 6"), ("y1", "y1"), ("x2", "x2"), ("y2", "y2"))])


@query("SELECT c_custkey AS doc_id, substring(c_mktsegment || ' of ' || c_nationkey, 3, 1) AS ch, CAST(1 AS BIGINT) AS line_index FROM customer")
def pdf_hit_test(spark, sf):
    """The character at a point of the second line."""
    return spatial.hit_test(scattered(spark, sf), 70.0, 680.0).select("doc_id", "ch", "line_index")


@query(LINES_SQL + """SELECT doc_id, '{"n_lines":3,"n_words":' || sum(len(string_split(text, ' '))) || ',"lines":[' || string_agg('"' || text || '"', ',' ORDER BY line_index) || ']}' AS structure FROM l GROUP BY doc_id""")
def pdf_page_structure(spark, sf):
    """Lines and words of a page as JSON."""
    found = layout.lines(scattered(spark, sf)).withColumn("n_words", F.size(F.split("text", " ")))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("line_index", "text"))), lambda r: r["text"])
    packed = F.struct(F.count(F.lit(1)).alias("n_lines"), F.sum("n_words").alias("n_words"), listed.alias("lines"))
    return found.groupBy("doc_id").agg(F.to_json(packed).alias("structure"))


@query("""SELECT c_custkey AS doc_id, '<svg xmlns="http://www.w3.org/2000/svg" width="612" height="792">' || '<text x="55.00" y="97.00">' || c_name || '</text><text x="55.00" y="117.00">' || c_mktsegment || ' of ' || c_nationkey
|| '</text><text x="55.00" y="137.00">last line ' || c_custkey || '</text></svg>' AS svg FROM customer""")
def pdf_svg_text(spark, sf):
    """A page's lines as a vector drawing of text."""
    return layout.svg_text(layout.lines(scattered(spark, sf)), 612, 792).select("doc_id", "svg")


# --- fonts ----------------------------------------------------------------------------------------


@query("SELECT c_custkey, translate(c_mktsegment, 'ABCDEFGHIJKLM', '0123456789&éŠ') AS text FROM customer")
def pdf_differences_text(spark, sf):
    """Codes named anew by a font's glyph names."""
    return sections(customer_files(spark, sf, samples.differences, "c_mktsegment"), "pages", KEY).select(KEY, "text")


@query("SELECT c_custkey, '’' || c_mktsegment || '‘' || '“' AS text FROM customer")
def pdf_standard_encoding(spark, sf):
    """A font without an encoding shows quotes of the standard one."""
    make = lambda t: samples.one_page(b"BT /F1 9 Tf %s Tj ET" % samples.literal(f"'{t}`\xaa"), {"Font": {"F1": samples.simple_font()}})
    return sections(customer_files(spark, sf, make, "c_mktsegment"), "pages", KEY).select(KEY, "text")


@query("""WITH c AS (SELECT c_custkey, string_split(substring(c_name, 10), '') AS d FROM customer)
SELECT c_custkey, list_sum([CAST(x AS INT) + 1 FOR x IN d]) * 1.0 AS width, CAST(len(d) AS BIGINT) AS n FROM c""")
def pdf_cid_widths(spark, sf):
    """Advance of digits whose widths a two-byte font lists one by one."""
    found = sections(customer_files(spark, sf, samples.wide_font, "substring(c_name, 10)"), "chars", KEY)
    return found.groupBy(KEY).agg(F.round(F.sum("w"), 6).alias("width"), F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, unnest(['F1', 'G0', 'G1', 'G2']) AS name, unnest(['Font0', 'Sample', 'Sample', 'Sample']) AS base_font, CAST(unnest([0, 0, 1, 2]) AS INT) AS page_no, false AS embedded FROM customer")
def pdf_fonts(spark, sf):
    """Fonts by resource name over a document; the first page that has one wins."""
    found = sections(customer_files(spark, sf, samples.three_pages, "c_name", "c_mktsegment"), "fonts", KEY)
    first = found.groupBy(KEY, "name").agg(F.min_by(F.struct("base_font", "page_no", "embedded"), "page_no").alias("f"))
    return first.select(KEY, "name", "f.*")


# --- sections -------------------------------------------------------------------------------------


@query("SELECT c_custkey, CAST(unnest([0, 2]) AS INT) AS start_index, unnest(['r', 'D']) AS style, unnest([NULL, c_mktsegment]) AS prefix, CAST(unnest([1, 7]) AS INT) AS start_value FROM customer")
def pdf_labels(spark, sf):
    return sections(customer_files(spark, sf, samples.three_pages, "c_name", "c_mktsegment"), "labels", KEY).drop("status", "error")


@query("SELECT c_custkey, c_mktsegment AS name, CAST(0 AS INT) AS page_no, 'XYZ' AS fit FROM customer")
def pdf_destinations(spark, sf):
    return sections(rich(spark, sf), "destinations", KEY).drop("status", "error")


@query("""SELECT c_custkey, CAST(unnest([NULL, 0, 0]) AS INT) AS page_no, unnest(['OpenAction', 'O', 'A']) AS trigger, unnest(['GoTo', 'Named', 'URI']) AS type,
unnest(['0', 'NextPage', 'http://x.example/' || c_custkey]) AS target FROM customer""")
def pdf_actions(spark, sf):
    return sections(rich(spark, sf), "actions", KEY).drop("status", "error")


@query("SELECT c_custkey, unnest([c_name, c_mktsegment]) AS name, unnest([true, false]) AS visible FROM customer")
def pdf_layers(spark, sf):
    return sections(rich(spark, sf), "layers", KEY).select(KEY, "name", "visible")


@query("SELECT c_custkey, CAST(0 AS INT) AS page_no, 'I' AS name, CAST(c_custkey % 7 + 1 AS INT) AS width, CAST(2 AS INT) AS height, 'DeviceRGB' AS color_space, 'DCTDecode' AS codec, md5('jpeg') AS md5 FROM customer")
def pdf_images(spark, sf):
    return sections(rich(spark, sf), "images", KEY).select(KEY, "page_no", "name", "width", "height", "color_space", "codec", F.md5("raw").alias("md5"))


@query("SELECT c_custkey, CAST(unnest([0, 1]) AS INT) AS ord, 'I' AS name, unnest([7.0, 105.0])::DOUBLE AS x, unnest([8.0, 6.0])::DOUBLE AS y, unnest([50.0, 10.0])::DOUBLE AS width, unnest([50.0, 20.0])::DOUBLE AS height FROM customer")
def pdf_placements(spark, sf):
    """Images painted through nested coordinate systems, one of them in a form."""
    return sections(rich(spark, sf), "placements", KEY).select(KEY, "ord", "name", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")])


@query("SELECT c_custkey, unnest(['0', '0/1']) AS path, unnest(['H1', 'Span']) AS type, unnest([c_mktsegment, NULL]) AS alt, unnest(['0', '1']) AS marks FROM customer")
def pdf_structure(spark, sf):
    found = sections(rich(spark, sf), "structure", KEY)
    return found.select(KEY, F.array_join("path", "/").alias("path"), "type", "alt", F.array_join("mcids", ",").alias("marks"))


@query("SELECT c_custkey, CASE c_custkey % 2 WHEN 1 THEN 'GTS_PDFA1' ELSE 'GTS_PDFX' END AS subtype, 'sRGB' AS identifier FROM customer")
def pdf_intents(spark, sf):
    return sections(rich(spark, sf), "intents", KEY).select(KEY, "subtype", "identifier")


@query("SELECT c_custkey, c_name AS title, c_mktsegment AS producer, CAST(c_custkey % 3 + 1 AS INT) AS pdfa_part FROM customer")
def pdf_xmp(spark, sf):
    """Fields of metadata packets."""
    found = sections(rich(spark, sf), "xmp", KEY).select(KEY, structure.metadata(F.col("xmp")).alias("m"))
    return found.select(KEY, "m.title", "m.producer", "m.pdfa_part")


@query("SELECT c_custkey, 'G' AS name, (c_custkey % 4) / 4.0 AS ca, 'Multiply' AS blend, false AS smask FROM customer")
def pdf_gstates(spark, sf):
    return sections(rich(spark, sf), "gstates", KEY).select(KEY, "name", "ca", "blend", "smask")


@query("SELECT c_custkey, unnest(['C', 'D']) AS name, unnest(['Indexed', 'DeviceN']) AS family, unnest(['ICCBased', 'DeviceCMYK']) AS base, CAST(unnest([1, 2]) AS INT) AS components FROM customer")
def pdf_color_spaces(spark, sf):
    return sections(rich(spark, sf), "spaces", KEY).select(KEY, "name", "family", "base", "components")


@query("SELECT unnest(['Do', 'Q', 'cm', 'pop', 'q']) AS op, (SELECT count(*) FROM customer) * unnest([2, 1, 1, 1, 1]) AS n")
def pdf_operator_census(spark, sf):
    """Operators outside strings over all files."""
    return sections(rich(spark, sf), "operators", KEY).groupBy("op").agg(F.sum("n").alias("n"))


@query("SELECT c_custkey, CAST(0 AS INT) AS page_no, 612.0::DOUBLE AS width, 100.0 + c_custkey % 3 AS crop_width, 200.0::DOUBLE AS crop_height FROM customer")
def pdf_page_info(spark, sf):
    c = F.col("crop")
    return sections(rich(spark, sf), "pages", KEY).select(KEY, "page_no", "width", (c[2] - c[0]).alias("crop_width"), (c[3] - c[1]).alias("crop_height"))


@query("SELECT c_custkey, c_mktsegment AS text FROM customer")
def pdf_page_lookup(spark, sf):
    """The second page of each file, counted from zero."""
    return sections(customer_files(spark, sf, samples.three_pages, "c_name", "c_mktsegment"), "pages", KEY).filter("page_no = 1").select(KEY, "text")


@query("SELECT c_custkey, c_name || chr(10) || chr(10) || '--- Page 1 ---' || chr(10) || chr(10) || c_mktsegment AS text FROM customer")
def pdf_page_range_text(spark, sf):
    """The first two pages in one text, with the number of each but the first."""
    found = sections(customer_files(spark, sf, samples.three_pages, "c_name", "c_mktsegment"), "pages", KEY)
    return layout.range_text(found, KEY, 0, 1)


@query("SELECT c_custkey, true AS linearized, CAST(c_custkey % 3 + 1 AS BIGINT) AS n_pages, CAST(5 AS BIGINT) AS first_object FROM customer")
def pdf_linearized(spark, sf):
    """The probe for files that begin with the dictionary of fast viewing."""
    both = parse(customer_files(spark, sf, samples.linear, "c_name", "int(c_custkey % 3 + 1)"), ("documents", "linearized"), KEY)
    return both.select(KEY, F.col("documents")[0]["linearized"].alias("linearized"), F.col("linearized")[0]["n_pages"].alias("n_pages"), F.col("linearized")[0]["first_object"].alias("first_object"))


@query("SELECT c_custkey, c_name AS title, c_name AS text FROM customer")
def pdf_encrypted(spark, sf):
    """Files under a password, by RC4 and by AES; one parse for both sections."""
    both = parse(customer_files(spark, sf, samples.protected, "c_name", KEY), ("documents", "pages"), KEY, password="p")
    return both.select(KEY, F.col("documents")[0]["info"]["Title"].alias("title"), F.col("pages")[0]["text"].alias("text"))


@query("""SELECT CASE c_custkey % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'ENCRYPTED' WHEN 2 THEN 'MALFORMED' ELSE 'EMPTY' END AS status, count(*) AS n FROM customer GROUP BY ALL""")
def pdf_status_totals(spark, sf):
    """Files by what became of them; no file fails a job."""

    def made(name, n):
        return [samples.moved(name, 1, 2), samples.protected(name, n), b"%PDF-1.4 no objects", b""][n % 4]

    return sections(customer_files(spark, sf, made, "c_name", KEY), "documents", KEY).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, '{"subtype":"' || CASE c_custkey % 2 WHEN 1 THEN 'GTS_PDFA1' ELSE 'GTS_PDFX' END || '","identifier":"sRGB"}' AS intent,
'[{"name":"' || c_name || '","visible":true},{"name":"' || c_mktsegment || '","visible":false}]' AS layers FROM customer""")
def pdf_dump_json(spark, sf):
    """Sections as JSON from one parse."""
    parsed = parse(rich(spark, sf), ("intents", "layers"), KEY)
    first = F.col("intents")[0]
    layers = F.transform("layers", lambda x: F.struct(x["name"].alias("name"), x["visible"].alias("visible")))
    return parsed.select(KEY, F.to_json(F.struct(first["subtype"].alias("subtype"), first["identifier"].alias("identifier"))).alias("intent"), F.to_json(layers).alias("layers"))


@query("""SELECT c_custkey, unnest(['Lang', 'MarkInfo']) AS key FROM customer""")
def pdf_schema_check(spark, sf):
    """Required keys that a file's catalog lacks, by a catalogue of rules as rows."""
    rules = spark.createDataFrame([("Catalog", k, kind) for k, kind in (("Type", "name"), ("Pages", "dictionary"), ("Lang", "string"), ("MarkInfo", "dictionary"))], "type string, key string, kind string")
    return audit.missing_keys(sections(rich(spark, sf), "keys", KEY).withColumnRenamed(KEY, "doc_id"), rules).select(F.col("doc_id").alias(KEY), "key")


# --- revisions, conformance and signatures from files ------------------------------------------------


def revised(spark, sf) -> DataFrame:
    return customer_files(spark, sf, samples.revised, "c_mktsegment", KEY)


@query("""SELECT c_custkey AS doc_id, CAST(1 AS INT) AS rev, 'form_field' AS class, 'modified' AS change FROM customer UNION ALL SELECT c_custkey, 1, 'annotation', 'added' FROM customer
UNION ALL SELECT c_custkey, 1, 'page', 'modified' FROM customer WHERE c_custkey % 3 = 0""")
def pdf_revision_changes(spark, sf):
    """What the second revision of each file did, from its cross-references."""
    found = sections(revised(spark, sf), "objects", KEY).withColumnRenamed(KEY, "doc_id")
    return audit.diff_revisions(found).filter("rev = 1").select("doc_id", "rev", "class", "change")


@query("SELECT c_custkey AS doc_id, 'page' AS class FROM customer WHERE c_custkey % 3 = 0")
def pdf_certified_changes(spark, sf):
    """Changes that a certification of level three doesn't allow."""
    found = sections(revised(spark, sf), "objects", KEY).withColumnRenamed(KEY, "doc_id")
    certified = found.select("doc_id").distinct().select("doc_id", F.lit(0).alias("rev"), F.lit(3).alias("permission"))
    return audit.certification_violations(audit.diff_revisions(found), certified).select("doc_id", "class")


@query("SELECT c_custkey, 'a' AS before, c_mktsegment AS after FROM customer")
def pdf_revision_text(spark, sf):
    """A field's value as of the first revision, from the file's beginning alone, and as of the last."""
    files = revised(spark, sf)
    ends = sections(files, "revisions", KEY).filter("rev = 0").select(F.col(KEY).alias("k"), "end_offset")
    cut = files.join(ends, F.col(KEY) == F.col("k")).select(KEY, F.expr("substring(content, 1, int(end_offset))").alias("content"))
    old = sections(cut, "fields", KEY).select(KEY, F.col("value").alias("before"))
    new = sections(files, "fields", KEY).select(F.col(KEY).alias("k"), F.col("value").alias("after"))
    return old.join(new, F.col(KEY) == F.col("k")).drop("k")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'INTACT' WHEN 1 THEN 'DIGEST_MISMATCH' ELSE 'BAD_SIGNATURE' END AS verdict,
c_custkey % 3 <> 1 AS digest_ok, c_custkey % 3 <> 2 AS signature_ok FROM customer""")
def pdf_signature_check(spark, sf):
    """Signed files: intact, changed later, or with a signature that doesn't fit."""
    return sections(customer_files(spark, sf, samples.signed, "c_name", KEY), "signatures", KEY).select(KEY, "verdict", "digest_ok", "signature_ok")


@query("""SELECT c_custkey, '{"sub_filter":"adbe.pkcs7.detached","verdict":"' || CASE c_custkey % 3 WHEN 0 THEN 'INTACT' WHEN 1 THEN 'DIGEST_MISMATCH' ELSE 'BAD_SIGNATURE' END || '","covers":true}' AS report FROM customer""")
def pdf_signature_report(spark, sf):
    """Each signature as JSON, with whether it covers the file to its end."""
    parsed = parse(customer_files(spark, sf, samples.signed, "c_name", KEY), ("signatures", "revisions"), KEY)
    s = F.col("signatures")[0]
    end = F.array_max(F.transform("revisions", lambda r: r["end_offset"]))
    return parsed.select(KEY, F.to_json(F.struct(s["sub_filter"].alias("sub_filter"), s["verdict"].alias("verdict"), (s["coverage_end"] >= end).alias("covers"))).alias("report"))


@query("""WITH f AS (SELECT c_custkey, c_custkey % 3 + 1 AS part, c_custkey % 2 = 1 AS intent, (c_custkey % 4) / 4.0 AS ca FROM customer)
SELECT c_custkey AS doc_id, 'no_output_intent' AS rule FROM f WHERE NOT intent UNION ALL SELECT c_custkey, 'transparency' FROM f WHERE part <= 1 AND ca < 1""")
def pdf_conformance(spark, sf):
    """Archival rules on flags that are read from the files."""
    return audit.archival_violations(sections(rich(spark, sf), "conformance", KEY).withColumnRenamed(KEY, "doc_id")).select("doc_id", "rule")


# --- files made of files ------------------------------------------------------------------------------


@query("SELECT c_custkey, CAST(unnest([0, 1, 2, 3]) AS INT) AS page_no, unnest([c_name, c_mktsegment, c_name || c_mktsegment, c_name]) AS text FROM customer")
def pdf_merge(spark, sf):
    """Two files made into one, pages with all that they need."""
    make = lambda name, segment: writer.merge([samples.three_pages(name, segment), writer.build([name])])
    return sections(customer_files(spark, sf, make, "c_name", "c_mktsegment"), "pages", KEY).select(KEY, "page_no", "text")


@query("SELECT c_custkey, CAST(unnest([0, 0, 1]) AS INT) AS part, CAST(unnest([0, 1, 0]) AS INT) AS page_no, unnest([c_name, c_mktsegment, c_name || c_mktsegment]) AS text FROM customer")
def pdf_split(spark, sf):
    """Files cut into files of two pages."""
    made = to_pdfs(read(spark, sf, "customer").select(KEY, "c_name", "c_mktsegment"), KEY, lambda name, segment: writer.split(samples.three_pages(name, segment), 2))
    files = made.select(F.struct(KEY, "part").alias("k"), "content")
    return sections(files, "pages", "k").select(f"k.{KEY}", "k.part", "page_no", "text")


@query("""SELECT c_custkey, unnest(['t', 'r', 'b', 'c']) AS full_name, unnest([CASE WHEN strlen(c_mktsegment) <= 9 THEN c_mktsegment ELSE 'old' END, 'old', CASE c_custkey % 2 WHEN 1 THEN 'Yes' ELSE 'Off' END,
CASE c_custkey % 4 WHEN 0 THEN 'one' WHEN 1 THEN 'two' ELSE 'old' END]) AS value FROM customer""")
def pdf_fill_form(spark, sf):
    """New values written into files, and read back: refused ones leave what was there."""
    listed = [
        {"type": "Tx", "name": "t", "value": "old", "max_length": 9}, {"type": "Tx", "name": "r", "value": "old", "flags": 1},
        {"type": "Btn", "name": "b"}, {"type": "Ch", "name": "c", "value": "old", "options": ["one", "two"]},
    ]

    def made(segment, n):
        return writer.fill(writer.build(["x"], fields=listed), {"t": segment, "r": segment, "b": n % 2 == 1, "c": n % 4})[0]

    found = sections(customer_files(spark, sf, made, "c_mktsegment", KEY), "fields", KEY)
    return found.select(KEY, "full_name", "value")


@query("""SELECT c_nationkey AS doc_id, c_name AS full_name, CASE WHEN c_custkey % 2 = 1 THEN 'old' WHEN c_custkey % 3 = 0 THEN c_mktsegment || ' (new)\\' ELSE 'old' END AS value FROM customer""")
def fdf_import(spark, sf):
    """Values of FDF texts applied to fields; read-only ones keep theirs."""
    c = read(spark, sf, "customer")
    fields = c.select(F.col("c_nationkey").alias("doc_id"), F.col("c_name").alias("full_name"), (F.col(KEY) % 2).cast("int").alias("flags"), F.lit("old").alias("value"))
    given = c.filter("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("doc_id"), F.col("c_name").alias("full_name"), F.lit(0).alias("flags"), F.concat("c_mktsegment", F.lit(" (new)\\")).alias("value"))
    return forms.apply_fdf(fields, forms.read_fdf(audit.fdf(given))).select("doc_id", "full_name", "value")


@query("SELECT c_custkey AS doc_id, c_mktsegment AS value FROM customer")
def pdf_field_by_name(spark, sf):
    """The first field of a name in each file."""
    make = lambda segment, name: writer.build(["x"], fields=[{"type": "Tx", "name": "a", "value": name}, {"type": "Tx", "name": "b", "value": segment}, {"type": "Tx", "name": "b", "value": name}])
    found = sections(customer_files(spark, sf, make, "c_mktsegment", "c_name"), "fields", KEY)
    ordered = found.withColumn("ord", F.monotonically_increasing_id()).withColumnRenamed(KEY, "doc_id")
    return forms.find(ordered, "b").select("doc_id", "value")


@query("""SELECT c_custkey, CAST(1 AS INT) AS page_no, 'Text' AS type,
'q' || chr(10) || '1 1 0.6 rg' || chr(10) || '0 0 20.00 20.00 re' || chr(10) || 'f' || chr(10) || 'BT' || chr(10) || '/Helv 10 Tf' || chr(10) || '0 g' || chr(10) || '2 8.00 Td' || chr(10) || '(' || c_name || ') Tj' || chr(10) || 'ET' || chr(10) || 'Q' || chr(10) AS stream FROM customer""")
def pdf_annotation_appearance(spark, sf):
    """The content stream that shows each note."""
    make = lambda name: writer.build(["x", "y"], notes=[(1, name)])
    found = sections(customer_files(spark, sf, make, "c_name"), "annotations", KEY)
    return found.select(KEY, "page_no", "type", values.appearance(F.col("type"), F.col("contents"), F.col("rect")).alias("stream"))


@query("SELECT c_custkey, c_name AS first, c_name || c_mktsegment AS last FROM customer")
def pdf_one_parse(spark, sf):
    """Two sections of one parse, without reading a file twice."""
    parsed = parse(customer_files(spark, sf, samples.three_pages, "c_name", "c_mktsegment"), ("pages", "labels"), KEY)
    found = rows(parsed, "pages", KEY)
    return found.groupBy(KEY).agg(F.min_by("text", "page_no").alias("first"), F.max_by("text", "page_no").alias("last"))


@query("SELECT c_custkey, c_name AS text FROM customer")
def pdf_base64_source(spark, sf):
    """Files that come as base64 without its padding."""
    files = customer_files(spark, sf, samples.moved, "c_name", "1", "2")
    coded = files.select(KEY, F.regexp_replace(F.base64("content"), "=+$", "").alias("base64"))
    return sections(from_base64(coded, KEY), "pages", KEY).select(KEY, "text")


@query("SELECT c_custkey, CAST(unnest([0, 1, 2]) AS INT) AS page_no, unnest([c_name, c_mktsegment, c_name || c_mktsegment]) AS text FROM customer")
def pdf_sql_function(spark, sf):
    """The table function of a section, in SQL."""
    register(spark)
    files = customer_files(spark, sf, samples.three_pages, "c_name", "c_mktsegment")
    return spark.sql("SELECT f.c_custkey, p.page_no, p.text FROM {f} f, LATERAL pdf_pages(f.content) p", f=files)


@query("SELECT c_custkey, CAST(unnest([0, 2]) AS INT) AS page_no, c_name AS text, unnest(['1 of 3 ' || c_mktsegment, '3 of 3 ' || c_mktsegment]) AS stamped FROM customer")
def pdf_stamps(spark, sf):
    """A running foot on every page but the second."""
    make = lambda name, segment: writer.stamp(writer.build([name] * 3), [(40, 20, 9, "{page} of {pages} " + segment)], (1,))
    found = sections(customer_files(spark, sf, make, "c_name", "c_mktsegment"), "pages", KEY).filter("page_no <> 1")
    parts = F.split("text", "\n")
    return found.select(KEY, "page_no", parts[0].alias("text"), parts[1].alias("stamped"))


@query("""SELECT c_custkey, '[' || string_agg('{"ch":"' || substring(c_name, CAST(i AS INT) + 1, 1) || '","x":' || (10 + 7 * i) || '.0}', ',' ORDER BY i) || ']' AS layout FROM (SELECT *, unnest(range(0, length(c_name))) AS i FROM customer) GROUP BY c_custkey""")
def pdf_layout_json(spark, sf):
    """Characters with their places as JSON."""
    found = sections(customer_files(spark, sf, samples.moved, "c_name", "0", "0"), "chars", KEY)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("ord", "ch", F.round("x", 6).alias("x")))), lambda r: F.struct(r["ch"].alias("ch"), r["x"].alias("x")))
    return found.groupBy(KEY).agg(F.to_json(listed).alias("layout"))


@query("""SELECT c_custkey, CAST(unnest([0, 2]) AS INT) AS page_no, CAST(8 AS INT) AS start FROM customer""")
def pdf_search_pages(spark, sf):
    """The first hit of a sign on each page of a range of pages."""
    from ..operators import search

    found = sections(customer_files(spark, sf, samples.three_pages, "c_name", "c_mktsegment"), "pages", KEY)
    keyed = found.filter(F.col("page_no").between(0, 2)).select(F.struct(KEY, "page_no").alias("doc_id"), "text")
    hits = search.limit_per_document(search.hits(keyed, "#"), 1)
    return hits.select(f"doc_id.{KEY}", "doc_id.page_no", "start")


@query("SELECT c_custkey, 'a(b)A(c)' || chr(10) || chr(10) || chr(10) || c_name || 'ä' AS text, false AS repaired FROM customer")
def pdf_by_hand(spark, sf):
    """Files that the engine's writer has no part in: object streams, odd spacing, nested and escaped strings."""
    both = parse(customer_files(spark, sf, samples.by_hand, "c_name"), ("pages", "documents"), KEY)
    return both.select(KEY, F.col("pages")[0]["text"].alias("text"), F.col("documents")[0]["repaired"].alias("repaired"))


@query("""SELECT c_custkey, unnest(['group.first', 'group.inner.second', 'group.third', 'button']) AS full_name, unnest(['Tx', 'Ch', 'Tx', 'Btn']) AS type, CAST(unnest([2, 2, 2, 0]) AS INT) AS flags,
unnest([c_name, c_mktsegment, 'above', 'Yes']) AS value, CAST(unnest([0, 2, 0, 0]) AS INT) AS n_options FROM customer""")
def pdf_nested_fields(spark, sf):
    """Dotted names, and what fields take over from those above."""
    found = sections(customer_files(spark, sf, samples.nested_fields, "c_name", "c_mktsegment"), "fields", KEY)
    return found.select(KEY, "full_name", "type", "flags", "value", F.size("options").alias("n_options"))


@query("SELECT c_custkey, replace(replace(replace(translate(c_mktsegment || '#012', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ#', 'ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡ' || chr(930) || 'ΣΤΥΦΧΨΩΪ–'), '0', 'x'), '1', 'ff'), '2', '🙂') AS text FROM customer")
def pdf_tounicode(spark, sf):
    """Codes by a font's own map: ranges, lists and single codes."""
    files = customer_files(spark, sf, samples.mapped, "concat(c_mktsegment, '#012')")
    return sections(files, "pages", KEY).select(KEY, "text")


@query("SELECT c_custkey, 'built' AS text, 10.0::DOUBLE AS x, 30.0 + c_custkey % 5 AS width, 40.0::DOUBLE AS height FROM customer")
def pdf_page_builder(spark, sf):
    """Pages written operator by operator, with an image and a word read back."""
    parsed = parse(customer_files(spark, sf, samples.drawn, "int(c_custkey % 5)"), ("pages", "placements"), KEY)
    at = F.col("placements")[0]
    return parsed.select(KEY, F.col("pages")[0]["text"].alias("text"), at["x"].alias("x"), at["width"].alias("width"), at["height"].alias("height"))


@query("""SELECT c_custkey, unnest([c_name, c_mktsegment, 'web']) AS title, CAST(unnest([0, 0, NULL]) AS INT) AS page_no, unnest([NULL, NULL, 'http://x.example/' || c_mktsegment]) AS uri FROM customer""")
def pdf_bookmarks(spark, sf):
    """Where bookmarks lead: to a page, by a name, to an address."""
    return sections(customer_files(spark, sf, samples.book, "c_name", "c_mktsegment"), "outline", KEY).select(KEY, "title", "page_no", "uri")


@query(LINES_SQL + """, b AS (SELECT doc_id, line_index, text, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l)
SELECT doc_id, CAST(line_index AS BIGINT) AS line_index, substring(text, CAST(i AS INT) + 1, 1) AS ch, CAST(s + i AS BIGINT) AS byte_start FROM (SELECT *, unnest(range(0, length(text))) AS i FROM b)""")
def pdf_char_index(spark, sf):
    """Each character's byte offset in the text that the layout gives."""
    return layout.char_index(scattered(spark, sf)).select("doc_id", "line_index", "ch", "byte_start")


def documents(spark, sf) -> Documents:
    return Documents(customer_files(spark, sf, samples.three_pages, "c_name", "c_mktsegment"), KEY)


@query("""SELECT c_custkey AS doc_id, CAST(3 AS INT) AS n_pages, CAST(90.0 AS DOUBLE) AS rotate, c_name || chr(10) || chr(10) || '--- Page 1 ---' || chr(10) || chr(10) || c_mktsegment AS text, CAST(4 AS BIGINT) AS n_fonts FROM customer""")
def tools_overview(spark, sf):
    """Page count, page information, text of a range and fonts by the methods of one object."""
    return documents(spark, sf).overview(0, 1).select("doc_id", "n_pages", "rotate", "text", "n_fonts")


@query("""SELECT c_custkey AS doc_id, CAST(unnest([0, 2]) AS INT) AS page_no, CAST(0 AS INT) AS start FROM customer""")
def tools_search(spark, sf):
    """Whatever the case, the first two hits of each document."""
    return documents(spark, sf).search_text("CUSTOMER", 0, 2, most=2).select("doc_id", "page_no", "start")


@query("""SELECT c_custkey AS doc_id, CAST(0 AS INT) AS page_no, CAST(strpos(c_name, '00') - 1 + i AS INT) AS start FROM (SELECT *, unnest(range(0, 20)) AS i FROM customer) WHERE substring(c_name, strpos(c_name, '00') + CAST(i AS INT), 2) = '00'""")
def tools_find(spark, sf):
    """Overlapping hits on the first page."""
    return documents(spark, sf).find_text("00", 0).select("doc_id", "page_no", "start")


@query("""SELECT c_custkey AS doc_id, substring(c_name, 1, 3) AS text, 'Link' AS type FROM customer""")
def tools_region(spark, sf):
    """Text of a region by glyph centres, and annotations that touch one."""
    d = Documents(customer_files(spark, sf, lambda name: samples.one_page(b"BT /F1 10 Tf 100 100 Td %s Tj ET" % samples.literal(name), {"Font": {"F1": samples.simple_font()}}, {"Annots": [{"Type": samples.N("Annot"), "Subtype": samples.N(k), "Rect": [x, 0, x + 9, 9]} for k, x in (("Link", 5), ("Text", 300))]}), "c_name"), KEY)
    marks = d.annotations(region=(0, 0, 100, 100)).select("doc_id", "type")
    return d.query_region(99, 95, 118, 115).select("doc_id", "text").join(marks, "doc_id")


@query("""SELECT c_custkey AS doc_id, unnest(['t', 'b', 'c', 'm']) AS full_name, unnest([CASE WHEN strlen(c_mktsegment) <= 9 THEN c_mktsegment ELSE 'old' END, CASE WHEN c_custkey % 2 = 1 THEN 'Yes' ELSE 'Off' END,
'old', 'x' || chr(10) || 'y']) AS value, unnest([CASE WHEN strlen(c_mktsegment) > 9 THEN 'too long' END, NULL, 'one option only', NULL]) AS refused FROM customer""")
def form_setters(spark, sf):
    """New values for fields as rows: refused ones leave what was there."""
    kinds = F.array(*[F.struct(F.lit(n).alias("full_name"), F.lit(k).alias("type"), F.lit(f).alias("flags")) for n, k, f in (("t", "Tx", 0), ("b", "Btn", 0), ("c", "Ch", 0), ("m", "Ch", forms.MULTI_SELECT))])
    c = read(spark, sf, "customer").select(F.col(KEY).alias("doc_id"), "c_mktsegment", F.explode(kinds).alias("k"))
    fields = c.select("doc_id", "k.*", F.lit(9).alias("max_length"), F.array(F.lit("x"), F.lit("y")).alias("options"), F.lit("old").alias("value"), "c_mktsegment")
    done = forms.set_values(fields, F.col("c_mktsegment"), F.col("doc_id") % 2 == 1, F.array(F.lit(0), F.lit(1)))
    return done.select("doc_id", "full_name", "value", "refused")
