"""Queries over functions of values, filters on bytes from elsewhere, and page sets, each beside SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from ..functions import colour, values
from ..operators import pages, search, tables
from ..pdf import ccitt_many, filters
from ..pdf.ccitt_many import spans
from ..pdf.functions import evaluate
from ..sources.writing import spread
from . import samples
from .catalog import CELLS_SQL, CHARS_SQL, line_items, order_cells, query, read

# --- values ---------------------------------------------------------------------------------------


@query("SELECT event_id, coalesce(TRY_CAST(trim(CASE event_id % 3 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN ' 12.5 ' ELSE 'x' || event_id END) AS DOUBLE), 0) AS v FROM events")
def number_parse(spark, sf):
    text = F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string")).when(F.col("event_id") % 3 == 1, " 12.5 ").otherwise(F.concat(F.lit("x"), "event_id"))
    return read(spark, sf, "events").select("event_id", values.number(text).alias("v"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d 10:20:30 UTC') END AS t FROM orders""")
def asn1_time(spark, sf):
    """Times with two-digit and four-digit years, and what isn't a time."""
    day = F.date_format("o_orderdate", "yyyyMMdd")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.substring(day, 3, 6), F.lit("102030Z"))).when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.lit("102030Z"))).otherwise("soon")
    return read(spark, sf, "orders").select("o_orderkey", values.asn1_time(text).alias("t"))


FONTS_SQL = "WITH f AS (SELECT p_partkey, (['Courier', 'Times-Roman', 'ArialMT', 'ABCDEF+Times New Roman', 'Verdana'])[p_partkey % 5 + 1] AS name FROM part)\n"


def font_names(spark, sf):
    listed = F.array(*[F.lit(x) for x in ("Courier", "Times-Roman", "ArialMT", "ABCDEF+Times New Roman", "Verdana")])
    return read(spark, sf, "part").select("p_partkey", F.get(listed, (F.col("p_partkey") % 5).cast("int")).alias("name"))


@query(FONTS_SQL + "SELECT p_partkey, name IN ('Courier', 'Times-Roman') AS standard FROM f")
def standard_fonts(spark, sf):
    return font_names(spark, sf).select("p_partkey", values.is_standard_14(F.col("name")).alias("standard"))


@query(FONTS_SQL + "SELECT p_partkey, CASE name WHEN 'Courier' THEN 'mono' WHEN 'Times-Roman' THEN 'serif' WHEN 'ABCDEF+Times New Roman' THEN 'serif' WHEN 'ArialMT' THEN 'arial' ELSE 'sans-serif' END AS stand_in FROM f")
def font_substitution(spark, sf):
    """By the whole name, else by an entry that the name contains, else the last resort."""
    known = [("Courier", "mono"), ("Times", "serif"), ("Arial", "arial")]
    return font_names(spark, sf).select("p_partkey", values.substitute(F.col("name"), known).alias("stand_in"))


@query("""SELECT p_brand, p_partkey, p_size FROM (SELECT p_brand, p_partkey, p_size * 20 AS p_size FROM part)
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_size - 600), -p_size, p_partkey) = 1""")
def best_font_match(spark, sf):
    """The nearest weight to 600 in each family; of two equally near, the bolder."""
    p = read(spark, sf, "part").select("p_brand", "p_partkey", (F.col("p_size") * 20).alias("p_size"))
    near = F.struct(values.weight_distance(F.col("p_size"), 600), "p_partkey")
    return p.groupBy("p_brand").agg(F.min_by(F.struct("p_partkey", "p_size"), near).alias("b")).select("p_brand", "b.*")


@query(r"""SELECT doc_id, '"' || replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"' AS scalar FROM documents""")
def yaml_escape(spark, sf):
    return read(spark, sf, "documents").select("doc_id", values.yaml_escape(F.col("text")).alias("scalar"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, json_valid(props) AS valid FROM events")
def json_values(spark, sf):
    """A value of each event's JSON, and whether it is JSON."""
    e = read(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query()
def hmac_digests(spark, sf):
    """Tested against Python's."""
    t = F.coalesce("text", F.lit("")).cast("binary")
    return read(spark, sf, "documents").select("doc_id", values.hmac_sha256(F.concat("lang", "source").cast("binary"), t).alias("mac"))


@query()
def hash_sha512(spark, sf):
    """Tested against Python's."""
    t = F.coalesce("text", F.lit("")).cast("binary")
    return read(spark, sf, "documents").select("doc_id", F.sha2(t, 384).alias("sha384"), F.sha2(t, 512).alias("sha512"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents")
def base64_lenient(spark, sf):
    """Base64 with spaces and without its padding, decoded again."""
    loose = F.concat(F.lit(" "), F.rtrim(F.regexp_replace(F.base64(F.coalesce("text", F.lit("")).cast("binary")), "=", " ")), F.lit("\n"))
    return read(spark, sf, "documents").select("doc_id", F.md5(values.from_base64(loose)).alias("md5"))


MATRIX_SQL = "WITH m AS (SELECT l_orderkey, l_linenumber, cos(radians(l_quantity)) AS a, sin(radians(l_quantity)) AS b, l_extendedprice AS e, l_discount AS f FROM lineitem)\n"


@query(MATRIX_SQL + "SELECT l_orderkey, l_linenumber, round(degrees(atan2(b, a)), 6) AS angle, round(2 * e + 5, 4) AS x, round(3 * f + 7, 6) AS y, round(sqrt(4 * a * a + 9 * b * b), 6) AS size FROM m")
def affine_placement(spark, sf):
    """Angle, origin and size of a rotated unit square after a scaling and a shift."""
    li = line_items(spark, sf)
    a, b = F.cos(F.radians("l_quantity")), F.sin(F.radians("l_quantity"))
    inner = F.array(a, b, -b, a, F.col("l_extendedprice"), F.col("l_discount"))
    m = values.concat_matrix(inner, F.array(*[F.lit(float(x)) for x in (2, 0, 0, 3, 5, 7)]))
    found = li.select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"), m.alias("m"))
    size = F.sqrt(F.col("m")[0] * F.col("m")[0] + F.col("m")[1] * F.col("m")[1])
    return found.select(
        "l_orderkey", "l_linenumber", F.round(values.rotation(F.col("a"), F.col("b")), 6).alias("angle"), F.round(F.col("m")[4], 4).alias("x"),
        F.round(F.col("m")[5], 6).alias("y"), F.round(size, 6).alias("size"),
    )


@query("SELECT l_orderkey, l_linenumber, CASE l_linestatus WHEN 'O' THEN 'vertical' ELSE 'horizontal' END AS mode FROM lineitem")
def writing_mode(spark, sf):
    mode = F.when(F.col("l_linestatus") == "O", 1).otherwise(0)
    return line_items(spark, sf).select("l_orderkey", "l_linenumber", values.writing_mode(mode).alias("mode"))


UNIT_SQL = "WITH u AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS a, l_tax * 12 AS b, l_quantity / 50 AS c FROM lineitem)\n"


def units(spark, sf):
    return line_items(spark, sf).select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("a"), (F.col("l_tax") * 12).alias("b"), (F.col("l_quantity") / 50).alias("c"))


@query(UNIT_SQL + "SELECT l_orderkey, l_linenumber, round(least(greatest(0.5 * pow(least(a, 1), 2.2) + 0.25 * pow(least(b, 1), 2.2), 0), 1), 6) AS r, round(pow(least(c, 1), 1.8), 6) AS g FROM u")
def calibrated_colours(spark, sf):
    """CalRGB through gamma and matrix, and CalGray."""
    rgb = colour.calibrated_rgb(F.col("a"), F.col("b"), F.col("c"), (2.2, 2.2, 1.8), (0.5, 0.25, 0, 0, 1, 0, 0, 0, 1))
    return units(spark, sf).select("l_orderkey", "l_linenumber", F.round(rgb[0], 6).alias("r"), F.round(colour.calibrated_gray(F.col("c"), 1.8)[0], 6).alias("g"))


@query(UNIT_SQL + """SELECT l_orderkey, l_linenumber, round(0.9505 * CASE WHEN (100 * a + 16) / 116 + (50 * b) / 500 > 6.0 / 29 THEN pow((100 * a + 16) / 116 + (50 * b) / 500, 3)
ELSE 3 * (6.0 / 29) * (6.0 / 29) * ((100 * a + 16) / 116 + (50 * b) / 500 - 4.0 / 29) END, 6) AS x FROM u""")
def lab_colours(spark, sf):
    xyz = colour.lab_to_xyz(F.col("a") * 100, F.col("b") * 50, F.col("c") * 50)
    return units(spark, sf).select("l_orderkey", "l_linenumber", F.round(xyz[0], 6).alias("x"))


@query(UNIT_SQL + "SELECT l_orderkey, l_linenumber, round(0.4124 * a + 0.3576 * b + 0.1805 * c, 6) AS x, round(0.2126 * a + 0.7152 * b + 0.0722 * c, 6) AS y FROM u")
def rgb_matrices(spark, sf):
    matrix = (0.4124, 0.3576, 0.1805, 0.2126, 0.7152, 0.0722, 0.0193, 0.1192, 0.9505)
    xyz = values.rgb_to_xyz(F.array("a", "b", "c"), matrix)
    return units(spark, sf).select("l_orderkey", "l_linenumber", F.round(xyz[0], 6).alias("x"), F.round(xyz[1], 6).alias("y"))


@query("SELECT s_suppkey, CAST(500 + s_suppkey AS BIGINT) AS size, '4.3' AS version, 'mntr' AS device_class, CASE s_suppkey % 2 WHEN 0 THEN 'RGB' ELSE 'CMYK' END AS space, 'Lab' AS connection FROM supplier WHERE s_suppkey % 3 <> 2")
def icc_profiles(spark, sf):
    """Headers of profiles; what isn't a profile has none."""
    space = F.when(F.col("s_suppkey") % 2 == 0, "RGB ").otherwise("CMYK")
    mark = F.when(F.col("s_suppkey") % 3 == 2, "none").otherwise("acsp")
    hexed = F.concat(
        F.lpad(F.hex(500 + F.col("s_suppkey")), 8, "0"), F.lit("00000000" + "04300000" + b"mntr".hex()), F.hex(space.cast("binary")), F.lit(b"Lab ".hex() + "00" * 12),
        F.hex(mark.cast("binary")), F.lit("00" * 100),
    )
    found = read(spark, sf, "supplier").select("s_suppkey", values.icc_header(F.unhex(hexed)).alias("h"))
    return found.filter("h is not null").select("s_suppkey", "h.*")


@query("""SELECT p_partkey, round(1 + 4 * pow(least(x, 1), 2), 6) AS exponential, round(CASE WHEN x < 0.5 THEN 2 * x ELSE 1 - pow(2 * least(x, 1) - 1, 2) END, 6) AS stitched,
round(CASE WHEN x > 0.5 THEN 1 - least(x, 1) ELSE 2 * x END, 6) AS calculated, round(least(x, 1) * 3, 6) AS sampled FROM (SELECT p_partkey, p_size / 40.0 AS x FROM part)""")
def pdf_functions(spark, sf):
    """A function of each kind at one point for each part."""

    def run(batches):
        import pyarrow as pa

        doc = samples.function_host()
        made = samples.functions()
        for batch in batches:
            found = [[evaluate(doc, f, [x])[0] for x in batch.column(1).to_pylist()] for f in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(f, pa.float64()) for f in found]], names=["p_partkey", "exponential", "stitched", "calculated", "sampled"])

    p = read(spark, sf, "part").select("p_partkey", (F.col("p_size") / 40.0).alias("x"))
    names = ("exponential", "stitched", "calculated", "sampled")
    found = p.mapInArrow(run, "p_partkey long, " + ", ".join(f"{n} double" for n in names))
    return found.select("p_partkey", *[F.round(n, 6).alias(n) for n in names])


# --- filters --------------------------------------------------------------------------------------

# Known answers: bytes in hex, filters in order, and what they say.
VECTORS = (
    ("800b6050220c0c8501", ("LZWDecode",), "-----A---B"),
    ("3c7e383763555244" + b"]i,\"Ebo80~>".hex(), ("ASCII85Decode",), "Hello World!"),
    ("02414243fe448001", ("RunLengthDecode",), "ABCDDD"),
    ("789ccb48cdc9c95728cf2fca490100" + "1a0b045d", ("FlateDecode",), "hello world"),
    (b"78 9C CB 48 CD C9 C9 57 28 CF 2F CA 49 01 00 1A 0B 04 5D>".hex(), ("AHx", "Fl"), "hello world"),
    (b"02414243FE448001>".hex(), ("ASCIIHexDecode", "RunLengthDecode"), "ABCDDD"),
)


@query("SELECT n_nationkey, (['-----A---B', 'Hello World!', 'ABCDDD', 'hello world', 'hello world', 'ABCDDD'])[n_nationkey % 6 + 1] AS said FROM nation")
def filter_vectors(spark, sf):
    """Bytes that other encoders made, single filters and chains."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for n in batch.column(0).to_pylist():
                raw, names, _ = VECTORS[n % len(VECTORS)]
                found.append(filters.decode(bytes.fromhex(raw), list(names), []).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["n_nationkey", "said"])

    return read(spark, sf, "nation").select("n_nationkey").mapInArrow(run, "n_nationkey int, said string")


#: Texts go through a filter up to so many bytes at once.
AT_ONCE = 4 << 20


def _digests(spark, sf, back):
    """md5 of each text after ``back``, which takes a list of them."""

    def run(batches):
        import hashlib

        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            found = []
            for a, b in spans(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), AT_ONCE):
                texts = [(t or "").encode() for t in batch.column(1)[a:b].to_pylist()]
                found += [hashlib.md5(data).hexdigest() for data in back(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "md5"])

    return spread(read(spark, sf, "documents").select("doc_id", "text")).mapInArrow(run, "doc_id long, md5 string")


MD5_SQL = "SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents"


@query(MD5_SQL)
def filter_predictors(spark, sf):
    """Rows of 24 bytes under the PNG predictors in turn, from an encoder of the query's own."""

    def back(data: bytes) -> bytes:
        packed = zlib.compress(samples.png_rows(data, 24, 3))
        return filters.decode(packed, ["FlateDecode"], [{"Predictor": 15, "Columns": 8, "Colors": 3}])[: len(data)]

    return _digests(spark, sf, lambda texts: [back(data) for data in texts])


@query(MD5_SQL)
def filter_tiff_predictor(spark, sf):
    """Horizontal differences of 16-bit samples of three colours."""

    def back(data: bytes) -> bytes:
        packed = zlib.compress(samples.tiff_rows(data, 4, 3))
        return filters.decode(packed, ["FlateDecode"], [{"Predictor": 2, "Columns": 4, "Colors": 3, "BitsPerComponent": 16}])[: len(data)]

    return _digests(spark, sf, lambda texts: [back(data) for data in texts])


def _fax(k: int):
    def run(spark, sf):
        def back(texts: list[bytes]) -> list[bytes]:
            width, rows = 64, [-(-len(data) // 8) for data in texts]
            coded = ccitt_many.encode_many([data.ljust(n * 8, b"\0") for data, n in zip(texts, rows, strict=True)], width, k)
            params = [[{"K": k, "Columns": width, "Rows": n, "BlackIs1": True}] for n in rows]
            found = filters.decode_many(coded, ["CCITTFaxDecode"], params)
            return [data[: len(text)] for data, text in zip(found, texts, strict=True)]

        return _digests(spark, sf, back)

    run.__name__ = {-1: "filter_fax_g4", 0: "filter_fax_g3", 4: "filter_fax_mixed"}[k]
    return query(MD5_SQL)(run)


for _k in (-1, 0, 4):
    _fax(_k)


# --- pages, tables and search -------------------------------------------------------------------------


def item_pages(spark, sf):
    li = line_items(spark, sf)
    return li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("page_no"), "l_partkey", F.lit(0).alias("rotate"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))


@query("SELECT l_orderkey AS doc_id, l_linenumber - 1 AS page_no, CAST(90 AS INT) AS rotate, 792.0::DOUBLE AS width, 612.0::DOUBLE AS height FROM lineitem")
def rotate_pages(spark, sf):
    return pages.rotate(item_pages(spark, sf), 450).select("doc_id", "page_no", "rotate", "width", "height")


@query("SELECT l_orderkey AS doc_id, l_linenumber - 1 AS page_no, 500.0::DOUBLE AS width, 692.0::DOUBLE AS height FROM lineitem")
def crop_pages(spark, sf):
    """Boxes cut to what lies on the page."""
    return pages.crop(item_pages(spark, sf), 50.0, 100.0, 550.0, 900.0).select("doc_id", "page_no", "width", "height")


@query("""SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber > 2 THEN l_linenumber - 2 ELSE 0 END AS page_no, l_partkey FROM lineitem WHERE l_linenumber <> 2""")
def remove_page(spark, sf):
    """Without the second page; those after it close up."""
    return pages.remove(item_pages(spark, sf), F.lit(1)).select("doc_id", "page_no", "l_partkey")


@query("""SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber >= 2 THEN l_linenumber ELSE 0 END AS page_no, l_partkey FROM lineitem
UNION ALL SELECT DISTINCT l_orderkey, 1, CAST(NULL AS BIGINT) FROM lineitem""")
def insert_page(spark, sf):
    """With an empty second page; those from there on make room."""
    p = item_pages(spark, sf)
    new = p.select("doc_id").distinct().select("doc_id", F.lit(1).alias("page_no"))
    return pages.insert(p, new).select("doc_id", "page_no", "l_partkey")


@query(CELLS_SQL + """, d AS (SELECT doc_id, row, a AS c0, c AS c2 FROM b)
SELECT doc_id, row, col, CASE col WHEN 0 THEN c0 WHEN 2 THEN c2 ELSE '' END AS text FROM d, (SELECT unnest([0, 1, 2]) AS col)""")
def table_dense(spark, sf):
    """Every cell of each table, empty ones too, where the second column is missing."""
    return tables.dense(order_cells(spark, sf).filter("col <> 1"), ("doc_id",)).select("doc_id", "row", "col", "text")


@query("SELECT doc_id, 1 AS row, 2 AS col, c AS text FROM (" + CELLS_SQL.strip() + " SELECT * FROM b) WHERE row = 1")
def table_cell(spark, sf):
    """One cell of each table; none where it is out of bounds."""
    return tables.cell(order_cells(spark, sf), 1, 2).select("doc_id", "row", "col", "text")


@query("""SELECT event_type, count(*) AS n, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation FROM events GROUP BY event_type""")
def timing_statistics(spark, sf):
    """Count, extremes, mean and population deviation by kind."""
    v = F.col("value")
    e = read(spark, sf, "events").groupBy("event_type")
    return e.agg(F.count(F.lit(1)).alias("n"), *[F.round(f(v), 6).alias(n) for f, n in ((F.min, "least"), (F.max, "most"), (F.avg, "mean"), (F.stddev_pop, "deviation"))])


@query(CHARS_SQL + ", h AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g WHERE gram = 'the') SELECT doc_id, CAST(i AS INT) AS start FROM h WHERE k <= 3")
def search_limited(spark, sf):
    """The first three hits of each document."""
    return search.limit_per_document(search.hits(read(spark, sf, "documents"), "the"), 3).select("doc_id", "start")


@query(CHARS_SQL + "SELECT gram AS trigram, doc_id, string_agg(i, ',' ORDER BY i) AS positions FROM g WHERE gram IS NOT NULL GROUP BY gram, doc_id")
def trigram_postings(spark, sf):
    """The inverted index itself: offsets by trigram and document."""
    found = search.trigram_index(spread(read(spark, sf, "documents").select("doc_id", "text")))
    return found.select("trigram", "doc_id", F.array_join("positions", ",").alias("positions"))


@query("""WITH k AS (SELECT l_orderkey AS doc_id, l_linenumber, l_returnflag AS name, l_linestatus AS value FROM lineitem)
SELECT doc_id, name, value FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY l_linenumber) = 1""")
def first_by_name(spark, sf):
    """Distinct names over a document; the first place that has one wins."""
    li = line_items(spark, sf).select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("value"))
    return li.groupBy("doc_id", "name").agg(F.min_by("value", "l_linenumber").alias("value"))


@query(MD5_SQL)
def aes_decryption(spark, sf):
    """Texts that Spark encrypts, read by the engine's own cipher: two implementations of one standard."""
    d = spread(read(spark, sf, "documents").select("doc_id", "text"))
    sealed = d.select("doc_id", F.aes_encrypt(F.coalesce("text", F.lit("")).cast("binary"), F.lit("0123456789abcdef"), F.lit("CBC"), F.lit("PKCS"), F.lit("iviviviviviviviv").cast("binary")).alias("c"))

    def run(batches):
        import hashlib

        import pyarrow as pa

        from ..pdf.crypt import Aes, unpad

        cipher = Aes(b"0123456789abcdef")
        for batch in batches:
            found = [hashlib.md5(unpad(cipher.cbc_decrypt(c[16:], c[:16]))).hexdigest() for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "md5"])

    return sealed.mapInArrow(run, "doc_id long, md5 string")


@query()
def derived_keys(spark, sf):
    """Keys by PBKDF2, tested against a known answer."""
    return read(spark, sf, "supplier").select("s_suppkey", F.lower(F.hex(values.pbkdf2_sha256(F.col("s_name").cast("binary"), F.lit("salt").cast("binary"), 10))).alias("key"))


@query("SELECT event_id, chr(CAST(33 + event_id % 5000 AS INT)) AS ch, strlen(chr(CAST(33 + event_id % 5000 AS INT))) AS n_bytes FROM events")
def codepoints(spark, sf):
    from ..functions.text import codepoint_to_utf8

    ch = codepoint_to_utf8(33 + F.col("event_id") % 5000)
    return read(spark, sf, "events").select("event_id", ch.alias("ch"), F.octet_length(ch).cast("long").alias("n_bytes"))


@query("""
WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, 700 - 10 * l_linenumber - CASE WHEN l_linenumber > 3 THEN 30 ELSE 0 END AS y, l_linenumber || '. ' || l_returnflag AS t FROM lineitem),
g AS (SELECT *, CASE WHEN lag(y) OVER w - y > 15 THEN chr(10) ELSE '' END || t AS m FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n))
SELECT doc_id, string_agg(m, chr(10) ORDER BY n) || chr(10) AS markdown FROM g GROUP BY doc_id""")
def markdown_page(spark, sf):
    """Numbered lines as lists, and a blank line at a wide gap."""
    from ..operators import layout

    n = F.col("l_linenumber")
    y = 700 - 10 * n - F.when(n > 3, 30).otherwise(0)
    lines = line_items(spark, sf).select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_no"), n.alias("reading_order"), y.cast("double").alias("y"), F.lit(10.0).alias("h"), F.lit(9.0).alias("font_size"),
        F.concat(n.cast("string"), F.lit(")  "), "l_returnflag").alias("text"),
    )
    return layout.markdown_page(layout.markdown_lines(lines, layout.body_size(lines))).drop("page_no")


@query("""SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL""")
def stream_windows(spark, sf):
    """Events as a stream, counted by hour and kind: the stream's whole result is that of a batch."""
    from ..streaming import ingest

    found = ingest.drained(ingest.counts_by_window(ingest.rows_arriving(spark, sf, "events.parquet"), "ts", "event_type", delay="100 days"))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def stream_sessions(spark, sf):
    """Sessions of each user, ended by six hours without events."""
    from ..streaming import ingest

    found = ingest.drained(ingest.tagged_sessions(ingest.rows_arriving(spark, sf, "events.parquet"), "user_id", "ts", "21599.999999 seconds", delay="100 days"))  # windows that touch are one session
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_latest(spark, sf):
    """Each user's newest event, kept as state of the engine's own while events arrive."""
    from ..streaming import ingest

    events = ingest.rows_arriving(spark, sf, "events.parquet").select("user_id", "event_id", "event_type", "ts")
    return ingest.drained(ingest.latest_by_state(events, "user_id", "ts", "event_id"), "update").select("user_id", "event_id", "event_type")
