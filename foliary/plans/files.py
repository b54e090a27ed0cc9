"""Queries that write PDF files from rows and read them back, each beside its SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from ..functions.text import count_overlapping
from ..pdf import filters
from ..pdf.writer import build, update
from ..sources.pdf import sections
from ..sources.writing import pages_of, spread, to_pdf
from .catalog import query, read

PAGES_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
p AS (SELECT doc_id, CAST(i // 40 AS INT) AS page_no, string_agg(t, chr(10) ORDER BY i) AS text FROM l GROUP BY ALL)
"""


def document_files(spark, sf, make=lambda text: build(pages_of(text))):
    return to_pdf(read(spark, sf, "documents").select("doc_id", "text"), "doc_id", make)


@query(PAGES_SQL + "SELECT doc_id, page_no, md5(text) AS md5, length(text) AS n_chars FROM p")
def pdf_roundtrip_text(spark, sf):
    """Every text as a file, and each page's text read back from it."""
    found = sections(document_files(spark, sf), "pages", "doc_id")
    return found.select("doc_id", "page_no", F.md5(F.col("text").cast("binary")).alias("md5"), F.length("text").cast("long").alias("n_chars"))


@query(PAGES_SQL + "SELECT doc_id, CAST(count(*) AS INT) AS n_pages FROM p GROUP BY doc_id")
def pdf_page_count(spark, sf):
    return sections(document_files(spark, sf), "documents", "doc_id").select("doc_id", "n_pages")


@query(PAGES_SQL + ", h AS (SELECT doc_id, page_no, len(string_split(text, 'the')) - 1 AS n_hits FROM p) SELECT * FROM h WHERE n_hits > 0")
def pdf_search(spark, sf):
    """Occurrences on each page of files that were written and parsed."""
    found = sections(document_files(spark, sf), "pages", "doc_id").select("doc_id", "page_no", count_overlapping(F.col("text"), "the").cast("long").alias("n_hits"))
    return found.filter("n_hits > 0")


@query("SELECT doc_id, lang || ' ' || source AS title, 'n' || n_chars AS subject FROM documents")
def pdf_info(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    files = to_pdf(rows, "doc_id", lambda lang, source, n: build([""], info={"Title": f"{lang} {source}", "Subject": f"n{n}"}))
    return sections(files, "documents", "doc_id").select("doc_id", F.col("info")["Title"].alias("title"), F.col("info")["Subject"].alias("subject"))


@query(PAGES_SQL + "SELECT doc_id, page_no, md5(text) AS md5, true AS repaired FROM p")
def pdf_repair(spark, sf):
    """Files whose cross-reference is gone: read through the repair scan."""

    def broken(text):
        data = build(pages_of(text))
        return data[: data.rfind(b"xref\n0 ")] + b"trailer\n" + data[data.rfind(b"<< /Size") :].replace(b"startxref", b"startxxxx")

    files = document_files(spark, sf, broken)
    repaired = sections(files, "documents", "doc_id").select(F.col("doc_id").alias("d"), "repaired")
    found = sections(files, "pages", "doc_id").select("doc_id", "page_no", F.md5(F.col("text").cast("binary")).alias("md5"))
    return found.join(repaired, F.col("doc_id") == F.col("d")).drop("d")


@query("SELECT doc_id, CAST(0 AS INT) AS page_no, 'Text' AS type, lang || '/é€' AS contents FROM documents")
def pdf_annotations(spark, sf):
    files = to_pdf(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id", lambda lang: build(["x"], notes=[(0, f"{lang}/é€")]))
    return sections(files, "annotations", "doc_id").select("doc_id", "page_no", "type", "contents")


@query("SELECT doc_id, source || '.txt' AS name, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS md5 FROM documents WHERE text IS NOT NULL")
def pdf_attachments(spark, sf):
    rows = read(spark, sf, "documents").filter("text is not null").select("doc_id", "source", "text")
    files = to_pdf(rows, "doc_id", lambda source, text: build(["x"], attachments={f"{source}.txt": text.encode()}))
    return sections(files, "attachments", "doc_id").select("doc_id", "name", "size", "md5")


@query("""SELECT n_nationkey, r_name AS title, 0 AS depth FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT n_nationkey, n_name, 1 FROM nation UNION ALL SELECT n_nationkey, 'Index', 0 FROM nation""")
def pdf_outline(spark, sf):
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    rows = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name", "n_name")
    files = to_pdf(rows, "n_nationkey", lambda region, nation: build(["x"], outline=[(region, [(nation, [])]), ("Index", [])]))
    return sections(files, "outline", "n_nationkey").select("n_nationkey", "title", "depth")


@query("SELECT c_custkey, c_mktsegment AS full_name, 'Tx' AS type, CAST(c_custkey % 8 AS INT) AS flags, c_name AS value FROM customer")
def pdf_form_fields(spark, sf):
    rows = read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    files = to_pdf(rows.withColumn("f", F.col("c_custkey") % 8), "c_custkey", lambda name, segment, f: build(["x"], fields=[{"type": "Tx", "name": segment, "flags": f, "value": name}]))
    return sections(files, "fields", "c_custkey").select("c_custkey", "full_name", "type", "flags", "value")


@query("SELECT o_orderkey, CAST(unnest([0, 1]) AS INT) AS rev, unnest([false, true]) AS is_last FROM orders")
def pdf_revisions(spark, sf):
    """Files with one update: two revisions, of which the last ends with the file."""

    def made(priority):
        return update(build(["x"], info={"Title": "a"}), {99: {"Note": priority.encode()}})

    files = to_pdf(read(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", made)
    found = sections(files, "revisions", "o_orderkey")
    sizes = files.select(F.col("o_orderkey").alias("k"), F.octet_length("content").alias("size"))
    return found.join(sizes, F.col("o_orderkey") == F.col("k")).select("o_orderkey", "rev", (F.col("end_offset") == F.col("size")).alias("is_last"))


def _a85(data: bytes) -> bytes:
    import base64

    return base64.a85encode(data) + b"~>"


CODECS = {
    "flate": (zlib.compress, "FlateDecode", {}),
    "a85": (_a85, "ASCII85Decode", {}),
    "ahx": (lambda data: data.hex().encode() + b">", "ASCIIHexDecode", {}),
    "rl": (filters.run_length_encode, "RunLengthDecode", {}),
    "lzw": (filters.lzw_encode, "LZWDecode", {}),
    "predictor": (lambda data: zlib.compress(filters.predict_up(data, 16)), "FlateDecode", {"Predictor": 12, "Columns": 16}),
}


def _codec(name: str):
    encode, filter_name, params = CODECS[name]

    def run(spark, sf):
        def both(batches):
            import hashlib

            import pyarrow as pa

            for batch in batches:
                out = []
                for t in batch.column(1):
                    data = (t.as_py() or "").encode()
                    back = filters.decode(encode(data), [filter_name], [params])
                    out.append(hashlib.md5(back[: len(data)]).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "md5"])

        return spread(read(spark, sf, "documents").select("doc_id", "text")).mapInArrow(both, "doc_id long, md5 string")

    run.__name__ = f"filter_roundtrip_{name}"
    return query("SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents")(run)


for _name in CODECS:
    _codec(_name)
