"""Relational queries over the given tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import colour, numbering, values
from ..functions import text as tx
from ..operators import audit, layout, pages, search, spatial, tables
from ..sources.writing import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


LINE_ITEMS = """(SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS l_linenumber) FROM lineitem)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            # Shared adapters are written by the table's name and spelt out here.
            SQL[f.__name__] = sql.replace("FROM lineitem", f"FROM {LINE_ITEMS} AS lineitem")
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def line_items(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with l_linenumber made unique within each order, in a fixed order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return read(spark, sf, "lineitem").withColumn("l_linenumber", F.row_number().over(w))


# --- numbering and labels -------------------------------------------------------------------------

ROMAN_SQL = """CASE WHEN o_orderkey BETWEEN 1 AND 3999 THEN repeat('M', CAST(o_orderkey // 1000 AS INT))
|| (['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'])[CAST(o_orderkey // 100 AS INT) % 10 + 1]
|| (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[CAST(o_orderkey // 10 AS INT) % 10 + 1]
|| (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[CAST(o_orderkey AS INT) % 10 + 1] ELSE CAST(o_orderkey AS VARCHAR) END"""


@query(f"SELECT o_orderkey, {ROMAN_SQL} AS label FROM orders")
def page_label_roman(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", numbering.roman(F.col("o_orderkey")).alias("label"))


@query("""
WITH RECURSIVE l AS (
  SELECT o_orderkey, o_orderkey AS rest, '' AS label FROM orders
  UNION ALL
  SELECT o_orderkey, (rest - 1) // 26, chr(CAST(65 + (rest - 1) % 26 AS INT)) || label FROM l WHERE rest > 0)
SELECT o_orderkey, label FROM l WHERE rest <= 0""")
def page_label_alpha(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", numbering.letters(F.col("o_orderkey")).alias("label"))


def label_ranges(spark, sf) -> DataFrame:
    """Two ranges for each order: front matter in small Roman numerals, then a prefixed body."""
    o = read(spark, sf, "orders")
    front = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("start_index"), F.lit("r").alias("style"), F.lit("").alias("prefix"), F.lit(1).alias("start_value"))
    body = o.select(
        F.col("o_orderkey").alias("doc_id"), F.lit(2).alias("start_index"), F.lit("A").alias("style"),
        F.concat(F.col("o_orderstatus"), F.lit("-")).alias("prefix"), (F.col("o_custkey") % 40 + 1).cast("int").alias("start_value"),
    )
    return front.unionByName(body)


@query("""
WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber - 1 AS page_no, l_partkey FROM lineitem),
q AS (SELECT p.*, o_orderstatus, (o_custkey % 40) + 1 + page_no - 2 AS n FROM p JOIN orders ON o_orderkey = doc_id)
SELECT doc_id, page_no, l_partkey,
  CASE WHEN page_no < 2 THEN (['i', 'ii'])[page_no + 1]
       ELSE o_orderstatus || '-' || CASE WHEN n > 26 THEN chr(CAST(64 + (n - 1) // 26 AS INT)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INT)) END AS label
FROM q""")
def page_label_asof(spark, sf):
    p = line_items(spark, sf).select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("page_no"), "l_partkey")
    return pages.label_pages(p, label_ranges(spark, sf))


# --- search ---------------------------------------------------------------------------------------

CHARS_SQL = """
WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(0, length(text))) AS i FROM documents WHERE text <> ''),
g AS (SELECT doc_id, i, ch || lead(ch, 1) OVER w || lead(ch, 2) OVER w AS gram FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i))
"""


@query(CHARS_SQL + "SELECT doc_id, count(*) AS n_hits, min(i) AS first_hit, max(i) AS last_hit FROM g WHERE gram = 'ere' GROUP BY doc_id")
def search_exact_overlapping(spark, sf):
    return search.hits(read(spark, sf, "documents"), "ere").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_hits"), F.min("start").alias("first_hit"), F.max("start").alias("last_hit")
    )


@query("SELECT doc_id, len(string_split(lower(text), 'erer')) - 1 AS n_hits FROM documents WHERE contains(lower(text), 'erer')")
def search_folded_plain(spark, sf):
    """Occurrences that don't overlap, whatever the case."""
    return search.hits(read(spark, sf, "documents"), "ErEr", False, False).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hits"))


@query("""
WITH p AS (SELECT doc_id, text, string_split(text, 'example.com') AS parts FROM documents WHERE contains(text, 'example.com')),
h AS (SELECT doc_id, text, i, list_sum([length(x) + 11 FOR x IN parts[1:i]]) - 11 AS start
      FROM (SELECT doc_id, text, parts, unnest(range(1, len(parts))) AS i FROM p))
SELECT doc_id, start, substring(text, CAST(greatest(start - 30, 0) AS BIGINT) + 1, CAST(start + 11 + 30 - greatest(start - 30, 0) AS BIGINT)) AS context FROM h""")
def search_context(spark, sf):
    return search.hits(read(spark, sf, "documents"), "example.com")


@query(CHARS_SQL + """, n AS (SELECT doc_id, count(*) AS n_hits FROM g WHERE gram = 'the' GROUP BY doc_id)
SELECT doc_id, n_hits, row_number() OVER (ORDER BY n_hits DESC, doc_id) AS place FROM n QUALIFY place <= 20""")
def search_topk(spark, sf):
    """The report of the 20 documents with most hits."""
    d = read(spark, sf, "documents")
    n = d.select("doc_id", tx.count_overlapping(F.col("text"), "the").alias("n_hits")).filter("n_hits > 0")
    top = n.orderBy(F.desc("n_hits"), "doc_id").limit(20)
    listed = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("n_hits")).alias("m"), "doc_id"))).alias("r"))  # 20 rows
    return listed.select(F.posexplode("r").alias("i", "r")).select("r.doc_id", (-F.col("r.m")).alias("n_hits"), (F.col("i") + 1).alias("place"))


@query(CHARS_SQL + "SELECT gram AS trigram, count(*) AS n_positions, count(DISTINCT doc_id) AS n_docs FROM g WHERE gram IS NOT NULL GROUP BY gram")
def trigram_index(spark, sf):
    return search.trigram_counts(spread(read(spark, sf, "documents").select("doc_id", "text")))


REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@query("""
WITH t AS (SELECT p_partkey, list_distinct([substring(p_name, i, 3) FOR i IN range(1, length(p_name) - 1)]) AS g FROM part),
q AS (SELECT r_name, list_distinct([substring(lower(r_name), i, 3) FOR i IN range(1, length(r_name) - 1)]) AS q FROM region)
SELECT p_partkey, r_name, round(CASE WHEN len(list_distinct(list_concat(g, q))) = 0 THEN 0.0
   ELSE len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q))) END, 6) AS similarity FROM t, q""")
def trigram_jaccard(spark, sf):
    """Every part's name against the stated set of query terms: the five region names."""
    terms = F.explode(F.array(*[F.lit(n) for n in REGIONS])).alias("r_name")
    p = read(spark, sf, "part").select("p_partkey", "p_name", terms)
    sim = tx.trigram_similarity(F.array_distinct(tx.trigrams(F.col("p_name"))), F.array_distinct(tx.trigrams(tx.fold(F.col("r_name")))))
    return p.select("p_partkey", "r_name", F.round(sim, 6).alias("similarity"))


@query("""SELECT c_custkey, least(levenshtein(c_mktsegment, 'BUILDINGS'), 5) AS distance,
least(levenshtein(c_name, 'Customer#000000042'), 3) AS name_distance FROM customer""")
def levenshtein_bounded(spark, sf):
    return read(spark, sf, "customer").select(
        "c_custkey",
        tx.edit_distance(F.col("c_mktsegment"), F.lit("BUILDINGS"), 4).alias("distance"),
        tx.edit_distance(F.col("c_name"), F.lit("Customer#000000042"), 2).alias("name_distance"),
    )


FUZZY_QUERY = "stupid and patetic"


@query()
def fuzzy_search(spark, sf):
    """Tested against brute force."""
    return search.fuzzy(spread(read(spark, sf, "documents").select("doc_id", "text")), FUZZY_QUERY)


# --- layout ---------------------------------------------------------------------------------------

GRID_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS line_index, line, t FROM l WHERE t <> '')
"""


def grid_glyphs(spark, sf) -> DataFrame:
    return layout.grid_pages(spread(read(spark, sf, "documents").select("doc_id", "text")))


@query(GRID_SQL + """SELECT doc_id, line_index, t AS text, 0.0::DOUBLE AS x, 792.0 - 14.0 * (line + 1) AS y, 8.0 * length(t) AS w FROM n""")
def line_text(spark, sf):
    """Texts to glyphs on a grid, and glyphs back to lines by position alone."""
    return layout.lines(grid_glyphs(spark, sf)).select("doc_id", "line_index", "text", "x", "y", "w")


@query(GRID_SQL + """, w AS (SELECT doc_id, line_index, line, t, regexp_extract_all(t, '[^ ]+') AS words FROM n)
SELECT doc_id, line_index, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS n_chars, max(length(word)) * 8.0 AS widest
FROM (SELECT doc_id, line_index, unnest(words) AS word FROM w) GROUP BY doc_id, line_index""")
def word_segment(spark, sf):
    words = layout.words(grid_glyphs(spark, sf))
    return words.groupBy("doc_id", "line_index").agg(
        F.count(F.lit(1)).alias("n_words"), F.sum(F.length("text")).alias("n_chars"), F.max("w").alias("widest")
    )


@query(GRID_SQL + """SELECT doc_id, line_index, coalesce(CAST(sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS byte_start FROM n""")
def char_byte_index(spark, sf):
    d = read(spark, sf, "documents")
    lines = d.select("doc_id", F.lit(0).alias("page_no"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_index", "text"))
    return layout.byte_index(lines.filter("text <> ''")).select(
        "doc_id", (F.row_number().over(_by_line()) - 1).alias("line_index"), "byte_start"
    )


def _by_line():
    return Window.partitionBy("doc_id").orderBy("line_index")


def order_spans(spark, sf) -> DataFrame:
    """Line items as spans of a page: three columns by part, lower for each line number."""
    li = line_items(spark, sf)
    return li.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_no"), F.col("l_linenumber").alias("line_index"),
        ((F.col("l_partkey") % 3) * 180 + F.col("l_suppkey") % 7).cast("double").alias("x"),
        (700 - 20 * F.col("l_linenumber")).cast("double").alias("y"), F.col("l_returnflag").alias("text"), "l_partkey",
    )


SPANS_SQL = """
WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber AS line_index, CAST((l_partkey % 3) * 180 + l_suppkey % 7 AS DOUBLE) AS x,
           CAST(700 - 20 * l_linenumber AS DOUBLE) AS y, l_returnflag AS text, l_partkey FROM lineitem),
c AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY l_partkey % 3) - 1 AS column_index FROM s)
"""


@query(SPANS_SQL + "SELECT doc_id, line_index, l_partkey, column_index, row_number() OVER (PARTITION BY doc_id ORDER BY column_index, y DESC, x, line_index) - 1 AS reading_order FROM c")
def reading_order(spark, sf):
    return layout.reading_order(layout.columns(order_spans(spark, sf))).select("doc_id", "line_index", "l_partkey", "column_index", "reading_order")


@query(SPANS_SQL + "SELECT doc_id, CAST(count(DISTINCT column_index) AS BIGINT) AS n_columns FROM c GROUP BY doc_id")
def column_detect(spark, sf):
    return layout.columns(order_spans(spark, sf)).groupBy("doc_id").agg(F.countDistinct("column_index").alias("n_columns"))


@query(SPANS_SQL + "SELECT doc_id, string_agg(text, chr(10) ORDER BY column_index, y DESC, x, line_index) || chr(10) AS text, count(*) AS n_lines FROM c GROUP BY doc_id")
def page_text(spark, sf):
    return layout.page_text(layout.reading_order(layout.columns(order_spans(spark, sf)))).drop("page_no")


@query("""
WITH s AS (SELECT l_orderkey AS doc_id, round(8 + l_quantity / 10, 1) AS s, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT doc_id, s AS body_size FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s) = 1""")
def body_font_mode(spark, sf):
    sized = line_items(spark, sf).select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_no"), (8 + F.col("l_quantity") / 10).alias("font_size"))
    return layout.body_size(sized).drop("page_no")


@query("""
WITH f AS (SELECT l_orderkey AS doc_id, l_linenumber, l_shipdate, 8 + l_quantity / 10 AS z, '* ' || l_linestatus || ' ' || l_returnflag AS t FROM lineitem),
s AS (SELECT doc_id, round(z, 1) AS s, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT doc_id, s AS b FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s) = 1)
SELECT doc_id, l_linenumber, CASE WHEN z / b >= 1.8 THEN '# ' || t WHEN z / b >= 1.4 THEN '## ' || t WHEN z / b >= 1.15 THEN '### ' || t
  ELSE '- ' || substring(t, 3) END AS markdown FROM f JOIN b USING (doc_id)""")
def markdown_headings(spark, sf):
    li = line_items(spark, sf)
    text = F.concat(F.lit("* "), F.col("l_linestatus"), F.lit(" "), F.col("l_returnflag"))
    lines = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_no"), "l_linenumber", (8 + F.col("l_quantity") / 10).alias("font_size"), text.alias("text"))
    return layout.markdown_lines(lines, layout.body_size(lines)).select("doc_id", "l_linenumber", "markdown")


# --- selection ------------------------------------------------------------------------------------


@query(GRID_SQL + """, s AS (SELECT doc_id, line_index, line, substring(t, 11, 26) AS s, length(t) AS size FROM n WHERE 792 - 14 * (line + 1) < 700 AND 792 - 14 * (line + 1) + 12 > 650)
SELECT doc_id, line_index, s AS text, 80.0::DOUBLE AS x1, 8.0 * least(size, 36) AS x2 FROM s WHERE s <> ''""")
def select_rect(spark, sf):
    """The text of a rectangle on every page."""
    return spatial.select_rect(grid_glyphs(spark, sf), 81.0, 700.0, 287.0, 650.0).select("doc_id", "line_index", "text", "x1", "x2")


@query(GRID_SQL + """, b AS (SELECT doc_id, line_index, strlen(t) AS size, coalesce(sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM n)
SELECT doc_id, line_index, CAST(least(s + size, 900) - greatest(s, 400) AS BIGINT) AS overlap FROM b WHERE s < 900 AND s + size > 400""")
def select_range(spark, sf):
    lines = layout.byte_index(layout.lines(grid_glyphs(spark, sf)))
    return spatial.select_range(lines, 400, 500).select("doc_id", "line_index", "overlap")


@query("""
WITH r AS (SELECT doc_id, line, n, starts, c FROM (
  SELECT l_orderkey AS doc_id, l_linestatus AS line, l_linenumber AS n, l_returnflag AS c,
    CASE WHEN lag(l_returnflag) OVER w = l_returnflag THEN 0 ELSE 1 END AS starts FROM lineitem WHERE l_linenumber + 0.5 BETWEEN 2 AND 6 WINDOW w AS (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_partkey))),
i AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id, line ORDER BY n ROWS UNBOUNDED PRECEDING) - 1 AS span_index FROM r)
SELECT doc_id, line AS line_index, CAST(span_index AS BIGINT) AS span_index, c AS font_name, count(*) AS n_glyphs FROM i GROUP BY ALL""")
def query_region_spans(spark, sf):
    """Line items as glyphs: runs of one font within a line, of the glyphs whose centres lie in a region."""
    li = line_items(spark, sf)
    chars = li.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_no"), F.col("l_linestatus").alias("line_index"),
        F.col("l_linenumber").cast("double").alias("x"), F.col("l_partkey").alias("ord"), F.lit(1.0).alias("w"),
        F.lit(0.0).alias("y"), F.lit(1.0).alias("h"), F.lit("x").alias("ch"), F.col("l_returnflag").alias("font_name"),
    )
    found = spatial.spans(chars.filter(spatial.centre_in(6, 1, 2, 0)))
    return found.select("doc_id", "line_index", "span_index", "font_name", F.length("text").cast("long").alias("n_glyphs"))


def boxes(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Line items as words, and one mark for each order, all on the order's page."""
    li, o = line_items(spark, sf), read(spark, sf, "orders")
    x, y = (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") * 37 % 700).cast("double")
    words = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("word_id"), x.alias("x1"), y.alias("y1"), (x + F.col("l_quantity")).alias("x2"), (y + 12).alias("y2"))
    x, y = (F.col("o_custkey") % 400).cast("double"), (F.col("o_orderkey") % 500).cast("double")
    marks = o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("mark_id"), x.alias("x1"), y.alias("y1"), (x + 150).alias("x2"), (y + 200).alias("y2"))
    return words, marks


BOX_SQL = """
WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber AS word_id, l_partkey % 500 AS x1, l_suppkey * 37 % 700 AS y1, l_partkey % 500 + l_quantity AS x2, l_suppkey * 37 % 700 + 12 AS y2 FROM lineitem),
m AS (SELECT o_orderkey AS doc_id, o_custkey AS mark_id, o_custkey % 400 AS x1, o_orderkey % 500 AS y1, o_custkey % 400 + 150 AS x2, o_orderkey % 500 + 200 AS y2 FROM orders)
"""


@query(BOX_SQL + "SELECT w.doc_id, word_id, mark_id FROM w JOIN m ON w.doc_id = m.doc_id AND w.x1 <= m.x2 AND m.x1 <= w.x2 AND w.y1 <= m.y2 AND m.y1 <= w.y2")
def annotation_overlap(spark, sf):
    words, marks = boxes(spark, sf)
    return spatial.overlap(words, marks, ("doc_id",)).select("doc_id", F.col("a_word_id").alias("word_id"), F.col("b_mark_id").alias("mark_id"))


@query(BOX_SQL + "SELECT doc_id, word_id FROM w WHERE NOT EXISTS (SELECT 1 FROM m WHERE w.doc_id = m.doc_id AND w.x1 < m.x2 AND m.x1 < w.x2 AND w.y1 < m.y2 AND m.y1 < w.y2)")
def redact(spark, sf):
    words, marks = boxes(spark, sf)
    return pages.redact(words, marks).select("doc_id", "word_id")


# --- tables ---------------------------------------------------------------------------------------


def order_cells(spark, sf) -> DataFrame:
    """Every order as a table: a heading, then a row for each line item."""
    li = line_items(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    body = li.select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("row"),
        F.posexplode(F.array(F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.concat(F.col("l_returnflag"), F.lit('|"<x>"')))).alias("col", "text"),
    )
    keys = li.select(F.col("l_orderkey").alias("doc_id")).distinct()
    head = keys.select("doc_id", F.lit(0).alias("row"), F.posexplode(F.array(F.lit("Part"), F.lit("Qty"), F.lit("Flag & note"))).alias("col", "text"))
    return head.unionByName(body)


CELLS_SQL = """
WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber AS row, CAST(l_partkey AS VARCHAR) AS a, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS b, l_returnflag || '|"<x>"' AS c FROM lineitem
UNION ALL SELECT DISTINCT l_orderkey, 0, 'Part', 'Qty', 'Flag & note' FROM lineitem)
"""


@query(CELLS_SQL + """SELECT doc_id, string_agg('"' || replace(a, '"', '""') || '","' || replace(b, '"', '""') || '","' || replace(c, '"', '""') || '"' || chr(10), '' ORDER BY row) AS content FROM b GROUP BY doc_id""")
def table_csv(spark, sf):
    return tables.to_csv(order_cells(spark, sf), ("doc_id",))


@query(CELLS_SQL + """SELECT doc_id, string_agg(a || chr(9) || b || chr(9) || c || chr(10), '' ORDER BY row) AS content FROM b GROUP BY doc_id""")
def table_tsv(spark, sf):
    return tables.to_tsv(order_cells(spark, sf), ("doc_id",))


@query(CELLS_SQL + """, e AS (SELECT doc_id, row, CASE WHEN row = 0 THEN 'th' ELSE 'td' END AS g, a, b, replace(replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS c FROM b)
SELECT doc_id, '<table>' || chr(10) || string_agg('<tr><' || g || '>' || a || '</' || g || '><' || g || '>' || b || '</' || g || '><' || g || '>' || c || '</' || g || '></tr>' || chr(10), '' ORDER BY row) || '</table>' || chr(10) AS content FROM e GROUP BY doc_id""")
def table_html(spark, sf):
    return tables.to_html(order_cells(spark, sf), ("doc_id",))


@query(CELLS_SQL + """, e AS (SELECT doc_id, row, a, b, replace(c, '|', '\\|') AS c FROM b),
z AS (SELECT *, greatest(3, max(strlen(a)) OVER w) AS wa, greatest(3, max(strlen(b)) OVER w) AS wb, greatest(3, max(strlen(c)) OVER w) AS wc FROM e WINDOW w AS (PARTITION BY doc_id))
SELECT doc_id, string_agg('| ' || rpad(a, CAST(wa AS INT), ' ') || ' | ' || rpad(b, CAST(wb AS INT), ' ') || ' | ' || rpad(c, CAST(wc AS INT), ' ') || ' |' || chr(10)
  || CASE WHEN row = 0 THEN '|' || repeat('-', wa + 2) || '|' || repeat('-', wb + 2) || '|' || repeat('-', wc + 2) || '|' || chr(10) ELSE '' END, '' ORDER BY row) AS content FROM z GROUP BY doc_id""")
def table_markdown(spark, sf):
    return tables.to_markdown(order_cells(spark, sf), ("doc_id",))


@query(CELLS_SQL + """SELECT doc_id, '{"rows":' || (max(row) + 1) || ',"cols":3,"cells":[' || string_agg('{"row":' || row || ',"col":0,"text":"' || a || '"},{"row":' || row || ',"col":1,"text":"' || b
 || '"},{"row":' || row || ',"col":2,"text":"' || replace(c, '"', '\\"') || '"}', ',' ORDER BY row) || ']}' AS content FROM b GROUP BY doc_id""")
def table_json(spark, sf):
    return tables.to_json(order_cells(spark, sf), ("doc_id",))


def placed_glyphs(spark, sf) -> DataFrame:
    """Every order's table as glyphs: one for each character, columns 120 points apart."""
    c = spread(order_cells(spark, sf))
    g = c.select("doc_id", F.lit(0).alias("page_no"), "row", "col", F.posexplode(F.split("text", "")).alias("i", "ch"))
    return g.select(
        "doc_id", "page_no", (F.col("row") * 10000 + F.col("col") * 100 + F.col("i")).alias("ord"), "ch",
        (80 + F.col("col") * 120 + F.col("i") * 7.0).cast("double").alias("x"), (700 - F.col("row") * 20).cast("double").alias("y"),
        F.lit(7.0).alias("w"), F.lit(12.0).alias("h"),
    )


@query(CELLS_SQL + """, d AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY row) - 1 AS r FROM b)
SELECT doc_id, r AS row, 0 AS col, a AS text FROM d UNION ALL SELECT doc_id, r, 1, b FROM d UNION ALL SELECT doc_id, r, 2, c FROM d""")
def table_cells(spark, sf):
    """Tables found from glyph positions alone."""
    return tables.cells(layout.pack(placed_glyphs(spark, sf))).drop("page_no")


# --- page sets ------------------------------------------------------------------------------------


@query("""
SELECT 0 AS source_no, doc_id AS page_no, row_number() OVER (ORDER BY doc_id) - 1 AS merged_no FROM documents
UNION ALL SELECT 1, page_id, (SELECT count(*) FROM documents) + row_number() OVER (ORDER BY page_id) - 1 FROM pages""")
def merge_pages(spark, sf):
    a = read(spark, sf, "documents").select(F.col("doc_id").alias("page_no"))
    b = read(spark, sf, "pages").select(F.col("page_id").alias("page_no"))
    return pages.merge([a, b]).select("source_no", "page_no", "merged_no")


@query("SELECT l_orderkey AS doc_id, l_linenumber - 1 AS page_no, l_partkey, (l_linenumber - 1) // 3 AS part_no, (l_linenumber - 1) % 3 AS part_page FROM lineitem")
def split_pages(spark, sf):
    p = line_items(spark, sf).select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("page_no"), "l_partkey")
    return pages.split(p, 3)


@query("""SELECT l_orderkey AS doc_id, l_linenumber AS page_no, l_partkey, CASE WHEN l_linenumber = 1 THEN 3 WHEN l_linenumber > 1 AND l_linenumber <= 3 THEN l_linenumber - 1 ELSE l_linenumber END AS new_no FROM lineitem""")
def move_page(spark, sf):
    p = line_items(spark, sf).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), "l_partkey")
    return pages.move(p, F.lit(1), F.lit(3))


@query("SELECT doc_id, CASE WHEN doc_id IN (3, 5) THEN NULL WHEN length(CAST(100 + 2 * doc_id AS VARCHAR)) >= 6 THEN 'EX-' || (100 + 2 * doc_id) ELSE 'EX-' || lpad(CAST(100 + 2 * doc_id AS VARCHAR), 6, '0') END || '/A' AS stamp FROM documents")
def bates(spark, sf):
    return read(spark, sf, "documents").select("doc_id", pages.bates(F.col("doc_id"), "EX-", "/A", 100, 2, 6, (3, 5)).alias("stamp"))


# --- audit ----------------------------------------------------------------------------------------


def objects(spark, sf) -> DataFrame:
    """Line items as entries that revisions write: order, revision by line number, object by part."""
    li = line_items(spark, sf)
    return li.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("rev"), (F.col("l_partkey") % 3).alias("obj"),
        F.col("l_suppkey").alias("offset"), (F.col("l_returnflag") != "R").alias("in_use"),
        F.get(F.array(*[F.lit(x) for x in ("form_field", "annotation", "page")]), (F.col("l_partkey") % 3).cast("int")).alias("class"),
    )


OBJECTS_SQL = """
WITH o AS (SELECT l_orderkey AS doc_id, l_linenumber AS rev, l_partkey % 3 AS obj, l_suppkey AS offset_, l_returnflag <> 'R' AS in_use,
  (['form_field', 'annotation', 'page'])[l_partkey % 3 + 1] AS class FROM lineitem),
d AS (SELECT *, CASE WHEN in_use AND before IS NULL THEN 'added' WHEN in_use AND NOT before THEN 'revived' WHEN in_use THEN 'modified' WHEN before THEN 'deleted' ELSE 'none' END AS change
  FROM (SELECT *, lag(in_use) OVER (PARTITION BY doc_id, obj ORDER BY rev) AS before FROM o))
"""


@query(OBJECTS_SQL + "SELECT doc_id, rev, obj, change FROM d")
def revision_diff(spark, sf):
    return audit.diff_revisions(objects(spark, sf)).select("doc_id", "rev", "obj", "change")


@query(OBJECTS_SQL + "SELECT doc_id, obj, rev, offset_ AS \"offset\" FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, obj ORDER BY rev DESC) = 1) WHERE in_use")
def revision_latest(spark, sf):
    return audit.latest(objects(spark, sf))


@query(OBJECTS_SQL + """SELECT d.doc_id, d.rev, obj, change, 1 + o_custkey % 3 AS permission FROM d JOIN orders ON o_orderkey = d.doc_id AND d.rev > 1
WHERE change <> 'none' AND (change = 'deleted' OR CASE 1 + o_custkey % 3 WHEN 1 THEN true WHEN 2 THEN class <> 'form_field' ELSE class = 'page' END)""")
def docmdp_violations(spark, sf):
    certified = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("rev"), (1 + F.col("o_custkey") % 3).alias("permission"))
    found = audit.certification_violations(audit.diff_revisions(objects(spark, sf)), certified)
    return found.select("doc_id", "rev", "obj", "change", "permission")


@query("""
WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS rev, l_linenumber * 1000 + l_suppkey % 7 AS end_offset FROM lineitem)
SELECT o_orderkey AS doc_id, CAST(o_custkey * 7 % 8000 AS BIGINT) AS coverage_end, min(rev) AS rev FROM orders LEFT JOIN r ON doc_id = o_orderkey AND end_offset >= o_custkey * 7 % 8000 GROUP BY ALL""")
def signature_coverage(spark, sf):
    r = line_items(spark, sf).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("rev"), (F.col("l_linenumber") * 1000 + F.col("l_suppkey") % 7).alias("end_offset"))
    s = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") * 7 % 8000).alias("coverage_end"))
    return audit.covering_revision(s, r).select("doc_id", "coverage_end", "rev")


def flags(spark, sf) -> DataFrame:
    """Orders as documents with conformance flags."""
    o = read(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_custkey") % 4 > 0, (F.col("o_custkey") % 4).cast("int")).alias("pdfa_part"),
        (F.col("o_custkey") % 5 > 0).alias("has_intent"), (F.col("o_orderkey") % 3).alias("unembedded_fonts"),
        (F.col("o_orderstatus") == "F").alias("encrypted"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderpriority")).alias("title"),
        (F.col("o_totalprice") % 100 / 100 + 0.5).alias("ca"), (F.col("o_orderkey") % 11 == 0).alias("smask"),
    )


FLAGS_SQL = """
WITH f AS (SELECT o_orderkey AS doc_id, o_custkey % 4 AS part, o_custkey % 5 > 0 AS intent, o_orderkey % 3 AS fonts, o_orderstatus = 'F' AS enc,
  o_orderkey % 7 > 0 AS title, o_totalprice % 100 / 100 + 0.5 AS ca, o_orderkey % 11 = 0 AS smask FROM orders),
v AS (SELECT doc_id, 'no_identifier' AS rule FROM f WHERE part = 0 UNION ALL SELECT doc_id, 'no_output_intent' FROM f WHERE NOT intent
UNION ALL SELECT doc_id, 'font_not_embedded' FROM f WHERE fonts > 0 UNION ALL SELECT doc_id, 'encrypted' FROM f WHERE enc
UNION ALL SELECT doc_id, 'no_title' FROM f WHERE NOT title UNION ALL SELECT doc_id, 'transparency' FROM f WHERE part <= 1 AND (ca < 1 OR smask))
"""


@query(FLAGS_SQL + "SELECT doc_id, rule FROM v")
def pdfa_rules(spark, sf):
    return audit.archival_violations(flags(spark, sf)).select("doc_id", "rule")


@query(FLAGS_SQL + "SELECT f.doc_id, CAST(count(rule) AS INT) AS n_violations, count(rule) = 0 AND part > 0 AS valid FROM f LEFT JOIN v ON f.doc_id = v.doc_id GROUP BY f.doc_id, part")
def pdfa_verdict(spark, sf):
    return audit.archival_verdict(flags(spark, sf))


def fields(spark, sf) -> DataFrame:
    """Customers as form fields of a document for each nation."""
    c = read(spark, sf, "customer")
    kind = F.get(F.array(F.lit("Tx"), F.lit("Ch"), F.lit("Btn")), (F.col("c_custkey") % 3).cast("int"))
    return c.select(
        F.col("c_nationkey").alias("doc_id"), F.col("c_name").alias("full_name"), kind.alias("type"), (F.col("c_custkey") % 8).alias("flags"),
        F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("value"), F.lit(9).alias("max_length"),
        F.array(F.lit("BUILDING"), F.lit("MACHINERY")).alias("options"),
    )


FIELDS_SQL = """
WITH f AS (SELECT c_nationkey AS doc_id, c_name AS n, c_custkey % 3 AS k, c_custkey % 8 AS g, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS v FROM customer)
"""


@query(FIELDS_SQL + """SELECT doc_id, n AS full_name, CASE WHEN (g & 2) <> 0 AND v IS NULL THEN 'required' WHEN k = 0 AND strlen(v) > 9 THEN 'too long'
WHEN k = 1 AND v NOT IN ('BUILDING', 'MACHINERY') THEN 'not an option' WHEN k = 2 AND v NOT IN ('Yes', 'Off') THEN 'not a state' END AS problem FROM f""")
def form_validate(spark, sf):
    f = fields(spark, sf)
    return f.select("doc_id", "full_name", audit.validate_field(F.col("type"), F.col("flags"), F.col("value"), F.col("max_length"), F.col("options")).alias("problem"))


@query(FIELDS_SQL + """SELECT doc_id, '%FDF-1.2' || chr(10) || '1 0 obj' || chr(10) || '<< /FDF << /Fields [' || chr(10) || string_agg('<< /T (' || n || ') /V (' || coalesce(v, '') || ') >>', chr(10) ORDER BY n)
|| chr(10) || '] >> >>' || chr(10) || 'endobj' || chr(10) || 'trailer' || chr(10) || '<< /Root 1 0 R >>' || chr(10) || '%%EOF' || chr(10) AS fdf, count(*) AS n_fields FROM f WHERE (g & 4) = 0 GROUP BY doc_id""")
def form_export(spark, sf):
    return audit.fdf(fields(spark, sf))


@query("""SELECT event_id, (event_id & 4) <> 0 AS can_print, (event_id & 8) <> 0 AS can_modify, (event_id & 16) <> 0 AS can_copy, (event_id & 32) <> 0 AS can_annotate,
(event_id & 256) <> 0 AS can_fill_forms, (event_id & 512) <> 0 AS can_accessibility, (event_id & 1024) <> 0 AS can_assemble, (event_id & 2048) <> 0 AS can_print_high FROM events""")
def permission_flags(spark, sf):
    return read(spark, sf, "events").select("event_id", *colour.permissions(F.col("event_id")))


# --- structure and functions ----------------------------------------------------------------------


@query("""
WITH t AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS title FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier)
SELECT r.title || CASE WHEN n.title IS NULL THEN '' ELSE '/' || n.title || CASE WHEN s.title IS NULL THEN '' ELSE '/' || s.title END END AS path,
  CASE WHEN n.title IS NULL THEN 0 WHEN s.title IS NULL THEN 1 ELSE 2 END AS depth FROM (SELECT * FROM t WHERE parent IS NULL) r
JOIN (SELECT id, parent, title FROM t UNION ALL SELECT NULL, id, NULL FROM t WHERE parent IS NULL) n ON n.parent = r.id
JOIN (SELECT id, parent, title FROM t UNION ALL SELECT NULL, id, NULL FROM t WHERE id LIKE 'n%' UNION ALL SELECT NULL, '-', NULL) s ON s.parent = coalesce(n.id, '-')""")
def outline_flatten(spark, sf):
    """A tree of regions, nations and suppliers, flattened by a recursive query."""
    from ..operators.structure import flatten

    r = read(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("title"))
    n = read(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("title"))
    s = read(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.col("s_name").alias("title"))
    return flatten(r.unionByName(n).unionByName(s)).select("path", "depth")


@query(r"""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&')) AS md5 FROM pages""")
def xml_entities(spark, sf):
    """The predefined entities of whole pages."""
    return read(spark, sf, "pages").select("page_id", F.md5(tx.xml_unescape(F.col("html")).cast("binary")).alias("md5"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS md5, sha1(coalesce(text, '')) AS sha1, sha256(coalesce(text, '')) AS sha256 FROM documents")
def hash_digests(spark, sf):
    t = F.coalesce("text", F.lit("")).cast("binary")
    return read(spark, sf, "documents").select("doc_id", F.md5(t).alias("md5"), F.sha1(t).alias("sha1"), F.sha2(t, 256).alias("sha256"))


@query("SELECT doc_id, base64(encode(text)) AS b64, lower(hex(encode(text))) AS hexed, text AS back FROM documents")
def base64_hex(spark, sf):
    t = F.col("text").cast("binary")
    return read(spark, sf, "documents").select("doc_id", values.to_base64(t).alias("b64"), F.lower(F.hex(t)).alias("hexed"), F.unbase64(F.base64(t)).cast("string").alias("back"))


@query("""SELECT l_orderkey, l_linenumber, round((1 - least(greatest(l_discount * 5, 0), 1)) * (1 - least(greatest(l_quantity / 60, 0), 1)), 6) AS r,
round((1 - least(greatest(l_tax * 5, 0), 1)) * (1 - least(greatest(l_quantity / 60, 0), 1)), 6) AS g FROM lineitem""")
def cmyk_to_rgb(spark, sf):
    rgb = colour.cmyk_to_rgb(F.col("l_discount") * 5, F.col("l_tax") * 5, F.lit(0.0), F.col("l_quantity") / 60)
    return line_items(spark, sf).select("l_orderkey", "l_linenumber", F.round(rgb[0], 6).alias("r"), F.round(rgb[1], 6).alias("g"))


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, ((l_partkey * 7) % 360) AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN d <= 5 OR d >= 355 THEN 'left-to-right' WHEN abs(d - 90) <= 5 THEN 'bottom-to-top' WHEN abs(d - 180) <= 5 THEN 'right-to-left'
WHEN abs(d - 270) <= 5 THEN 'top-to-bottom' ELSE 'rotated' END AS direction FROM d""")
def rotation_label(spark, sf):
    return line_items(spark, sf).select("l_orderkey", "l_linenumber", colour.direction((F.col("l_partkey") * 7 % 360).cast("double")).alias("direction"))
