"""Glyphs to lines, words, columns, reading order and Markdown.

A page of glyphs is one row: doc_id, page_no, ``glyphs`` (a string with a character for each glyph,
in the order in which they are shown) and the arrays x, y, w, h (y grows upwards). ``pack`` makes
such rows of a table with a row for each glyph; PDF files give them as they are parsed. So a page
is laid out where its row lies, in numpy over Arrow batches, without a shuffle and without a row
for each character. What follows lines is windows over small tables of lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ("doc_id", "page_no")
CELL_W, CELL_H, STEP, TOP = 8.0, 12.0, 14.0, 792.0
BOXES = ("x", "y", "w", "h")
GLYPHS = "glyphs string, x array<double>, y array<double>, w array<double>, h array<double>"


def _keys(df: DataFrame) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in PAGE)


def pack(chars: DataFrame) -> DataFrame:
    """Pages of glyphs from rows with doc_id, page_no, ord, ch, x, y, w, h; one shuffle by page.

    ``ch`` is one character. Glyphs with one ``ord`` are ordered by place.
    """
    rows = F.sort_array(F.collect_list(F.struct("ord", *BOXES, "ch")))
    packed = chars.groupBy(*PAGE).agg(rows.alias("__g"))
    arrays = [F.col("__g")[k].cast("array<double>").alias(k) for k in BOXES]
    return packed.select(*PAGE, F.array_join(F.col("__g")["ch"], "").alias("glyphs"), *arrays)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def string_of(codes: np.ndarray) -> str:
    return codes.astype(np.uint32).tobytes().decode("utf-32-le")


def grid_pages(docs: DataFrame) -> DataFrame:
    """Glyphs of plain text on a fixed grid of 8 x 12 points, lines 14 points apart, one page a text."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(at, PAGES_AT_ONCE)
                columns: list[list] = [[] for _ in range(5)]
                for text in part.column(1).to_pylist():
                    codes = codes_of(text or "")
                    feeds = codes == 10
                    line = np.cumsum(feeds)
                    start = np.concatenate(([0], np.flatnonzero(feeds) + 1))
                    col, solid = np.arange(len(codes)) - start[line - feeds], ~feeds
                    n = int(solid.sum())
                    page = (string_of(codes[solid]), CELL_W * col[solid], TOP - STEP * (line[solid] + 1), np.full(n, CELL_W), np.full(n, CELL_H))
                    for held, value in zip(columns, page, strict=True):
                        held.append(value)
                kinds = (pa.string(), *[pa.list_(pa.float64())] * 4)
                numbers = pa.array([0] * part.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), numbers, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[*PAGE, "glyphs", *BOXES]
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, page_no int, {GLYPHS}")


#: Pages laid out between two batches of results.
PAGES_AT_ONCE = 200


class Page:
    """A page's glyphs by their order on the page: line by line, each from left to right."""

    def __init__(self, codes: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, tolerance: float = 2.0, gap: float = 10.0):
        """Glyphs on one baseline, apart by less than ``gap`` times their size, are a line.

        Baselines are clustered from the top down first (a glyph joins the one above it within the
        tolerance) and then cut at wide gaps, which makes the order total where a tolerant
        comparison would not be.
        """
        place = np.arange(len(codes))
        down = np.lexsort((place, x, -y))
        row = np.empty(len(codes), np.int64)
        row[down] = np.cumsum(np.diff(y[down], prepend=y[down][:1]) < -tolerance)
        order = np.lexsort((place, x, row))
        self.order, row = order, row[order]
        self.codes, self.x, self.y, self.w, self.h = codes[order], x[order], y[order], w[order], h[order]
        ends = self.x + self.w
        self.gap = np.concatenate(([0.0], self.x[1:] - ends[:-1]))
        starts = np.concatenate(([True], (row[1:] != row[:-1]) | (self.gap[1:] >= gap * np.maximum(self.w, self.h)[1:])))[: len(codes)]
        self.starts = np.flatnonzero(starts)
        self.line = np.cumsum(starts) - 1

    def boxes(self, starts: np.ndarray, take: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, ...]:
        """Left, bottom, right and top of groups of the taken glyphs that begin at ``starts``."""
        x, y, w, h = self.x[take], self.y[take], self.w[take], self.h[take]
        return (
            np.minimum.reduceat(x, starts), np.minimum.reduceat(y, starts), np.maximum.reduceat(x + w, starts), np.maximum.reduceat(y + h, starts),
        )


def strings(codes: np.ndarray, starts: np.ndarray) -> list[str]:
    text = string_of(codes)
    ends = [*starts[1:].tolist(), len(codes)]
    return [text[s:e] for s, e in zip(starts.tolist(), ends, strict=True)]


def by_page(pages: DataFrame, schema: str, make: Callable[..., list], plain: bool = False, **options) -> DataFrame:
    """Rows that ``make`` gives of each page, as a column or array for every field of ``schema``.

    It gets a ``Page``, or with ``plain`` the arrays of codes, x, y, w and h as they are.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    full = f"{_keys(pages)}, {schema}"
    arrow = to_arrow_schema(StructType.fromDDL(full))
    names = arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(at, PAGES_AT_ONCE)
                arrays = [part.column(i) for i in range(3, 7)]
                flat = [c.flatten().to_numpy(zero_copy_only=False) for c in arrays]
                sizes = np.concatenate(([0], np.cumsum(arrays[0].value_lengths().to_numpy(zero_copy_only=False))))
                done, counts = [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    s, e = int(sizes[i]), int(sizes[i + 1])
                    arrays_of = (codes_of(text), *[f[s:e] for f in flat])
                    rows = None if e <= s else make(*arrays_of) if plain else make(Page(*arrays_of, **options))
                    counts.append(len(rows[0]) if rows else 0)
                    if counts[-1]:
                        done.append(rows)
                if not done:
                    continue
                which = pa.array(np.repeat(np.arange(part.num_rows), counts))
                found = [[v for rows in done for v in rows[k]] if isinstance(done[0][k], list) else np.concatenate([rows[k] for rows in done]) for k in range(len(done[0]))]
                columns = [part.column(0).take(which), part.column(1).take(which), *[pa.array(c, f.type) for c, f in zip(found, list(arrow)[2:], strict=True)]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return pages.select(*PAGE, "glyphs", *BOXES).filter("glyphs <> ''").mapInArrow(run, full)


def lines(pages: DataFrame, tolerance: float = 2.0, gap: float = 10.0) -> DataFrame:
    """One row for each line of each page: text, box and baseline."""

    def make(p: Page) -> list:
        x, y, right, _ = p.boxes(p.starts)
        return [np.arange(len(p.starts)), strings(p.codes, p.starts), x, y, right - x, np.maximum.reduceat(p.h, p.starts)]

    return by_page(pages, "line_index long, text string, x double, y double, w double, h double", make, tolerance=tolerance, gap=gap)


def words(pages: DataFrame) -> DataFrame:
    """One row for each word of each line: a new word begins after a space or a wide gap.

    Wide is over twice the line's mean gap (gaps below zero left out; two points if there are none).
    """

    def make(p: Page) -> list:
        first = np.zeros(len(p.codes), bool)
        first[p.starts] = True
        space = p.codes == 32
        counted = ~first & (p.gap >= 0)
        n = np.add.reduceat(counted.astype(float), p.starts)
        total = np.add.reduceat(np.where(counted, p.gap, 0.0), p.starts)
        mean = np.divide(total, n, out=np.full(len(n), 2.0), where=n > 0)
        begins = first | (p.gap > 2 * mean[p.line]) | np.concatenate(([False], space[:-1]))
        run = np.cumsum(begins)
        word = run - run[p.starts][p.line]
        solid = np.flatnonzero(~space)
        if not len(solid):
            return [[]]
        run = run[solid]
        starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        x, y, right, top = p.boxes(starts, solid)
        at = solid[starts]
        return [p.line[at], word[at], strings(p.codes[solid], starts), x, y, right - x, top - y]

    return by_page(pages, "line_index long, word_index long, text string, x double, y double, w double, h double", make)


def _flag_runs(df: DataFrame, by: tuple[str, ...], order: list, starts: Column, name: str) -> DataFrame:
    """Number the runs that rows form when ``starts`` is true at each run's first row."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("__s", F.coalesce(starts.cast("int"), F.lit(1)))
    return marked.withColumn(name, F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__s")


def text_of(ch: str, *order: str) -> Column:
    """Aggregate: characters joined in order."""
    rows = F.sort_array(F.collect_list(F.struct(*order, ch)))
    return F.array_join(F.transform(rows, lambda r: r[ch]), "")


def char_index(pages: DataFrame) -> DataFrame:
    """Every glyph in the order of the page's text: its line, and its UTF-8 offset there, a byte for each line feed."""

    def make(p: Page) -> list:
        size = 1 + (p.codes > 0x7F) + (p.codes > 0x7FF) + (p.codes > 0xFFFF)
        start = np.cumsum(size) - size + p.line
        return [p.order, strings(p.codes, np.arange(len(p.codes))), p.line, start]

    return by_page(pages, "ord long, ch string, line_index long, byte_start long", make)


def columns(lines: DataFrame, bucket: float = 10.0, gap: float = 20.0) -> DataFrame:
    """Adds column_index: a column begins where the distinct 10-point buckets of x leave a gap."""
    lines = lines.withColumn("__b", F.floor(F.col("x") / bucket) * bucket)
    w = Window.partitionBy(*PAGE).orderBy("__b")
    found = _flag_runs(lines.select(*PAGE, "__b").distinct(), PAGE, ["__b"], F.col("__b") - F.lag("__b").over(w) > gap, "column_index")
    keys = [F.col(k).alias(f"__{k}") for k in PAGE]
    found = found.select(*keys, F.col("__b").alias("__c"), "column_index")
    same = [lines[k].eqNullSafe(F.col(f"__{k}")) for k in PAGE]
    joined = lines.join(found, same[0] & same[1] & (F.col("__b") == F.col("__c")))
    return joined.drop("__b", "__c", *[f"__{k}" for k in PAGE])


def reading_order(lines: DataFrame) -> DataFrame:
    """Adds reading_order: column by column, each from the top down."""
    w = Window.partitionBy(*PAGE).orderBy("column_index", F.desc("y"), "x", "line_index")
    return lines.withColumn("reading_order", F.row_number().over(w) - 1)


def page_text(lines: DataFrame, order: str = "reading_order") -> DataFrame:
    """Each page's lines in order, each with a line feed."""
    rows = F.sort_array(F.collect_list(F.struct(order, "text")))
    joined = F.concat(F.array_join(F.transform(rows, lambda r: r["text"]), "\n"), F.lit("\n"))
    return lines.groupBy(*PAGE).agg(joined.alias("text"), F.count(F.lit(1)).alias("n_lines"))


def byte_index(lines: DataFrame, order: str = "line_index") -> DataFrame:
    """Adds byte_start: the line's UTF-8 offset in the page text, one byte for each line feed."""
    w = Window.partitionBy(*PAGE).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("byte_start", F.coalesce(F.sum(F.octet_length("text").cast("long") + 1).over(w), F.lit(0)))


def body_size(sized: DataFrame, size: str = "font_size", weight: Column | None = None) -> DataFrame:
    """Each page's most frequent font size at a tenth of a point; ties go to the smaller."""
    counts = sized.groupBy(*PAGE, F.round(size, 1).alias("s")).agg(F.sum(weight if weight is not None else F.lit(1)).alias("n"))
    return counts.groupBy(*PAGE).agg(F.max(F.struct("n", (-F.col("s")).alias("m"))).alias("b")).select(*PAGE, (-F.col("b.m")).alias("body_size"))


def markdown_lines(lines: DataFrame, body: DataFrame) -> DataFrame:
    """Adds markdown: headings by size over the body's, bullets and numbers normalised."""
    ratio = F.col("font_size") / F.col("body_size")
    mark = F.when(ratio >= 1.8, "# ").when(ratio >= 1.4, "## ").when(ratio >= 1.15, "### ").otherwise("")
    text = F.trim("text")
    listed = F.regexp_replace(F.regexp_replace(text, r"^[-*•]\s+", "- "), r"^(\d+)[.)]\s+", "$1. ")
    return lines.join(body, list(PAGE)).withColumn("markdown", F.when(mark != "", F.concat(mark, text)).otherwise(listed))


def markdown_page(lines: DataFrame, order: str = "reading_order") -> DataFrame:
    """Each page's markdown lines in order, with a blank line where the gap to the line above is over 1.5 mean line heights."""
    page = Window.partitionBy(*PAGE)
    above = F.lag("y").over(page.orderBy(order))
    rows = lines.withColumn("__far", (above - F.col("y") > 1.5 * F.avg("h").over(page)) | (above < F.col("y")))
    rows = rows.withColumn("__t", F.when(F.col("__far"), F.concat(F.lit("\n"), F.col("markdown"))).otherwise(F.col("markdown")))
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order, "__t"))), lambda r: r["__t"])
    return rows.groupBy(*PAGE).agg(F.concat(F.array_join(listed, "\n"), F.lit("\n")).alias("markdown"))



def svg_text(lines: DataFrame, width: float, height: float) -> DataFrame:
    """Each page's lines as an SVG drawing of text; y grows downwards there."""
    from ..functions.text import html_escape

    place = F.format_string('<text x="%.2f" y="%.2f">%s</text>', F.col("x"), F.lit(float(height)) - F.col("y"), html_escape(F.col("text")))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("line_index", place.alias("t")))), lambda r: r["t"])
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}">'
    return lines.groupBy(*PAGE).agg(F.concat(F.lit(head), F.array_join(rows, ""), F.lit("</svg>")).alias("svg"))


def range_text(pages: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """The text of a range of pages, each but the first after a line with its number; no row where none is there."""
    if not 0 <= first <= last:
        raise ValueError(f"pages {first} to {last}")
    rows = F.sort_array(F.collect_list(F.struct("page_no", "text")))
    return pages.filter(F.col("page_no").between(first, last)).groupBy(key).agg(joined_pages(rows, first).alias("text"))


def joined_pages(rows: Column, first: int) -> Column:
    """The text of an array of pages in order."""
    parts = F.transform(rows, lambda r: F.concat(F.when(r["page_no"] > first, F.concat(F.lit("\n\n--- Page "), r["page_no"], F.lit(" ---\n\n"))).otherwise(""), F.coalesce(r["text"], F.lit(""))))
    return F.array_join(parts, "")
