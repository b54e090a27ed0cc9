"""Tables: grids from glyph positions, and exports of cell tables (table key, row, col, text)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import csv_field, html_escape
from .layout import by_page, strings


def cells(pages: DataFrame) -> DataFrame:
    """One row for each cell with text of the table that a page of glyphs forms: row, col, text.

    Rows are baselines from the top down, columns begin at wide gaps in x: over twice the mean
    width of the page's distinct glyph extents. Only pages with at least two rows and two columns
    are tables. Glyphs below U+0020 and U+007F are dropped.
    """

    def make(codes, x, y, w, h) -> list:
        down = np.unique(-y, return_inverse=True)[1]
        if not down.any():
            return [[]]
        ends = x + w
        spans = np.lexsort((w, ends, x))
        sx, se, sw = x[spans], ends[spans], w[spans]
        fresh = np.concatenate(([True], (sx[1:] != sx[:-1]) | (se[1:] != se[:-1]) | (sw[1:] != sw[:-1])))
        reach = np.maximum.accumulate(se)
        wide = np.concatenate(([True], sx[1:] - reach[:-1] > 2 * sw[fresh].mean()))
        if wide.sum() < 2:
            return [[]]
        solid = np.flatnonzero((codes >= 32) & (codes != 127))
        if not len(solid):
            return [[]]
        col = np.searchsorted(sx[wide], x[solid], "right") - 1
        order = np.lexsort((solid, x[solid], col, down[solid]))
        solid, col = solid[order], col[order]
        row = down[solid]
        starts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (col[1:] != col[:-1]))))
        return [row[starts], col[starts], [t.strip(" ") for t in strings(codes[solid], starts)]]

    return by_page(pages, "row int, col int, text string", make, plain=True)


def _table(cells: DataFrame, keys: tuple[str, ...], cell: Column, between: str, line) -> DataFrame:
    """Cells joined to rows and rows to a text; ``line`` gets a row's joined cells and its number."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col("col"), cell.alias("v"))))
    rows = cells.groupBy(*keys, "row").agg(F.array_join(F.transform(ordered, lambda c: c["v"]), between).alias("r"))
    rows = rows.withColumn("r", line(F.col("r"), F.col("row")))
    down = F.sort_array(F.collect_list(F.struct("row", "r")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(down, lambda r: r["r"]), "").alias("content"))


def to_csv(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return _table(cells, keys, csv_field(F.col("text")), ",", lambda r, _: F.concat(r, F.lit("\n")))


def to_tsv(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return _table(cells, keys, F.col("text"), "\t", lambda r, _: F.concat(r, F.lit("\n")))


def to_html(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    tag = F.when(F.col("row") == 0, "th").otherwise("td")
    cell = F.concat(F.lit("<"), tag, F.lit(">"), html_escape(F.col("text")), F.lit("</"), tag, F.lit(">"))
    body = _table(cells, keys, cell, "", lambda r, _: F.concat(F.lit("<tr>"), r, F.lit("</tr>\n")))
    return body.withColumn("content", F.concat(F.lit("<table>\n"), "content", F.lit("</table>\n")))


def to_markdown(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Padded to each column's widest cell in bytes (three at least); bars are escaped before padding."""
    escaped = F.replace(F.trim("text"), F.lit("|"), F.lit("\\|"))
    sized = cells.withColumn("text", escaped)
    width = F.greatest(F.lit(3), F.max(F.octet_length("text")).over(Window.partitionBy(*keys, "col")))
    sized = sized.withColumn("w", width)
    padded = F.concat(F.lit(" "), F.col("text"), F.repeat(F.lit(" "), F.col("w") - F.octet_length("text")), F.lit(" "))
    ordered = F.sort_array(F.collect_list(F.struct("col", padded.alias("v"), "w")))
    rows = sized.groupBy(*keys, "row").agg(ordered.alias("c"))
    line = F.concat(F.lit("|"), F.array_join(F.transform("c", lambda c: c["v"]), "|"), F.lit("|\n"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform("c", lambda c: F.repeat(F.lit("-"), c["w"] + 2)), "|"), F.lit("|\n"))
    rows = rows.select(*keys, "row", F.when(F.col("row") == 0, F.concat(line, rule)).otherwise(line).alias("r"))
    down = F.sort_array(F.collect_list(F.struct("row", "r")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(down, lambda r: r["r"]), "").alias("content"))


def to_json(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("row", "col", "text")))
    return cells.groupBy(*keys).agg(
        F.to_json(F.struct((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), listed.alias("cells"))).alias("content")
    )


def dense(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Every cell of each table up to its last row and column; those without text are empty.

    A table's rows and columns come from its own extent, by sequences, and no cross join.
    """
    upto = cells.groupBy(*keys).agg(F.max("row").alias("__r"), F.max("col").alias("__c"))
    every = upto.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("__r")))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("__c"))))
    joined = every.drop("__r", "__c").join(cells.select(*keys, "row", "col", "text"), [*keys, "row", "col"], "left")
    return joined.withColumn("text", F.coalesce("text", F.lit("")))


def cell(cells: DataFrame, row: int, col: int) -> DataFrame:
    """One cell of each table; no row where it is out of bounds."""
    return cells.filter((F.col("row") == row) & (F.col("col") == col))
