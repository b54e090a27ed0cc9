"""Selections by rectangle, range and region, and box overlap joins on a grid of cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import PAGE, Page, by_page, strings, text_of


def select_rect(pages: DataFrame, x1: float, y1: float, x2: float, y2: float, centre: bool = False) -> DataFrame:
    """The selected text of each line of pages of glyphs, with its box.

    A glyph is selected if its box strictly overlaps the rectangle, whichever corners are given,
    or with ``centre`` if its centre lies in the closed rectangle.
    """
    left, right, low, high = min(x1, x2), max(x1, x2), min(y1, y2), max(y1, y2)

    def make(p: Page) -> list:
        if centre:
            cx, cy = p.x + p.w / 2, p.y + p.h / 2
            hit = (left <= cx) & (cx <= right) & (low <= cy) & (cy <= high)
        else:
            hit = (p.x < right) & (p.x + p.w > left) & (p.y < high) & (p.y + p.h > low)
        taken = np.flatnonzero(hit)
        if not len(taken):
            return [[]]
        line = p.line[taken]
        starts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        return [line[starts], strings(p.codes[taken], starts), *p.boxes(starts, taken)]

    return by_page(pages, "line_index long, text string, x1 double, y1 double, x2 double, y2 double", make)


def hit_test(pages: DataFrame, x: float, y: float) -> DataFrame:
    """The glyph at a point of each page, the last shown if several are: its place, character and line."""

    def make(p: Page) -> list:
        hit = np.flatnonzero((p.x <= x) & (x <= p.x + p.w) & (p.y <= y) & (y <= p.y + p.h))
        if not len(hit):
            return [[]]
        at = hit[p.order[hit].argmax()]
        return [p.order[[at]], strings(p.codes[[at]], np.array([0])), p.line[[at]]]

    return by_page(pages, "ord long, ch string, line_index long", make)


def hit_boxes(pages: DataFrame, term: str) -> DataFrame:
    """Where a term lies on each page: a box for each line part of every occurrence, which don't overlap."""
    if not term:
        raise ValueError("an empty term is everywhere")

    def make(p: Page) -> list:
        out: list[tuple] = []
        for number, (text, s) in enumerate(zip(strings(p.codes, p.starts), p.starts.tolist(), strict=True)):
            at = text.find(term)
            while at >= 0:
                taken = slice(s + at, s + at + len(term))
                out.append((number, at, *[float(v[0]) for v in p.boxes(np.array([0]), taken)]))
                at = text.find(term, at + len(term))
        return [list(c) for c in zip(*out, strict=True)] if out else [[]]

    return by_page(pages, "line_index long, start int, x1 double, y1 double, x2 double, y2 double", make)


def centre_in(x1: float, y1: float, x2: float, y2: float) -> Column:
    """A glyph row whose centre lies in the closed rectangle."""
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    return cx.between(min(x1, x2), max(x1, x2)) & cy.between(min(y1, y2), max(y1, y2))


def select_range(lines: DataFrame, start: int, length: int) -> DataFrame:
    """Lines with byte_start whose UTF-8 interval overlaps the range, and how much of each does."""
    size = F.octet_length("text").cast("long")
    begin, end = F.col("byte_start"), F.col("byte_start") + size
    return lines.filter((begin < start + length) & (end > start)).withColumn(
        "overlap", F.least(end, F.lit(start + length)) - F.greatest(begin, F.lit(start))
    )


def spans(chars: DataFrame, font: str = "font_name") -> DataFrame:
    """Runs of one font within a line, as one row each: gaps and islands by lag and running sum."""
    line = (*PAGE, "line_index")
    w = Window.partitionBy(*line).orderBy("x", "ord")
    starts = F.coalesce((F.lag(font).over(w) != F.col(font)).cast("int"), F.lit(1))
    runs = chars.withColumn("__s", starts)
    runs = runs.withColumn("span_index", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return runs.groupBy(*line, "span_index").agg(
        F.first(font).alias(font), text_of("ch", "x", "ord").alias("text"), F.min("x").alias("x"), F.max(F.col("x") + F.col("w")).alias("x_end")
    )


#: A key with more boxes than these is met by cells; one with fewer by the key alone.
FEW = 64


def parted(b: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Boxes of keys that have few, and those of keys that have many."""
    counted = b.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return counted.filter(F.col("__n") <= FEW).drop("__n"), counted.filter(F.col("__n") > FEW).drop("__n")


def sided(df: DataFrame, keys: tuple[str, ...], side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in (*keys, "__i", "__j") else f"{side}_{c}") for c in df.columns])


def meets(closed: bool = True) -> Column:
    """That the boxes of sides a and b overlap; closed ones also where they only touch."""
    less = (lambda p, q: p <= q) if closed else (lambda p, q: p < q)
    return (
        less(F.col("a_x1"), F.col("b_x2")) & less(F.col("b_x1"), F.col("a_x2"))
        & less(F.col("a_y1"), F.col("b_y2")) & less(F.col("b_y1"), F.col("a_y2"))
    )


def overlap(a: DataFrame, b: DataFrame, keys: tuple[str, ...], cell: float = 64.0, closed: bool = True) -> DataFrame:
    """Pairs of boxes (x1, y1, x2, y2) of one key that overlap.

    Where b has few boxes of a key, each box of a is compared with them all; where it has many,
    the two meet by grid cells, so no comparison grows with the square of a page.
    """
    few, many = parted(b, keys)
    near = sided(a, keys, "a").join(sided(few, keys, "b").hint("merge"), list(keys)).filter(meets(closed))
    return near.unionByName(overlap_by_cells(a, many, keys, cell, closed))


def overlap_by_cells(a: DataFrame, b: DataFrame, keys: tuple[str, ...], cell: float = 64.0, closed: bool = True) -> DataFrame:
    """Pairs of boxes that overlap, by an equality join on grid cells.

    A pair is found in every cell that both touch and kept in the one that holds the lower left
    corner of their intersection, so no pair is returned twice and none needs a distinct. Joins are
    merged: sizes are guessed from files, before a box becomes a row for each cell, so Spark would
    broadcast tables of many times the size that it allows.
    """

    def celled(df: DataFrame, side: str) -> DataFrame:
        span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell).cast("int"), F.floor(F.col(hi) / cell).cast("int"))
        return sided(df.withColumn("__i", F.explode(span("x1", "x2"))).withColumn("__j", F.explode(span("y1", "y2"))), keys, side)

    there = b.select(*keys).distinct().hint("merge")
    joined = celled(a.join(there, list(keys), "left_semi"), "a").join(celled(b, "b").hint("merge"), [*keys, "__i", "__j"])
    corner = (F.floor(F.greatest("a_x1", "b_x1") / cell) == F.col("__i")) & (F.floor(F.greatest("a_y1", "b_y1") / cell) == F.col("__j"))
    return joined.filter(meets(closed) & corner).drop("__i", "__j")
