"""Page sets: labels, merge, split, move, rotate, stamps and redaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import label

BOX = ("x1", "y1", "x2", "y2")


def label_pages(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds label: each page takes the range with the greatest start at or before it.

    ``pages`` has doc_id and page_no; ``ranges`` has doc_id, start_index, style, prefix,
    start_value. Ranges and pages pass through one window, so the cost is that of a sort, not of an
    inequality join. Pages before any range are labelled with their decimal number.
    """
    r = ranges.select(
        "doc_id", F.col("start_index").alias("page_no"), F.struct("start_index", "style", "prefix", "start_value").alias("__r"), F.lit(0).alias("__k")
    )
    both = pages.withColumn("__k", F.lit(1)).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy("doc_id").orderBy("page_no", "__k").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__r", F.last("__r", ignorenulls=True).over(w)).filter("__k = 1")
    at = F.col("page_no") - F.col("__r.start_index") + F.coalesce(F.col("__r.start_value"), F.lit(1))
    text = F.when(F.col("__r").isNull(), (F.col("page_no") + 1).cast("string")).otherwise(label(F.col("__r.style"), F.col("__r.prefix"), at))
    return found.withColumn("label", text).drop("__r", "__k")


#: Ranges that a merge sorts apart; the table of their sizes is what it broadcasts.
RANGES = 256


def merge(parts: Sequence[DataFrame], order: str = "page_no", ranges: int = RANGES) -> DataFrame:
    """Pages of several sets one after another: source, page_no within it, and merged_no over all.

    Each source is cut into ranges of its order at approximate quantiles. Pages are numbered within
    their range, and the counts of the ranges before, a row for each, give where a range begins; so
    no task sorts a whole source.
    """
    both = None
    for i, p in enumerate(parts):
        p = p.withColumn("source_no", F.lit(i))
        both = p if both is None else both.unionByName(p)
    steps = [k / ranges for k in range(1, ranges)]
    cuts = both.groupBy("source_no").agg(F.percentile_approx(order, steps, 4 * ranges).alias("__cuts"))
    dealt = both.join(F.broadcast(cuts), "source_no").withColumn("__range", F.size(F.filter("__cuts", lambda c: c <= F.col(order)))).drop("__cuts")
    counts = dealt.groupBy("source_no", "__range").count()
    before = Window.orderBy("source_no", "__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = counts.withColumn("__o", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("source_no", "__range").orderBy(order)) - 1)
    return ranked.join(F.broadcast(offsets), ["source_no", "__range"]).withColumn("merged_no", F.col("__o") + F.col("__n")).drop("__o", "__n", "__range")


def split(pages: DataFrame, size: int) -> DataFrame:
    """Adds part_no and part_page: each document cut into parts of ``size`` pages."""
    return pages.withColumns({"part_no": F.floor(F.col("page_no") / size), "part_page": F.col("page_no") % size})


def move(pages: DataFrame, source: Column, target: Column) -> DataFrame:
    """Adds new_no: the page at ``source`` goes to ``target`` and those between close up."""
    n = F.col("page_no")
    new = (
        F.when(n == source, target)
        .when((n > source) & (n <= target), n - 1)
        .when((n < source) & (n >= target), n + 1)
        .otherwise(n)
    )
    return pages.withColumn("new_no", new)


def rotate(pages: DataFrame, by: int) -> DataFrame:
    """Turn pages by a multiple of 90 degrees; sides are swapped where that turns them."""
    turned = (by // 90) % 2 == 1
    sides = {"width": F.col("height"), "height": F.col("width")} if turned else {}
    return pages.withColumns({"rotate": F.pmod(F.col("rotate") + by, F.lit(360)), **sides})


def crop(pages: DataFrame, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """Pages reduced to the part of a box that lies on them; none where it lies outside."""
    left, low = F.greatest(F.lit(min(x1, x2)), F.lit(0.0)), F.greatest(F.lit(min(y1, y2)), F.lit(0.0))
    right, high = F.least(F.lit(max(x1, x2)), F.col("width")), F.least(F.lit(max(y1, y2)), F.col("height"))
    return pages.filter((right > left) & (high > low)).withColumns({"width": right - left, "height": high - low})


def remove(pages: DataFrame, number: Column) -> DataFrame:
    """Without the page of this number; those after it close up."""
    n = F.col("page_no")
    return pages.filter(n != number).withColumn("page_no", F.when(n > number, n - 1).otherwise(n))


def insert(pages: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """With new pages (keys and the page_no that each gets, one for a document); those from there on make room."""
    at = new.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("page_no").alias("__at"))
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    met = same[0]
    for s in same[1:]:
        met = met & s
    n = F.col("page_no")
    moved = pages.join(at, met, "left").withColumn("page_no", F.when(n >= F.col("__at"), n + 1).otherwise(n))
    return moved.drop("__at", *[f"__{k}" for k in keys]).unionByName(new, allowMissingColumns=True)


def bates(number: Column, prefix: str = "", suffix: str = "", start: int = 1, increment: int = 1, digits: int = 6, skip: tuple[int, ...] = ()) -> Column:
    """A running stamp. Numbers longer than ``digits`` are written in full; skipped pages have none, and leave their number unused."""
    value = (F.lit(start) + number * increment).cast("string")
    stamp = F.concat(F.lit(prefix), F.when(F.length(value) >= digits, value).otherwise(F.lpad(value, digits, "0")), F.lit(suffix))
    return F.when(~number.isin(list(skip)), stamp) if skip else stamp


def redact(words: DataFrame, marks: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Words that touch no mark (x1, y1, x2, y2). The text goes, not just its look.

    Where a page has many marks they are met through grid cells, so each word is compared with
    nearby ones only; words with one box are hit or not together, so boxes say which are.
    """
    from .spatial import meets, overlap_by_cells, parted, sided

    few, many = parted(marks.select(*keys, *BOX), keys)
    a, b = sided(words, keys, "a"), sided(few, keys, "b").withColumnsRenamed({k: f"b_{k}" for k in keys})
    same = meets(closed=False)
    for k in keys:
        same = (F.col(k) == F.col(f"b_{k}")) & same
    there = many.select(*keys).distinct().hint("merge")
    near = a.join(b.hint("merge"), same, "left_anti").join(there, list(keys), "left_anti")
    near = near.select(*[F.col(c if c in keys else f"a_{c}").alias(c) for c in words.columns])
    hit = overlap_by_cells(words.select(*keys, *BOX), many, keys, closed=False)
    hit = hit.select(*keys, *[F.col(f"a_{c}").alias(c) for c in BOX]).distinct()
    far = words.join(there, list(keys), "left_semi").join(hit.hint("merge"), [*keys, *BOX], "left_anti")
    return near.unionByName(far.select(*words.columns))
