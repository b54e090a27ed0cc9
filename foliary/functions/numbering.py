"""Page numbering styles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")


def _digit(n: Column, place: int, one: str, five: str, ten: str) -> Column:
    table = [u.translate(str.maketrans("IVX", one + five + ten)) for u in UNITS]
    return F.get(F.array(*[F.lit(t) for t in table]), F.floor(n / place).cast("int") % 10)


def roman(n: Column) -> Column:
    """Upper-case Roman numeral of 1 to 3999; decimal digits outside of that."""
    thousands = F.repeat(F.lit("M"), F.floor(n / 1000).cast("int"))
    # The tables are keyed by letters that the place's own letters replace.
    numeral = F.concat(thousands, _digit(n, 100, "C", "D", "M"), _digit(n, 10, "X", "L", "C"), _digit(n, 1, "I", "V", "X"))
    return F.when(n.between(1, 3999), numeral).otherwise(n.cast("string"))


def letters(n: Column) -> Column:
    """A to Z, then AA, AB, ...: bijective base 26. Empty below 1."""
    start = F.struct(n.cast("long").alias("rest"), F.lit("").alias("out"))

    def step(a: Column, _: Column) -> Column:
        more = a["rest"] > 0
        letter = F.char(65 + (a["rest"] - 1) % 26)
        return F.struct(
            F.when(more, F.floor((a["rest"] - 1) / 26)).otherwise(F.lit(0)).cast("long").alias("rest"),
            F.when(more, F.concat(letter, a["out"])).otherwise(a["out"]).alias("out"),
        )

    # 14 letters reach beyond any long; a fold keeps the expression's size fixed.
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda a: a["out"])


def label(style: Column, prefix: Column, number: Column) -> Column:
    """Prefix and number in one of the styles D, R, r, A, a; a null style has no number."""
    body = (
        F.when(style == "D", number.cast("string"))
        .when(style == "R", roman(number))
        .when(style == "r", F.lower(roman(number)))
        .when(style == "A", letters(number))
        .when(style == "a", F.lower(letters(number)))
        .otherwise("")
    )
    return F.concat(F.coalesce(prefix, F.lit("")), body)
