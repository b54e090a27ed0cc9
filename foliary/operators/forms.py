"""Form fields as rows: new values with their rules, FDF read and applied, fields by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import READ_ONLY, has

PUSH_BUTTON, MULTI_SELECT = 1 << 16, 1 << 21


def refusal(kind: Column, flags: Column, max_length: Column, options: Column, text: Column, places: Column) -> Column:
    """Why a field doesn't take a new value, null if it does.

    ``text`` is the value of a text field, ``places`` the positions chosen of a choice field.
    """
    outside = F.exists(places, lambda i: (i < 0) | (i >= F.size(options)))
    return (
        F.when(has(flags, READ_ONLY), "read only")
        .when((kind == "Tx") & (max_length > 0) & (F.octet_length(text) > max_length), "too long")
        .when((kind == "Btn") & has(flags, PUSH_BUTTON), "push button")
        .when((kind == "Ch") & outside, "not an option")
        .when((kind == "Ch") & (F.size(places) > 1) & ~has(flags, MULTI_SELECT), "one option only")
        .when(~kind.isin("Tx", "Btn", "Ch"), "not a value field")
    )


def set_values(fields: DataFrame, text: Column, checked: Column, places: Column) -> DataFrame:
    """Adds refused, and sets value where nothing refuses it."""
    why = refusal(F.col("type"), F.col("flags"), F.col("max_length"), F.col("options"), text, places)
    new = (
        F.when(F.col("type") == "Tx", text)
        .when(F.col("type") == "Btn", F.when(checked, "Yes").otherwise("Off"))
        .otherwise(F.array_join(F.transform(places, lambda i: F.get("options", i)), "\n"))
    )
    marked = fields.withColumn("refused", why)
    return marked.withColumn("value", F.when(F.col("refused").isNull(), new).otherwise(F.col("value")))


PAIR = r"/T\s*\(((?:[^()\\]|\\.)*)\)\s*/V\s*\(((?:[^()\\]|\\.)*)\)"


def _plain(text: Column) -> Column:
    """A literal string's content without its escapes."""
    held = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    for a, b in (("\\(", "("), ("\\)", ")"), ("\\r", "\r"), ("\\n", "\n"), ("\\t", "\t")):
        held = F.replace(held, F.lit(a), F.lit(b))
    return F.replace(held, F.lit("\x00"), F.lit("\\"))


def read_fdf(texts: DataFrame, fdf: str = "fdf") -> DataFrame:
    """full_name and value of every pair of an FDF text, with the text's doc_id."""
    names, values = (F.regexp_extract_all(F.col(fdf), F.lit(PAIR), F.lit(k)) for k in (1, 2))
    pairs = texts.select("doc_id", F.explode(F.arrays_zip(names.alias("n"), values.alias("v"))).alias("p"))
    return pairs.select("doc_id", _plain(F.col("p.n")).alias("full_name"), _plain(F.col("p.v")).alias("value"))


def apply_fdf(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Fields with the values that an FDF has for them; read-only fields and others keep theirs."""
    new = values.select(F.col("doc_id").alias("__d"), F.col("full_name").alias("__n"), F.col("value").alias("__v"))
    joined = fields.join(new, (F.col("doc_id") == F.col("__d")) & (F.col("full_name") == F.col("__n")), "left")
    value = F.when(has(F.col("flags"), READ_ONLY), F.col("value")).otherwise(F.coalesce("__v", "value"))
    return joined.withColumn("value", value).drop("__d", "__n", "__v")


def find(fields: DataFrame, name: str, order: str = "ord") -> DataFrame:
    """Each document's first field of a name, in tree order."""
    named = fields.filter(F.col("full_name") == name)
    columns = [c for c in fields.columns if c != "doc_id"]
    return named.groupBy("doc_id").agg(F.min_by(F.struct(*columns), order).alias("f")).select("doc_id", "f.*")
