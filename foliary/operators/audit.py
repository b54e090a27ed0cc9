"""Revisions, certification rules, signature coverage, archival checks and forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def diff_revisions(objects: DataFrame) -> DataFrame:
    """Adds change: what a revision did to an object (added, modified, deleted, revived).

    ``objects`` has doc_id, rev, obj, offset, in_use: the entries that each revision writes.
    """
    w = Window.partitionBy("doc_id", "obj").orderBy("rev")
    was, now = F.coalesce(F.lag("in_use").over(w), F.lit(False)), F.col("in_use")
    seen = F.lag("rev").over(w).isNotNull()
    change = (
        F.when(now & ~seen, "added").when(now & ~was, "revived").when(now, "modified").when(was, "deleted").otherwise("none")
    )
    return objects.withColumn("change", change)


def latest(objects: DataFrame, upto: int | None = None) -> DataFrame:
    """The newest entry of every object, as of a revision; objects then free are left out."""
    if upto is not None:
        objects = objects.filter(F.col("rev") <= upto)
    row = F.max_by(F.struct("rev", "offset", "in_use"), "rev").alias("r")
    return objects.groupBy("doc_id", "obj").agg(row).select("doc_id", "obj", "r.*").filter("in_use").drop("in_use")


def allowed(kind: Column, permission: Column) -> Column:
    """Whether a change to an object of a class is allowed after certification."""
    return (
        F.when(permission == 1, False)
        .when(permission == 2, kind.isin("form_field", "signature"))
        .when(permission == 3, kind.isin("form_field", "signature", "annotation"))
        .otherwise(True)
    )


def certification_violations(changes: DataFrame, certified: DataFrame) -> DataFrame:
    """Changes after a document's certification that its permission doesn't cover.

    ``changes`` is diff_revisions with class; ``certified`` has doc_id, rev, permission. Deletions
    are never allowed.
    """
    c = certified.select(F.col("doc_id").alias("__d"), F.col("rev").alias("certified_rev"), "permission")
    later = changes.join(c, (F.col("doc_id") == F.col("__d")) & (F.col("rev") > F.col("certified_rev"))).drop("__d")
    bad = (F.col("change") == "deleted") | ~allowed(F.col("class"), F.col("permission"))
    return later.filter((F.col("change") != "none") & bad)


def covering_revision(signatures: DataFrame, revisions: DataFrame) -> DataFrame:
    """Adds rev: the first revision that ends at or after the signed bytes, null if none does.

    One ordered pass over both (an as-of join) instead of an inequality join.
    """
    r = revisions.select("doc_id", F.col("end_offset").alias("__at"), F.col("rev").alias("__r"), F.lit(1).alias("__k"))
    both = signatures.withColumn("__at", F.col("coverage_end")).withColumn("__k", F.lit(0)).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy("doc_id").orderBy("__at", "__k").rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn("rev", F.first("__r", ignorenulls=True).over(w)).filter("__k = 0").drop("__at", "__r", "__k")


RULES = (
    ("no_identifier", "the metadata name no conformance", "pdfa_part is null"),
    ("no_output_intent", "no archival output intent", "not has_intent"),
    ("font_not_embedded", "a font is not embedded", "unembedded_fonts > 0"),
    ("encrypted", "the file is encrypted", "encrypted"),
    ("no_title", "the title is missing", "title is null or title = ''"),
    ("transparency", "transparency in part 1", "coalesce(pdfa_part, 1) <= 1 and (ca < 1 or smask)"),
)


def archival_violations(flags: DataFrame) -> DataFrame:
    """One row for each document and broken rule; all rules in one pass over the flags."""
    found = F.filter(F.array(*[F.when(F.expr(e), F.struct(F.lit(r).alias("rule"), F.lit(m).alias("message"))) for r, m, e in RULES]), lambda x: x.isNotNull())
    return flags.select("doc_id", F.explode(found).alias("v")).select("doc_id", "v.rule", "v.message")


def archival_verdict(flags: DataFrame) -> DataFrame:
    """Valid: conformance is claimed and no rule is broken."""
    broken = sum((F.coalesce(F.expr(e), F.lit(False)).cast("int") for _, _, e in RULES), F.lit(0))
    return flags.select("doc_id", broken.alias("n_violations"), ((broken == 0) & F.col("pdfa_part").isNotNull()).alias("valid"))


REQUIRED, READ_ONLY, NO_EXPORT = 1 << 1, 1 << 0, 1 << 2


def has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def validate_field(kind: Column, flags: Column, value: Column, max_length: Column, options: Column) -> Column:
    """Null if a field's value is fine, else what is wrong with it."""
    blank = value.isNull() | (value == "")
    return (
        F.when(has(flags, REQUIRED) & blank, "required")
        .when((kind == "Tx") & (max_length > 0) & (F.octet_length(value) > max_length), "too long")
        .when((kind == "Ch") & ~blank & ~F.array_contains(options, value), "not an option")
        .when((kind == "Btn") & ~blank & ~value.isin("Yes", "Off"), "not a state")
    )


def export_value(flags: Column, value: Column) -> Column:
    """A field's value for export; empty where it isn't to be exported."""
    return F.when(has(flags, NO_EXPORT), "").otherwise(F.coalesce(value, F.lit("")))


def fdf(fields: DataFrame) -> DataFrame:
    """One FDF text for each document from full_name, flags and value, fields in order of name."""
    from ..functions.text import pdf_escape

    kept = fields.filter(~has(F.col("flags"), NO_EXPORT))
    entry = F.concat(F.lit("<< /T ("), pdf_escape(F.col("full_name")), F.lit(") /V ("), pdf_escape(F.coalesce("value", F.lit(""))), F.lit(") >>"))
    rows = F.array_sort(F.collect_list(F.struct("full_name", entry.alias("e"))))
    body = F.array_join(F.transform(rows, lambda r: r["e"]), "\n")
    head, tail = "%FDF-1.2\n1 0 obj\n<< /FDF << /Fields [\n", "\n] >> >>\nendobj\ntrailer\n<< /Root 1 0 R >>\n%%EOF\n"
    return kept.groupBy("doc_id").agg(F.concat(F.lit(head), body, F.lit(tail)).alias("fdf"), F.count(F.lit(1)).alias("n_fields"))


def missing_keys(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """Required keys that an object of a type lacks, or holds with another kind of value.

    ``keys`` has doc_id, obj, type, key, kind; ``rules`` has type, key, kind, a row for each
    required key: a catalogue, of a size that doesn't grow with the files.
    """
    wanted = rules.select(F.col("type"), F.col("key").alias("wanted"), F.col("kind").alias("wanted_kind"))
    there = keys.groupBy("doc_id", "obj", "type").agg(F.map_from_entries(F.collect_list(F.struct("key", "kind"))).alias("held"))
    both = there.join(F.broadcast(wanted), "type")
    found = F.col("held")[F.col("wanted")]
    bad = both.filter(found.isNull() | (found != F.col("wanted_kind")))
    return bad.select("doc_id", "obj", "type", F.col("wanted").alias("key"), F.coalesce(found, F.lit("missing")).alias("found"))


def read_catalogue(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The required keys that a tab-separated catalogue file (Key, Type, Required) names for one type of object.

    Keys that take several types (separated by ";") are checked for presence alone.
    """
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    plain = F.when(~F.col("Type").contains(";"), F.col("Type"))
    return rows.filter(F.upper("Required") == "TRUE").select(F.lit(kind).alias("type"), F.col("Key").alias("key"), plain.alias("kind"))
