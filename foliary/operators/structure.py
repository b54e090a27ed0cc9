"""Trees and marked-up metadata: outlines, inheritance, elements and attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten(nodes: DataFrame, depth_limit: int = 64) -> DataFrame:
    """Paths and depths of a forest of (id, parent, title), by a recursive query.

    Cycles can't be reached from a root, and ``depth_limit`` bounds the recursion.
    """
    return nodes.sparkSession.sql(
        """
        WITH RECURSIVE tree MAX RECURSION LEVEL {limit} AS (
          SELECT id, title AS path, 0 AS depth FROM {nodes} WHERE parent IS NULL
          UNION ALL
          SELECT n.id, concat(t.path, '/', n.title), t.depth + 1 FROM tree t JOIN {nodes} n ON n.parent = t.id)
        SELECT id, path, depth FROM tree""",
        nodes=nodes,
        limit=depth_limit,
    )


def element(xml: Column, name: str) -> Column:
    """Content of the first element of this name, empty if there is none."""
    return F.regexp_extract(xml, f"<{name}[^>]*>(.*?)</{name}>", 1)


def attribute(xml: Column, tag: str, name: str) -> Column:
    return F.regexp_extract(xml, f'<{tag}[^>]*\\s{name}="([^"]*)"', 1)


def metadata(xml: Column) -> Column:
    """Title, creator, subjects and conformance of an XMP packet, in element form."""
    first = lambda tag: F.trim(F.regexp_extract(xml, f"(?s)<{tag}>.*?<rdf:li[^>]*>(.*?)</rdf:li>", 1))
    subjects = F.regexp_extract_all(F.regexp_extract(xml, "(?s)<dc:subject>(.*?)</dc:subject>", 1), F.lit("(?s)<rdf:li[^>]*>(.*?)</rdf:li>"), F.lit(1))
    plain = lambda tag: F.trim(element(xml, tag))
    return F.struct(
        first("dc:title").alias("title"), first("dc:creator").alias("creator"), first("dc:description").alias("description"), subjects.alias("subjects"),
        plain("xmp:CreatorTool").alias("creator_tool"), plain("pdf:Producer").alias("producer"), plain("xmp:CreateDate").alias("created"),
        plain("pdfaid:part").try_cast("int").alias("pdfa_part"), plain("pdfaid:conformance").alias("conformance"),
    )
