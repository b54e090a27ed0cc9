"""Documents to tokens in five stages: filter, two deduplications, mixing and tokenizing.

Every stage decides on rows, not on ids: of equal texts and of near copies one row stays, also
where rows repeat or share a doc_id, or have none. All but the last stage return the columns of
the documents, whatever others there are.

Edge cases: null and empty texts are scored, deduplicated, mixed and encoded like any other (an
empty text has no ids); null languages and sources are categories of their own; ties between equal
texts go to the largest doc_id and those between near copies to the least; without labels of both
kinds the classifier scores 0.5 and keeps every row; an empty table passes through every stage
empty; labels of documents that aren't there count for nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliary.llm import bpe, exact_dedup, mixing, quality_classifier, queries, simhash_dedup
from foliary.llm.common import discard, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    return quality_classifier.accept(docs, queries.table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest doc_id stays."""
    return simhash_dedup.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by calibrated probabilities."""
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, their number, and digests of the ids and of the decoded bytes."""
    return bpe.tokenize(docs, *queries.vocabulary(), with_ids=True)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixed", mixed), ("tokens", tokens)]

#: Compression, fingerprints and merges can't be said in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input.

    A stage's table goes when the next one is written; the last one stays until the application ends.
    """
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out, path = stage(spark, docs, sf_dir), scratch(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
