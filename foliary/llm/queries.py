"""Queries and SQL of this subpackage, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    chat_format,
    exact_dedup,
    html_extract,
    mixing,
    pii,
    quality_classifier,
    quality_rules,
    secrets,
    simhash_dedup,
)
from .common import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the public vocabulary; other callers pass their own."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.group(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(table(spark, sf_dir, "documents"), *vocabulary())


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"), secrets.Ledger(spark, scratch(spark, "ledger")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).drop("host").withColumn("host_rate", F.round("host_rate", 6))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_simhash_dedup,
        op3_chat_formatting,
        op4_exact_dedup,
        op5_quality_classifier,
        op6_pii,
        op7_byte_bpe,
        op8_secret_scans,
        op9_quality_rules,
        op10_source_mixing,
    )
}

OP4_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
g AS (
  SELECT doc_id, source, text, words, len(words) AS n_words,
         [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, len(words) - 1)] AS grams
  FROM w),
p AS (SELECT doc_id, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS pos FROM g WHERE n_words > 2),
d AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words
      FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS place FROM d WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT g.doc_id, source, CAST(n_words AS BIGINT) AS n_words,
         CAST(len(list_aggregate(words, 'string_agg', '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM g LEFT JOIN r USING (doc_id)),
b AS (
  SELECT doc_id, source, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m),
e AS (
  SELECT source, 1 AS place, 'words' AS rule, n_words < 50 AS fails FROM b
  UNION ALL SELECT source, 2, 'repeats', 100 * n_repeat_words > 50 * n_words FROM b
  UNION ALL SELECT source, 3, 'symbols', 10 * n_symbols > n_words FROM b
  UNION ALL SELECT source, 4, 'lines', 10 * n_dup_lines > 3 * n_lines FROM b
  UNION ALL SELECT source, 5, 'length', word_chars < 3 * n_words OR word_chars > 12 * n_words FROM b),
h AS (SELECT source, place, rule, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(fails AS INT)) AS DOUBLE) AS f FROM e GROUP BY ALL),
s AS (SELECT rule, count(*) AS k, sum(n) AS tn, sum(f) AS tf, sum(f * f / n) AS tq FROM h GROUP BY rule),
t AS (SELECT h.*, tn - n AS others, k - 1 AS k, (tf - f) / nullif(tn - n, 0) AS mean, (tq - f * f / n) / nullif(tn - n, 0) AS q FROM h JOIN s USING (rule)),
u AS (SELECT *, mean * (1 - mean) AS within_, greatest(0, q - mean * mean) AS spread FROM t),
v AS (SELECT *, CASE WHEN spread - within_ * k / others > 0
        THEN least(100.0, greatest(1.0, (within_ - spread) / (spread - within_ * k / others))) ELSE 100.0 END AS strength FROM u),
w2 AS (SELECT source, place, rule, n, CASE WHEN others > 0 THEN (f + mean * strength) / (n + strength) ELSE f / n END AS rate,
         others > 0 AND (f + mean * strength) / (n + strength) > greatest(0.2, mean + 3 * sqrt(within_ / (strength + 1))) AS rejects FROM v),
x AS (SELECT source, CAST(any_value(n) AS BIGINT) AS host_docs, max(rate) AS host_rate,
        coalesce(string_agg(rule, ',' ORDER BY place) FILTER (rejects), '') AS host_failed FROM w2 GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, host_docs,
       round(host_rate, 6) AS host_rate, host_failed, NOT base_failed AND host_failed = '' AS kept
FROM b JOIN x ON b.source IS NOT DISTINCT FROM x.source
"""


#: Kinds in order: name, pattern, group whose length counts, least length.
SECRET_KINDS = r'''
SELECT 0 AS kind, 'assign' AS name, doc_id, string_split_regex(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps,
  regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS whole,
  regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS measured, 12 AS least FROM d
UNION ALL SELECT 1, 'access', doc_id, string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), 18 FROM d
UNION ALL SELECT 2, 'hex', doc_id, string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), 16 FROM d
UNION ALL SELECT 3, 'pem', doc_id, string_split_regex(text, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----'), regexp_extract_all(text, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----'),
  regexp_extract_all(text, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----'), 0 FROM d
UNION ALL SELECT 4, 'jwt', doc_id, string_split_regex(text, 'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+'), regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+'),
  regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+'), 0 FROM d
UNION ALL SELECT 5, 'forge', doc_id, string_split_regex(text, 'gh[pousr]_[A-Za-z0-9]{36,}'), regexp_extract_all(text, 'gh[pousr]_[A-Za-z0-9]{36,}'), regexp_extract_all(text, 'gh[pousr]_[A-Za-z0-9]{36,}'), 0 FROM d
UNION ALL SELECT 6, 'chat', doc_id, string_split_regex(text, 'xox[abprs]-[A-Za-z0-9-]{10,}'), regexp_extract_all(text, 'xox[abprs]-[A-Za-z0-9-]{10,}'), regexp_extract_all(text, 'xox[abprs]-[A-Za-z0-9-]{10,}'), 0 FROM d
'''

OP8_SQL = f'''
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS ({SECRET_KINDS}),
m AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM k),
s AS (SELECT doc_id, kind, name, length(whole[i]) AS size,
             list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN whole[1:i - 1]]), 0) AS start
      FROM m WHERE length(measured[i]) >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        coalesce(string_agg(name || ':' || start || ':' || (start + size), ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base,
        string_agg(name || ':' || start || ':' || (start + size), ',' ORDER BY start, kind) AS spans
      FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
'''


ORACLE_SQL = {"op8_secret_scans": OP8_SQL, "op4_exact_dedup": OP4_SQL, "op9_quality_rules": OP9_SQL}
