"""Search: exact hits with context, inverted trigram index, and fuzzy search by diagonal votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import context, edit_distance, fold, let, positions, trigram_similarity, trigrams


def hits(docs: DataFrame, term: str, case_sensitive: bool = True, overlapping: bool = True, around: int = 30) -> DataFrame:
    """One row for each occurrence: doc_id, start (code points), context."""
    text = F.coalesce(F.col("text"), F.lit(""))
    within, wanted = (text, term) if case_sensitive else (fold(text), term.translate(str.maketrans(_UPPER, _UPPER.lower())))
    found = docs.filter(within.contains(wanted)).select("doc_id", "text", F.explode(positions(within, wanted, overlapping)).alias("start"))
    return found.select("doc_id", "start", context(F.col("text"), F.col("start"), len(term), around).alias("context"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def limit_per_document(found: DataFrame, most: int) -> DataFrame:
    """The first hits of each document in order; a limit of zero or less keeps all."""
    if most <= 0:
        return found
    w = Window.partitionBy("doc_id").orderBy("start")
    return found.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def trigram_index(docs: DataFrame, text: str = "text") -> DataFrame:
    """Postings: one row for each trigram and document, with its offsets.

    A frequent trigram is split by document, so no row holds more than one document's offsets.
    """
    rows = docs.select("doc_id", F.posexplode(trigrams(F.coalesce(F.col(text), F.lit("")))).alias("at", "trigram"))
    return rows.groupBy("trigram", "doc_id").agg(F.sort_array(F.collect_list("at")).alias("positions"))


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences of each trigram and documents that have it, combined in each task first."""
    grams = trigrams(F.coalesce(F.col(text), F.lit("")))
    # Every occurrence, and once more each distinct trigram of the document, in one pass.
    marked = lambda g: F.concat(F.transform(g, lambda x: F.struct(x.alias("g"), F.lit(0).alias("d"))), F.transform(F.array_distinct(g), lambda x: F.struct(x.alias("g"), F.lit(1).alias("d"))))
    rows = docs.select(F.explode(let(grams, marked)).alias("t"))
    return rows.groupBy(F.col("t.g").alias("trigram")).agg(F.sum(1 - F.col("t.d")).alias("n_positions"), F.sum("t.d").alias("n_docs"))


CANDIDATES = 64
LEAST_SIMILARITY, LEAST_SCORE = 0.25, 0.55


def fuzzy(docs: DataFrame, query: str) -> DataFrame:
    """Approximate occurrences of a query of at least four characters: doc_id, start, length, score.

    Every trigram that a text shares with the query votes for the diagonal on which it lies. A
    document's 64 diagonals with most votes (the operator's definition, ties to the earlier) are
    verified: the first length within the edit bound whose trigram sets are similar enough counts.
    """
    n = len(query)
    if n < 4:
        raise ValueError("a fuzzy query has at least four characters")
    edits = max(1, n // 4)
    grams = [query[i : i + 3] for i in range(n - 2)]
    least = max(1, len(grams) // 3)
    offsets: dict[str, list[int]] = {}
    for i, g in enumerate(grams):
        offsets.setdefault(g, []).append(i)
    known = F.create_map(*[x for g, at in offsets.items() for x in (F.lit(g), F.array(*[F.lit(i) for i in at]))])
    text = F.coalesce(F.col("text"), F.lit(""))
    # Only trigrams of the query are exploded: the text is filtered before any row is made.
    listed = F.array(*[F.lit(g) for g in offsets])
    tagged = F.transform(trigrams(text), lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    shared = F.filter(tagged, lambda t: F.array_contains(listed, t["g"]))
    rows = docs.select("doc_id", F.explode(shared).alias("t"))
    votes = rows.select("doc_id", F.explode(F.transform(known[F.col("t.g")], lambda o: F.col("t.i") - o)).alias("start"))
    counted = votes.filter("start >= 0").groupBy("doc_id", "start").agg(F.count(F.lit(1)).alias("votes")).filter(F.col("votes") >= least)
    w = Window.partitionBy("doc_id").orderBy(F.desc("votes"), "start")
    best = counted.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= CANDIDATES)
    starts = best.groupBy("doc_id").agg(F.sort_array(F.collect_list("start")).alias("starts"))
    wanted = F.array(*[F.lit(g) for g in grams])
    lengths = F.array(*[F.lit(k) for k in range(n - edits, n + edits + 1)])

    def verified(start, size):
        piece = F.substring(text, start + 1, size)
        d = edit_distance(piece, F.lit(query), edits)
        tri = trigram_similarity(trigrams(piece), wanted)
        score = 0.55 * (1 - d / F.greatest(F.lit(n), size)) + 0.45 * tri
        good = (d <= edits) & (tri >= LEAST_SIMILARITY) & (score >= LEAST_SCORE) & (F.length(piece) == size)
        return F.when(good, F.struct(start.alias("start"), size.alias("length"), F.round(score, 6).alias("score")))

    first = lambda s: F.filter(F.transform(lengths, lambda k: verified(s, k)), lambda r: r.isNotNull())
    found = docs.select("doc_id", "text").join(starts, "doc_id")
    found = found.select("doc_id", F.explode(F.transform("starts", lambda s: F.get(first(s), F.lit(0)))).alias("r")).filter("r is not null")
    return found.select("doc_id", "r.start", "r.length", "r.score")
