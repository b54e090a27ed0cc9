"""Host-level quality rules: per-document rules, shrunk failure rates per host, joined verdicts.

Every document is held against five rules. For each rule, failures are summed by host, and a
host's rate is shrunk by an empirical beta prior that all other hosts give: its mean is their rate,
its strength comes from their spread beyond what sampling explains (method of moments). A host is
rejected by a rule if its shrunk rate lies over ``DEVIATIONS`` of the prior's standard deviations
above the prior's mean, and over ``LEAST_RATE``; with a host all its documents go.

Native DataFrame expressions only.

Edge cases: a null or blank text has no words and fails the base rule; a null host is a host of
its own; a table with one host has no prior, and only the base rule counts; repeated rows count as
often as they occur; an empty table gives an empty result; other columns of the input are never
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, let, pick

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host isn't rejected by a rule that a smaller share of its documents fails.
LEAST_RATE = 0.2
DEVIATIONS = 3.0
#: Bounds of the prior's strength, in documents: a host with many more speaks for itself.
STRENGTH = (1.0, 100.0)


def rules() -> dict[str, Column]:
    """What a document fails, by its figures."""
    n = F.col("n_words")
    return {
        "words": n < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "length": (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 12 * n),
    }


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != F.lit(""))


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs at least twice in the text.

    Sorting (hash, words, position) puts equal windows side by side, so the work is n log n for any
    text; words are compared only where hashes are equal. Texts whose hashes all differ are done.
    """

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

        def placed(h: Column) -> Column:
            return F.transform(
                h,
                lambda x, i: F.struct(
                    x.alias("h"), F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("p")
                ),
            )

        def covered(s: Column) -> Column:
            # Null past either end: coalesce makes the comparison false there.
            def twin(x: Column, i: Column) -> Column:
                def same(y: Column) -> Column:
                    return F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

                return same(F.get(s, i - 1)) | same(F.get(s, i + 1))

            at = F.sort_array(F.transform(F.filter(s, twin), lambda x: x["p"]))
            start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
            step = lambda a, p: F.struct(
                p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")
            )
            return F.aggregate(at, start, step, lambda a: a["n"])

        def repeats(h: Column) -> Column:
            return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(F.sort_array(placed(h)), covered))

        return F.when(F.size(w) < 3, 0).otherwise(let(hashes, repeats))

    return let(words, count).cast("long")


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the six figures of each whole text, with ``base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    raw = pick(docs, *dict.fromkeys(("doc_id", "text", host))).select(
        "doc_id",
        F.col(host).alias("host"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(
            lines,
            lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")),
        ).alias("l"),
        let(
            words_of(text),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")),
        ).alias("w"),
    )
    n, r = F.col("w.n_words"), F.col("w.n_repeat_words")
    return raw.select(
        "doc_id", "host", n.alias("n_words"), "word_chars", "n_symbols", F.col("l.n").alias("n_lines"),
        F.col("l.dup").alias("n_dup_lines"), r.alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)).alias("base_failed"),
    )


def host_verdicts(measured: DataFrame) -> DataFrame:
    """Of each host: its documents, its highest shrunk rate, and the rules that reject it.

    Partial aggregation makes one host with a third of all rows as cheap as any other; the sums
    over all hosts are one row.
    """
    failed = {name: F.sum(fails.cast("long")).alias(f"f_{name}") for name, fails in rules().items()}
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), *failed.values())
    n = F.col("host_docs").cast("double")
    sums = [F.sum(F.col(f"f_{r}")).alias(f"f_{r}") for r in failed]
    squares = [F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / n).alias(f"q_{r}") for r in failed]
    total = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum("host_docs").alias("n"), *sums, *squares).first()
    if not total["k"]:
        return hosts.select("host", "host_docs", F.lit(0.0).alias("host_rate"), F.lit("").alias("host_failed"))
    rates, names = [], []
    others = F.nullif(F.lit(float(total["n"])) - n, F.lit(0.0))  # null: there are none, and no prior
    for r in failed:
        f = F.col(f"f_{r}").cast("double")
        hosts = hosts.withColumn(f"m_{r}", (F.lit(float(total[f"f_{r}"])) - f) / others)
        mean = F.col(f"m_{r}")
        within = mean * (1 - mean)
        spread = F.greatest(F.lit(0.0), (F.lit(total[f"q_{r}"]) - f * f / n) / others - mean * mean)
        hosts = hosts.withColumn(f"v_{r}", spread).withColumn(f"b_{r}", F.col(f"v_{r}") - within * F.lit(total["k"] - 1.0) / others)
        fitted = F.least(F.lit(STRENGTH[1]), F.greatest(F.lit(STRENGTH[0]), (within - F.col(f"v_{r}")) / F.col(f"b_{r}")))
        hosts = hosts.withColumn(f"s_{r}", F.when(F.col(f"b_{r}") > 0, fitted).otherwise(STRENGTH[1]))
        strength = F.col(f"s_{r}")
        hosts = hosts.withColumn(f"r_{r}", F.coalesce((f + mean * strength) / (n + strength), f / n))
        limit = F.greatest(F.lit(LEAST_RATE), mean + DEVIATIONS * F.sqrt(within / (strength + 1)))
        rates.append(F.col(f"r_{r}"))
        names.append(F.when(others.isNotNull() & (F.col(f"r_{r}") > limit), r))
    return hosts.select("host", "host_docs", F.greatest(*rates).alias("host_rate"), F.concat_ws(",", *names).alias("host_failed"))


def apply_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: figures, ``base_failed``, its host's highest rate and failed rules, and ``kept``.

    The figures are written once to the shared folder, since both the aggregate and the join
    back need them.
    """
    measured = cut(measure(docs, host), "rules")
    hosts = host_verdicts(measured).withColumnRenamed("host", "__host")
    joined = measured.join(hosts, F.col("host").eqNullSafe(F.col("__host")), "left").drop("__host")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_failed") == ""))
