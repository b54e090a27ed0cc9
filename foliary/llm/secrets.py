"""Secret scans through a ledger of content-addressed blobs.

Every historical version of a path is addressed by the SHA-256 of its text. The ledger holds which
(blob, rule version) pairs were scanned and what was found; a run scans only the pairs that it
lacks, one copy of each blob, and joins the findings back to all paths that hold the blob.

Native DataFrame expressions only. The ledger is a folder of Parquet tables, one for each run.

Edge cases: a null text counts as the empty blob; a null doc_id is an id like any other; repeated
rows get the same findings; an empty table gives an empty result; other columns are never read.
Offsets are code points.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, pick

FINDING = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters; ``hints``: one of them is in every match."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    hints: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# The base rules. Runs of a fixed alphabet are matched whole, so a minimum within the
# pattern drops the same matches as one applied afterwards; the value of an assignment can hold
# another keyword, so there the minimum has to come after.
BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", hints=("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]{16,}+"),
)
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hints=("-----BEGIN ",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", hints=("eyJ",)),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
)
RULES = (*BASE, *ADDED)


def matches(text: Column, rule: Rule, kind: int) -> Column:
    """Findings of one rule: the pieces between matches, and the matches, give the offsets."""
    none = F.array().cast(FINDING)
    pattern = F.lit(rule.pattern)

    def located(gaps: Column) -> Column:
        whole = F.regexp_extract_all(text, pattern, F.lit(0))
        value = F.regexp_extract_all(text, pattern, F.lit(rule.group))
        rows = F.arrays_zip(F.transform(gaps, F.length).alias("g"), F.transform(whole, F.length).alias("w"), F.transform(value, F.length).alias("v"))
        rows = F.transform(rows, lambda r: F.struct(r["g"].alias("g"), r["w"].alias("w"), r["v"].alias("v")))
        start = F.struct(F.lit(0).alias("at"), none.alias("found"))

        def step(a: Column, r: Column) -> Column:
            begin = a["at"] + r["g"]
            end = begin + F.coalesce(r["w"], F.lit(0))
            one = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
            good = r["w"].isNotNull() & (r["v"] >= rule.least)
            return F.struct(end.alias("at"), F.when(good, F.concat(a["found"], one)).otherwise(a["found"]).alias("found"))

        return F.when(F.size(gaps) < 2, none).otherwise(F.aggregate(rows, start, step, lambda a: a["found"]))

    found = let(F.split(text, rule.pattern), located)
    if rule.hints:
        hinted = text.contains(rule.hints[0])
        for h in rule.hints[1:]:
            hinted = hinted | text.contains(h)
        found = F.when(hinted, found).otherwise(none)
    return found


class Ledger:
    """Scanned (blob, rule version) pairs and their findings, under a path in shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _runs(self) -> list[str]:
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = fs.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(fs):
            return []
        runs = [s.getPath().toString() for s in store.listStatus(fs)]
        marker = self.spark._jvm.org.apache.hadoop.fs.Path
        return [r for r in runs if store.exists(marker(f"{r}/_SUCCESS"))]  # runs that were cut short don't count

    def entries(self) -> DataFrame:
        """blob_id, the rule versions scanned, and what they found; a row for each run and blob."""
        schema = "blob_id binary, scanned array<string>, findings array<struct<rule:string,start:int,end:int>>"
        runs = self._runs()
        return self.spark.read.schema(schema).parquet(*runs) if runs else self.spark.createDataFrame([], schema)

    def update(self, versions: DataFrame, blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan what is unseen of ``versions`` (doc_id, text); ``blobs`` has their doc_id and blob_id."""
        wanted = F.array(*[F.lit(r.key) for r in rules])
        one = blobs.groupBy("blob_id").agg(F.min("doc_id").alias("rep"))
        runs = self._runs()
        if runs:
            done = self.entries().groupBy(F.col("blob_id").alias("b")).agg(F.flatten(F.collect_list("scanned")).alias("done"))
            one = one.join(done, F.col("blob_id") == F.col("b"), "left").drop("b")
            one = one.withColumn("todo", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>"))))
        else:
            one = one.withColumn("todo", wanted)
        one = one.filter(F.size("todo") > 0).select("blob_id", "rep", "todo")
        text = F.coalesce(F.col("text"), F.lit(""))
        content = versions.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))
        texts = content.join(one, (F.col("blob") == F.col("blob_id")) & F.col("doc_id").eqNullSafe(F.col("rep")))
        found = F.concat(*[
            F.when(F.array_contains("todo", r.key), matches(F.col("text"), r, k)).otherwise(F.array().cast(FINDING))
            for k, r in enumerate(rules)
        ])
        keys = F.array(*[F.lit(r.key) for r in rules])
        named = F.transform(
            F.col("found"), lambda f: F.struct(F.get(keys, f["kind"]).alias("rule"), f["start"].alias("start"), f["end"].alias("end"))
        )
        scanned = texts.select("blob_id", F.col("todo").alias("scanned"), found.alias("found"))
        scanned.select("blob_id", "scanned", named.alias("findings")).dropDuplicates(["blob_id"]).write.parquet(
            f"{self.path}/run-{uuid.uuid4().hex}"
        )

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob_id and its findings under these rule versions, for blobs with any."""
        current = F.array(*[F.lit(r.key) for r in rules])
        kinds = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.key), F.lit(k))])
        rows = self.entries().filter(F.size("findings") > 0)
        merged = rows.groupBy("blob_id").agg(F.flatten(F.collect_list("findings")).alias("f"))  # a row for each run
        kept = F.filter("f", lambda f: F.array_contains(current, f["rule"]))
        ordered = F.transform(kept, lambda f: F.struct(f["start"].alias("start"), kinds[f["rule"]].alias("kind"), f["end"].alias("end")))
        return merged.select("blob_id", F.sort_array(ordered).alias("findings"))


def find(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts and digest of the base rules' spans, and all spans, for every version."""
    versions = pick(versions, "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    blobs = cut(versions.select("doc_id", F.unhex(F.sha2(text, 256)).alias("blob_id")), "blobs")
    ledger.update(versions, blobs, rules)
    # Written first: a join of two plain exchanges is one that Spark can split where a blob is hot.
    found = cut(ledger.findings(rules), "findings").withColumnRenamed("blob_id", "b")
    joined = blobs.join(found, F.col("blob_id") == F.col("b"), "left")
    joined = joined.withColumn("all", F.coalesce("findings", F.array().cast(FINDING)))
    names = F.array(*[F.lit(r.name) for r in rules])
    base = [k for k, r in enumerate(rules) if r in BASE]
    is_base = lambda f: f["kind"].isin(base)
    of_kind = lambda k: lambda f: f["kind"] == k
    spell = lambda rows: F.array_join(
        F.transform(rows, lambda f: F.concat_ws(":", F.get(names, f["kind"]), f["start"].cast("string"), f["end"].cast("string"))), ","
    )
    return joined.select(
        "doc_id",
        *[F.size(F.filter("all", of_kind(k))).cast("long").alias(f"n_{rules[k].name}") for k in base],
        F.sha2(spell(F.filter("all", is_base)), 256).alias("base_sha256"),
        spell(F.col("all")).alias("spans"),
    )
