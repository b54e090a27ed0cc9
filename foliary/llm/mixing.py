"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed for every cell of source, language and topic. The cells are raked until
their marginals meet the targets; raked over observed share is a cell's factor, and a document is
sampled with a probability in proportion to it. The probabilities are as large as they can be
without any above one, so the expected marginals are the targets.

Every source, language and topic has a target of its own, however many there are. Up to
``LOCAL_CELLS`` cells are raked on the driver and broadcast; beyond that marginals and factors are
tables, summed and joined back axis by axis. Values count as one, "(other)", only where the caller
asks for it: by a least share of the rows for an axis, or by giving "(other)" a target.

Edge cases: null source, language or text have categories "(none)" or count as empty text; a
document without words belongs to a cell like any other but weighs nothing; the draw depends on
doc_id and seed alone, so repeated rows stay or go together and a rerun draws alike; targets that
can't be met together are met as far as raking gets, with a warning; where all weights tie every
probability is one; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, pick

OTHER, NONE = "(other)", "(none)"
AXES = ("source", "lang", "topic")
#: Cells that the driver collects and rakes, and that are broadcast; checked by counting them.
LOCAL_CELLS = 100_000
#: Targets are the observed shares to this power, renormalised: below 1 they are evened out.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.9}
SEED = 20240601


def topic_of(text: Column, words: Column) -> Column:
    """A coarse genre from the text alone; five values. Callers with topics of their own pass another function."""
    return (
        F.when(text.rlike("(?i)license|copyright|©"), "legal")
        .when(text.contains("@") | text.contains("+1 ("), "contact")
        .when(text.rlike(r"[#*$%&|]{3}"), "markup")
        .when(words >= 400, "long")
        .otherwise("short")
    )


#: Largest miss of a marginal (a share) that passes without a warning.
TOLERATED = 1e-4


def _warn(off: float) -> None:
    """Targets that exclude each other, as where a topic has but one language, can't all be met."""
    if off > TOLERATED:
        warnings.warn(f"the targets exclude each other: a marginal is off by {off:.2g} after the last round", stacklevel=3)


def rake(weights: np.ndarray, codes: np.ndarray, targets: list[np.ndarray], rounds: int = 1000, within: float = 1e-10) -> np.ndarray:
    """Cell weights whose marginals along each axis are the targets; a warning says where they can't be.

    ``codes`` has a row for each cell with its category along every axis. Targets of categories
    without weight are dropped and the rest renormalised.
    """
    w = weights / max(weights.sum(), 1e-300)
    goals = []
    for axis, goal in enumerate(targets):
        there = np.bincount(codes[:, axis], w, len(goal)) > 0
        goals.append(np.where(there, goal, 0) / max(goal[there].sum(), 1e-300))
    for _ in range(rounds):
        worst = 0.0
        for axis, goal in enumerate(goals):
            have = np.bincount(codes[:, axis], w, len(goal))
            ratio = np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)
            worst = max(worst, np.abs(goal - have).max(initial=0))
            w = w * ratio[codes[:, axis]]
        if worst < within:
            break
    else:
        _warn(worst)
    return w


def rake_tables(cells: DataFrame, targets: dict[str, dict[str, float]], rounds: int = 1000, within: float = 1e-10) -> DataFrame:
    """Cells with their ``factor``, raked over observed share, as ``rake`` has it; nothing is gathered.

    Only goals and factors, a row for each category, are written between the steps.
    """
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    shares = cells.select(*AXES, (F.col("tokens") / F.lit(max(total, 1e-300))).alias("share"))
    goals, factors = {}, {}
    for axis in AXES:
        have = shares.groupBy(axis).agg(F.sum("share").alias("have"))
        given = targets.get(axis)
        if given:
            named = spark.createDataFrame([(k, float(v)) for k, v in given.items()], f"{axis} string, goal double")
            have = have.join(named, axis, "left").withColumn("goal", F.coalesce("goal", F.lit(0.0)))
        else:
            have = have.withColumn("goal", F.pow("have", F.lit(TEMPER[axis])))
        have = cut(have.select(axis, F.when(F.col("have") > 0, F.col("goal")).otherwise(0.0).alias("goal")), "goals")
        whole = max(have.agg(F.sum("goal")).first()[0] or 0.0, 1e-300)
        goals[axis] = have.select(axis, (F.col("goal") / F.lit(whole)).alias("goal"))
        factors[axis] = have.select(axis, F.lit(1.0).alias(f"by_{axis}"))

    def joined() -> DataFrame:
        out = shares
        for axis in AXES:
            out = out.join(factors[axis], axis)
        return out.withColumn("factor", F.col("by_source") * F.col("by_lang") * F.col("by_topic"))

    for _ in range(rounds):
        worst = 0.0
        for axis in AXES:
            have = joined().groupBy(axis).agg(F.sum(F.col("share") * F.col("factor")).alias("have"))
            ratio = F.when(F.col("have") > 0, F.col("goal") / F.col("have")).otherwise(0.0)
            step = have.join(goals[axis], axis).join(factors[axis], axis)
            step = cut(step.select(axis, (F.col(f"by_{axis}") * ratio).alias(f"by_{axis}"), F.abs(F.col("goal") - F.col("have")).alias("off")), "factors")
            worst = max(worst, step.agg(F.max("off")).first()[0] or 0.0)
            factors[axis] = step.drop("off")
        if worst < within:
            break
    else:
        _warn(worst)
    return joined().select(*AXES, "share", "factor")


def _names(cells: DataFrame, axis: str, given: dict[str, float], least: float) -> DataFrame:
    """(axis, name): "(other)" where neither a target names the value nor its share of rows is at least ``least``."""
    counts = cells.groupBy(axis).agg(F.sum("docs").alias("docs"))
    total = counts.agg(F.sum("docs")).first()[0] or 0
    stay = F.col(axis).isin(list(given)) | (F.col("docs") >= F.lit(least * total))
    return counts.select(axis, F.when(stay, F.col(axis)).otherwise(OTHER).alias("name"))


class Plan(NamedTuple):
    """Names of lumped axes, the probability of every cell, and whether the cells are few."""

    names: dict[str, DataFrame]
    cells: DataFrame
    few: bool

    def attach(self, rows: DataFrame, prefix: str = "") -> DataFrame:
        """Rows with ``probability``; their categories are in the axes' columns with ``prefix``."""
        for axis, names in self.names.items():
            names = names.select(F.col(axis).alias("__value"), F.col("name").alias("__name"))
            rows = rows.join(names, F.col(prefix + axis) == F.col("__value")).withColumn(prefix + axis, F.col("__name")).drop("__value", "__name")
        cells = self.cells.select(*[F.col(a).alias(f"__cell_{a}") for a in AXES], F.col("probability").alias(prefix + "probability"))
        same = [F.col(prefix + a) == F.col(f"__cell_{a}") for a in AXES]
        found = rows.join(F.broadcast(cells) if self.few else cells, same[0] & same[1] & same[2], "left")
        return found.drop(*[f"__cell_{a}" for a in AXES])


def plan(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, least_share: dict[str, float] | None = None) -> Plan:
    """Probabilities from rows with their categories and tokens.

    ``targets`` maps an axis to shares by value; an axis without has the tempered observed shares.
    ``least_share`` maps an axis to the share of rows below which values count as "(other)".
    """
    spark, targets, least_share = rows.sparkSession, targets or {}, least_share or {}
    table = cut(rows.groupBy(*AXES).agg(F.sum("tokens").cast("double").alias("tokens"), F.count(F.lit(1)).alias("docs")), "cells")
    names = {}
    for axis in AXES:
        given = targets.get(axis) or {}
        if axis in least_share or OTHER in given:
            names[axis] = _names(table, axis, given, least_share.get(axis, 2.0))
    if names:
        lumped = table
        for axis, named in names.items():
            lumped = lumped.join(named, axis).withColumn(axis, F.col("name")).drop("name")
        table = cut(lumped.groupBy(*AXES).agg(F.sum("tokens").alias("tokens")), "cells")
    if table.count() > LOCAL_CELLS:
        raked = cut(rake_tables(table, targets), "raked")
        top = raked.filter("share > 0").agg(F.max("factor")).first()[0] or 0.0
        chance = F.when(F.col("share") > 0, F.col("factor") / F.lit(top)).otherwise(1.0) if top > 0 else F.lit(1.0)
        return Plan(names, raked.select(*AXES, chance.alias("probability")), False)
    cells = table.orderBy(*AXES).collect()
    schema = "source string, lang string, topic string, probability double"
    if not cells:
        return Plan(names, spark.createDataFrame([], schema), True)
    weights = np.array([c["tokens"] or 0.0 for c in cells])
    codes, goals = [], []
    for axis in AXES:
        values = sorted({c[axis] for c in cells})
        at = {n: i for i, n in enumerate(values)}
        code = np.array([at[c[axis]] for c in cells])
        have = np.bincount(code, weights, len(values))
        given = targets.get(axis)
        goals.append(np.array([given.get(n, 0.0) for n in values]) if given else have ** TEMPER[axis])
        codes.append(code)
    raked = rake(weights, np.array(codes).T, goals)
    share = weights / max(weights.sum(), 1e-300)
    factor = np.divide(raked, share, out=np.zeros_like(raked), where=share > 0)
    factor[share == 0] = factor.max(initial=0)  # nothing to weigh: such documents cost no tokens
    top = factor.max(initial=0)
    chance = factor / top if top > 0 else np.ones_like(factor)
    listed = [(*[c[a] for a in AXES], float(p)) for c, p in zip(cells, chance, strict=True)]
    return Plan(names, spark.createDataFrame(listed, schema), True)


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) fixed by the id."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) / F.lit(float(1 << 53))


Topic = Callable[[Column, Column], Column]


def _measured(docs: DataFrame, topic: Topic, prefix: str = "") -> DataFrame:
    """Rows with the axes' categories and the number of words, each worked out once.

    Words are counted without an array of them, so a very long text costs a copy or two of itself.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]++", "x")
    counted = docs.withColumn(prefix + "tokens", F.length(F.translate(marks, SPACES, "")).cast("long"))
    found = {"source": F.coalesce("source", F.lit(NONE)), "lang": F.coalesce("lang", F.lit(NONE)), "topic": topic(text, F.col(prefix + "tokens"))}
    return counted.withColumns({prefix + k: v for k, v in found.items()})


def mix(
    docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, seed: int = SEED, least_share: dict[str, float] | None = None,
    topic: Topic = topic_of,
) -> DataFrame:
    """doc_id, its cell and tokens, the cell's probability, and whether the document is drawn.

    ``topic`` makes the topic's column from the text and its number of words.
    """
    base = pick(docs, "doc_id", "text", "lang", "source")
    rows = cut(_measured(base, topic).select("doc_id", *AXES, "tokens"), "mixing")
    found = plan(rows, targets, least_share).attach(rows)
    return found.withColumn("selected", draw(F.col("doc_id"), seed) < F.col("probability"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, seed: int = SEED, topic: Topic = topic_of) -> DataFrame:
    """The input rows that are drawn, all columns; each is decided where it is read."""
    base = _measured(pick(docs, "text", "lang", "source"), topic).select(*AXES, "tokens")
    marked = plan(base, targets).attach(_measured(docs, topic, "__mix_"), "__mix_")
    return pick(marked.filter(draw(F.col("doc_id"), seed) < F.col("__mix_probability")), *docs.columns)
