"""Mixing sources to target weights by iterative proportional fitting
(operator 8).

Documents are cells of source, language and topic, a cell's size is its tokens.
Raking multiplies cell weights until the weighted tokens of each margin have
their target shares.  The scale is set by the share of all tokens to keep, not
by any cell: a margin's value can't give more than it has, so values whose goal
is beyond that are kept whole and the others share what is missing; weights
beyond 1 are cut to 1 and the other cells of the margin are raked again.  A
document is then kept with its cell's calibrated probability, decided by a hash
of its id, so that a repeated run keeps the same ones.  Cells and margins are
tables: each step is a grouped aggregation and a join, whatever the number of
sources; as many cells as may be broadcast are raked in memory, with the same
steps."""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import discard, matched, written

#: Target share of a margin's value: its share to this power, normalised.
#: 1 leaves the mixture as it is, 0 makes all values equal.
SOURCE_POWER, LANGUAGE_POWER, TOPIC_POWER = 0.7, 0.8, 1.0
ROUNDS, TOLERANCE = 20, 1e-6
#: Share of all tokens that is kept.
KEPT = 0.75
#: A margin's kept tokens that are off the target by more than this share of it
#: are reported.
OFF = 0.01
#: Bytes of a cell with its names.
CELL_BYTES = 120
MARGINS = ("source", "lang", "topic")
LOG = logging.getLogger(__name__)


def topic(text: Column) -> Column:
    """A coarse topic by the text's form: table (bars), list (short lines), code
    (braces), dialogue (quotation marks), brief (under 1,000 characters) or
    prose, the first that fits."""
    n = F.length(text)
    count = lambda sign: n - F.length(F.replace(text, F.lit(sign), F.lit("")))
    forms = F.when(100 * count("|") > n, "table").when(80 * count("\n") > n, "list").when(100 * count("{") > n, "code")
    return forms.when(60 * count('"') > n, "dialogue").when(n < 1000, "brief").otherwise("prose")


def targets(cells: DataFrame, powers: dict[str, float]) -> DataFrame:
    """(margin, value, target) by powers of the present shares."""
    out = None
    for margin, power in powers.items():
        shares = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
        raised = shares.select(F.lit(margin).alias("margin"), "value", F.pow("tokens", F.lit(power)).alias("t"))
        whole = raised.agg(F.sum("t").alias("whole"))  # one row
        part = raised.crossJoin(F.broadcast(whole)).select("margin", "value", (F.col("t") / F.col("whole")).alias("target"))
        out = part if out is None else out.unionByName(part)
    return out


def raked(cells: DataFrame, wanted: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with weight: weighted tokens sum
    to 1 and each margin's shares reach their targets; values without a target
    have weight 0.  Where the margins don't settle in ``rounds``, the largest
    change of the last round is logged."""
    wanted = written(wanted, "targets")
    cells = written(cells.withColumn("weight", F.lit(1.0)), "cells")
    moved = None
    for _ in range(rounds):
        before = cells
        for margin in MARGINS:
            goal = wanted.filter(F.col("margin") == margin).select(F.col("value").alias(margin), "target")
            have = cells.groupBy(margin).agg(F.sum(F.col("weight") * F.col("tokens")).alias("have")).filter("have > 0")
            factor = have.join(goal, margin).select(margin, (F.col("target") / F.col("have")).alias("factor"))
            cells = cells.join(factor, margin, "left").withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(0.0))).drop("factor")
        cells = written(cells.select(*before.columns), "cells")
        moved = cells.join(before.select(*MARGINS, F.col("weight").alias("was")), list(MARGINS)).agg(F.max(F.abs(F.try_divide("weight", "was") - 1))).first()[0]
        discard(before)
        if moved is None or moved < tolerance:
            return cells
    LOG.warning("raking has not settled after %d rounds: weights still move by %.3g", rounds, moved)
    return cells


def goals(cells: DataFrame, wanted: DataFrame, kept: float) -> DataFrame:
    """(margin, value, tokens, target, goal): goal is the tokens to keep of each
    value, min(tokens, level * target), with the margin's level such that they
    sum to ``kept`` of all tokens.  A value that ``wanted`` lacks has target 0."""
    have = None
    for margin in MARGINS:
        sums = cells.groupBy(F.lit(margin).alias("margin"), F.col(margin).alias("value")).agg(F.sum("tokens").alias("tokens"))
        have = sums if have is None else have.unionByName(sums)
    have = written(have.join(wanted, ["margin", "value"], "left").withColumn("target", F.coalesce("target", F.lit(0.0))), "margins")
    level = dict.fromkeys(MARGINS, 0.0)
    while True:
        at = F.create_map(*[x for m in MARGINS for x in (F.lit(m), F.lit(level[m]))])[F.col("margin")]
        free = F.col("tokens") > at * F.col("target")
        rows = have.groupBy("margin").agg(F.sum("tokens").alias("all"), F.sum(F.when(free, 0).otherwise(F.col("tokens"))).alias("whole"), F.sum(F.when(free, F.col("target")).otherwise(0.0)).alias("share")).collect()  # one row a margin
        # each turn keeps more values whole; the level only rises
        new = level | {r.margin: max(level[r.margin], (kept * r["all"] - r.whole) / r.share) for r in rows if r.share > 0}
        if all(new[m] <= level[m] * (1 + 1e-12) for m in MARGINS):
            return have.withColumn("goal", F.least(F.col("tokens").cast("double"), at * F.col("target")))
        level = new


def rates(cells: DataFrame, goal: DataFrame, kept: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with probability, at most 1, raked
    from the same one everywhere: expected tokens meet each margin's goal, as far as its cells have them."""
    cells = cells.select(*MARGINS, "tokens", F.lit(float(kept)).alias("probability"))
    cells = written(cells, "cells")
    moved = None
    for _ in range(rounds):
        before = cells
        for margin in MARGINS:
            own = goal.filter(F.col("margin") == margin).select(F.col("value").alias(margin), "goal")
            full = F.col("probability") >= 1
            have = cells.groupBy(margin).agg(F.sum(F.col("probability") * F.col("tokens")).alias("have"), F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"))
            # more can only come from cells that aren't full; less from all
            more = (F.col("goal") - F.col("full")) / (F.col("have") - F.col("full"))
            factor = F.when(F.col("goal") <= F.col("have"), F.col("goal") / F.col("have")).when(F.col("have") > F.col("full"), more).otherwise(1.0)
            factors = have.filter("have > 0").join(own, margin).select(margin, factor.alias("factor"))
            cells = cells.join(factors, margin, "left").withColumn("probability", F.least(F.lit(1.0), F.col("probability") * F.coalesce("factor", F.lit(0.0)))).drop("factor")
        cells = written(cells.select(*before.columns), "cells")
        moved = cells.join(before.select(*MARGINS, F.col("probability").alias("was")), list(MARGINS)).agg(F.max(F.abs(F.col("probability") - F.col("was")))).first()[0]
        discard(before)
        if moved is None or moved < tolerance:
            return cells
    LOG.warning("raking has not settled after %d rounds: probabilities still move by %.3g", rounds, moved)
    return cells


def solved(cells: list[tuple], wanted: dict[str, dict[str, float]], kept: float, rounds: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, list[tuple]]:
    """What ``goals`` and ``rates`` give, in memory: (probabilities of the cells
    (source, lang, topic, tokens), rows of margin, value, tokens, target, goal)."""
    tokens = np.array([c[3] for c in cells], float)
    codes, goal, rows = [], [], []
    for i, margin in enumerate(MARGINS):
        values, code = np.unique(np.array([c[i] for c in cells], object), return_inverse=True)
        have = np.bincount(code, tokens, len(values))
        target = np.array([wanted.get(margin, {}).get(v, 0.0) for v in values.tolist()])
        level = 0.0
        while True:
            free = have > level * target
            share = target[free].sum()
            new = max(level, (kept * have.sum() - have[~free].sum()) / share) if share > 0 else level
            if new <= level * (1 + 1e-12):
                break
            level = new
        codes.append(code)
        goal.append(np.minimum(have, level * target))
        rows += [(margin, v, int(h), float(t), float(g)) for v, h, t, g in zip(values.tolist(), have, target, goal[-1], strict=True)]
    p, moved = np.full(len(cells), float(kept)), 0.0
    for _ in range(rounds):
        before = p
        for code, g in zip(codes, goal, strict=True):
            full = p >= 1
            have, whole = np.bincount(code, p * tokens, len(g)), np.bincount(code, np.where(full, tokens, 0), len(g))
            with np.errstate(divide="ignore", invalid="ignore"):
                factor = np.where(g <= have, g / have, np.where(have > whole, (g - whole) / (have - whole), 1.0))
            p = np.minimum(1.0, p * np.where(have > 0, factor, 0.0)[code])
        moved = np.abs(p - before).max(initial=0.0)
        if moved < tolerance:
            return p, rows
    LOG.warning("raking has not settled after %d rounds: probabilities still move by %.3g", rounds, moved)
    return p, rows


def unmet(cells: DataFrame, goal: DataFrame, kept: float, off: float = OFF) -> DataFrame:
    """(margin, value, tokens, target, share) of the margins' values whose share
    of the expected tokens is off the target by more than ``off`` of it."""
    out = None
    for margin in MARGINS:
        got = cells.groupBy(F.lit(margin).alias("margin"), F.col(margin).alias("value")).agg(F.sum(F.col("probability") * F.col("tokens")).alias("got"), F.sum("tokens").alias("own"))
        out = got if out is None else out.unionByName(got)
    whole = out.groupBy("margin").agg((F.sum("own") * kept).alias("whole"))
    out = out.drop("own").join(goal, ["margin", "value"]).join(F.broadcast(whole), "margin").withColumn("share", F.col("got") / F.col("whole"))
    return out.filter(F.abs(F.col("share") - F.col("target")) > off * F.col("target")).select("margin", "value", "tokens", "target", "share")


def mix(documents: DataFrame, powers: dict[str, float] | None = None, wanted: DataFrame | None = None, rounds: int = ROUNDS, kept: float = KEPT, topics: Column | None = None) -> DataFrame:
    """``documents`` (doc_id, text, source, lang, ...) with topic, n_tokens
    (words), probability and sampled; columns of these names are replaced.

    ``kept`` of all tokens are kept in expectation, with the target shares of
    each margin; a value that has less than its target asks is kept whole and
    the others share the rest.  Margins that miss their target are logged, and
    so is raking that doesn't settle.  ``wanted``: (margin, value, target); by
    default powers of the present shares; a value that it lacks has target 0:
    none of its documents with words is sampled.  ``topics``: each document's
    topic; by default its form.  Null sources, languages and topics are the
    value ''.  A document without words says nothing about margins and has
    probability 1 if its cell has no words at all.  Rows that repeat share one
    decision; a null id is decided by its text."""
    names = [c for c in documents.columns if c not in ("topic", "n_tokens", "probability", "sampled")]
    text = F.coalesce("text", F.lit(""))
    n_tokens = F.regexp_count(text, F.lit("[^ \\t-\\r]+")).cast("long")
    rows = documents.select(*names, (F.coalesce(topics, F.lit("")) if topics is not None else topic(text)).alias("topic"), n_tokens.alias("n_tokens"))
    cell = [F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.col("topic")]
    sizes = written(rows.groupBy(*cell).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "cells")
    cells = sizes.filter("tokens > 0").drop("docs")
    powers = powers or {"source": SOURCE_POWER, "lang": LANGUAGE_POWER, "topic": TOPIC_POWER}
    goal = written(wanted if wanted is not None else targets(cells, powers), "targets")
    if max(sizes.count(), goal.count()) * CELL_BYTES <= common.BROADCAST_BYTES:
        # cells that would be broadcast are raked in memory, in one step; beyond, as tables
        rows_ = [tuple(r) for r in cells.select(*MARGINS, "tokens").collect()]
        by_margin: dict[str, dict[str, float]] = {}
        for margin, value, target in goal.select("margin", "value", "target").collect():
            by_margin.setdefault(margin, {})[value] = target
        p, found = solved(sorted(rows_), by_margin, kept, rounds)
        spark = documents.sparkSession
        chances = spark.createDataFrame([(*c, float(x)) for c, x in zip(sorted(rows_), p, strict=True)], "source string, lang string, topic string, tokens long, probability double")
        goal = spark.createDataFrame(found, "margin string, value string, tokens long, target double, goal double")
    else:
        goal = written(goals(cells, goal, kept), "goals")
        chances = rates(cells, goal, kept, rounds)
    missed = written(unmet(chances, goal, kept), "unmet")
    if n := missed.count():
        worst = missed.orderBy(F.desc(F.abs(F.col("share") - F.col("target")))).limit(10).collect()
        LOG.warning("%d values miss their target share of tokens; furthest: %s", n, [(r.margin, r.value, round(r.target, 6), round(r.share, 6)) for r in worst])
    named = chances.join(sizes.drop("tokens"), list(MARGINS)).select(*[F.col(m).alias(f"_{m}") for m in MARGINS], F.col("probability").alias("_probability"), "docs")
    by = [c.alias(f"_{m}") for c, m in zip(cell, MARGINS, strict=True)]
    joined = matched(rows.select("*", *by), written(named, "rates"), [f"_{m}" for m in MARGINS], CELL_BYTES, "docs", F.xxhash64("doc_id", "n_tokens"))
    chance = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit("mix"))).otherwise(F.xxhash64("doc_id", F.lit("mix"))), F.lit(1 << 30)) / float(1 << 30)
    probability = F.coalesce("_probability", F.lit(1.0))
    return joined.select(*names, "topic", "n_tokens", F.round(probability, 9).alias("probability"), (chance < probability).alias("sampled"))
