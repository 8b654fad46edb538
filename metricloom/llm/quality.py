"""Quality rules with risk-controlled thresholds (operator 2).

Base counts come from the whole text.  Each metric has a fixed grid of cutoffs.
On labelled documents two rules are proved for each stratum (language), each
with half of its error probability, ERROR / strata; one of the two is used.

* The sequence: metrics in the order SEQUENCE, each tightened from the most
  lenient cutoff to 0 before the next one starts.  The whole rule so far is
  tested at each step: it stands if an exact binomial (Clopper-Pearson) bound
  says that it rejects at most RISK of the good documents; the first step that
  fails ends it.  Testing in a fixed order needs no correction for the number
  of steps or metrics, so about 250 good labels are enough with four strata.
* Metric by metric: a fixed-order test of each one's cutoffs, with RISK and the
  error divided by the number of metrics, so that all metrics together reject at
  most RISK however they depend on each other.  It needs about 1,850 good
  labels, but a metric that can't be tightened doesn't end the others.

The rule with cutoffs for more metrics is used, the sequence if they are equal.
Bonferroni over strata and the two rules: with probability 1 - ERROR no stratum
rejects more than RISK of its good documents.  Languages with fewer good labels
than the sequence's first step needs (a number that doesn't depend on any
document's metrics) are one stratum together, and the bound holds for them
together.  A stratum with too few labels even so gets no cutoff and keeps all
that passes the base rules, as does a language without any good label."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, ship, slices, small, written

RISK, ERROR = 0.02, 0.05
GRID = 200
SYMBOLS = b"#*$%&|<>"
METRICS = 5
#: The stratum of all languages with few labels.
POOL = "\u0000few labels"
#: Metrics in the order of the sequence: symbols, exclamation marks, length of
#: words, repeated words, repeated lines.
SEQUENCE = (0, 3, 4, 2, 1)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """The base counts of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    chars = len(b"".join(words).decode("utf-8", "replace"))
    lines, seen, dup = text.split(b"\n"), set(), 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line.split(None, 1):
            seen.add(line)
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    repeat = 0
    if len(ids) > 3:
        k = len(number) + 1
        # triples as single numbers; pairs are numbered first where a triple might overflow
        pair = ids[:-1] * k + ids[1:]
        if k > 2_000_000:
            pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        triple = pair[:-1] * k + ids[2:]
        order = np.argsort(triple, kind="stable")
        same = triple[order][1:] == triple[order][:-1]
        if same.any():
            twice = np.zeros(len(triple), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(len(ids), bool)
            for j in range(3):
                covered[j : j + len(triple)] |= twice
            repeat = int(covered.sum())
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), dup, repeat


def with_counts(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, base counts, metrics) of each row; metrics is the grid
    step, 0 .. GRID, that each share reaches."""
    ship(documents.sparkSession)

    def run(batches):
        for batch in slices(batches, "text"):
            rows = []
            for text in as_bytes(batch.column("text")):
                base = counts(text)
                n, chars = max(base[0], 1), max(base[1], 1)
                lines = text.count(b"\n") + 1 if text else 1
                shares = (base[2] / chars, base[3] / lines, base[4] / n, text.count(b"!") / chars if text else 0.0, base[1] / n / 40)
                rows.append((*base, [min(GRID, math.ceil(GRID * s)) for s in shares]))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.list_(pa.int32()))], names=["doc_id", "lang", *BASE, "metrics"])

    columns = documents.select("doc_id", "lang", "text") if "lang" in documents.columns else documents.select("doc_id", F.lit(None).cast("string").alias("lang"), "text")
    return columns.mapInArrow(run, f"doc_id long, lang string, {', '.join(f'{c} long' for c in BASE)}, metrics array<int>")


def at_most(rejected: int, n: int, risk: float, error: float) -> bool:
    """Whether ``rejected`` of ``n`` proves a rate of at most ``risk``: the
    upper Clopper-Pearson bound at 1 - error is at most risk exactly if
    P(X <= rejected | n, risk) <= error."""
    if not n or rejected / n > risk:
        return False
    k = np.arange(rejected + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in k.tolist()]) + k * math.log(risk) + (n - k) * math.log1p(-risk)
    return bool(np.exp(logs - logs.max()).sum() * math.exp(logs.max()) <= error)


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, metric, cutoff): a document whose metric exceeds the cutoff is
    rejected; no row where none is proved."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1 and doc_id is not null")
    good_rows = rows.filter("not base_failed").join(good, "doc_id").select("stratum", "metrics")
    held = good_rows.select("stratum", F.posexplode("metrics").alias("metric", "step"))
    reached = [F.when(F.col("metrics")[m] > 0, k * GRID + GRID - F.col("metrics")[m]) for k, m in enumerate(SEQUENCE)]
    path = good_rows.select("stratum", F.lit(-1).alias("metric"), F.coalesce(*reached, F.lit(METRICS * GRID)).cast("int").alias("step"))
    # at most GRID + 1 rows for each stratum and metric, METRICS * GRID + 1 for the sequence (metric -1)
    table = written(held.unionByName(path).groupBy("stratum", "metric", "step").agg(F.count("*").alias("n")), "steps")
    sizes = table.filter("metric = -1").groupBy("stratum").agg(F.sum("n").alias("labels"))
    strata = max(1, sizes.count())
    least = math.log(error / strata / 2) / math.log1p(-risk)
    pools = written(sizes.select("stratum", F.when(F.col("labels") >= least, F.col("stratum")).otherwise(POOL).alias("pool")), "pools")
    share = risk / METRICS
    table = table.join(small(pools, 80), "stratum").groupBy(F.col("pool").alias("stratum"), "metric", "step").agg(F.sum("n").alias("n"))

    schema = pa.schema([("stratum", pa.string()), ("metric", pa.int32()), ("cutoff", pa.int32())])

    def choose(key, rows):
        metric, step, count = (rows.column(c).to_numpy() for c in ("metric", "step", "n"))
        n = int(count[metric == -1].sum())
        whole = np.bincount(step[metric == -1], count[metric == -1], METRICS * GRID + 1).cumsum().astype(np.int64)
        sequence, was = {}, (-1, False)
        for i in range(METRICS * GRID):
            if whole[i] != was[0]:
                was = (whole[i], at_most(int(whole[i]), n, risk, error / strata / 2))
            if not was[1]:
                break
            sequence[SEQUENCE[i // GRID]] = GRID - 1 - i % GRID
        single = {}
        for m in range(METRICS):
            steps, was = np.bincount(step[metric == m], count[metric == m], GRID + 1).astype(np.int64), (-1, False)
            for cutoff in range(GRID - 1, -1, -1):
                if (above := int(steps[cutoff + 1 :].sum())) != was[0]:
                    was = (above, at_most(above, n, share, error / strata / 2 / METRICS))
                if not was[1]:
                    break
                single[m] = cutoff
        best = single if len(single) > len(sequence) else sequence
        return pa.Table.from_pylist([{"stratum": key[0].as_py(), "metric": m, "cutoff": c} for m, c in best.items()], schema)

    ship(rows.sparkSession)
    chosen = table.groupBy("stratum").applyInArrow(choose, "stratum string, metric int, cutoff int")
    return pools.join(chosen.withColumnRenamed("stratum", "pool"), "pool").select("stratum", "metric", "cutoff")


def judged(documents: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, failed_metrics) of each row of ``documents``.

    base_failed: under 50 words, or more than half of the words lie in repeated
    three-word windows.  Null and empty texts have zero counts and fail.  A null
    language is a stratum of its own.  Labels of one document: the worst counts.
    Repeated rows are judged alike; ids may be null (never labelled)."""
    rows = with_counts(documents)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = written(rows.withColumn("base_failed", failed).withColumn("stratum", F.coalesce("lang", F.lit(""))), "counts")
    limits = cutoffs(rows, labels, risk, error)
    limits = written(limits.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("metric", "cutoff"))).alias("limits")), "limits")  # one entry a metric
    beyond = F.filter(F.transform(F.col("metrics"), lambda m, i: F.when(m > F.col("limits")[i], i)), lambda i: i.isNotNull())
    out = rows.join(small(limits, 200), "stratum", "left").withColumn("failed_metrics", F.coalesce(beyond, F.array().cast("array<int>")))
    return out.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.size("failed_metrics") == 0)).alias("kept"), "failed_metrics")
