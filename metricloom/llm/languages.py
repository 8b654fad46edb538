"""Language identification by Bayesian evidence fusion (operator 6).

Each document brings up to four pieces of evidence, combined as log odds:

* its text: hashed byte trigrams under each language's multinomial, tempered
  because trigrams aren't independent;
* the language that its markup or record declares, through the declared
  language's confusion table;
* its address suffix, through a table of the same kind;
* its host: a prior smoothed towards the suffix's, which is smoothed towards
  that of all documents.

The languages are those that LEAST_DOCS of all documents declare.  The text
model is fitted on TRAIN distinct texts of each declared language in expectation
(all, if it has fewer), those of least hash; tables and priors are grouped aggregations over all
documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, matched, ship, slices, written

#: Distinct training texts of each language, as expected (those of least hash),
#: and documents that a language needs.
TRAIN, LEAST_DOCS = 20_000, 5
BITS = 16
#: Weight of a trigram's log likelihood ratio, and the sum's bound: text alone
#: says at most so much.
TEMPER, BOUND = 0.25, 40.0
#: Pseudo-documents with which a host's and a suffix's table starts.
HOST_WEIGHT, SUFFIX_WEIGHT = 20.0, 100.0
CONFIDENCE = 0.5


def trigrams(text: bytes) -> np.ndarray:
    """Hashed trigrams of the lower-cased letters; any run of others is one
    space.  Empty for a text without letters."""
    b = np.frombuffer(text.lower(), np.uint8)
    letter = ((b >= 97) & (b <= 122)) | (b >= 128)
    if not letter.any():
        return np.empty(0, np.int64)
    b = np.where(letter, b, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    b = np.r_[np.uint8(32), b[keep], np.uint8(32)].astype(np.uint32)
    code = b[:-2] * np.uint32(65536) + b[1:-1] * np.uint32(256) + b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def fit(documents: DataFrame, text: str, declared: str) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and log likelihoods [trigram, language].  The counts
    that reach the driver are at most 2 ** BITS for each language; the model has
    2 ** BITS values of four bytes for each."""
    ship(documents.sparkSession)
    every = documents.filter(F.col(declared).isNotNull() & (F.length(text) > 0)).select(F.col(declared).alias("declared"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    # copies of a text are counted once in ``texts``, each in ``docs``
    sizes = every.groupBy("declared", "hash").agg(F.count("*").alias("n")).groupBy("declared").agg(F.sum("n").alias("docs"), F.count("*").alias("texts"))
    sizes = written(sizes.filter(F.col("docs") >= LEAST_DOCS), "languages")
    languages = sorted(r[0] for r in sizes.select("declared").collect())
    # a number in [0, 1) from the hash: a fixed share of a language's texts lies below the bound
    place = F.shiftrightunsigned("hash", 11) / float(1 << 53)
    shares = sizes.select("declared", (F.lit(float(TRAIN)) / F.col("texts")).alias("share"))
    chosen = every.join(F.broadcast(shares), "declared").filter(place < F.col("share"))
    chosen = chosen.groupBy("declared", "hash").agg(F.first("text").alias("text")).select("declared", "text")

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            for lang, t in zip(batch.column("declared").to_pylist(), as_bytes(batch.column("text")), strict=True):
                totals.setdefault(lang, np.zeros(1 << BITS, np.int64))
                totals[lang] += np.bincount(trigrams(t), minlength=1 << BITS)
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "gram", "n"])

    sums = chosen.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = np.full((1 << BITS, max(1, len(languages))), 0.5)
    got = sums.toArrow()
    where = {lang: i for i, lang in enumerate(languages)}
    np.add.at(counts, (got.column("gram").to_numpy(), np.array([where[x] for x in got.column("lang").to_pylist()], np.int64)), got.column("n").to_numpy())
    return languages, np.log(counts / counts.sum(0)).astype(np.float32)


def scored(documents: DataFrame, languages: list[str], model: np.ndarray, text: str) -> DataFrame:
    """``documents`` without the text, with likelihoods (bounded log ratios to
    the best language; null without letters)."""
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS rows, a column a language
    names = [c for c in documents.columns if c != text]

    def run(batches):
        table = shared.value
        for batch in slices(batches, text):
            out = []
            for t in as_bytes(batch.column(text)):
                grams = trigrams(t or b"")
                if len(grams) and len(languages):
                    total = np.zeros(len(languages))
                    for a in range(0, len(grams), 1 << 16):
                        total += table[grams[a : a + (1 << 16)]].sum(0, dtype=np.float64)
                    out.append(np.maximum(TEMPER * (total - total.max()), -BOUND).tolist())
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.list_(pa.float64()))], names=[*names, "likelihoods"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name != text)
    return documents.mapInArrow(run, f"{kinds}, likelihoods array<double>")


def _table(rows: DataFrame, key: str, n: int, parent: DataFrame | None, over: str | None, weight: float, name: str) -> DataFrame:
    """(key, over, shares, docs): shares of each language among the key's
    documents, smoothed by ``weight`` documents of the parent's shares, and the
    number of these documents."""
    counts = rows.groupBy(key, *([over] if over else [])).agg(F.count("*").alias("docs"), *[F.sum(F.when(F.col("best") == i, 1).otherwise(0)).cast("double").alias(f"n{i}") for i in range(n)])
    if parent is not None:
        counts = counts.join(parent, over, "left") if over else counts.crossJoin(F.broadcast(parent))  # one row
    base = [F.col("_up")[i] if parent is not None else F.lit(1.0 / n) for i in range(n)]
    total = sum((F.col(f"n{i}") for i in range(n)), F.lit(0.0))
    share = F.array(*[(F.col(f"n{i}") + weight * base[i]) / (total + weight) for i in range(n)])
    return counts.select(key, *([over] if over else []), share.alias(name), "docs")


def identify(documents: DataFrame, text: str = "text", declared: str | None = "lang", suffix: Column | None = None, host: str | None = "source", confidence: float = CONFIDENCE) -> DataFrame:
    """The columns of ``documents`` but the text, with language, posterior and
    kept; other columns called so are replaced.

    ``declared``, ``suffix`` and ``host`` may be None.  A null in one of them
    says nothing about its row.  A row is kept if its text has a letter and the
    best language's posterior reaches ``confidence``; a null or empty text or one
    without letters has language ``und`` and posterior 0.  With no language to
    fit (no declared one has LEAST_DOCS documents) every row is ``und``.  Rows
    that repeat are judged alike; ids don't matter."""
    columns = [c for c in documents.columns if c not in ("language", "posterior", "kept", text)]
    rows = documents.select(*columns, F.col(text).alias("_text"), (F.col(declared) if declared else F.lit(None)).cast("string").alias("_declared"), (suffix if suffix is not None else F.lit(None)).cast("string").alias("_suffix"), (F.col(host) if host else F.lit(None)).cast("string").alias("_host"))
    languages, model = fit(rows, "_text", "_declared")
    n = len(languages)
    if not n:
        return documents.select(*columns, F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("kept"))
    rows = written(scored(rows, languages, model, "_text"), "scores")
    seen = rows.filter("likelihoods is not null").withColumn("best", F.array_position("likelihoods", F.array_max("likelihoods")) - 1)

    everything = seen.agg(*[F.sum(F.when(F.col("best") == i, 1).otherwise(0)).cast("double").alias(f"n{i}") for i in range(n)]).first()  # one row
    counts = [(x or 0.0) + 1.0 for x in everything]
    whole = [c / sum(counts) for c in counts]
    root = documents.sparkSession.range(1).select(F.array(*map(F.lit, whole)).alias("_up"))
    suffixes = written(_table(seen.withColumn("_suffix", F.coalesce("_suffix", F.lit(""))), "_suffix", n, root, None, SUFFIX_WEIGHT, "suffix_share"), "suffixes")
    hosts = _table(seen.filter("_host is not null").withColumn("_suffix", F.coalesce("_suffix", F.lit(""))), "_host", n, suffixes.drop("docs").withColumnRenamed("suffix_share", "_up"), "_suffix", HOST_WEIGHT, "host_share")
    # P(declared | language): one row for each declared value
    confusion = seen.filter("_declared is not null").groupBy("_declared").agg(F.count("*").alias("docs"), F.array(*[((F.sum(F.when(F.col("best") == i, 1).otherwise(0)) + 0.5) / (counts[i] + 0.5)) for i in range(n)]).alias("declared_given"))
    hosts, confusion = written(hosts, "hosts"), written(confusion, "confusion")

    # each row finds its host's, its suffix's and its declared language's table
    joined = rows.withColumn("_suffix", F.coalesce("_suffix", F.lit("")))
    spread = F.xxhash64("likelihoods")
    joined = matched(joined, hosts, ["_host", "_suffix"], 120 + 8 * n, "docs", spread)
    joined = matched(joined, suffixes, ["_suffix"], 80 + 8 * n, "docs", spread)
    joined = matched(joined, confusion, ["_declared"], 80 + 8 * n, "docs", spread)
    prior = F.coalesce("host_share", "suffix_share", F.array(*map(F.lit, whole)))
    logs = F.transform("likelihoods", lambda x, i: x + F.log(F.get(prior, i)) + F.coalesce(F.log(F.get("declared_given", i)), F.lit(0.0)))
    joined = joined.withColumn("_logs", logs).withColumn("_most", F.array_max("_logs"))
    odds = F.aggregate("_logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_most")))
    joined = joined.withColumn("_posterior", F.coalesce(1 / odds, F.lit(0.0)))
    name = F.element_at(F.array(*map(F.lit, languages)), F.array_position("_logs", F.col("_most")).cast("int"))
    return joined.select(*columns, F.when(F.col("likelihoods").isNotNull(), name).otherwise("und").alias("language"), F.round("_posterior", 6).alias("posterior"), (F.col("_posterior") >= confidence).alias("kept"))


def page_parts(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, suffix, host) of raw web pages: visible text
    without tags, scripts and styles, the html tag's language, the address's
    last label and its host."""
    body = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", "://([^/?#:]*)", 1))
    blank = lambda c: F.when(c != "", c)
    return pages.select("page_id", body.alias("text"), blank(F.lower(F.regexp_extract("html", r"(?is)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1))).alias("declared"), blank(F.regexp_extract(host, r"([^.]+)$", 1)).alias("suffix"), blank(host).alias("host"))


def identify_pages(pages: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """(page_id, declared, suffix, host, language, posterior, kept); null html
    or url gives no evidence of its kind."""
    return identify(page_parts(pages), "text", "declared", F.col("suffix"), "host", confidence)
