"""Benchmark decontamination by template windows (operator 7).

Texts become sequences of words with typed placeholders: a word with a digit is
a number, a word of two letters or more that begins with a capital is a name, a
unit of measure after a number is a unit.  What begins a sentence has a capital
in any case, so an item is also read with its sentences' first words as they
are, for documents that have them inside a sentence.  Hashes of WINDOW template
words (built by doubling: one, two, four, eight words) of the benchmark meet
those of the documents in a hash join.  Windows on one diagonal of a document
and an item make an alignment; enough of them with enough words that aren't
placeholders, and slots that are filled consistently (one literal of the item
always stands for one literal of the document), flag the document, so that a
question with other numbers or names is still caught.  Items are also looked
for word for word where templates say too little."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written

WINDOW = 8
#: Aligned windows that flag a document: six make thirteen words in a row.
LEAST = 6
#: Literal words that the aligned windows have together at least (a word counts
#: in each): windows of many placeholders say less, so more of them are needed.
EVIDENCE = 24
#: Windows with fewer literal words than this say nothing as templates; items
#: that have one are also looked for word for word.
LITERALS = 2
#: Items of fewer words than WINDOW are found word for word, from this many
#: words on: a shorter run is ordinary language.
SHORTEST = 4
#: Units of measure.
UNITS = "mm|cm|km|m|mg|g|kg|ml|l|s|sec|min|h|hours|days|weeks|months|years|miles|feet|inches|pounds|ounces|dollars|euros|cents|percent|degrees|usd|eur"
NAME, NUMBER, UNIT = "\u0002", "\u0003", "\u0004"
SPACE = " \\t-\\r"
#: ASCII punctuation and the common signs of other scripts.
PUNCTUATION = "[!-/:-@\\[-`{-~\u00a1-\u00bf\u2010-\u2027\u3001-\u3003]+"


def words(text: Column, openers: bool = True) -> Column:
    """Lower-case words without punctuation; placeholders carry a mark first.
    ``openers``: whether a sentence's first word may be a name."""
    # each pattern starts with a small class or a literal: one quick scan a text
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{NAME}-{UNIT}\\t-\\r]", " ")
    t = F.concat(F.lit(" "), t)
    inside = "" if openers else "(?<![.!?] )(?<!\\A )"
    t = F.regexp_replace(t, f" [\"'(\u201c\u2018]?{inside}(?=\\p{{Lu}}\\p{{L}})", f" {NAME}")
    t = F.regexp_replace(t, "[0-9]+", NUMBER + "$0")
    t = F.regexp_replace(F.lower(t), f"({NUMBER}[0-9]+) +(?=(?:{UNITS})(?![\\p{{L}}{NUMBER}]))", f"$1 {UNIT}")
    t = F.regexp_replace(t, PUNCTUATION, "")
    # what was only a mark and punctuation goes too
    return F.filter(F.split(t, " +"), lambda w: F.length(w) > 0)


def _mark(w: Column) -> Column:
    """0 for a word that stands for itself."""
    return F.when(F.contains(w, F.lit(NUMBER)), 2).when(w.startswith(NAME), 1).when(w.startswith(UNIT), 3).otherwise(0)


def _bound(x: Column, f) -> Column:
    """f(x), x evaluated once."""
    return F.transform(F.array(x), f)[0]


def _doubled(h: Column, step: int) -> Column:
    n = F.greatest(F.size(h) - step, F.lit(0))
    return F.zip_with(F.slice(h, 1, n), F.slice(h, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def _longer(h: Column, step: int) -> Column:
    return _bound(h, lambda x: _doubled(x, step))


def template_windows(words_: Column) -> Column:
    """Hashes of the WINDOW-word templates by position."""

    def name(w: Column) -> Column:
        return F.when(F.contains(w, F.lit(NUMBER)), F.lit(2).cast("long")).when(w.startswith(NAME), F.lit(1).cast("long")).when(w.startswith(UNIT), F.lit(3).cast("long")).otherwise(F.xxhash64(w))

    one = F.transform(words_, name)
    return _longer(_longer(_longer(one, 1), 2), 4)


def literal_windows(words_: Column, width: int = WINDOW) -> Column:
    """Hashes of the runs of ``width`` literal words, in any case, by position."""
    # named apart from templates, so that both kinds meet their own in one join
    out = F.transform(words_, lambda w: F.xxhash64(F.ltrim(w, F.lit(NAME)), F.lit(width)))
    held = 1
    while held < width:  # runs of twice the words, the last two overlapping
        step = min(held, width - held)
        out = _longer(out, step)
        held += step
    return out


def _literals(at: Column) -> Column:
    """Words of the item's window at ``at`` that aren't placeholders."""
    return WINDOW - F.size(F.filter(F.slice("item_words", at + 1, WINDOW), lambda w: _mark(w) > 0))


def flagged(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_matched) for documents that hold a benchmark item:
    of several items the one with most aligned words, then the least id."""
    # a null item_id names no item; repeated ones are readings of one item
    given = benchmark.filter("item_id is not null").select("item_id", words(F.col("text")).alias("as_names"), words(F.col("text"), False).alias("as_words"))
    readings = F.array_distinct(F.array("as_names", "as_words"))
    items = given.select("item_id", F.explode(readings).alias("item_words")).distinct()
    items = written(items.select(F.xxhash64("item_id", "item_words").alias("reading"), "item_id", "item_words", template_windows(F.col("item_words")).alias("windows")), "items")
    at = items.select("reading", "item_words", F.posexplode("windows").alias("item_at", "name")).withColumn("literals", _literals(F.col("item_at")))
    kinds = at.filter(F.col("literals") >= LITERALS).select(F.lit(0).alias("kind"), F.col("reading").alias("key"), "item_at", "name", "literals").distinct()
    # word for word: items with a window of few literal words, and short items whole
    few = F.exists(F.transform("windows", lambda w, i: _literals(i) < LITERALS), lambda x: x)
    verbatim = {WINDOW: items.filter(few)} | {k: items.filter(F.size("item_words") == k) for k in range(SHORTEST, WINDOW)}
    for width, those in verbatim.items():
        found = those.select(F.lit(width).alias("kind"), F.col("item_id").alias("key"), F.posexplode(literal_windows(F.col("item_words"), width)).alias("item_at", "name"), F.lit(width).alias("literals"))
        kinds = kinds.unionByName(found.distinct())
    seeds = written(kinds, "seeds")
    needs = seeds.groupBy("kind", "key").agg(F.least(F.lit(LEAST), F.count("*")).alias("need"), F.least(F.lit(EVIDENCE), F.sum("literals")).alias("evidence"))
    needs = written(needs, "needs")
    widths = sorted(r[0] for r in seeds.select("kind").distinct().collect())  # of each kind one row: five at most

    # all windows of a text in one array, kind after kind
    texts = documents.filter("doc_id is not null").select("doc_id", words(F.col("text")).alias("w"))
    arrays = [template_windows(F.col("w")) if k == 0 else literal_windows(F.col("w"), k) for k in widths] or [F.array().cast("array<bigint>")]
    found = texts.select("doc_id", F.size("w").alias("n_words"), F.posexplode(F.concat(*arrays)).alias("at", "name"))
    before, offset = F.lit(0), F.lit(0)
    for k in widths:
        offset = F.when(F.col("kind") == k, before).otherwise(offset)
        before = before + F.greatest(F.col("n_words") - ((k or WINDOW) - 1), F.lit(0))
    met = found.join(small(seeds, 40), "name").withColumn("shift", F.col("at") - offset - F.col("item_at"))
    aligned = met.groupBy("doc_id", "kind", "key", "shift", "item_at").agg(F.first("literals").alias("literals"))
    aligned = aligned.groupBy("doc_id", "kind", "key", "shift").agg(F.count("*").alias("n"), F.sum("literals").alias("sum"), F.min("item_at").alias("low"), F.max("item_at").alias("high"))
    enough = written(aligned.join(small(needs, 40), ["kind", "key"]).filter("n >= need and sum >= evidence").drop("need", "evidence", "sum"), "likely")
    likely = enough.filter("kind = 0").withColumnRenamed("key", "reading")
    literal = enough.filter("kind > 0").select("doc_id", F.col("key").alias("item_id"), (F.col("n") + F.col("kind") - 1).alias("n_words"))

    ids = written(likely.select("doc_id").distinct(), "ids")
    texts = documents.join(small(ids, 16), "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("doc_words"))
    pair = likely.join(small(items.select("reading", "item_id", "item_words"), 4000), "reading").join(texts, "doc_id")
    long = F.col("high") - F.col("low") + WINDOW
    both = F.arrays_zip(F.slice("item_words", F.col("low") + 1, long).alias("item"), F.slice("doc_words", F.greatest(F.col("low") + F.col("shift"), F.lit(0)) + 1, long).alias("doc"))
    filled = F.filter(both, lambda p: p["item"].isNotNull() & p["doc"].isNotNull() & (_mark(p["item"]) > 0) & (_mark(p["item"]) == _mark(p["doc"])))
    consistent = _bound(filled, lambda s: F.size(F.array_distinct(s)) == F.size(F.array_distinct(F.transform(s, lambda p: p["item"]))))
    agreed = pair.filter(consistent).select("doc_id", "item_id", (F.col("n") + WINDOW - 1).alias("n_words"))
    agreed = agreed.unionByName(literal)
    return agreed.groupBy("doc_id").agg(F.max_by("item_id", F.struct("n_words", -F.col("item_id"))).alias("item_id"), F.max("n_words").alias("n_matched"))


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` with contaminated, item_id and n_matched (words of the
    alignment at least); columns of these names are replaced.

    An item is found where LEAST of its template windows align with the document
    and have EVIDENCE literal words together (all its windows, if they have
    less); word for word, where a window has fewer than LITERALS literal words; and
    with SHORTEST to WINDOW - 1 words where all of them follow one another.
    Items under SHORTEST words, null and empty texts on either side match
    nothing.  White space of any kind separates words.  Of several items the one
    with most aligned words is named, then the least id.  Rows that share a
    doc_id are one document: they are flagged together; a null doc_id is never
    flagged, a null item_id never found."""
    hits = written(flagged(documents.select("doc_id", "text"), benchmark), "hits")
    kept = [c for c in documents.columns if c not in ("contaminated", "item_id", "n_matched")]
    return documents.select(*kept).join(small(hits, 40), "doc_id", "left").select(*kept, F.col("item_id").isNotNull().alias("contaminated"), "item_id", "n_matched")
