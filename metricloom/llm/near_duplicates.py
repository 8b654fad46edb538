"""Near-duplicate documents by fast similarity sketches, banding and exact
verification (operator 9).

A document is the set of its distinct five-word shingles.  The sketch has T
coordinates.  In round i < T every element lands in one hashed bin and leaves
the value i plus a fraction there, in round T + j every element lands in bin j;
each bin keeps its least value and a set stops after the round that fills its
last bin.  So every coordinate fills after 2T rounds at the latest, a set of
more than T log T elements usually needs one, and the share of equal
coordinates of two sets is concentrated around their similarity.

Sets that are equal (128-bit sums of their elements) form a class; only the
class's smallest document goes on.  BANDS bands of ROWS coordinates make
bucket keys: two sets of similarity 0.85 share none of them with probability
(1 - 0.85 ** ROWS) ** BANDS = 2.0e-8 (3.2e-6 at 0.80).  In a bucket each class is compared with
one pivot, then with a second one if the bucket still spans several components.
What is left of such buckets is compared exactly, in blocks: classes outside
the bucket's largest component against all its classes of other components, on
the full sets, inside a task that returns only links which join components.
Pairs inside a component are never listed, so a thousand copies cost a thousand
comparisons and not a million.  Every link is confirmed on the full sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, discard, matched, mix, odd, pair_components, ship, signed, slices, small, window_hashes, word_hashes, written

SHINGLE = 5
ROWS, BANDS = 4, 24
T = ROWS * BANDS
#: Classes that one task compares with as many others.
BLOCK = 500
#: Pairs of one pivot for each copy of the pivot's set.
PIVOT_PAIRS = 2_000


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct shingle hashes, sorted; all words as one shingle if they are
    fewer than SHINGLE."""
    hashes = word_hashes(words, len(words))
    if len(hashes) > SHINGLE - 1:
        return np.unique(window_hashes(hashes, SHINGLE))
    return window_hashes(hashes, len(hashes), 7 + len(hashes)) if len(hashes) else np.empty(0, np.uint64)


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []  # of bytes: A-Z and ASCII white space only


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The sketch of each set that isn't empty, a row of T 64-bit values."""
    out = np.full((len(sets), T), np.uint64(0xFFFFFFFFFFFFFFFF))
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate([np.empty(0, np.uint64), *sets])
    flat = out.reshape(-1)
    for i in range(2 * T):
        if not len(elements):
            break
        h = mix(elements ^ odd(5000 + i))
        place = (h >> np.uint64(32)) * np.uint64(T) >> np.uint64(32) if i < T else np.full(len(h), i - T, np.uint64)
        np.minimum.at(flat, of * T + place.astype(np.int64), (h & np.uint64(0xFFFFFFFF)) | np.uint64(i << 32))
        unfilled = (out == np.uint64(0xFFFFFFFFFFFFFFFF)).any(1)
        more = unfilled[of]
        of, elements = of[more], elements[more]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """BANDS bucket keys for each sketch."""
    keys = np.zeros((len(sketch), BANDS), np.uint64)
    for r in range(ROWS):
        keys += mix(sketch[:, r::ROWS]) * odd(7000 + r)
    return mix(keys + np.arange(BANDS, dtype=np.uint64) * odd(7100))


def sketched(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, keys) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for batch in slices(batches, "text"):
            sets = [shingles(words_of(t)) for t in as_bytes(batch.column("text"))]
            sums = [np.array([mix(s ^ odd(seed)).sum(dtype=np.uint64) for s in sets], np.uint64) for seed in (8001, 8002)]
            keys = signed(band_keys(sketches(sets))).tolist()
            columns = [batch.column("doc_id"), [len(s) for s in sets], signed(sums[0]), signed(sums[1]), [k if len(s) else [] for k, s in zip(keys, sets, strict=True)]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>")


def _sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, elements) of the wanted documents (id: a class's smallest)."""
    schema = pa.schema([("id", pa.int64()), ("elements", pa.list_(pa.int64()))])

    def run(batches):
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([signed(shingles(words_of(t))) for t in as_bytes(batch.column("text"))], schema.types[1])], schema=schema)

    texts = documents.select("doc_id", "text").join(small(wanted, 16).withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    # a repeated id stands for its text of least hash among those with words
    return texts.mapInArrow(run, "id long, elements array<long>").filter(F.size("elements") > 0).groupBy("id").agg(F.min_by("elements", F.xxhash64("elements")).alias("elements"))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b, of the written ``pairs`` (pivot, id) whose sets reach
    ``percent`` of similarity.  A pivot of many pairs has a copy of its set for
    each PIVOT_PAIRS of them."""
    counts = pairs.groupBy("pivot").agg(F.count("*").alias("rows"))
    counts = written(counts.select("pivot", "rows", F.ceil(F.col("rows") / PIVOT_PAIRS).alias("salts")), "pivots")
    salted = matched(pairs, counts, ["pivot"], 32, "rows", F.xxhash64("id"), "inner").select("pivot", "id", F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt"))
    left = sets.withColumnRenamed("id", "pivot").join(small(counts, 32).select("pivot", "salts"), "pivot")
    left = left.select("pivot", F.col("elements").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    both = F.size(F.array_intersect("own", "elements"))
    fits = salted.join(left, ["pivot", "salt"]).join(sets, "id").withColumn("both", both)
    fits = fits.filter(100 * F.col("both") >= percent * (F.size("own") + F.size("elements") - F.col("both")))
    return fits.select(*_ordered(F.col("pivot"), F.col("id")))


def _ordered(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _block_links(here: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between unlike components of one bucket of ``here`` (key,
    id, component), found by comparing blocks of at most about BLOCK classes;
    of the links that join the same components a block returns one."""
    count = here.groupBy("key", "component").count()
    most = count.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.sum("count").alias("n"), F.max("count").alias("most"))
    blocks = most.select("key", "main", F.col("n").alias("rows"), F.ceil(F.col("n") / BLOCK).alias("right"), F.ceil((F.col("n") - F.col("most")) / BLOCK).alias("left"))
    blocks = written(blocks, "blocks")
    rows = matched(here.select("key", "id", "component"), blocks, ["key"], 48, "rows", F.xxhash64("id"), "inner").join(sets, "id")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), n)
    columns = ["key", "id", "component", "main", "elements"]
    minor = rows.filter("component <> main").select(*columns, F.lit(True).alias("minor"), own(F.col("left")).alias("i"), every(F.col("right")).alias("j"))
    other = rows.select(*columns, F.lit(False).alias("minor"), every(F.col("left")).alias("i"), own(F.col("right")).alias("j"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(block):
        ids, parts = block.column("id").to_pylist(), block.column("component").to_pylist()
        main, minor = block.column("main")[0].as_py(), np.array(block.column("minor").to_pylist())
        lists = block.column("elements").combine_chunks()
        ends = lists.offsets.to_numpy()
        values = lists.values.to_numpy()
        member = [values[ends[k] : ends[k + 1]] for k in range(len(ids))]
        right = np.flatnonzero(~minor)
        owner = np.repeat(np.arange(len(right)), [len(member[k]) for k in right])
        elements = np.concatenate([np.empty(0, np.int64), *(member[k] for k in right)])
        sizes = np.array([len(member[k]) for k in right], np.int64)
        joined = {c: c for c in parts}

        def find(c):
            while joined[c] != c:
                joined[c] = c = joined[joined[c]]
            return c

        out = []
        for k in np.flatnonzero(minor).tolist():
            own = np.sort(member[k])
            at = np.minimum(np.searchsorted(own, elements), len(own) - 1)
            both = np.bincount(owner[own[at] == elements], minlength=len(right))
            for r in np.flatnonzero(100 * both >= percent * (sizes + len(own) - both)).tolist():
                other = int(right[r])
                if (parts[other] == main or ids[other] < ids[k]) and (x := find(parts[k])) != (y := find(parts[other])):
                    joined[max(x, y)] = min(x, y)
                    out.append((min(ids[k], ids[other]), max(ids[k], ids[other])))
        return pa.Table.from_arrays([pa.array([p[n] for p in out], pa.int64()) for n in (0, 1)], schema=schema)

    return minor.unionByName(other).groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def class_components(documents: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(id, component) of classes (id, keys) that have a link."""
    rows = written(classes.select("id", F.explode("keys").alias("key")), "bands")
    by_id = F.xxhash64("id")
    sizes = written(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("pivot")).filter("n > 1"), "sizes")
    buckets = written(matched(rows, sizes, ["key"], 32, "n", by_id, "inner").select("key", "id", "pivot"), "buckets")
    discard(rows, sizes)
    sets = written(_sets(documents, written(buckets.select("id").distinct(), "wanted")), "sets")
    tried = written(buckets.filter("id <> pivot").select("pivot", "id").distinct(), "pairs")
    links = written(_links(tried, sets, percent), "links")
    for turn in ("pivot", "blocks"):
        reached = pair_components(links)
        here = written(buckets.select("key", "id").join(reached, "id", "left").withColumn("component", F.coalesce("component", "id")), "here")
        mixed = here.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("id", by_id).alias("turn"), F.count("*").alias("n")).filter("low < high")
        mixed = written(mixed.select("key", "turn", "n"), "turns")
        here = written(matched(here, mixed, ["key"], 32, "n", by_id, "inner").select("key", "id", "component", "turn"), "mixed")
        if turn == "pivot":
            pairs = here.filter("id <> turn").select(F.col("turn").alias("pivot"), "id").distinct()
            seen = tried.unionByName(tried.select(F.col("id").alias("pivot"), F.col("pivot").alias("id")))
            more = written(_links(written(pairs.join(seen, ["pivot", "id"], "left_anti"), "pairs"), sets, percent), "links")
        else:
            more = written(_block_links(here, sets, percent), "links")
        links = links.unionByName(more)
    return reached if more.isEmpty() else pair_components(links)


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``documents``.

    Words: runs of bytes other than ASCII white space, A-Z lower-cased.  Two
    documents are linked if 100 * intersection >= percent * union of their
    shingle sets; component_id is the smallest doc_id reachable, kept is true
    for it alone.  A null, empty or blank text has no shingles and no links; a
    null doc_id neither (component_id null, kept true).  Rows that share a
    doc_id and text are one document and get equal rows.  Where texts of one
    doc_id are unlike, each row is in its own text's class, and a class that has
    this id as its smallest is compared by the text of least hash among them."""
    ship(documents.sparkSession)
    rows = written(sketched(documents), "sketches")
    some = rows.filter("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "set_a", "set_b"]
    # one row for each class and map task travels, however many copies there are
    classes = written(some.groupBy(*same).agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.any_value("keys").alias("keys")), "classes")
    reached = class_components(documents, classes, percent)
    named = classes.join(reached, "id", "left").filter("copies > 1 or component is not null").select(*same, "copies", F.coalesce("component", "id").alias("component"))
    out = matched(rows.drop("keys"), written(named, "named"), same, 56, "copies", F.xxhash64("doc_id"))
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
