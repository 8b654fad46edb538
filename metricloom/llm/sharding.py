"""Balanced label propagation over equal texts (operator 1).

Documents with equal texts are linked.  What moves is a cell: the documents of
one group that are in one shard, with their number, so that a group of any size
is a few rows.  Each round joins cells with the shards' free places: a cell
moves to the shard that holds most of its group among those with free places,
in whole or as far as the quota reaches; running sums over hash buckets decide
exactly who still fits.  At the end unlinked documents fill the free places.

Law: ``rows``; the shards' row counts are at most one apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, matched, written

SHARDS, ROUNDS = 24, 12
#: Rows of a group for each bucket in which they are numbered.
BUCKET_ROWS = 10_000


def running(df: DataFrame, groups: list[str], bucket: str, order: list, amount: Column, name: str) -> DataFrame:
    """Adds the sum of ``amount`` over earlier rows of the group: first within a
    bucket, then over the buckets' sums, so that no task holds a whole group."""
    inner = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*groups, bucket).agg(F.sum(amount).alias("_sum"))
    if not groups:
        # one row a bucket: a few for each shuffle partition
        outer = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(outer), F.lit(0))).drop("_sum")
    here = df.withColumn("_here", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    return here.join(ahead, [*groups, bucket]).withColumn(name, F.col("_here") + F.col("_ahead")).drop("_here", "_ahead")


def _literal(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def _at(values: list[int], i: Column) -> Column:
    return F.element_at(_literal(values), i.cast("int") + 1)


def propagated(cells: DataFrame, quota: list[int], buckets: int, rounds: int) -> DataFrame:
    """Cells (key, shard, n) after label propagation under the quotas."""
    for _ in range(rounds):
        load = [0] * len(quota)
        for shard, n in cells.groupBy("shard").agg(F.sum("n")).collect():  # one row a shard
            load[shard] = n
        free = [q - x for q, x in zip(quota, load, strict=True)]
        group = Window.partitionBy("key")  # at most one row a shard
        open_ = F.when(_at(free, F.col("shard")) > 0, F.struct("n", -F.col("shard")))
        best = cells.withColumn("best", F.max(open_).over(group)).withColumn("target", -F.col("best").getField("col2"))
        wants = best.filter("target is not null and shard <> target").filter(F.struct("n", -F.col("shard")) < F.col("best"))
        wants = wants.select("key", "shard", "target", "n", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
        queued = running(wants, ["target"], "bucket", ["n", "key", "shard"], F.col("n"), "before")
        moved = queued.withColumn("n", F.least("n", F.greatest(_at(free, F.col("target")) - F.col("before"), F.lit(0)))).filter("n > 0")
        moved = written(moved.select("key", "shard", "target", "n"), "moved")
        change = moved.select("key", "shard", (-F.col("n")).alias("n")).unionByName(moved.select("key", F.col("target").alias("shard"), "n"))
        if moved.isEmpty():
            return cells
        new = written(cells.unionByName(change).groupBy("key", "shard").agg(F.sum("n").alias("n")).filter("n > 0"), "cells")
        discard(cells, moved)
        cells = new
    return cells


def shard(documents: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    size: UTF-8 bytes of the text (null: none) plus 8; text_crc32 unsigned (a
    null text as an empty one); slot: gapless from 0 in each shard; grown_shard
    is null under this law.  Rows with equal texts, the empty one too, are
    linked; null texts are not.  Repeated rows and ids each take a place of
    their own.  Other columns don't matter.  An empty table gives no rows."""
    spark = documents.sparkSession
    buckets = max(64, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.unhex(F.sha2("text", 256))).alias("key"),
    )
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int")
    rows = written(rows.withColumn("bucket", bucket), "rows")
    total = rows.count()
    quota = [total // shards + (j < total % shards) for j in range(shards)]
    groups = rows.filter("key is not null").groupBy("key").agg(F.count("*").alias("copies")).filter("copies > 1")
    groups = written(groups.select("key", "copies", F.col("copies").alias("n")), "groups")
    every_row = F.xxhash64("doc_id", "text_crc32", "size")
    linked = matched(rows.drop("bucket"), groups, ["key"], 72, "copies", every_row, "inner")
    linked = written(linked.withColumn("bucket", F.pmod(every_row, F.ceil(F.col("n") / BUCKET_ROWS)).cast("int")).drop("n"), "linked")
    singles = matched(rows, groups, ["key"], 72, "copies", every_row, "left_anti")

    start = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).cast("int")
    cells = propagated(written(linked.groupBy("key", start.alias("shard")).agg(F.count("*").alias("n")), "cells"), quota, buckets, rounds)

    load = [0] * shards
    for j, n in cells.groupBy("shard").agg(F.sum("n")).collect():  # one row a shard
        load[j] = n
    full = [min(a, b) for a, b in zip(load, quota, strict=True)]
    over = [a - b for a, b in zip(load, full, strict=True)]
    over_before = [sum(over[:j]) for j in range(shards)]
    gaps = [a - b for a, b in zip(quota, full, strict=True)]
    gaps_before = [sum(gaps[:j]) for j in range(shards + 1)]

    # places of a group's documents: by rank in the group, cell after cell
    placed = cells.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    placed = running(placed, ["shard"], "bucket", ["key"], F.col("n"), "first_slot")
    placed = placed.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # at most one cell a shard
    plan = placed.groupBy("key").agg(F.sum("n").alias("copies"), F.sort_array(F.collect_list(F.struct("first", "n", "shard", "first_slot"))).alias("cells"))
    ranked = running(linked, ["key"], "bucket", ["doc_id", "text_crc32", "size"], F.lit(1), "rank")
    ranked = matched(ranked, written(plan, "plan"), ["key"], 40 + 40 * shards, "copies", every_row, "inner")
    cell = F.filter("cells", lambda c: (c["first"] <= F.col("rank")) & (F.col("rank") < c["first"] + c["n"]))[0]
    ranked = ranked.withColumn("cell", cell).select("doc_id", "size", "text_crc32", F.col("cell.shard").alias("at"), (F.col("cell.first_slot") + F.col("rank") - F.col("cell.first")).alias("slot"))
    beyond = F.col("slot") - _at(quota, F.col("at"))
    ranked = ranked.withColumn("spare", F.when(beyond >= 0, beyond + _at(over_before, F.col("at"))))
    alone = running(singles, [], "bucket", ["doc_id", "text_crc32", "size"], F.lit(1), "rank")
    alone = alone.select("doc_id", "size", "text_crc32", F.lit(None).cast("int").alias("at"), F.lit(None).cast("long").alias("slot"), (F.col("rank") + sum(over)).alias("spare"))

    # what isn't placed fills the gaps in order
    gap = F.size(F.filter(_literal(gaps_before[1:]), lambda e: e <= F.col("spare")))
    every = ranked.unionByName(alone).withColumn("gap", F.when(F.col("spare").isNotNull(), gap))
    return every.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.coalesce("gap", "at").cast("int").alias("shard"),
        F.when(F.col("gap").isNull(), F.col("slot")).otherwise(_at(full, F.col("gap")) + F.col("spare") - _at(gaps_before, F.col("gap"))).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
