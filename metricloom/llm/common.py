"""Helpers shared by the operators: the cluster's shared folder, written
intermediate tables, columnar text access and vectorised hashing."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast up to this many bytes (estimated from counted rows);
#: beyond it the same join shuffles.
BROADCAST_BYTES = 16 << 20


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package's source to the Python workers, once for each
    application; Spark serves the file to executors that start later."""
    if (app := spark.sparkContext.applicationId) not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        with tempfile.TemporaryDirectory() as at:
            source = Path(at) / "source"
            shutil.copytree(root / "metricloom", source / "metricloom", ignore=shutil.ignore_patterns("__pycache__"))
            spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/metricloom", "zip", source))
        _SHIPPED.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and every executor see: ``spark.checkpoint.dir``.
    Where it is unset (tests in one JVM), a temporary folder is set once."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="metricloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/metricloom-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: it cuts the
    lineage and survives the loss of any executor."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.written_at)


def sweep(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables; results that were not
    written elsewhere can't be read afterwards."""
    _delete(spark, shared_dir(spark))


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit BROADCAST_BYTES.
    ``df`` must be a written table, so that counting reads footers only."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def matched(left: DataFrame, right: DataFrame, on: list[str], row_bytes: int, rows: str, spread: Column, how: str = "left") -> DataFrame:
    """``left`` with the other columns of ``right``, a written table with one
    row for each key and, in column ``rows``, the number of rows of ``left``
    that have it.

    Where ``right`` isn't small, the keys of most rows are broadcast, as many
    as fit BROADCAST_BYTES by their share of the total, and the rest is
    shuffled; rows whose value is known by then, and those with a null key, are
    dealt by ``spread``.  So no key fills a task, however hot it is.  how:
    left, inner or left_anti."""
    values = [c for c in right.columns if c not in on and c != rows]
    right = right.select(*on, rows, F.struct(F.lit(True).alias("_"), *values).alias("_found"))
    if right.count() * row_bytes <= BROADCAST_BYTES:
        out = left.join(F.broadcast(right.drop(rows)), on, "left")
    else:
        most = (right.agg(F.sum(rows)).first()[0] or 0) * row_bytes // BROADCAST_BYTES
        hot = right.filter(F.col(rows) > most).select(*on, F.col("_found").alias("_hot"))  # fewer than BROADCAST_BYTES / row_bytes rows
        out = left.join(F.broadcast(hot), on, "left")
        done = F.col("_hot").isNotNull()
        for c in on:
            done = done | F.col(c).isNull()
        out = out.withColumn("_salt", F.when(done, F.pmod(spread, F.lit(1 << 20)) + 1).otherwise(0))
        cold = right.filter(F.col(rows) <= most).select(*on, F.lit(0).cast("long").alias("_salt"), "_found")
        out = out.join(cold, [*on, "_salt"], "left").withColumn("_found", F.coalesce("_hot", "_found"))
    if how != "left":
        out = out.filter(F.col("_found").isNotNull() if how == "inner" else F.col("_found").isNull())
    return out.select(*left.columns, *([] if how == "left_anti" else [F.col(f"_found.{v}").alias(v) for v in values]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about ``most`` bytes of text at most
    (a longer text stays whole, alone): memory doesn't grow with the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.nan_to_num(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(float))
        ends, held = [], 0.0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                ends.append(i)
                held = 0.0
            held += size
        for a, b in zip([0, *ends], [*ends, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def word_hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit (xor-shift and odd
    multipliers)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def odd(i: int) -> np.uint64:
    """The i-th odd multiplier."""
    return np.uint64(xxhash.xxh3_64_intdigest(b"odd", i + 1) | 1)


def window_hashes(hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of ``width`` values, by its first position."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += hashes[j : j + n] * odd(salt * 1000 + j)
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def pair_components(pairs: DataFrame) -> DataFrame:
    """(id, component) of every id in ``pairs`` (a, b): the smallest id that it
    reaches.  Each round takes the least label among neighbours and then the
    label's own label, so that the number of rounds is logarithmic in a chain's
    length; labels are a table, never collected."""
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component"), F.count("*").alias("links")), "labels")
    while True:
        # a hub's links and a large component's label are hot keys
        ends = labels.select(F.col("id").alias("b"), "component", "links")
        near = matched(both, ends, ["b"], 40, "links", F.xxhash64("a"), "inner").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("least"))
        met = written(labels.join(near, "id").select("id", "links", F.col("component").alias("was"), F.least("component", "least").alias("now")), "met")
        own = met.groupBy("now").agg(F.count("*").alias("rows")).join(labels.select(F.col("id").alias("now"), F.col("component").alias("further")), "now")
        own = written(own.select("now", "further", "rows"), "own")
        new = written(matched(met, own, ["now"], 40, "rows", F.xxhash64("id"), "inner").select("id", "was", F.least("now", "further").alias("component"), "links"), "labels")
        settled = new.filter("component < was").isEmpty()
        discard(labels, met, own)
        labels = new
        if settled:
            discard(pairs)
            return labels.select("id", "component")
