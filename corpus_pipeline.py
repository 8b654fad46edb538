"""A training corpus from ``documents``: language ID, near-duplicate removal,
benchmark decontamination, mixing, tokenised output.  Each stage works on all
that its predecessor kept and is written as Parquet before the next reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm import decontaminate, languages, mixing, near_duplicates, token_files
from metricloom.llm.common import shared_dir, small, table, written
from metricloom.llm.queries import vocabulary


#: Similarity of five-word shingle sets, in percent, from which near_dedup takes
#: two documents for one (op9_near_duplicates itself has 85).
NEAR_PERCENT = 80


KEY = ["_key_a", "_key_b"]


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with a 128-bit key of the columns' values, nulls among them."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return docs.select("*", *[F.xxhash64(F.lit(i), *parts).alias(k) for i, k in enumerate(KEY)])


def _without(docs: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """``docs`` whose key isn't in ``gone``."""
    return docs.join(small(written(gone.select(*key).distinct(), "gone"), 16 * len(key)), key, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the others go.  A row is judged by
    its own text, language and source: ids may be null or repeat."""
    keyed = _keyed(docs, "doc_id", "text", "lang", "source")
    judged = languages.identify(keyed.select(*KEY, "text", "lang", "source"))
    return _without(keyed, judged.filter("not kept"), KEY).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates.

    Rows equal in id and text count once.  Rows that share an id but not a text
    are documents of their own, and so is each text with a null id; in a
    group they come after the ids, those with a null id last."""
    keyed = _keyed(docs, "doc_id", "text")
    rows = written(keyed.select("doc_id", *KEY), "row-keys")
    shared = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*KEY)).alias("low"), F.max(F.struct(*KEY)).alias("high")).filter("low <> high")
    # all but the first text of a shared id, and null ids, are numbered beyond the largest id
    others = rows.join(shared, "doc_id").filter(F.struct(*KEY) != F.col("low")).select(*KEY, F.lit(0).cast("long").alias("after"))
    others = written(others.unionByName(rows.filter("doc_id is null").select(*KEY, F.lit(1 << 54).alias("after"))).distinct(), "others")
    last = rows.agg(F.max("doc_id")).first()[0] or 0
    numbers = written(others.select(*KEY, (F.monotonically_increasing_id() + F.col("after") + F.lit(last + 1)).alias("_number")), "numbers")
    own = keyed.join(small(numbers, 40), KEY, "left").withColumn("_number", F.coalesce("_number", "doc_id"))
    found = near_duplicates.near_duplicates(own.select(F.col("_number").alias("doc_id"), "text"), percent=NEAR_PERCENT)
    gone = found.filter("not kept").select(F.col("doc_id").alias("_number"))
    return _without(own, gone, ["_number"]).dropDuplicates(["_number"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; each row is judged by its own text,
    whatever its id."""
    keyed = _keyed(docs, "doc_id", "text")
    flagged = decontaminate.flagged(keyed.select(F.col(KEY[0]).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(keyed, flagged.select(F.col("doc_id").alias(KEY[0])), KEY[:1]).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the raked weights sample."""
    return mixing.mix(docs).filter("sampled").select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the ids and returns doc_id, start, n_tokens, ids_crc32, read back."""
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex[:12]}"
    return token_files.token_files(docs, vocabulary(), folder).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixture), ("token_output", token_output)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
