"""The ten queries, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, languages, mixing, near_duplicates, quality, sharding, substrings, token_counts, token_files, url_filters
from .common import table

VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("failed_metrics")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), vocabulary()).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "language", "posterior", "kept")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over raw pages: text, declared markup language, suffix, host."""
    return languages.identify_pages(table(spark, sf_dir, "pages")).select("page_id", "declared", "suffix", "host", "language", "posterior", "kept")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return docs.selectExpr("doc_id", "contaminated", "item_id", "n_matched", "not contaminated as kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "sampled")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.drop_repeats(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sharding, op2_quality_rules, op3_url_filters, op4_token_files, op5_token_counts, op6_language_id, language_id_pages, op7_decontamination, op8_mixing, op9_near_duplicates, op10_substring_dedup, pipeline)
}
ORACLE_SQL: dict[str, str] = {
    "op3_url_filters": url_filters.oracle(),
}
