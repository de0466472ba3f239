"""One query for each operator, over its whole table and with its default parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_formatting, decontamination, lm_scoring, piece_coding, quality_rules, sharding, simhash_dedup, suffix_dedup, token_counts, url_filters
from ._shared import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.find_repeats(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_coding.encode_documents(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat_formatting.format_preferences(chat_formatting.neighbours(table(spark, sf_dir, "conversations")))
    masks = {c: chat_formatting.mask_text(pairs[c]) for c in ("chosen_mask", "rejected_mask")}
    return pairs.withColumns(masks)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def sharding_small_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's operator with a limit of 64 KiB, under which small tables split too."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), max_bytes=1 << 16)


_ALL = (
    op1_suffix_dedup,
    op2_sentencepiece,
    op3_sharding,
    op4_lm_scoring,
    op5_token_counts,
    op6_url_filters,
    op7_chat_formatting,
    op8_quality_rules,
    op9_decontamination,
    op10_simhash_dedup,
    sharding_small_limit,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

#: The others can't be said in SQL; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_sharding": sharding.oracle(sharding.MAX_BYTES),
    "sharding_small_limit": sharding.oracle(1 << 16),
    "op6_url_filters": url_filters.ORACLE,
    "op7_chat_formatting": chat_formatting.ORACLE,
    "op8_quality_rules": quality_rules.ORACLE,
}
