"""The corpus pipeline: five stages, each on all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next
one. All but the last return the columns of documents; the last returns the texts as piece ids.

Null and empty texts have no words and go in the first stage, and so do rows of hosts that mostly fail; of repeated rows one
is left by the second. An empty table gives no rows at any stage. Columns with names of any kind are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontamination, piece_coding, quality_rules, simhash_dedup, suffix_dedup
from lodestone.llm._shared import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: under 20 words, over 30 % of words in repeated windows, or of a host that mostly fails."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies, exact or near (five-word shingles, similarity of 0.8 or more), the smallest doc_id stays."""
    return simhash_dedup.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes or more that stand at several places are taken out of the texts; documents left blank by that go."""
    return suffix_dedup.drop_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with at most 5 % of it edited, go; those without a text stay, and all do if there are no items."""
    return decontamination.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, n_chars and round_trip of every document; no ids for null and empty texts."""
    return piece_coding.encode_documents(docs)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("repeats", repeats), ("decontamination", decontaminate), ("encoding", encode)]

#: Lyndon groups, fingerprints and the pieces' Viterbi can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
