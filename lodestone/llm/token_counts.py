"""Token counts from an exact length histogram.

Documents are encoded once and aggregated by their number of tokens. Whatever is asked afterwards (totals, quantiles,
tokens left under any context limit) comes from suffix sums of that histogram and never from the documents again. The
sums are taken in two steps, over ranges of 1,024 lengths and within each range, so that no task sees every length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer's file says texts are cut before its merges apply: a fixed value of its format.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
SPAN = 1024


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


_encodings: dict[str, object] = {}


def _encoding(digest: str, data: bytes):
    """One encoding for each worker and file, told by the file's content."""
    if digest not in _encodings:
        import tiktoken

        _encodings.clear()
        _encodings[digest] = tiktoken.Encoding("lodestone", pat_str=PATTERN, mergeable_ranks=read_ranks(data), special_tokens={})
    return _encodings[digest]


def document_lengths(docs: DataFrame, text: str = "text", ranks: str = RANKS) -> DataFrame:
    """(n_tokens) of every row's whole text; null and empty texts have 0. The file of ranks must be under 64 MB."""
    with open(ranks, "rb") as file:
        data = file.read((64 << 20) + 1)
    if len(data) > 64 << 20:
        raise ValueError("the file of ranks is over 64 MB")
    sent, digest = docs.sparkSession.sparkContext.broadcast(data), sha256(data).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(digest, sent.value).encode_ordinary
        for batch in batches:
            column = batch.column(0)
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(column[i].as_py())) for i in range(len(column))], pa.int64())], names=["n_tokens"])

    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("__t")).mapInArrow(run, "n_tokens long")


def length_table(lengths: DataFrame) -> DataFrame:
    """Suffix sums over a histogram of lengths (n_tokens long, one row for each document).

    One row for each length L that occurs: n_docs of just that length, docs_over and tokens_over of greater lengths,
    docs_upto and tokens_upto of L and less, truncated_tokens: what is left if every document is cut at L,
    and cumulative_share: docs_upto over all documents, from which quantiles are read. An empty table gives no rows.
    """
    histogram = lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("__r", F.expr(f"n_tokens div {SPAN}"))
    histogram = materialize(histogram, "token-lengths")
    own = F.col("n_docs") * F.col("n_tokens")
    later = Window.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = histogram.groupBy("__r").agg(F.sum("n_docs").alias("d"), F.sum(own).alias("t"))
    # one row for 1,024 lengths: as many rows as the longest document has thousands of tokens
    after = ranges.select("__r", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("__d"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("__t"))
    totals = ranges.agg(F.sum("d").alias("__docs"), F.sum("t").alias("__tokens"))
    within = Window.partitionBy("__r").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    summed = histogram.join(after, "__r").crossJoin(F.broadcast(totals)).select(  # totals is one row
        "n_tokens",
        "n_docs",
        (F.coalesce(F.sum("n_docs").over(within), F.lit(0)) + F.col("__d")).alias("docs_over"),
        (F.coalesce(F.sum(own).over(within), F.lit(0)) + F.col("__t")).alias("tokens_over"),
        "__docs",
        "__tokens",
    )
    return summed.select(
        "n_tokens",
        "n_docs",
        "docs_over",
        "tokens_over",
        (F.col("__docs") - F.col("docs_over")).alias("docs_upto"),
        (F.col("__tokens") - F.col("tokens_over")).alias("tokens_upto"),
        (F.col("__tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("truncated_tokens"),
        ((F.col("__docs") - F.col("docs_over")) / F.col("__docs")).alias("cumulative_share"),
    )


def truncated_total(table: DataFrame, limit: int) -> DataFrame:
    """One row (tokens) for any context limit: what is left if every document is cut there. 0 for an empty table.

    The row of the greatest length up to the limit has it: the tokens of lengths up to its own, and the limit for each longer
    document.
    """
    row = F.max_by(F.struct("tokens_upto", "docs_over"), F.when(F.col("n_tokens") <= limit, F.col("n_tokens"))).alias("x")
    found = table.agg(row, F.max(F.col("docs_over") + F.col("docs_upto")).alias("all"))
    return found.select(F.coalesce(F.col("x.tokens_upto") + F.col("x.docs_over") * limit, F.col("all") * limit, F.lit(0)).alias("tokens"))


def quantile(table: DataFrame, share: float | Column) -> DataFrame:
    """One row (n_tokens): the least length that at least `share` of the documents don't exceed. Null for an empty table."""
    return table.filter(F.col("cumulative_share") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, text: str = "text", ranks: str = RANKS) -> DataFrame:
    """length_table() of docs. Every row counts, repeated ones too; other columns are ignored."""
    return length_table(document_lengths(docs, text, ranks))
