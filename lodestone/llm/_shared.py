"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_files, remember_folder, shared_folder, table  # noqa: F401

#: Bytes 0x20 and 0x09-0x0D: what separates words in every operator here.
WORD_GAPS = " \t\n\x0b\f\r"
GAP_PATTERN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side is broadcast by hint only if it has at most this many rows.
BROADCAST_ROWS = 50_000
#: Keys of one or two longs are broadcast up to this many (32 MB); above, the planner shuffles.
KEY_ROWS = 2_000_000


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Lineage ends here: a lost executor costs the reading of files, not the recomputation of what made them.
    The files go when the driver's interpreter ends, or earlier through discard().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    remember_folder(spark, path)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the files behind a materialized DataFrame that no later step reads."""
    if df is not None:
        drop_files(df)


def hint_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast df if it is known to have few rows; otherwise leave the choice to the planner."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one, __row: whatever their names, they can't clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")


def row_hashes(key: str, text: str) -> tuple[Column, Column]:
    """128 bits, as two longs, that tell a row by its key and text; rows equal in both are one, null texts are empty ones."""
    t = F.coalesce(F.col(text), F.lit(""))
    k = F.coalesce(F.col(key).cast("string"), F.lit("\x00"))
    return F.xxhash64(k, t), F.xxhash64(t, F.lit(1), k)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_array(text: Column) -> Column:
    """The words of a text, runs of anything but 0x20 and 0x09-0x0D; null and blank texts have none."""
    trimmed = F.call_function("btrim", F.coalesce(text, F.lit("")), F.lit(WORD_GAPS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP_PATTERN))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a mapInArrow function, after which the worker gives free memory back to the system: workers stay, idle, while the JVM needs it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform.startswith("linux"):
            getattr(ctypes.CDLL(None), "malloc_trim", int)(0)  # other C libraries than GNU's lack it

    return task
