"""Splits of positions 0..n-1 into parts: floor, balanced and ceiling chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def split_floor(pos: Column, n: int, parts: int) -> Column:
    """Chunks of floor(n / parts); the last part takes the rest (all rows, if there are fewer than parts)."""
    size = n // parts
    return F.lit(parts - 1).cast("int") if size == 0 else F.least(F.floor(pos / size), F.lit(parts - 1)).cast("int")


def split_balanced(pos: Column, n: int, parts: int) -> Column:
    """The first n mod parts parts get one row more than the others."""
    base, rest = divmod(n, parts)
    edge = rest * (base + 1)
    if base == 0:
        return pos.cast("int")
    return F.when(pos < edge, F.floor(pos / (base + 1))).otherwise(rest + F.floor((pos - edge) / base)).cast("int")


def split_ceil(pos: Column, n: int, parts: int) -> Column:
    """Chunks of ceil(n / parts); the last ones may be short or empty."""
    return F.floor(pos / max(1, -(-n // parts))).cast("int")


SPLITS = {"floor": split_floor, "balanced": split_balanced, "ceil": split_ceil}


def bounds(spark: SparkSession, n: int, parts: int, how: str) -> DataFrame:
    """(part, start, stop) of each part, stop excluded, empty parts too. Arithmetic over `parts` rows, not over n."""
    p = F.col("id")
    if how == "floor":
        size = n // parts
        start = p * size
        stop = F.when(p == parts - 1, n).otherwise((p + 1) * size)
    elif how == "balanced":
        base, rest = divmod(n, parts)
        start = p * base + F.least(p, F.lit(rest))
        stop = start + base + F.when(p < rest, 1).otherwise(0)
    elif how == "ceil":
        size = -(-n // parts)
        start = F.least(p * size, F.lit(n))
        stop = F.least((p + 1) * size, F.lit(n))
    else:
        raise ValueError(f"no such split: {how}")
    return spark.range(parts).select(p.cast("int").alias("part"), start.cast("long").alias("start"), stop.cast("long").alias("stop"))
