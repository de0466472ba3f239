"""Stable sorting, merging of sorted runs and bitwise radix passes.

A global position is never made by a window without partitions, which would put every row into one task: rows are
range-partitioned by the sort key, counted by partition, and numbered from their partition's offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bit_length, ceil_div, kth_bit
from ..session import cut_lineage, drop_files


#: Rows that a range of radix_pass() has, about.
RANGE_ROWS = 1_000_000
#: Bits that a pass of radix_sort() takes, and the counts (ranges times digits) beyond which it takes fewer.
DIGIT_BITS, CELLS = 4, 1 << 20


def with_position(df: DataFrame, order: list[Column | str], name: str = "pos", start: int = 0) -> DataFrame:
    """df with each row's place in the given order, from `start` on. Ties of the whole order are placed arbitrarily.

    One shuffle by range: each range is sorted, numbered on its own and written, then moved behind the ranges before it by
    their counts, which are one small aggregation of the written numbers.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    # the low 33 bits of monotonically_increasing_id() number a partition's rows in their order, the others are its number
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("__id", F.monotonically_increasing_id())
    fixed = cut_lineage(ranged)
    part = F.shiftright("__id", 33)
    counts = fixed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = (F.col("__id").bitwiseAND((1 << 33) - 1) + F.col("__before") + start).cast("long")
    return fixed.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(name, place).drop("__id", "__part", "__before")


def stable_sort(df: DataFrame, key: Column | str, pos: Column | str) -> DataFrame:
    """Ascending by key; equal keys keep the order of pos."""
    return df.orderBy(key, pos)


def merge_runs(left: DataFrame, right: DataFrame, key: str, pos: str, name: str = "rank") -> DataFrame:
    """Two sorted runs as one: ties go to the left run, and inside a run to the smaller pos. Adds side and the merged rank from 1 on."""
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    return with_position(both, [key, "side", pos], name, start=1)


def bottom_up_pass(df: DataFrame, run: int, key: str = "v", pos: str = "pos", name: str = "new_pos") -> DataFrame:
    """One pass over runs of `run` rows: every block of 2 * run rows comes out sorted. Blocks are independent keys."""
    block = F.floor(F.col(pos) / (2 * run)).cast("long")
    place = F.row_number().over(Window.partitionBy(block).orderBy(key, pos))
    return df.withColumn(name, block * (2 * run) + place - 1)


def bottom_up_sort(df: DataFrame, n: int, key: str = "v", pos: str = "pos") -> DataFrame:
    """All passes; doubles the run until it covers n rows. The last passes have few blocks: stable_sort() is the one to use at scale."""
    run, now = 1, df
    while run < n:
        step = cut_lineage(bottom_up_pass(now, run, key, pos).drop(pos).withColumnRenamed("new_pos", pos))
        drop_files(now)
        now, run = step, run * 2
    return now


def merge_tasks(spark: SparkSession, n: int) -> DataFrame:
    """(run, merges): how many two-way merges each pass over n rows makes, from runs of one row on."""
    passes = max(0, n - 1).bit_length()
    run = F.expr("shiftleft(1L, cast(id as int))")
    return spark.range(passes).select(run.alias("run"), ceil_div(F.lit(n), 2 * run).alias("merges"))


def distinct_ranks(df: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """The distinct keys with their places in order, from 1 on."""
    return with_position(df.select(key).distinct(), [key], name, start=1)


def running_offsets(df: DataFrame, group: str, order: str, name: str = "running") -> DataFrame:
    """df with how many rows of the same group come before each."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return df.withColumn(name, place.cast("long"))


def radix_pass(df: DataFrame, bit: int, value: str = "v", pos: str = "pos", name: str = "new_pos", parts: int | None = None, n: int | None = None, width: int = 1) -> DataFrame:
    """Stable partition by one bit: zeros keep their order in front, ones theirs behind. Or by the digit of `width` bits from there on.

    Positions are cut into `parts` ranges, by default of RANGE_ROWS rows and 64 at least; each has a histogram of the digits, whose exclusive sums over the ranges are the
    offsets of the rows that a range numbers on its own, behind all rows of smaller digits.
    """
    if n is None:
        n = df.count()
    parts = parts or radix_parts(n)
    size = max(1, -(-n // parts))
    digit = kth_bit(value, bit) if width == 1 else F.shiftright(value, bit).bitwiseAND((1 << width) - 1).cast("int")
    rows = df.withColumn("__bit", digit).withColumn("__part", F.floor(F.col(pos) / size).cast("int"))
    offsets = exclusive_offsets(rows.groupBy("__part", "__bit").agg(F.count("*").alias("__n")), "__part", "__bit", "__n")
    smaller = Window.orderBy("__bit").rowsBetween(Window.unboundedPreceding, -1)  # a row for each digit
    bases = offsets.groupBy("__bit").agg(F.sum("__n").alias("__n")).select("__bit", F.coalesce(F.sum("__n").over(smaller), F.lit(0)).alias("__base"))
    place = F.row_number().over(Window.partitionBy("__part", "__bit").orderBy(pos)) - 1
    joined = rows.join(F.broadcast(offsets.drop("__n")), ["__part", "__bit"]).join(F.broadcast(bases), "__bit")  # 2 ** width * parts rows, and 2 ** width
    return joined.withColumn(name, (place + F.col("before") + F.col("__base")).cast("long")).drop("__part", "__bit", "before", "__base")


def radix_parts(n: int) -> int:
    """How many ranges n rows are cut into: a task's share doesn't grow with them."""
    return max(64, -(-n // RANGE_ROWS))


def exclusive_offsets(histogram: DataFrame, part: str, group: str, count: str) -> DataFrame:
    """histogram with `before`: the counts of the same group in earlier parts."""
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return histogram.withColumn("before", F.coalesce(F.sum(count).over(earlier), F.lit(0)))


def radix_sort(df: DataFrame, value: str = "v", pos: str = "pos") -> DataFrame:
    """Least bits first, a pass for every DIGIT_BITS bits that the greatest value has. Values must not be negative."""
    least, bits, n = df.agg(F.min(value), F.max(bit_length(value)), F.count("*")).first()
    if least is not None and least < 0:
        raise ValueError("radix_sort takes non-negative values only")
    now, width = df, max(1, min(DIGIT_BITS, (CELLS // radix_parts(n)).bit_length() - 1))
    for bit in range(0, bits or 0, width):
        step = cut_lineage(radix_pass(now, bit, value, pos, n=n, width=width).drop(pos).withColumnRenamed("new_pos", pos))
        drop_files(now)
        now = step
    return now


def bit_histogram(df: DataFrame, value: str, bits: int) -> DataFrame:
    """(k, bit, n): how many values have a 0 or a 1 at each of the lowest `bits` places. One pass over the rows."""
    places = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), kth_bit(value, k).alias("bit")) for k in range(bits)])).alias("x")
    return df.select(places).groupBy("x.k", "x.bit").agg(F.count("*").alias("n"))
