"""Inputs made by rule: integers, permutations, graphs and matrices.

The random ones take a seed and are distributed; the arithmetic ones give the same rows in every engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform_ints(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(pos, v): n integers, each of 0..n-1."""
    return spark.range(n).select(F.col("id").alias("pos"), F.floor(F.rand(seed) * n).cast("int").alias("v"))


def arithmetic_ints(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), ((F.col("id") * 7919 + 13) % n).alias("v"))


def permutation(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(pos, v): 0..n-1 shuffled by a keyed hash. A sort by range; no single task sees all rows."""
    from ..operators.sorting import with_position

    return with_position(spark.range(n).select(F.col("id").alias("v"), F.xxhash64("id", F.lit(seed)).alias("__h")), ["__h", "v"]).select("pos", "v")


def random_multigraph(spark: SparkSession, n: int, least: int = 50, most: int = 100, seed: int = 42) -> DataFrame:
    """(src, dst): `least` to `most` edges drawn for each node, in both directions, duplicates kept, no self loops."""
    drawn = spark.range(n).select(F.col("id").alias("src"), F.floor(F.rand(seed) * (most - least + 1) + least).cast("int").alias("k"))
    ends = drawn.select("src", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("j")).select("src", F.floor(F.rand(seed + 1) * (n - 1)).alias("d"))
    # drawn from the n - 1 other nodes, so nothing has to be drawn again
    one_way = ends.select("src", (F.col("d") + F.when(F.col("d") >= F.col("src"), 1).otherwise(0)).cast("long").alias("dst")) if n > 1 else ends.select("src", F.col("d").cast("long").alias("dst")).limit(0)
    # an edge is given both ways from one row: drawing again for the other way would give other ends
    return one_way.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*")


def arithmetic_multigraph(spark: SparkSession, n: int) -> DataFrame:
    """Like random_multigraph(), by rule: 50 + i mod 51 edges for node i; self loops are left out."""
    ends = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") % 51 + 49)).alias("j"))
    one_way = ends.select("src", ((F.col("src") * 31 + F.col("j") * F.col("j") * 17 + F.col("j") + 1) % n).alias("dst")).filter("src <> dst")
    return one_way.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*")


def three_out_graph(spark: SparkSession, n: int, distinct: bool = True) -> tuple[DataFrame, DataFrame]:
    """(src, dst) and (v): node i points to (i*i + j*i) mod n for j in 0..2; duplicates collapse, self loops stay."""
    i = F.col("id")
    edges = spark.range(n).select(i.alias("src"), F.explode(F.array(*[(i * i + j * i) % n for j in range(3)])).alias("dst"))
    return (edges.distinct() if distinct else edges), spark.range(n).select(i.alias("v"))


def random_three_out(spark: SparkSession, n_graphs: int, least: int, most: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(graph_id, src, dst) and (graph_id, v): sizes in [least, most), three edges drawn for each node, duplicates and self loops included."""
    size = (F.lit(least) + F.pmod(F.xxhash64("graph_id", F.lit(seed)), F.lit(max(1, most - least)))).cast("long")
    nodes = spark.range(n_graphs).select(F.col("id").alias("graph_id")).withColumn("n", size).select("graph_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("v"))
    ends = [F.pmod(F.xxhash64("graph_id", "v", F.lit(seed), F.lit(j)), F.col("n")) for j in range(3)]
    return nodes.select("graph_id", F.col("v").alias("src"), F.explode(F.array(*ends)).alias("dst")), nodes.select("graph_id", "v")


def arithmetic_factor(spark: SparkSession, n: int) -> DataFrame:
    """(i, k, b): an n x n matrix of whole numbers 1..10, to be multiplied by its transpose."""
    i, k = F.col("i"), F.col("k")
    grid = spark.range(n).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    return grid.select("i", "k", ((i * 7 + k * 3 + i * k) % 10 + 1).cast("double").alias("b"))


def random_factor(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    grid = spark.range(n).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    return grid.select("i", "k", (F.pmod(F.xxhash64("i", "k", F.lit(seed)), F.lit(10)) + 1).cast("double").alias("b"))


def constant_vector(spark: SparkSession, n: int, value: float) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("v"), F.lit(float(value)).alias("e"))
