"""Connected components of a link table, by alternating large-star and small-star steps.

Links never come to the driver: each step is two shuffles over the links that are left, and the loop ends when the
table, told by its count and a hash sum, no longer changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialize


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (the larger ones for large, the others and itself for small) are linked to its least neighbour."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (u long, v long) -> (node, root): every linked node with the least node it can reach, itself included.

    Repeated links, links of a node to itself and links with a null end count for nothing; without links there are no rows. A
    root with very many nodes is one key of a join; the planner's skew join splits it.
    """
    now = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    state = _state(now)
    while state[0]:
        after = materialize(_star(_star(now, True), False), "links")
        reached = _state(after)
        discard(now)
        now = after
        if reached == state:
            break
        state = reached
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
