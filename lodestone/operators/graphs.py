"""Adjacency, breadth-first search and undamped ranking over edge tables (src, dst)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_files

#: A frontier or vector of at most this many rows is broadcast into the join with the edges; a larger one is shuffled.
SMALL = 200_000
#: Edges and nodes of a graph that one task ranks by itself (its process has 568 MB at most); larger graphs are ranked by joins.
GRAPH_ROWS = 5_000_000
#: Nodes of a diagonal of edges, at least.
DIAGONAL = 1024


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge in both directions; duplicates stay."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def adjacency(edges: DataFrame) -> DataFrame:
    """(v, neighbors): the sorted list of each node's neighbours, duplicates included."""
    return edges.groupBy(F.col("src").alias("v")).agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))


def edges_of(lists: DataFrame) -> DataFrame:
    """The edge table of adjacency()."""
    return lists.select(F.col("v").alias("src"), F.explode("neighbors").alias("dst"))


def in_degree(edges: DataFrame) -> DataFrame:
    """(dst, n) over distinct edges."""
    return edges.select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("n"))


def transition_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, w): distinct edges, self loops kept, w = 1 / in-degree of dst."""
    once = edges.select("src", "dst").distinct()
    return once.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("dst")))


def expand(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """(v): the distinct nodes next to a frontier (v)."""
    return frontier.join(edges, frontier["v"] == edges["src"]).select(F.col("dst").alias("v")).distinct()


def unvisited(candidates: DataFrame, visited: DataFrame) -> DataFrame:
    return candidates.join(visited.select("v"), "v", "left_anti")


def bfs_levels(edges: DataFrame, start: int) -> DataFrame:
    """(v, level) of every node reached from start over directed edges; start has level 0, whether it has edges or not.

    A level is a join, a distinct and an anti-join with what has been visited; each level is written on its own, and the
    visited table is the union of those files. The edges are written once, distinct, so that no level makes them again.
    """
    spark = edges.sparkSession
    edges = cut_lineage(edges.select("src", "dst").distinct())
    kind = edges.schema["src"].dataType
    frontier = spark.range(1).select(F.lit(start).cast(kind).alias("v"), F.lit(0).alias("level"))
    levels = [frontier]
    size, level = 1, 0
    while size:
        visited = levels[0]
        for more in levels[1:]:
            visited = visited.unionByName(more)
        level += 1
        near = frontier.select("v")
        near = expand(F.broadcast(near) if size <= SMALL else near, edges)
        frontier = cut_lineage(unvisited(near, visited).withColumn("level", F.lit(level)))
        size = frontier.count()
        if size:
            levels.append(frontier)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def bfs_count(edges: DataFrame, start: int) -> DataFrame:
    """One row (visited)."""
    return bfs_levels(edges, start).agg(F.count("*").alias("visited"))


def spmv(weights: DataFrame, vector: DataFrame, value: str = "e") -> DataFrame:
    """(v, y): y[src] = sum of w * x[dst]; nodes without an outgoing edge have no row."""
    joined = weights.join(vector.select(F.col("v").alias("dst"), F.col(value).alias("__x")), "dst")
    return joined.groupBy(F.col("src").alias("v")).agg(F.sum(F.col("w") * F.col("__x")).alias("y"))


def l2_norm(df: DataFrame, value: str, name: str = "norm") -> DataFrame:
    return df.agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias(name))


def l2_distance(df: DataFrame, a: str, b: str, name: str = "error") -> DataFrame:
    return df.agg(F.sqrt(F.sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))).alias(name))


def share_of_total(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """value over the sum of all values; the sum is one row, broadcast. Null where the sum is 0."""
    total = df.agg(F.sum(value).alias("__total"))
    return df.crossJoin(F.broadcast(total)).withColumn(name, F.try_divide(F.col(value), F.col("__total"))).drop("__total")


_UNSETTLED = "a graph's ranks are still over {} apart after {} steps"


class _Steps:
    """The sums over one graph's distinct edges, for vectors of its nodes in the order of their out-degrees, greatest first.

    The j-th edges of all nodes that have so many are a diagonal, a gather over a prefix of the nodes; what few nodes have beyond
    the diagonals is summed by stretches. Edges are 4 bytes each, in the order of their ends: sums don't depend on how rows come.
    """

    def __init__(self, edges: pa.Table, nodes: pa.Table) -> None:
        ids = nodes.column("v").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]

        def places(column: pa.ChunkedArray) -> np.ndarray:
            """Which node each is; -1 for what is no node."""
            out, done = np.empty(len(column), np.int32), 0
            for chunk in column.chunks:
                x = chunk.to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
                out[done : done + len(x)] = np.where(ids[at] == x, order[at], -1)
                done += len(x)
            return out

        dst = places(edges.column("dst"))
        count = np.bincount(dst[dst >= 0], minlength=len(ids))  # edges from what is no node count here, too
        src = places(edges.column("src"))
        known = (src >= 0) & (dst >= 0)
        src, dst = src[known], dst[known]
        del order, ids, known
        degree = np.bincount(src, minlength=len(count))
        by_degree = np.argsort(-degree, kind="stable")
        degree = degree[by_degree]
        self.place = np.empty(len(count), np.int32)
        self.place[by_degree] = np.arange(len(count), dtype=np.int32)
        del by_degree
        pointed = np.flatnonzero(count)  # the nodes whose values are read
        self.read, self.weight = self.place[pointed], 1.0 / count[pointed]
        where = np.zeros(len(count), np.int32)
        where[pointed] = np.arange(len(pointed), dtype=np.int32)
        key = self.place[src] * np.int64(max(1, len(pointed))) + where[dst]
        del src, dst, where, pointed, count
        key.sort()
        key %= max(1, len(self.read))
        ends = key.astype(np.int32)
        del key
        first = np.cumsum(degree) - degree
        self.diagonals: list[np.ndarray] = []
        while (k := int(np.searchsorted(-degree, -len(self.diagonals)))) >= DIAGONAL:
            self.diagonals.append(ends[first[:k] + len(self.diagonals)])
        over = degree[:k] - len(self.diagonals)
        self.starts = np.cumsum(over) - over
        rest = ends[: degree[:k].sum()]
        self.rest = rest[np.arange(len(rest)) - np.repeat(first[:k], degree[:k]) >= len(self.diagonals)]
        self.buffer = np.empty(len(self.diagonals[0]) if self.diagonals else 0)

    def add(self, e: np.ndarray, s: np.ndarray) -> None:
        """Add each node's sum over its edges' ends in e to s."""
        x = e[self.read] * self.weight
        for diagonal in self.diagonals:
            s[: len(diagonal)] += np.take(x, diagonal, out=self.buffer[: len(diagonal)], mode="clip")
        if len(self.rest):
            s[: len(self.starts)] += np.add.reduceat(x[self.rest], self.starts)


def _rank_one(threshold: float | None, iterations: int | None, max_iterations: int):
    """rank_graphs() of one graph's distinct edges and nodes."""

    def run(edges: pa.Table, nodes: pa.Table) -> pa.Table:
        n = nodes.num_rows
        e, done, error = np.ones(n), 0, np.inf
        if n:
            steps, s = _Steps(edges, nodes), np.zeros(n)
        while n and done < (iterations or max_iterations) and not (threshold is not None and (np.isnan(error) or error <= threshold)):
            if done:
                s[:] = e
            steps.add(e, s)
            norm = np.sqrt(s @ s)
            if norm:
                s /= norm
            else:
                s[:] = np.nan
            e -= s
            error, e, s, done = np.sqrt(e @ e), s, e, done + 1
        if threshold is not None and n and error > threshold:
            raise RuntimeError(_UNSETTLED.format(threshold, max_iterations))
        return nodes.select(["graph_id", "v"]).append_column("rank", pa.array((e / e.sum())[steps.place] if n else e))

    return run


def rank_graphs(edges: DataFrame, nodes: DataFrame, threshold: float | None = None, iterations: int | None = None, max_iterations: int = 10_000, graph_rows: int = GRAPH_ROWS) -> DataFrame:
    """(graph_id, v, rank) of several graphs at once; every graph stops on its own.

    edges: (graph_id, src, dst), nodes: (graph_id, v). Rank flows from a node to those that point to it, weighted by one
    over its in-degree; there is no damping. A node's sum is kept from one iteration to the next, so after the first
    iteration the step is (I + M), normalised to length 1; ranks sum to 1 in the end. A graph ends after `iterations`
    steps, or once two steps are at most `threshold` apart; a graph without a rank to give (all zero) has NaN ranks. It is an
    error if a graph hasn't ended after max_iterations steps. Rows with nulls don't count.

    If no graph has more than graph_rows edges or nodes, by a count, each is ranked by one task and graphs go side by side;
    else a step is a join of all graphs' edges and vectors, written and read again.
    """
    if (threshold is None) == (iterations is None):
        raise ValueError("give a threshold or a number of iterations")
    once = edges.select("graph_id", "src", "dst").dropna().distinct()
    nodes = nodes.select("graph_id", "v").dropna().distinct()
    if max(df.groupBy("graph_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] for df in (once, nodes)) <= graph_rows:
        shape = ", ".join(f"{c} {t}" for c, t in nodes.dtypes) + ", rank double"
        return once.groupBy("graph_id").cogroup(nodes.groupBy("graph_id")).applyInArrow(_rank_one(threshold, iterations, max_iterations), shape)
    weights = cut_lineage(once.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("graph_id", "dst"))))
    now = cut_lineage(nodes.withColumns({"e": F.lit(1.0), "acc": F.lit(0.0)}))
    n_graphs, n_nodes = now.agg(F.count_distinct("graph_id"), F.count("*")).first()

    def few(df: DataFrame, rows: int) -> DataFrame:
        """A side of at most SMALL rows goes to all tasks; a graph's norm must not bring its nodes to one."""
        return F.broadcast(df) if rows <= SMALL else df

    finished: list[DataFrame] = []
    done = 0
    while done < (iterations or max_iterations):
        x = now.select("graph_id", F.col("v").alias("dst"), F.col("e").alias("__x"))
        step = weights.join(few(x, n_nodes), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("v")).agg(F.sum(F.col("w") * F.col("__x")).alias("y"))
        summed = now.join(few(step, n_nodes), ["graph_id", "v"], "left").select("graph_id", "v", F.col("e").alias("old"), (F.col("acc") + F.coalesce("y", F.lit(0.0))).alias("s"))
        norms = summed.groupBy("graph_id").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
        scaled = summed.join(few(norms, n_graphs), "graph_id").withColumn("e", F.when(F.col("norm") == 0, F.lit(math.nan)).otherwise(F.col("s") / F.col("norm")))
        after = cut_lineage(scaled.select("graph_id", "v", "old", "e", F.col("e").alias("acc")))
        done += 1
        if threshold is not None:
            gap = after.groupBy("graph_id").agg(F.sqrt(F.sum((F.col("e") - F.col("old")) * (F.col("e") - F.col("old")))).alias("error"))
            # NaN compares as greater than everything here, but ends a graph
            ended = gap.filter(F.isnan("error") | (F.col("error") <= threshold)).select("graph_id")
            if ended.isEmpty():
                drop_files(now)
                now = after
                continue
            over = cut_lineage(ended)
            left = after.join(few(over, n_graphs), "graph_id", "left_anti")
            finished.append(after.join(few(over, n_graphs), "graph_id", "left_semi"))
            now = cut_lineage(left)
            if now.isEmpty():
                break
        else:
            drop_files(now)
            now = after
    else:
        if threshold is not None:
            raise RuntimeError(_UNSETTLED.format(threshold, max_iterations))
    out = now.select("graph_id", "v", "e")
    for more in finished:
        out = out.unionByName(more.select("graph_id", "v", "e"))
    totals = out.groupBy("graph_id").agg(F.sum("e").alias("__total"))
    return out.join(few(totals, n_graphs), "graph_id").select("graph_id", "v", F.try_divide("e", "__total").alias("rank"))


def rank(edges: DataFrame, nodes: DataFrame, **how: float) -> DataFrame:
    """rank_graphs() of one graph: edges (src, dst), nodes (v) -> (v, rank)."""
    return rank_graphs(edges.withColumn("graph_id", F.lit(0)), nodes.withColumn("graph_id", F.lit(0)), **how).select("v", "rank")
