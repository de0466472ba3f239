"""Gram products and Cholesky factors of matrices held as coordinate tables (i, j, a)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_files

#: Largest order that one task factors densely (128 MB of doubles); above, factor_relational() is the way.
DENSE_ORDER = 4000


def gram(rows: DataFrame) -> DataFrame:
    """B times its transpose: (i, k, b) -> (i, j, a). A self-join on k, aggregated before and after the shuffle."""
    left = rows.select("k", F.col("i"), F.col("b").alias("x"))
    right = rows.select("k", F.col("i").alias("j"), F.col("b").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("a"))


def gram_of_vectors(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """Products of the first `dims` components over all rows: (i, j, a), without a join.

    Each task adds the products of its batches into one dims x dims block and gives that, so rows are read once and only
    blocks are shuffled. Rows without a vector, or a shorter one, count as zeros where they have none.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            if batch.num_rows:
                x = np.array([row + [0.0] * (dims - len(row)) for row in batch.column(0).to_pylist()])
                total += x.T @ x
        i, j = np.indices((dims, dims))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "a"])

    cells = F.transform(F.slice(F.coalesce(vector, F.array()), 1, dims), lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    return df.select(cells.alias("x")).mapInArrow(add, "i int, j int, a double").groupBy("i", "j").agg(F.sum("a").alias("a"))


def factor_relational(matrix: DataFrame, n: int, block: int = 64) -> DataFrame:
    """(i, j, l), i >= j: the lower Cholesky factor, `block` columns at a time.

    A block needs those before it, so this is n / block steps: what the finished columns take from the block's rows is a
    join and a sum over the cluster, the block's own square is factored by one task, and each row below it is solved for on
    its own. Only a step's new columns are written. A matrix that isn't positive definite gives NaN from the first bad column
    on.
    """
    done: DataFrame | None = None
    for low in range(0, n, block):
        high = min(low + block, n)
        panel = matrix.filter((F.col("j") >= low) & (F.col("j") < high) & (F.col("i") >= F.col("j"))).select("i", "j", "a")
        if done is not None:
            pivot = done.filter((F.col("i") >= low) & (F.col("i") < high)).select(F.col("j").alias("k"), F.col("i").alias("j"), F.col("l").alias("lj"))
            rows = done.filter(F.col("i") >= low).select("i", F.col("j").alias("k"), F.col("l").alias("li"))
            dots = rows.join(pivot, "k").filter("i >= j").groupBy("i", "j").agg(F.sum(F.col("li") * F.col("lj")).alias("dot"))
            panel = panel.join(dots, ["i", "j"], "left").select("i", "j", (F.col("a") - F.coalesce("dot", F.lit(0.0))).alias("a"))
        panel = cut_lineage(panel)
        square = panel.filter(F.col("i") < high).agg(F.collect_list(F.struct("i", "j", "a")).alias("square"))  # block x block cells
        below = panel.filter(F.col("i") >= high).groupBy("i").agg(F.collect_list(F.struct("j", "a")).alias("row"))
        top = square.select(F.lit(-1).alias("i"), F.array().cast("array<struct<j:int,a:double>>").alias("row"), "square")
        solved = below.crossJoin(F.broadcast(square)).unionByName(top).mapInArrow(_solve(low, high), "i int, j int, l double")
        step = cut_lineage(solved)
        drop_files(panel)
        done = step if done is None else done.unionByName(step)
    if done is None:
        return matrix.select("i", "j", F.col("a").alias("l")).limit(0)
    return done


def _solve(low: int, high: int):
    """Rows (i, row, square) -> the factor's entries in columns [low, high) of row i; of the square's own rows where i is -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a = np.zeros((high - low, high - low))
            for c in batch.column(2)[0].as_py():
                a[c["i"] - low, c["j"] - low] = a[c["j"] - low, c["i"] - low] = c["a"]
            factor = _lower(a)
            owners, below = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if -1 in owners:
                rows, columns = np.tril_indices(high - low)
                yield _cells(rows + low, columns + low, factor[rows, columns])
            given = [k for k, i in enumerate(owners) if i >= 0]
            if given:
                right = np.zeros((len(given), high - low))
                for k, at in enumerate(given):
                    for c in below[at]:
                        right[k, c["j"] - low] = c["a"]
                with np.errstate(all="ignore"):
                    for j in range(high - low):
                        right[:, j] = (right[:, j] - right[:, :j] @ factor[j, :j]) / factor[j, j]
                yield _cells(np.repeat(np.array(owners)[given], high - low), np.tile(np.arange(low, high), len(given)), right.ravel())

    return run


def _cells(i: np.ndarray, j: np.ndarray, l: np.ndarray) -> pa.RecordBatch:
    """Entries as Arrow columns: pandas would turn NaN into null on the way."""
    return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(l)], names=["i", "j", "l"])


def _lower(a: np.ndarray) -> np.ndarray:
    n = len(a)
    try:
        return np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        # column by column, as far as the numbers go: NaN from the first negative pivot on
        low = np.zeros((n, n))
        with np.errstate(all="ignore"):
            for j in range(n):
                low[j, j] = np.sqrt(a[j, j] - low[j, :j] @ low[j, :j])
                low[j + 1 :, j] = (a[j + 1 :, j] - low[j + 1 :, :j] @ low[j, :j]) / low[j, j]
        return low


def _factor(cells: pa.Table) -> pa.Table:
    at_i, at_j, values = (cells.column(c).to_numpy() for c in ("i", "j", "a"))
    n = int(at_i.max()) + 1
    a = np.zeros((n, n))
    a[at_i, at_j] = values
    i, j = np.tril_indices(n)
    made = pa.Table.from_batches([_cells(i, j, _lower(a)[i, j])])
    return made.add_column(0, "matrix_id", pa.array(np.full(len(i), cells.column("matrix_id")[0].as_py(), np.int64)))


def factor_many(matrices: DataFrame) -> DataFrame:
    """(matrix_id, i, j, a) -> (matrix_id, i, j, l): a task for each matrix, of order DENSE_ORDER at most."""
    largest = matrices.agg(F.max("i")).first()[0]
    if largest is not None and largest >= DENSE_ORDER:
        raise ValueError(f"a matrix has order {largest + 1}; use factor_relational() over {DENSE_ORDER}")
    return matrices.select("matrix_id", "i", "j", "a").groupBy("matrix_id").applyInArrow(_factor, "matrix_id long, i int, j int, l double")


def top_left(matrix: DataFrame, value: str, n: int = 5) -> DataFrame:
    """The n x n corner as text cells of width 8."""
    return matrix.filter((F.col("i") < n) & (F.col("j") < n)).select("i", "j", F.format_string("%8.4f", value).alias("cell"))


def densify(lower: DataFrame, n: int) -> DataFrame:
    """(i, j, l) of all n x n places; 0 where the factor has none."""
    spark: SparkSession = lower.sparkSession
    grid = spark.range(n).select(F.col("id").cast("int").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.join(lower, ["i", "j"], "left").select("i", "j", F.coalesce("l", F.lit(0.0)).alias("l"))
