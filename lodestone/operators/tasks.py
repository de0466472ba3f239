"""Independent tasks: submit many, wait for all, count what was finished.

Executors are the pool; a task is a row, and many rows share a Python worker. Growth, idle workers and hand-over of
results are the scheduler's.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_tasks(spark: SparkSession, n: int, body: Callable[[int], float], parallel: int | None = None) -> DataFrame:
    """(task_id, result): body(task_id) of tasks 0..n-1 on `parallel` partitions (as many as the session has cores by default).

    body may run more than once for a task if an executor is lost, and must not have side effects of its own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"task_id": batch["id"], "result": [float(body(i)) for i in batch["id"].tolist()]})

    return spark.range(0, n, 1, parallel or spark.sparkContext.defaultParallelism).mapInPandas(run, "task_id long, result double")


def logged_tasks(spark: SparkSession, n: int, body: Callable[[int], float], parallel: int | None = None) -> DataFrame:
    """run_tasks() with a log: (task_id, worker, started_ns, ended_ns, result). A worker is a partition; clocks are the executors' own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker = TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for i in batch["id"].tolist():
                started = time.time_ns()
                result = float(body(i))
                rows.append((i, worker, started, time.time_ns(), result))
            yield pd.DataFrame(rows, columns=["task_id", "worker", "started_ns", "ended_ns", "result"])

    return spark.range(0, n, 1, parallel or spark.sparkContext.defaultParallelism).mapInPandas(run, "task_id long, worker int, started_ns long, ended_ns long, result double")


def completed(tasks: DataFrame) -> DataFrame:
    """One row (n_tasks, total)."""
    return tasks.agg(F.count("*").alias("n_tasks"), F.sum("result").alias("total"))
