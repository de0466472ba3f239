"""Reports over measured runs: means, first-value pivots, splits by threads, latencies and completion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seconds
from ..functions.scalars import PERF_PATTERN, TRAVERSAL_PATTERN, micros


def mean_runs(runs: DataFrame, keys: list[str], value: str = "time") -> DataFrame:
    """Mean of each configuration over the runs that have a value; configurations without any are left out."""
    return runs.groupBy(*keys).agg(F.avg(value).alias("mean")).filter(F.col("mean").isNotNull())


def first_value_pivot(runs: DataFrame, row: str, column: str, names: list[str], value: str, order: Column | str, cell=seconds) -> DataFrame:
    """One row for each value of `row`, one text column for each name: the cell of the first value by `order`, '' if there is none.

    The names are given, so the plan is one aggregation; no job looks for them first.
    """
    first = [F.min_by(F.col(value), F.when((F.col(column) == n) & F.col(value).isNotNull(), order if isinstance(order, Column) else F.col(order))).alias(n) for n in names]
    return runs.filter(F.col(column).isin(names)).groupBy(row).agg(*first).select(row, *[cell(n).alias(n) for n in names])


def split_by_threads(runs: DataFrame, threads: int, suffix: str = "_{}") -> tuple[DataFrame, str]:
    """The runs of one thread count, and the suffix its report's file gets."""
    return runs.filter(F.col("num_threads") == threads), suffix.format(threads)


def series(runs: DataFrame, program: str, size: str = "size", time: str = "time") -> DataFrame:
    """(x, y): a program's sizes and seconds, what a line of a chart is drawn from."""
    return runs.filter(F.col("program_name") == program).select(F.col(size).alias("x"), (F.col(time) / 1e9).alias("y"))


def pivots_by_threads(runs: DataFrame, names: list[str], order: str, row: str = "size", threads: str = "num_threads", program: str = "program_name", time: str = "time") -> DataFrame:
    """(threads, row, one text column for each name): the pivots of all thread counts in one aggregation; write_pivots() writes one for each count."""
    keyed = runs.withColumn("__row", F.struct(threads, row))
    return first_value_pivot(keyed, "__row", program, names, time, order).select("__row.*", *names)


def total_by(df: DataFrame, *keys: str, name: str = "total") -> DataFrame:
    """How many rows each file, graph or other key has in all."""
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def union_distinct(*parts: DataFrame) -> DataFrame:
    """Local results put together and made distinct."""
    return union_all(*parts).distinct()


def valid_sizes(df: DataFrame, size: str, most: int | None = None) -> DataFrame:
    """Rows whose size is positive and at most `most`; the others are skipped, as runs of such sizes are."""
    ok = F.col(size) > 0
    return df.filter(ok if most is None else ok & (F.col(size) <= most))


def small_output(df: DataFrame, n: int, most: int = 100) -> DataFrame | None:
    """df if it has at most `most` rows by the given count, to be shown; None otherwise."""
    return df if n <= most else None


def run_matrix(*axes: DataFrame) -> DataFrame:
    """Every combination of the axes' values: the list of runs to make. Axes are lists of settings, a few rows each."""
    out = axes[0]
    for axis in axes[1:]:
        out = out.crossJoin(F.broadcast(axis))
    return out


def scan_perf_log(logs: DataFrame, text: str = "value") -> DataFrame:
    """The first PERFDATA line of each log text: its six fields, null where there is none."""
    field = [F.regexp_extract(text, PERF_PATTERN, g) for g in range(1, 7)]
    names = ("array_size", "program_name", "num_threads", "min_parallel_size", "thread_stack_size", "time")
    kinds = ("long", "string", "int", "int", "long", "double")
    found = F.regexp_like(text, F.lit(PERF_PATTERN))
    return logs.select("*", *[F.when(found, f.try_cast(k)).alias(n) for f, n, k in zip(field, names, kinds)])


def scan_traversal_log(logs: DataFrame, text: str = "value") -> DataFrame:
    return logs.withColumn("time", F.regexp_extract(text, TRAVERSAL_PATTERN, 1).try_cast("double"))


def latency_summary(samples: DataFrame, latency: str = "latency", by: list[str] | None = None) -> DataFrame:
    """(total, n_ok, n_failed, mean): failed requests have a latency under 0. Partial sums by task, then the whole."""
    ok = F.col(latency) >= 0
    return samples.groupBy(*(by or [])).agg(
        F.sum(F.when(ok, F.col(latency))).alias("total"),
        F.count_if(ok).alias("n_ok"),
        F.count_if(F.col(latency) < 0).alias("n_failed"),
        F.avg(F.when(ok, F.col(latency))).alias("mean"),
    )


def task_completion(tasks: DataFrame, loop: str, expected: str) -> DataFrame:
    """(loop, n_tasks, complete): how many tasks each loop finished, and whether that is the number expected, the greatest in its rows."""
    return tasks.groupBy(loop).agg(F.count("*").alias("n_tasks"), (F.count("*") == F.max(expected)).alias("complete"))


def matching_lines(lines: DataFrame, pattern: str, text: str = "value") -> DataFrame:
    return lines.agg(F.count_if(F.regexp_like(text, F.lit(pattern))).alias("n"))


def lifecycle(threads: DataFrame) -> DataFrame:
    """Spans of (thread_id, launch, work_start, work_end, destroy) in microseconds."""
    m = {c: micros(c) for c in ("launch", "work_start", "work_end", "destroy")}
    return threads.select(
        "thread_id",
        (m["work_start"] - m["launch"]).alias("launch_us"),
        (m["work_end"] - m["work_start"]).alias("work_us"),
        (m["destroy"] - m["work_end"]).alias("destroy_us"),
        (m["destroy"] - m["launch"]).alias("total_us"),
    )


def lifecycle_means(threads: DataFrame) -> DataFrame:
    spans = lifecycle(threads)
    return spans.agg(F.count("*").alias("n_threads"), *[F.avg(c).alias(f"mean_{c}") for c in spans.columns[1:]])
