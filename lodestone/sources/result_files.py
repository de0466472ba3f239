"""Result tables as delimited text: appended rows, pivots, and texts by folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import shared_folder

MEASUREMENT = T.StructType(
    [
        T.StructField("array_size", T.LongType()),
        T.StructField("program_name", T.StringType()),
        T.StructField("num_threads", T.IntegerType()),
        T.StructField("min_parallel_size", T.IntegerType()),
        T.StructField("thread_stack_size", T.LongType()),
        T.StructField("time", T.DoubleType()),
    ]
)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"


def append_rows(df: DataFrame, folder: str, sep: str = "\t") -> None:
    """Add rows; each file that is written has its own header line."""
    df.write.mode("append").csv(folder, sep=sep, header=True)


def read_rows(spark: SparkSession, folder: str, schema: T.StructType, sep: str = "\t") -> DataFrame:
    """The schema is given: nothing is inferred, and files aren't read twice."""
    return spark.read.csv(folder, sep=sep, header=True, schema=schema)


def write_pivot(pivot: DataFrame, folder: str, order: str) -> None:
    """A pivot as one tab-separated file, in the order of its key. Pivots have a row for each size: a few."""
    pivot.orderBy(order).coalesce(1).write.mode("overwrite").csv(folder, sep="\t", header=True, emptyValue="")


def write_pivots(pivots: DataFrame, folder: str, by: str, order: str) -> None:
    """A pivot for each value of `by`, one tab-separated file under by=<value>/, in the order of its key."""
    pivots.repartition(by).sortWithinPartitions(by, order).write.mode("overwrite").partitionBy(by).csv(folder, sep="\t", header=True, emptyValue="")


def write_texts(df: DataFrame, folder: str, by: str, text: str = "value") -> None:
    """A folder by=<value>/ for each value, with a line for each row."""
    df.select(by, text).write.partitionBy(by).mode("append").text(folder)
