"""Folders of numbered graph files: <i>.txt with the number of nodes, a line 'from to' for each edge, and END."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import atoi
from ..session import shared_folder


def write_graphs(edges: DataFrame, nodes: DataFrame, folder: str | None = None) -> str:
    """(graph_id, src, dst) and (graph_id, v) -> the folder, with one text for each graph under graph_id=<i>/.

    A graph is one text, gathered by one task, as the format asks for.
    """
    folder = folder or f"{shared_folder(edges.sparkSession)}/graphs-{uuid.uuid4().hex}"
    line = F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"))
    bodies = edges.groupBy("graph_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("src", "dst", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    heads = nodes.groupBy("graph_id").agg(F.count("*").cast("string").alias("n"))
    texts = heads.join(bodies, "graph_id", "left").select("graph_id", F.concat_ws("\n", "n", "body", F.lit("END")).alias("value"))
    texts.repartition("graph_id").write.partitionBy("graph_id").text(folder)
    return folder


def read_graphs(spark: SparkSession, folder: str, n_graphs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(graph_id, src, dst) and (graph_id, n): the first n_graphs numbered graphs of a folder of <i>.txt or graph_id=<i>/ files.

    Lines after END are ignored, with or without a line end behind it; numbers are read as far as they go. The id comes
    from the path, so files of other graphs are left out before their lines are parsed.
    """
    texts = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    number = F.regexp_extract("path", r"(?:graph_id=(\d+)/[^/]*|/(\d+)\.txt)$", 0)
    ids = texts.withColumn("graph_id", F.regexp_extract(number, r"(\d+)", 1).try_cast("long")).filter("graph_id IS NOT NULL")
    if n_graphs is not None:
        ids = ids.filter(F.col("graph_id") < n_graphs)
    lines = F.split(F.regexp_replace("value", r"\r", ""), "\n")
    ended = F.when(F.array_position(lines, "END") > 0, F.slice(lines, F.lit(1), (F.array_position(lines, "END") - 1).cast("int"))).otherwise(lines)
    parsed = ids.select("graph_id", ended.alias("lines"))
    sizes = parsed.select("graph_id", atoi(F.get("lines", 0)).alias("n"))
    rows = parsed.select("graph_id", F.explode(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))).alias("l")).filter("trim(l) <> ''")
    parts = F.split(F.trim("l"), " +")
    return rows.select("graph_id", atoi(F.get(parts, 0)).alias("src"), atoi(F.coalesce(F.get(parts, 1), F.lit(""))).alias("dst")), sizes
