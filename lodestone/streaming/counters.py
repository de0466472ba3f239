"""Running counts over a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def running_counts(stream: DataFrame, *keys: str) -> DataFrame:
    """Counts so far, by key (one count without keys). State is one number for each key."""
    return stream.groupBy(*keys).agg(F.count("*").alias("n"))


def drain_counts(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Stream what is at path until nothing is left, and give the final counts.

    Every batch writes all counts to its own folder of the shared place; the last batch's are read again. The path is a
    file or a folder of Parquet files.
    """
    at = f"{shared_folder(spark)}/counts-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    # the stream's source wants a folder; a single file is found by its name there
    single = spark.read.parquet(path).select("_metadata.file_name").limit(1).first()
    if single is not None and single[0] == name:
        source = stream.option("pathGlobFilter", name).option("recursiveFileLookup", "false").parquet(folder)
    else:
        source = stream.parquet(path)
    batches: list[int] = []

    def keep(counts: DataFrame, batch: int) -> None:
        counts.write.mode("overwrite").parquet(f"{at}/batch={batch}")
        batches.append(batch)

    counted = running_counts(source, *keys)
    running = counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{at}-state").trigger(availableNow=True).start()
    running.awaitTermination()
    if not batches:
        return spark.createDataFrame([], counted.schema)
    return spark.read.parquet(f"{at}/batch={batches[-1]}")
