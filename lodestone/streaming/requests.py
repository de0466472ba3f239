"""A stream of requests, each answered by a stateless map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import http_response


def listen(spark: SparkSession, host: str = "localhost", port: int = 6969) -> DataFrame:
    """Lines of a TCP connection as (value). For demonstrations: the source can't answer."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def listen_files(spark: SparkSession, folder: str, schema, backlog: int = 5) -> DataFrame:
    """Files that arrive in a folder, `backlog` at most in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", backlog).parquet(folder)


def serve_files(spark: SparkSession, folder: str, schema, out: str, backlog: int = 5, value: str = "value") -> None:
    """Answer what has arrived in a folder, batch by batch, and append the replies to the folder out; ends when all is answered.

    A batch is answered once even if the query is stopped and started again: what it has read is kept beside out.
    """
    replies = respond(listen_files(spark, folder, schema, backlog), value)
    running = replies.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out.rstrip('/')}-state").trigger(availableNow=True).start()
    running.awaitTermination()


def respond(requests: DataFrame, value: str = "value") -> DataFrame:
    """Batch or stream: adds response. Requests that couldn't be read (null) are dropped and not answered."""
    return requests.filter(F.col(value).isNotNull()).withColumn("response", http_response(value))
