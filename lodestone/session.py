"""Sessions and the shared folder that iterative operators write to."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None
_written: list[tuple[SparkSession, str]] = []


def local_session(cores: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    """A local session: AQE on, as many shuffle partitions as cores, UTC."""
    settings = {
        "spark.master": f"local[{cores}]",
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | more
    return SparkSession.builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def setting(spark: SparkSession, name: str, default: str | None = None) -> str | None:
    """What a run is told by name: the session's setting, else the driver's environment variable, else the default."""
    return spark.conf.get(name, os.environ.get(name, default))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own where it is unset and the master is local, as in tests."""
    global _own_folder
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return _own_folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: loops stay of one step's plan, and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    remember_folder(df.sparkSession, path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def drop_files(df: DataFrame) -> None:
    """Delete what cut_lineage() wrote for df, once nothing reads it any more."""
    path = getattr(df, "_lodestone_path", None)
    if path:
        delete_folder(df.sparkSession, path)


def remember_folder(spark: SparkSession, path: str) -> None:
    """A folder to be deleted when the driver ends, if nothing has done it before."""
    _written.append((spark, path))


def delete_folder(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _written[:] = [x for x in _written if x[1] != path]


@atexit.register
def _delete_all() -> None:
    """What is left goes when the driver's interpreter ends."""
    for spark, path in list(_written):
        try:
            if spark.sparkContext._jsc is not None:
                delete_folder(spark, path)
        except Exception:  # the session has ended; its folder goes with the cluster's
            return
