"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on one machine, where none is set, a temporary one."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="strandforge-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/strandforge/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


class Sink:
    """A new file at a path, as an open binary stream of the driver."""

    def __init__(self, spark: SparkSession, path: str):
        where, fs = file_system(spark, path)
        self._of = fs.create(where, True)

    def write(self, data: bytes) -> int:
        self._of.write(bytearray(data))
        return len(data)

    def flush(self) -> None:
        self._of.flush()

    def close(self) -> None:
        self._of.close()


def remove(spark: SparkSession, path: str) -> None:
    where, fs = file_system(spark, path)
    fs.delete(where, True)


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """df written once, with options of the Parquet writer, and read back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing reads it."""
    for df in frames:
        if path := getattr(df, "_written", None):
            remove(df.sparkSession, path)
