"""Folders that driver and executors share, and tables written there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, folder: str) -> bool:
    path, system = _path(spark, folder)
    return system.exists(path)


def delete(spark: SparkSession, folder: str) -> None:
    path, system = _path(spark, folder)
    system.delete(path, True)


def size_bytes(spark: SparkSession, folder: str) -> int:
    path, system = _path(spark, folder)
    return system.getContentSummary(path).getLength()


def new_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir (or what setCheckpointDir has set); it goes when
    the driver ends. Where neither is set, a local session, as in tests, gets a local one; a
    cluster is refused, since each executor would write to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:/tmp/checkpoints"
    folder = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    path, system = _path(spark, folder)
    system.deleteOnExit(path)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Writes a table in the shared folder and reads it again."""
    folder = new_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def state_of(spark: SparkSession, folder: str) -> str:
    """Files below a path with their sizes and times: equal as long as nothing was written."""
    path, system = _path(spark, folder)
    found, files = [], system.listFiles(path, True)
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return "\n".join(sorted(found))
