"""Cutting lineage: tables written in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where it is unset and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    for folders in _noted:
        folders.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.folder = path
    return table


def _path(spark: SparkSession, name: str):
    """A path for Hadoop's file systems, and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder, if it is there."""
    path, files = _path(spark, folder)
    files.delete(path, True)


def move(spark: SparkSession, folder: str, to: str) -> None:
    """Rename a folder; ``to`` is not there yet."""
    (path, files), (new, _) = _path(spark, folder), _path(spark, to)
    files.mkdirs(new.getParent())
    if not files.rename(path, new):
        raise OSError(f"{folder} was not renamed to {to}")


def forget(df: DataFrame) -> None:
    """Delete a table made by :func:`written`, once nothing reads it any more."""
    delete(df.sparkSession, df.folder)


_noted: list[list[str]] = []


@contextmanager
def noted() -> Iterator[list[str]]:
    """The folders of the tables written meanwhile."""
    _noted.append(folders := [])
    try:
        yield folders
    finally:
        _noted.pop()
