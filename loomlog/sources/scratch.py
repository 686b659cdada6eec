"""Folders for intermediate files that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; only a local master may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="loomlog-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, however often it is read, and safe from lost executors."""
    folder = scratch_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below path; none if it is missing."""
    fs, folder = _files(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(folder) if x.isDirectory()] if fs.exists(folder) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, file = _files(spark, path)
    return fs.exists(file)


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, folder = _files(spark, path)
    fs.delete(folder, True)
