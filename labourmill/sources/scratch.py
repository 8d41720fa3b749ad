"""A place for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as its own."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def folder(spark: SparkSession) -> str:
    """A new name in the folder that all executors share (``spark.checkpoint.dir``); only a local
    session may do without that setting. What is written there goes when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    system, at = files(spark, path)
    system.mkdirs(at)
    system.deleteOnExit(at)
    return f"{path}/t"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once and read back, for what several later steps use."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
