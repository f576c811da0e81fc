"""Materialised stages: a frame that several later steps read is written once, so plans stay small and a lost executor costs no recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = set_.get() if set_.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/stage-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _until_exit(spark: SparkSession, path: str, make: bool = False) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if make:
        fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir (a temporary one only where that is unset on a local master, as in tests); it goes when the application ends."""
    path = _path(spark, name)
    _until_exit(spark, path, make=True)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written below spark.checkpoint.dir, as folder() has it, and read again."""
    spark = df.sparkSession
    path = _path(spark, name)
    df.write.parquet(path)
    _until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
