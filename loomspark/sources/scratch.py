"""Cutting lineage between the passes of an iterative plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset, as in tests."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="loom-"))
    return spark.conf.get("spark.checkpoint.dir")


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint, for the small tables of an iteration."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder(spark))
    return df.checkpoint()


def new_path(spark: SparkSession) -> str:
    return f"{folder(spark)}/loom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a compressed table in the shared folder, until the driver ends: for large tables that are read more than
    once."""
    spark, path = df.sparkSession, new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
