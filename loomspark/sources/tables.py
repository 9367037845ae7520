"""Named Parquet tables of a data directory."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TOP = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def share_package(spark: SparkSession) -> None:
    """Lets Python workers look for the package where the driver found it, whatever folder they start in. A cluster
    that ships it (--py-files, an image) doesn't need this."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if TOP not in known:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*known, TOP]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """`<sf_dir>/<name>.parquet`, through Spark's reader, so any store Spark can open will do."""
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of input per core below which a few row groups may hold everything.
SMALL_PER_CORE = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small input dealt over all cores before costly work on its rows: Parquet can't split a row group, so a small
    file would keep one core busy. Larger inputs have row groups enough and stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < SMALL_PER_CORE * cores else df
