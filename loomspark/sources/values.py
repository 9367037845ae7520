"""Named scalars as one-row tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

KINDS = {int: "bigint", float: "double", str: "string", bool: "boolean"}


def save_value(spark: SparkSession, path: str, value: int | float | str | bool) -> None:
    spark.createDataFrame([(value,)], f"value {KINDS[type(value)]}").coalesce(1).write.mode("overwrite").parquet(path)


def load_value(spark: SparkSession, path: str):
    return spark.read.parquet(path).first().value
