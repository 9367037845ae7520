"""Text lines and tab-separated tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Column `value`, a row per line of all files under the paths."""
    return spark.read.text(list(paths))


def iterate_lines(spark: SparkSession, *paths: str) -> Iterator[str]:
    """Lines one after the other, a partition at a time."""
    return (r.value for r in read_lines(spark, *paths).toLocalIterator())


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, quote="", escape="")


def read_ngrams(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, schemas.NGRAMS)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, schemas.EDGES)


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Columns joined by tabs; what was at the path is replaced, or added to with mode "append"."""
    df.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in df.columns)).alias("value")).write.mode(mode).text(path)


def append_log(spark: SparkSession, path: str, *lines: str) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)


def write_table(df: DataFrame, path: str, key: str, partitions: int | None = None) -> None:
    """A keyed table as Parquet, each key's rows together and in order, so that a lookup reads few row groups."""
    spread = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    spread.sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def lookup(spark: SparkSession, path: str, key: str, values: list) -> DataFrame:
    """The rows of several keys; the filter is pushed to Parquet."""
    return spark.read.parquet(path).where(F.col(key).isin(*values))


def send(df: DataFrame, connect, put) -> None:
    """Writes each row to an external store: connect() once in each task gives a connection, put(connection, row)
    writes one. Endpoints are the caller's; a retried task writes its rows again, so puts have to be idempotent."""

    def task(rows) -> None:
        connection = connect()
        for row in rows:
            put(connection, row)

    df.foreachPartition(task)
