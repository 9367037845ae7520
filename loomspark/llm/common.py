"""Helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a table may be broadcast, once counted.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and all runs on one machine (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/loom-{uuid.uuid4().hex}"


def until_exit(spark: SparkSession, path: str) -> None:
    """Has the driver's JVM delete what is at the path when it ends, unless drop() did so before."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)


def cut(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost
    executor costs no more than reading it again. The table stays until drop() or the end of the driver."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes the files behind tables made by cut(), once nothing will read them again."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles() if "/loom-" in f}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


_held: dict = {}


def held(key=None, make=None):
    """What this Python worker keeps from task to task: make(), once, while tasks ask for the same key. Tasks of
    another operator begin with held(), so a reused worker never has the memory of two. What Arrow keeps of former
    batches goes back to the system."""
    pa.default_memory_pool().release_unused()
    if key not in _held:
        _held.clear()
        if make:
            _held[key] = make()
    return _held.get(key)


@contextmanager
def batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What is written inside sends Arrow batches of so many rows to Python, at most: whole texts and their hashes
    are held for one batch a task. The session's own setting holds again afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def parts(texts: pa.Array, rows: int = 256) -> Iterator[list]:
    """The texts of an Arrow batch, some at a time, so that few of them are Python objects at once. An empty batch
    is one empty part."""
    for at in range(0, max(1, len(texts)), rows):
        yield texts.slice(at, rows).to_pylist()


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if counts of its rows and bytes show it small enough, else df: Spark then shuffles
    both sides."""
    each = [F.octet_length(c) if t in ("string", "binary") else 8 * F.size(c) if t.startswith("array") else F.lit(8) for c, t in df.dtypes]
    found = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(sum((F.coalesce(x, F.lit(0)).cast("bigint") for x in each), F.lit(0)))).first()
    return F.broadcast(df) if found[0] <= rows and (found[1] or 0) <= size else df


def md5_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
