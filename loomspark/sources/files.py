"""File operations on any file system that Spark can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str, recursive: bool = True) -> bool:
    """Whether there was something to delete."""
    fs, p = _at(spark, path)
    return fs.exists(p) and fs.delete(p, recursive)


def home_directory(spark: SparkSession, path: str = ".") -> str:
    return _at(spark, path)[0].getHomeDirectory().toString()


def copy(spark: SparkSession, source: str, target: str, overwrite: bool = True) -> bool:
    """Between any two file systems, local or not."""
    (a, p), (b, q) = _at(spark, source), _at(spark, target)
    return spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, overwrite, spark._jsparkSession.sessionState().newHadoopConf())


def children(spark: SparkSession, path: str, directories: bool = False) -> list[str]:
    """Names of the files, or of the directories, right below a path."""
    fs, p = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory() == directories)


def listing(spark: SparkSession, path: str, pattern: str = ".*", recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) of the files below a path whose whole path matches a regular expression."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.where(F.col("path").rlike(f"^(?:{pattern})$")).select("path", "length", "modificationTime")


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path: the sum of their lengths."""
    fs, p = _at(spark, path)
    return fs.getContentSummary(p).getLength()


def write_bytes(spark: SparkSession, path: str, content: bytes, overwrite: bool = True) -> None:
    """One small file from the driver."""
    fs, p = _at(spark, path)
    out = fs.create(p, overwrite)
    out.write(bytearray(content))
    out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    return bytes(rows[0].content)
