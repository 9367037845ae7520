"""Points, centres and memberships as text or binary files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_text_points(spark: SparkSession, path: str) -> DataFrame:
    """(id, v) of lines `name x y ...`, separated by spaces, commas or tabs: the first field is dropped, blank lines
    are skipped, and the id is the line's place among the others, by file name and place in the file. The first line's
    number of coordinates holds for all: further fields are dropped, missing ones and those that are no number read as
    null."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = lines.where(F.trim(F.regexp_replace("value", "[\t,]", " ")) != "").withColumn("at", F.monotonically_increasing_id())
    # a row for each split of a file; within one, the ids that Spark gives are consecutive
    splits = lines.groupBy("file", "start").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "start")) - F.col("n")
    numbered = lines.join(F.broadcast(splits.select("file", "start", "low", before.alias("before"))), ["file", "start"]).withColumn("id", F.col("before") + F.col("at") - F.col("low"))
    fields = F.split(F.trim(F.regexp_replace("value", "[ ,\t]+", " ")), " ")
    numbered = numbered.withColumn("fields", fields)
    first = numbered.where("id = 0").select(F.size("fields")).first()
    if first is None or first[0] < 2:
        return numbered.select("id", F.array().cast("array<float>").alias("v"))
    return numbered.select("id", F.transform(F.sequence(F.lit(1), F.lit(first[0] - 1)), lambda k: F.get("fields", k).try_cast("float")).alias("v"))


def read_binary_points(spark: SparkSession, path: str) -> DataFrame:
    """(id, v) of files of int32 n, int32 d and n d float32, little-endian; ids count within a file."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                n, d = struct.unpack_from("<ii", content)
                x = np.frombuffer(content, "<f4", n * d, 8).reshape(n, d)
                for at in range(0, n, 10_000):
                    yield pd.DataFrame({"id": np.arange(at, min(n, at + 10_000)), "v": list(x[at : at + 10_000])})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "id bigint, v array<float>")


def binary_points(points: np.ndarray) -> bytes:
    """The content of a binary point file."""
    x = np.ascontiguousarray(points, "<f4")
    return struct.pack("<ii", *x.shape) + x.tobytes()


def write_centres(centres: DataFrame, path: str) -> None:
    """Lines `cid c0 c1 ...` of (cid, c), in six decimals, in the order of cid."""
    line = F.concat_ws(" ", F.col("cid").cast("string"), F.transform("c", lambda x: F.format_string("%f", x.cast("double"))))
    centres.orderBy("cid").select(line.alias("value")).write.mode("overwrite").text(path)


def write_membership(membership: DataFrame, path: str) -> None:
    """Lines `id cid`, in the order of id."""
    membership.orderBy("id").select(F.concat_ws(" ", F.col("id").cast("string"), F.col("cid").cast("string")).alias("value")).write.mode("overwrite").text(path)
