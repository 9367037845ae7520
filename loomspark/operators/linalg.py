"""Dense matrices as coordinate tables (i, j, v)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_rows(rows: DataFrame, row: str, values: str) -> DataFrame:
    """Coordinates of a table with an array of values in each row."""
    return rows.select(F.col(row).alias("i"), F.posexplode(values).alias("j", "v")).select("i", F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))


def random_matrix(spark: SparkSession, lines: int, columns: int, seed: int = 0) -> DataFrame:
    """Uniform in [0, 1), by a hash of seed and place, so that it is the same however it is partitioned."""
    u = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)).cast("double") / float(1 << 52)
    return spark.range(lines * columns).select(F.floor(F.col("id") / columns).alias("i"), (F.col("id") % columns).alias("j"), u.alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """a b by a join on the inner index: for narrow or sparse tables, as it makes a row for every product."""
    x, y = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return x.join(y, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def multiply_blocks(a: DataFrame, b: DataFrame, block: int = 256) -> DataFrame:
    """a b by square blocks: a join on the inner block index and one dense product for each pair of blocks, so the
    rows between are n^3 / block of blocks instead of n^3 of numbers. A block is block^2 numbers at most."""
    at = lambda c: F.floor(F.col(c) / block).cast("bigint")
    cells = lambda m: F.collect_list(F.struct((F.col("i") % block).cast("int").alias("i"), (F.col("j") % block).cast("int").alias("j"), F.col("v").cast("double").alias("v")))
    x = a.groupBy(at("i").alias("bi"), at("j").alias("bk")).agg(cells(a).alias("x"))
    y = b.groupBy(at("i").alias("bk"), at("j").alias("bj")).agg(cells(b).alias("y"))

    def dense(cells) -> np.ndarray:
        out = np.zeros((block, block))
        for c in cells:
            out[c["i"], c["j"]] += c["v"]
        return out

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                p, q = dense(r.x), dense(r.y)
                rows, columns = sorted({c["i"] for c in r.x}), sorted({c["j"] for c in r.y})
                out = (p @ q)[np.ix_(rows, columns)]
                ii, jj = np.meshgrid(rows, columns, indexing="ij")
                yield pd.DataFrame({"i": r.bi * block + ii.ravel(), "j": r.bj * block + jj.ravel(), "v": out.ravel()})

    return x.join(y, "bk").select("bi", "bj", "x", "y").mapInPandas(products, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """a + b; both have the same cells."""
    return a.join(b.withColumnRenamed("v", "w"), ["i", "j"]).select("i", "j", (F.col("v") + F.col("w")).alias("v"))


def max_abs_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the largest difference of two cells, in double precision."""
    return a.join(b.withColumnRenamed("v", "w"), ["i", "j"]).agg(F.max(F.abs(F.col("v") - F.col("w"))).alias("max_abs_diff"))


def equals(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both have the same cells with the same values."""
    met = a.select("i", "j", F.col("v").alias("x")).join(b.select("i", "j", F.col("v").alias("y")), ["i", "j"], "full")
    return met.agg(F.coalesce(F.every(F.col("x").eqNullSafe(F.col("y"))), F.lit(True)).alias("equal"))


def gflops(n: int, seconds: float, repetitions: int = 1) -> float:
    """Rate of a dense n x n product."""
    return (2 * n - 1) * n * n * 1e-9 * repetitions / seconds
