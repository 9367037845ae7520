"""K-means over points (id, v: array of numbers)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .prefix import running_sum


def _points(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column("v")
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(v), -1) if len(v) else flat.reshape(0, 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest centre; of equals the first. One matrix product finds it for
    most points; where others come within its rounding, the distances are taken from the differences."""
    at = np.zeros(len(x), np.int32)
    squares = (centres**2).sum(1)
    for lo in range(0, len(x), step := max(1, (1 << 20) // len(centres))):
        part = x[lo : lo + step]
        d = squares - 2 * (part @ centres.T)
        best = d.argmin(1)
        slack = 1e-9 * ((part**2).sum(1) + squares.max())
        near = np.flatnonzero((d <= (d[np.arange(len(part)), best] + slack)[:, None]).sum(1) > 1)
        if len(near):
            best[near] = np.stack([((part[near] - c) ** 2).sum(1) for c in centres], 1).argmin(1)
        at[lo : lo + step] = best
    return at, ((x - centres[at]) ** 2).sum(1)


def assign(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, cid, dist): the nearest centre of each point (the first of equals) and the squared distance. The
    centres, K rows, go to the tasks; the points stay where they are and are taken in Arrow batches."""
    centres = np.asarray(centres, np.float64)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, d = _nearest(_points(b), centres)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(at), pa.array(d)], ["id", "cid", "dist"])

    kind = points.schema["id"].dataType.simpleString()
    return points.select("id", "v").mapInArrow(near, f"id {kind}, cid int, dist double")


def partial_sums(points: DataFrame, centres: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """(cid, size, sums, changed, cost) of each cluster: one row per task and cluster, then one per cluster. changed
    counts the points that were elsewhere under the centres `before`."""
    centres = np.asarray(centres, np.float64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = centres.shape
        size, changed, cost, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k), np.zeros((k, d))
        for b in batches:
            x = _points(b)
            if not len(x):
                continue
            at, dist = _nearest(x, centres)
            was = _nearest(x, before)[0] if before is not None else -1
            size += np.bincount(at, minlength=k)
            cost += np.bincount(at, dist, k)
            changed += np.bincount(at, at != was, k).astype(np.int64)
            for j in np.unique(at):
                sums[j] += x[at == j].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(size), pa.array(list(sums), pa.list_(pa.float64())), pa.array(changed), pa.array(cost)], ["cid", "size", "sums", "changed", "cost"])

    rows = points.select("v").mapInArrow(task, "cid int, size bigint, sums array<double>, changed bigint, cost double")
    d = centres.shape[1]
    total = F.array(*(F.sum(F.col("sums")[j]) for j in range(d)))
    return rows.groupBy("cid").agg(F.sum("size").alias("size"), total.alias("sums"), F.sum("changed").alias("changed"), F.sum("cost").alias("cost"))


def local_sums(x: np.ndarray, centres: np.ndarray, was: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Membership, sizes, sums and number of changes of points in memory."""
    at, _ = _nearest(x, centres)
    sums = np.stack([np.bincount(at, x[:, j], len(centres)) for j in range(x.shape[1])], 1)
    return at, np.bincount(at, minlength=len(centres)), sums, len(x) if was is None else int((at != was).sum())


def update(sums: DataFrame, centres: np.ndarray, min_size: int = 1) -> tuple[np.ndarray, int]:
    """New centres (the mean, or the old one for clusters of fewer than min_size points) and the number of points
    that changed cluster."""
    out, changed = np.array(centres, np.float64), 0
    for r in sums.collect():  # K rows
        changed += r.changed
        if r.size >= max(1, min_size):
            out[r.cid] = np.array(r.sums) / r.size
    return out, changed


def first_rows(points: DataFrame, k: int) -> np.ndarray:
    return np.array([r.v for r in points.orderBy("id").limit(k).collect()], np.float64)


def random_rows(points: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """The rows with the smallest hashes of (seed, id): the same ones however the points are dealt out."""
    return np.array([r.v for r in points.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k).collect()], np.float64)


def plus_plus_rows(points: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """K-means++: the first seed is the row with the smallest hash, the draws come from a generator with the seed."""
    first = points.select("id").orderBy(F.xxhash64(F.lit(seed), "id"), "id").first()
    ids = plus_plus(points, first.id, np.random.default_rng(seed).random(k - 1).tolist()) if first else []
    found = {r.id: r.v for r in points.where(F.col("id").isin(*ids)).collect()} if ids else {}
    return np.array([found[i] for i in ids], np.float64)


def plus_plus(points: DataFrame, first_id: int, draws: list[float]) -> list[int]:
    """Ids of seeds: the first given, each further one the first point at which the running sum of the squared
    distances to the nearest seed, by id and relative to the total, exceeds the next draw from [0, 1). Where all points
    are at seeds, the smallest id that is none yet; there are no more seeds than points."""
    ids = [first_id]
    for draw in draws:
        seeds = np.array([r.v for r in sorted(points.where(F.col("id").isin(*ids)).select("id", "v").collect())], np.float64)
        dist = assign(points, seeds)
        sums = running_sum(dist.select("id", "dist"), "id", "dist")
        total = sums.agg(F.max("running")).first()[0]
        found = sums.where(F.lit(draw) * total < F.col("running")).agg(F.min("id")).first()[0]
        if found is None:
            found = points.where(~F.col("id").isin(*ids)).agg(F.min("id")).first()[0]
        if found is None:
            break
        ids.append(found)
    return ids


#: How to find the first centres.
SEEDINGS = {"first": lambda points, k, seed: first_rows(points, k), "random": random_rows, "k-means++": plus_plus_rows}
#: Numbers (points times coordinates) up to which the passes run on the driver: counted first; they come as Arrow
#: columns, 32 MB, and are held as an array of as many.
LOCAL_NUMBERS = 4_000_000


@dataclass
class Fitted:
    centres: np.ndarray
    last: np.ndarray  # the centres that the membership was found with
    loops: int

    def membership(self, points: DataFrame) -> DataFrame:
        return assign(points, self.last) if len(self.last) else assign(points.limit(0), np.zeros((1, 1)))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(self.centres)], "cid int, c array<double>")


def kmeans(points: DataFrame, k: int, threshold: float = 0.001, max_loops: int = 500, init: str | np.ndarray = "first", min_size: int = 1, least_passes: int = 1, seed: int = 0) -> Fitted:
    """Lloyd's passes until no more than `threshold` of the points change cluster, max_loops + 1 at most.

    init: "first" (the k rows with the smallest ids), "random", "k-means++", or the centres. Fewer points than k give as
    many centres, none for an empty table. min_size 2 lets clusters of one
    point keep their centre; least_passes forces as many. Each pass is one scan of the points and K rows to the
    driver; the points are kept in memory as far as it goes. Up to LOCAL_NUMBERS, where a pass is shorter than
    starting its tasks, the same passes run over an array on the driver."""
    if k < 2:
        raise ValueError("k has to be 2 or more")
    if isinstance(init, str) and init not in SEEDINGS:
        raise ValueError(f"init has to be one of {', '.join(SEEDINGS)}, or centres")
    points = points.select("id", "v").persist()
    n = points.count()
    if not n:
        points.unpersist()
        return Fitted(np.zeros((0, 0)), np.zeros((0, 0)), 0)
    centres = SEEDINGS[init](points, k, seed) if isinstance(init, str) else np.asarray(init, np.float64)
    before, last, loop = None, centres, 0
    x = None
    if n * centres.shape[1] <= LOCAL_NUMBERS:
        x, was = np.stack(points.select(F.col("v").cast("array<double>").alias("v")).toArrow()["v"].to_numpy()), None
    while True:
        last = centres
        if x is not None:
            was, size, sums, changed = local_sums(x, last, was)
            centres = np.where((size >= max(1, min_size))[:, None], sums / np.maximum(size, 1)[:, None], last)
        else:
            centres, changed = update(partial_sums(points, last, before), last, min_size)
        before = last
        loop += 1
        if loop >= least_passes and (changed <= threshold * n or loop > max_loops):
            break
    points.unpersist()
    return Fitted(centres, last, loop)
