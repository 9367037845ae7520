"""Replay of an ordered mutation log (op, tid1, tid2, field, payload, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered(ops: DataFrame) -> DataFrame:
    """Operations by their sequence number, whatever order they came in."""
    return ops.orderBy("seq")


def replay(ops: DataFrame) -> DataFrame:
    """(tid, field, payload, seq): the state the log leaves. `write` inserts a payload (as the field ""), `set`
    upserts a field, `delete` removes all of a tid that came before; the last by seq wins. Two aggregations that
    combine before they shuffle, so an entity with many operations is no hot spot."""
    rows = ops.select(F.col("tid1").alias("tid"), "op", F.when(F.col("op") == "set", F.coalesce("field", F.lit(""))).otherwise(F.lit("")).alias("field"), "payload", "seq")
    last = rows.groupBy("tid", "op", "field").agg(F.max(F.struct("seq", "payload")).alias("x")).select("tid", "op", "field", "x.*")
    deleted = last.where("op = 'delete'").select("tid", F.col("seq").alias("gone"))
    kept = last.where("op in ('write', 'set')").join(deleted, "tid", "left").where("gone is null or seq > gone")
    return kept.groupBy("tid", "field").agg(F.max(F.struct("seq", "payload")).alias("x")).select("tid", "field", "x.payload", "x.seq")
