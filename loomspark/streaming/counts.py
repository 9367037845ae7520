"""Streaming forms (an extension): running n-gram counts and the latest state of a mutation log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspark.operators.ngrams import ngram_counts


def start_ngram_counts(lines: DataFrame, n: int, name: str, checkpoint: str) -> StreamingQuery:
    """Counts over all lines of a stream so far, as a table in memory under `name`."""
    return ngram_counts(lines, n).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, window: str, late: str) -> DataFrame:
    """(window, key, n); rows later than `late` after the newest are left out, and windows closed by then leave the
    state."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"))


def start_operations(ops: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """The last operation of each (tid1, op, field) of a growing log, as a table in memory under `name`: it is kept
    in the stream's own state, so a restarted query goes on from it, and replay() of it gives the log's state."""
    of = F.when(F.col("op") == "set", F.coalesce("field", F.lit(""))).otherwise(F.lit("")).alias("field")
    last = ops.groupBy("op", "tid1", of).agg(F.max(F.struct("seq", "payload")).alias("x")).select("op", "tid1", "field", "x.payload", "x.seq")
    return last.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
