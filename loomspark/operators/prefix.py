"""Running sums over a total order without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.sources.scratch import cut


def running_sum(df: DataFrame, order: str, value: str, name: str = "running") -> DataFrame:
    """df with the sum of `value` up to and including each row, by `order` (unique). Ranges of the order are summed
    by themselves; only their totals, one row each, are put in sequence."""
    ranged = cut(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = totals.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn("__in", F.sum(value).over(within)).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__in")).drop("__part", "__in", "__before")
