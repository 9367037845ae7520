"""Rating evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.vectors import squared_error


def mean_squared_error(ratings: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row `mse`: the mean squared difference of the ratings of the same (user, product)."""
    p = predictions.select("user", "product", F.col("rating").alias("predicted"))
    return ratings.join(p, ["user", "product"]).agg(F.avg(squared_error(F.col("rating"), F.col("predicted"))).alias("mse"))
