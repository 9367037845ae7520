"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, md5_unit, small

NO_SOURCE = "\x00"
#: How many numbers of __loom_cdf are __loom_u or less, by halving.
ABOVE = """aggregate(sequence(1, length(bin(size(__loom_cdf)))), named_struct('lo', 0, 'hi', size(__loom_cdf)),
    (s, i) -> if(s.lo >= s.hi, s, if(__loom_cdf[(s.lo + s.hi) div 2] <= __loom_u, named_struct('lo', int((s.lo + s.hi) div 2) + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', int((s.lo + s.hi) div 2)))), s -> s.lo)"""


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, total: float | None = None) -> DataFrame:
    """One row per source: (source, n, rate, least, cdf). `weights` names each source's share of the output (sources
    not named get none); without it the share is as n ** power. `total` is the expected number of output rows,
    by default the number of input rows. rate is the mean number of copies of each row; cdf is the Poisson
    distribution function at `least`, least + 1, ... until it rounds to 1, over 12 deviations to both sides of the rate:
    what is left out below is less than a double's last bit. So a source with a rate r has some 24 sqrt(r) + 40 numbers."""
    spark = docs.sparkSession
    counts = docs.groupBy(F.coalesce(F.col("source"), F.lit(NO_SOURCE)).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(power))))
    else:
        schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("weight", T.DoubleType())])
        named = spark.createDataFrame([(NO_SOURCE if k is None else k, float(v)) for k, v in weights.items()], schema)
        weighed = counts.join(named, "source", "left").fillna(0.0, ["weight"])
    weighed = cut(weighed)
    all_weight, all_n = weighed.agg(F.coalesce(F.sum("weight"), F.lit(0.0)), F.sum("n")).first()
    wanted = float(total) if total is not None else all_n
    rates = weighed.select("source", "n", (F.col("weight") / all_weight * wanted / F.col("n") if all_weight > 0 else F.lit(0.0)).alias("rate"))
    spread = 12 * F.sqrt("rate") + 20
    least = F.floor(F.col("rate") - spread)
    rates = rates.withColumn("least", F.when(least < 20, 0).otherwise(least).cast("bigint"))
    terms = rates.select("*", F.explode(F.sequence(F.col("least"), F.ceil(F.col("rate") + spread).cast("bigint"))).alias("k"))
    # in logarithms, so that no rate underflows; ln k! is a sum from 0 on, or from Stirling's series at `least` on
    k, low = F.col("k").cast("double"), F.col("least").cast("double")
    stirling = low * F.ln(low) - low + F.ln(2 * math.pi * low) / 2 + 1 / (12 * low) - 1 / (360 * low**3) + 1 / (1260 * low**5)
    by = Window.partitionBy("source").orderBy("k")
    log_factorial = F.when(F.col("least") > 0, stirling).otherwise(0.0) + F.sum(F.when(F.col("k") > F.greatest("least", F.lit(1)), F.ln(k)).otherwise(0.0)).over(by)
    log_p = F.when(F.col("rate") > 0, -F.col("rate") + k * F.ln("rate") - log_factorial)
    terms = terms.withColumn("p", F.coalesce(F.exp(log_p), (F.col("k") == 0).cast("double"))).withColumn("c", F.sum("p").over(by))
    listed = terms.groupBy("source", "n", "rate", "least").agg(F.sort_array(F.collect_list(F.struct("k", "c"))).alias("cs"))
    return listed.select("source", "n", "rate", "least", F.col("cs.c").alias("cdf"))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, total: float | None = None, seed: int = 0, shuffle: bool = True) -> DataFrame:
    """Each row of docs (doc_id, source, ...) as often as a Poisson number with its source's repetition rate
    says, in a random global order.

    The number is the Poisson distribution inverted at a point hashed from (seed, doc_id), so a run can be
    repeated, and equal rows are repeated alike. Adds `replica` (0, 1, ...) and `shuffle_key`, a hash of (seed,
    doc_id, replica) that the output is sorted by; columns of these names in docs are replaced, all others stay.
    Null or empty texts are rows like any other; rows without a source form a source of their own; a null doc_id
    hashes as the word "null"; an empty table stays empty. The table of rates has a row per source and is
    broadcast only if a count shows it small; else Spark shuffles both sides, and splits a hot source."""
    rates = cut(repetition_rates(docs, weights, power, total).select("source", "least", "cdf"))
    rates = small(rates.select(*(F.col(c).alias(f"__loom_{c}") for c in rates.columns)))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    point = md5_unit(F.lit(str(seed)), name)
    joined = docs.drop("replica", "shuffle_key").withColumn("__loom_key", F.coalesce(F.col("source"), F.lit(NO_SOURCE))).join(rates, F.col("__loom_key") == F.col("__loom_source"))
    copies = joined.withColumn("__loom_u", point).withColumn("__loom_n", (F.col("__loom_least") + F.expr(ABOVE)).cast("int")).where("__loom_n > 0")
    out = copies.withColumn("replica", F.explode(F.expr("sequence(0, __loom_n - 1)"))).drop("__loom_key", "__loom_source", "__loom_least", "__loom_cdf", "__loom_u", "__loom_n")
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(seed)), name, F.col("replica").cast("string"))))
    if not shuffle:
        return out
    # the keys are even, so their leading digits are ranges of like size and needn't be sampled
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("bigint") * parts / float(1 << 32)).cast("int")
    return out.repartitionById(parts, part).sortWithinPartitions("shuffle_key", "doc_id")
