"""Hashtag co-occurrence: counts of words beside tags, feature vectors and inner-product similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import is_hashtag, tokenize


def word_tag_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    """(word, hashtag, cnt): how often each word stands in a line with each hashtag; every occurrence of one counts
    with every occurrence of the other."""
    words = lines.select(tokenize(F.col(column)).alias("w"))
    tags = words.where(F.exists("w", is_hashtag)).select(F.filter("w", is_hashtag).alias("tags"), F.filter("w", lambda x: ~is_hashtag(x)).alias("others"))
    pairs = tags.select(F.explode("tags").alias("hashtag"), "others").select(F.explode("others").alias("word"), "hashtag")
    return pairs.groupBy("word", "hashtag").agg(F.count(F.lit(1)).alias("cnt"))


def feature_vector(counts: DataFrame, tag: str = "#job") -> DataFrame:
    """(word, cnt) of one hashtag."""
    return counts.where(F.col("hashtag") == tag).select("word", "cnt")


def as_maps(counts: DataFrame) -> DataFrame:
    """(word, tags: map of hashtag to count), for export; a word has as many entries as there are hashtags."""
    return counts.groupBy("word").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("hashtag", "cnt")))).alias("tags"))


def parse_vector(vector: Column) -> Column:
    """Array of (hashtag, cnt) of an imported vector `h:c;h:c;`; entries without a hashtag are dropped."""
    entries = F.filter(F.split(vector, ";"), lambda x: F.length(F.split_part(x, F.lit(":"), F.lit(1))) > 0)
    return F.transform(entries, lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("hashtag"), F.split_part(x, F.lit(":"), F.lit(2)).cast("bigint").alias("cnt")))


def tag_similarity(counts: DataFrame) -> DataFrame:
    """(sim, h1, h2) with h1 < h2: the inner product of the counts of the words both have.

    The counts are already one row per (word, hashtag), so a frequent word joins with as many rows as it has
    different hashtags, whatever its count; equal vectors of a pair meet only as partial sums."""
    a = counts.select("word", F.col("hashtag").alias("h1"), F.col("cnt").alias("c1"))
    b = counts.select("word", F.col("hashtag").alias("h2"), F.col("cnt").alias("c2"))
    pairs = a.join(b, (a["word"] == b["word"]) & (F.col("h1") < F.col("h2")))
    return pairs.groupBy("h1", "h2").agg(F.sum(F.col("c1") * F.col("c2")).alias("sim")).select("sim", "h1", "h2")
