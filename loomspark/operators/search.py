"""Keyword search: the users who use a hashtag most with given keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_posting(posting: Column) -> Column:
    """Array of (uid, freq) of a posting list `uid:freq,uid:freq`."""
    part = lambda x, k: F.split_part(x, F.lit(":"), F.lit(k))
    return F.transform(F.split(posting, ","), lambda x: F.struct(part(x, 1).cast("bigint").alias("uid"), part(x, 2).cast("bigint").alias("freq")))


def top_users(postings: DataFrame, hashtag: str, n: int, keywords: list[str]) -> DataFrame:
    """(uid, freq): the n users with the largest sum of freq over the keywords; ties by uid ascending.

    postings: (hashtag, keyword, uid, freq). The keys are literals, so the filter is pushed to the scan. An empty
    hashtag, no keywords or n below 1 is an error."""
    if not hashtag or not keywords or n < 1:
        raise ValueError("a hashtag, a keyword and n of 1 or more are needed")
    hit = postings.where((F.col("hashtag") == hashtag) & F.col("keyword").isin(*keywords))
    return hit.groupBy("uid").agg(F.sum("freq").alias("freq")).orderBy(F.col("freq").desc(), "uid").limit(n)


def top_users_by_keys(postings: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """The same for a table of keys (hashtag, keyword), as a semi-join; Spark broadcasts it if it is small."""
    hit = postings.join(keys.select("hashtag", "keyword"), ["hashtag", "keyword"], "left_semi")
    return hit.groupBy("uid").agg(F.sum("freq").alias("freq")).orderBy(F.col("freq").desc(), "uid").limit(n)


def as_posting(users: DataFrame) -> DataFrame:
    """One row `posting`: `uid:freq,uid:freq` in the order of the result, which is as long as its limit."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("f"), "uid")))
    return users.agg(F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["uid"], -r["f"])), ",").alias("posting"))
