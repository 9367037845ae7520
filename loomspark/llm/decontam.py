"""Benchmark decontamination by containment search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small


def normal_words(text: Column) -> Column:
    """The runs of letters and digits of a text, lower-cased, with single spaces between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def shingles(text: Column, words: int = 5) -> Column:
    """Array of the runs of so many words, with repeats; a shorter text is one shingle, an empty one has none."""
    normal = normal_words(text)
    runs = F.regexp_extract_all(normal, F.lit(r"(?=((?:\S+ ){%d}\S+))\S+" % (words - 1)), 1)
    return F.when(F.size(runs) > 0, runs).when(normal == "", F.array().cast("array<string>")).otherwise(F.array(normal))


def item_sketches(items: DataFrame, threshold: float) -> DataFrame:
    """(item_id, hash) of each item's bottom-k MinHash sketch. items: (item_id, shingles, n).

    Items are partitioned by size into classes of n in [2^c, 2^(c+1)). At the class's upper bound u, a text that
    holds the fraction `threshold` of an item's shingles misses u - ceil(threshold u) of them at most; with one
    more than that in the sketch, some sketched shingle is in every such text. So k is set by class, and no
    text that reaches the threshold can be missed, however long it is."""
    upper = F.expr("shiftleft(1L, length(bin(n)))") - 1
    k = (upper - F.ceil(F.lit(threshold) * upper - 1e-9) + 1).cast("int")
    hashes = F.array_sort(F.transform("shingles", lambda s: F.xxhash64(s)))
    return items.where("n > 0").select("item_id", F.explode(F.slice(hashes, F.lit(1), k)).alias("hash"))


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of each benchmark item (item_id, text) of whose distinct
    word shingles a document (doc_id, text) holds at least the fraction `threshold`.

    Every shingle of every whole text is looked up among the items' sketches (see item_sketches); the documents
    found are then verified by exact containment of the shingles themselves. The benchmark's tables are
    broadcast only if a count shows them small. Rows that share an id count as one text. Rows with a null id
    are left out, as nothing could refer to them; texts that are null or without words hold and are nothing; an
    item of fewer words than a shingle is found only in texts of just those words. Other columns are ignored."""
    items = benchmark.where("item_id is not null").select("item_id", F.explode(shingles(F.col("text"), words)).alias("s"))
    items = cut(items.groupBy("item_id").agg(F.collect_set("s").alias("shingles")).withColumn("n", F.size("shingles")))
    found = docs.where("doc_id is not null").select("doc_id", F.explode(shingles(F.col("text"), words)).alias("s"))
    sketched = small(item_sketches(items, threshold).select("hash").distinct())
    hit = cut(found.select("doc_id", F.xxhash64("s").alias("hash")).join(sketched, "hash", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits")))
    texts = docs.select("doc_id", "text").join(small(hit.select("doc_id")), "doc_id", "left_semi")
    whole = small(items.select("item_id", "n", F.explode("shingles").alias("s")))
    shared = texts.select("doc_id", F.explode(shingles(F.col("text"), words)).alias("s")).join(whole, "s").groupBy("doc_id", "item_id", "n").agg(F.count_distinct("s").alias("n_found"))
    return shared.select("doc_id", "item_id", F.col("n").cast("bigint").alias("n_shingles"), "n_found", (F.col("n_found") / F.col("n")).alias("containment")).where(F.col("n_found") >= F.ceil(F.lit(threshold) * F.col("n") - 1e-9))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """docs without the documents that hold an item of the benchmark; all columns stay."""
    held = contained_items(docs, benchmark, threshold, words).select("doc_id").distinct()
    return docs.join(small(cut(held)), "doc_id", "left_anti").select(*docs.columns)
