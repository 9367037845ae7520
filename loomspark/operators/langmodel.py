"""Next-word and next-phrase suggestion from n-gram counts (phrase, freq); phrases are unique."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Suggestions kept and least probability by the number of words of the suggestion, 1 to 4.
PHRASE_LIMITS = (3, 2, 2, 1)
PHRASE_PROBABILITIES = (0.05, 0.03, 0.01, 0.005)


def next_word(counts: DataFrame, top: int = 5, over: int = 2) -> DataFrame:
    """(prefix, word, freq, probability, rank): for each phrase of two words or more with freq > over, split into
    prefix and last word, the `top` most frequent last words of a prefix; ties by word. The probability is relative
    to the prefix's own count, which has to be > over as well."""
    frequent = counts.where(F.col("freq") > over).withColumn("w", F.split("phrase", " "))
    ext = frequent.where(F.size("w") > 1).select(F.array_join(F.slice("w", 1, F.size("w") - 1), " ").alias("prefix"), F.element_at("w", -1).alias("word"), "freq")
    totals = frequent.select(F.col("phrase").alias("prefix"), F.col("freq").alias("total"))
    best = Window.partitionBy("prefix").orderBy(F.col("freq").desc(), "word")
    ranked = ext.join(totals, "prefix").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("prefix", "word", "freq", (F.col("freq") / F.col("total")).alias("probability"), "rank")


def next_phrase(counts: DataFrame, limits: tuple = PHRASE_LIMITS, probabilities: tuple = PHRASE_PROBABILITIES) -> DataFrame:
    """(phrase, next_phrase, freq, probability): every split of a phrase of up to 5 words into a prefix and 1 to 4
    following words. Per prefix and number of following words only the first by (freq descending, text) are
    considered, and of those the probable enough are kept. The prefix itself takes a place among the one-word
    suggestions (as "@", with its own count). Prefixes that occur once, or are empty, have none."""
    w = counts.withColumn("w", F.split("phrase", " ")).where(F.size("w") <= len(limits) + 1)
    split = w.where(F.size("w") > 1).select("w", "freq", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    split = split.select(F.array_join(F.expr("slice(w, 1, k)"), " ").alias("phrase"), F.array_join(F.expr("slice(w, k + 1, size(w))"), " ").alias("next_phrase"), "freq", (F.size("w") - F.col("k")).alias("n_words"))
    totals = counts.where("freq >= 2 and phrase != ''").select("phrase", F.col("freq").alias("total"))
    own = totals.select("phrase", F.lit("@").alias("next_phrase"), F.col("total").alias("freq"), F.lit(1).alias("n_words"), "total")
    rows = split.join(totals, "phrase").unionByName(own)
    return best_phrases(rows, limits, probabilities)


def best_phrases(rows: DataFrame, limits: tuple, probabilities: tuple) -> DataFrame:
    """(phrase, next_phrase, freq, probability) of the suggestions to keep, from all of them (phrase, next_phrase,
    freq, n_words, total) and the prefixes themselves as "@"."""
    best = Window.partitionBy("phrase", "n_words").orderBy(F.col("freq").desc(), "next_phrase")
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("n_words"))
    # the constant bound lets Spark keep only the first rows of each group before it shuffles them
    ranked = rows.withColumn("place", F.row_number().over(best)).where((F.col("place") <= max(limits)) & (F.col("place") <= at(limits)))
    kept = ranked.where((F.col("next_phrase") != "@") & (F.col("freq") / F.col("total") >= at(probabilities)))
    return kept.select("phrase", "next_phrase", "freq", (F.col("freq") / F.col("total")).alias("probability"))


def as_wide(suggestions: DataFrame, key: str, name: str) -> DataFrame:
    """One row per key with a map from suggestion to probability."""
    return suggestions.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, "probability")))).alias("probabilities"))


def suggest(suggestions: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The rows of the given keys, as a point filter that reaches the scan."""
    return suggestions.where(F.col(key).isin(*values))
