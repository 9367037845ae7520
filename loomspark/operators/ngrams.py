"""N-gram counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import ngrams, tokenize


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row `value` for each line of a text column."""
    return docs.select(F.explode(F.split(F.col(text), "\n")).alias("value"))


def ngram_counts(lines: DataFrame, n: int, column: str = "value") -> DataFrame:
    """(ngram, freq) over all lines. Catalyst counts each partition's n-grams before it shuffles them."""
    words = lines.select(tokenize(F.col(column)).alias("w"))  # by itself, or each gram would tokenize its line again
    grams = words.select(F.explode(ngrams(F.col("w"), n)).alias("ngram"))
    return grams.groupBy("ngram").agg(F.count(F.lit(1)).alias("freq"))


def phrase_counts(lines: DataFrame, longest: int, column: str = "value") -> DataFrame:
    """(phrase, freq) of all 1- to longest-grams, from one pass over the lines; without the empty word."""
    tokens = lines.select(tokenize(F.col(column)).alias("w"))
    grams = tokens.select(F.explode(F.concat(*(ngrams(F.col("w"), n) for n in range(1, longest + 1)))).alias("phrase")).where("phrase != ''")
    return grams.groupBy("phrase").agg(F.count(F.lit(1)).alias("freq"))
