"""Text normalisation, tokens and n-grams as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The steps of the tokenizer, in order, as (pattern, replacement) of Java regular expressions.
URL = r"\b(https?|ftp|file)://[-a-zA-Z0-9+&@#/%?=~_|!:,.;]*[-a-zA-Z0-9+&@#/%=~_|]\b"
DELIMITERS = (r"[:;]", " ")
STEPS = [
    (URL, ""),
    DELIMITERS,
    (r"\p{Punct}(\s+|$)", " "),
    (r"(^|\s+)\p{Punct}+(\s+|$)", " "),
    (r"(^|\s+)[<>,./?!$%^&*()_+-=]", " "),
    (r"[^\x00-\x80]+", ""),
    (r"(^|\s+)\d+(\s+|$)", " "),
    (r"\s+", " "),
    (r"^[\x00-\x20]+|[\x00-\x20]+$", ""),
]


def normalize(line: Column, keep_delimiters: bool = False) -> Column:
    """Lower case; no URLs, no punctuation at the ends of words but # and @ in front, no characters beyond ASCII, no
    pure numbers, single spaces. keep_delimiters leaves : and ; inside words."""
    out = F.lower(line)
    for step in STEPS:
        if step[0] == URL:  # few lines have one, and the search is slow
            out = F.when(F.contains(out, F.lit("://")), F.regexp_replace(out, *step)).otherwise(out)
        elif not (keep_delimiters and step is DELIMITERS):
            out = F.regexp_replace(out, *step)
    return out


def tokenize(line: Column, keep_delimiters: bool = False) -> Column:
    """Array of a line's words; an empty line has one empty word."""
    return F.split(normalize(line, keep_delimiters), r"\s+")


def ngrams(tokens: Column, n: int) -> Column:
    """Array of the runs of n tokens, joined by spaces; none if there are fewer."""
    if n == 1:
        return tokens
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1)))
    return F.coalesce(F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " ")), F.array().cast("array<string>"))


def word_count(phrase: Column) -> Column:
    return F.size(F.split(phrase, " "))


def is_hashtag(word: Column) -> Column:
    return F.startswith(word, F.lit("#"))


def partition_of(key: Column, n: int) -> Column:
    """The partition of a hash partitioner with n partitions."""
    return F.pmod(F.hash(key), F.lit(n))
