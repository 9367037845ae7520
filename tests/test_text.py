import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.functions.text import ngrams, normalize, tokenize
from loomspark.operators import cooccur, langmodel, phrasemodel
from loomspark.operators.ngrams import ngram_counts, phrase_counts

GOLDEN = [
    ("Hello!! World...", ["hello!", "world.."]),
    ("3d 123abc", ["d", "23abc"]),
    ("10 20 30", ["0"]),
    ("1 2 3", [""]),
    ("café naïve", ["caf", "nave"]),
    ("#Job a:b http://x.y/z?q=1 end", ["#job", "a", "b", "end"]),
    ("a # # b ## c", ["a", "b", "c"]),
    ("--x (y) _z @me ##tag", ["-x", "y", "z", "@me", "##tag"]),
    ("", [""]),
]


def test_tokenizer(spark):
    df = spark.createDataFrame([(a,) for a, _ in GOLDEN], "value string")
    assert [r.t for r in df.select(tokenize(F.col("value")).alias("t")).collect()] == [b for _, b in GOLDEN]


def test_delimiters_can_stay(spark):
    df = spark.createDataFrame([("a:b c;d",)], "value string")
    assert df.select(normalize(F.col("value"), keep_delimiters=True)).first()[0] == "a:b c;d"


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_ngrams(spark):
    got = {r.ngram: r.freq for r in ngram_counts(lines(spark, "", "a b", "a b c", "a b"), 2).collect()}
    assert got == {"a b": 3, "b c": 1}
    assert {r.ngram: r.freq for r in ngram_counts(lines(spark, "", "x"), 1).collect()} == {"": 1, "x": 1}
    assert ngram_counts(lines(spark), 2).count() == 0
    assert lines(spark, "a b c").select(ngrams(tokenize(F.col("value")), 5)).first()[0] == []


def test_cooccurrence(spark):
    counts = cooccur.word_tag_counts(lines(spark, "#a #a w", "#a #b w x", "no tags here"))
    assert {(r.word, r.hashtag): r.cnt for r in counts.collect()} == {("w", "#a"): 3, ("x", "#a"): 1, ("w", "#b"): 1, ("x", "#b"): 1}
    assert [tuple(r) for r in cooccur.tag_similarity(counts).collect()] == [(4, "#a", "#b")]
    assert {r.word: r.cnt for r in cooccur.feature_vector(counts, "#b").collect()} == {"w": 1, "x": 1}
    assert {r.word: r.tags for r in cooccur.as_maps(counts).collect()} == {"w": {"#a": 3, "#b": 1}, "x": {"#a": 1, "#b": 1}}


def test_vector_import(spark):
    df = spark.createDataFrame([("#a:3;:1;#b:1;",)], "v string")
    assert [tuple(x) for x in df.select(cooccur.parse_vector(F.col("v")).alias("p")).first().p] == [("#a", 3), ("#b", 1)]


def test_next_word(spark):
    counts = spark.createDataFrame([("a", 10), ("a b", 6), ("a c", 3), ("a d", 2), ("z y", 9)], "phrase string, freq bigint")
    got = {(r.prefix, r.word): r.probability for r in langmodel.next_word(counts).collect()}
    assert got == {("a", "b"): 0.6, ("a", "c"): 0.3}
    tied = spark.createDataFrame([("a", 10), ("a c", 3), ("a b", 3)], "phrase string, freq bigint")
    assert [r.word for r in langmodel.next_word(tied, top=1).collect()] == ["b"]
    assert langmodel.as_wide(langmodel.next_word(tied), "prefix", "word").first().probabilities == {"b": 0.3, "c": 0.3}


def test_next_phrase(spark):
    rows = [("p", 100)] + [(f"p s{k}", n) for k, n in enumerate((60, 20, 10, 6, 4))] + [("p s0 t", 30), ("once", 1), ("once more", 1)]
    got = langmodel.next_phrase(spark.createDataFrame(rows, "phrase string, freq bigint")).collect()
    assert {(r.phrase, r.next_phrase): r.probability for r in got} == {("p", "s0"): 0.6, ("p", "s1"): 0.2, ("p", "s0 t"): 0.3, ("p s0", "t"): 0.5}


ODD_WORDS = ["a", "b", "@", "#x", "ab", "a\x01b", "a\x01", "a!b", "é@é", "a\x1fc", "c\x80", "the", "the", "the", "the", "", ".", "1"]


@pytest.mark.parametrize("sizes", [{}, {"bucket": 20, "sample": 1}, {"bucket": 300, "sample": 3}])
def test_next_phrase_of_lines_equals_that_of_counts(spark, sizes):
    draw = random.Random(3)
    text = lines(spark, *(" ".join(draw.choice(ODD_WORDS) for _ in range(draw.randint(0, 9))) for _ in range(400))).repartition(5)
    got, expected = phrasemodel.next_phrase(text, **sizes), langmodel.next_phrase(phrase_counts(text, 5))
    assert got.dtypes == expected.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert phrasemodel.next_phrase(lines(spark), **sizes).count() == 0


def test_next_phrase_of_lines_shuffles_a_place_once(spark):
    """Lines without a repeated phrase of two words: what is dealt out stays below 12 bytes a place, the result whole."""
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(3000)]
    ids = np.array([draw.randrange(3000) for _ in range(200_000)])
    packed = [*phrasemodel.pack(pa.array(words), ids, np.arange(0, 200_001, 50), 5, 4, frozenset(words[:5]))]
    assert sum(len(x) for row in packed for x in row[5:]) < 12 * len(ids)
    assert sum(int(phrasemodel.unpack(*row[2:], 5)[2].sum()) for row in packed) == len(ids)


def test_phrase_counts(spark):
    got = {r.phrase: r.freq for r in phrase_counts(lines(spark, "a b", "1 2 3"), 3).collect()}
    assert got == {"a": 1, "b": 1, "a b": 1}


@pytest.mark.parametrize("n", [1, 4])
def test_phrase_counts_equal_ngram_counts(spark, n):
    text = lines(spark, "the cat sat on the mat", "the cat ran")
    one = {r.ngram: r.freq for r in ngram_counts(text, n).collect()}
    every = {r.phrase: r.freq for r in phrase_counts(text, 4).collect()}
    assert {k: v for k, v in every.items() if len(k.split()) == n} == one
