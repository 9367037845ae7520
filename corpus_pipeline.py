"""The corpus pipeline: from raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result to the shared folder
and reads it back as the next one's docs. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import toxicity
from loomspark.llm.common import cut, drop, scratch_path, until_exit
from loomspark.llm.decontam import decontaminate
from loomspark.llm.mixing import poisson_mix
from loomspark.llm.queries import fold, tokenizer_path
from loomspark.llm.simhash import drop_near_copies
from loomspark.llm.tokens import read_tokens, write_tokens
from loomspark.sources.tables import table

#: A document with this probability of being toxic or more goes.
TOXIC = 0.7


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """docs as one column, beside those that an operator reads: no name of docs can clash with one that it adds."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__loom_row"), *names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't call toxic. Null and empty texts have no evidence and stay;
    repeated rows are scored alike; all columns stay, whatever they are called; an empty table stays empty."""
    index = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1), "toxic")
    return toxicity.score(packed(docs, "text"), index).where(f"score < {TOXIC}").select("__loom_row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies: 5-word shingles, similarity 0.8 or more. Texts without
    words, null or empty, are one group; of repeated rows one stays; rows without a doc_id all stay, and all columns."""
    return drop_near_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: less than 0.8 of its 5-word shingles. Null and empty texts, rows without a
    doc_id, repeated rows and all columns stay; an empty benchmark drops nothing."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), threshold=0.8, words=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source in proportion to the square root of its size, by Poisson replication, in random order. Rows without a
    source are a source; null texts and repeated rows are rows like any other; all columns stay, whatever they are
    called; an empty table stays empty."""
    return poisson_mix(packed(docs, "doc_id", "source"), power=0.5, seed=8).select("__loom_row.*")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id order, and what stands in them for each (copy of a) document. A null text is the
    end id alone; a null doc_id comes first; other columns are ignored; an empty table gives no rows."""
    path = scratch_path(spark)
    write_tokens(docs, path, tokenizer_path(), end_id=0)
    until_exit(spark, path)
    return read_tokens(spark, path)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_copies), ("decontamination", drop_benchmark), ("mixing", mix), ("token_ids", to_tokens)]

#: SQL has neither the tokenizer nor the learned classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table goes once the next one's is written; the last but one's stays until
    the driver ends, as the result may be read again."""
    docs, former = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        drop(*former)
        former = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
