"""A corpus pipeline of five stages over ``documents``.

Toxic documents go; of each group of documents similar in their word 5-grams
one stays; documents that hold benchmark items go; the sources are mixed to
their target weights, so that a document may stand in several rows or none; the
rest is written as compressed token ids. Each stage reads what the one before
kept, as Parquet in the shared folder.

The first and the last stage train models and compress, which SQL can't
express. ``tests/llm/test_pipeline.py`` holds every stage on its own input:
toxicity against the operator's scores and the labels, the next three against
plain Python, the last by reading every text back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from semblance.llm import common as C
from semblance.llm import decontaminate, jaccard, mixing, tokens, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(spark, docs, C.table(spark, sf_dir, "labels"))


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(spark, docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(spark, docs, C.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.binary(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_similar),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_binary", token_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
