"""A corpus pipeline: five stages, each an operator of ``newsloom.llm``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import decontamination, mixing, ngram_join, quality_lm, sharding
from newsloom.session import pin, use_checkpoint_dir

SHARDS = 16


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under trusted text lies within their language's bounds.

    Null texts and texts without words go; a null language is one of its own; repeated rows share a verdict;
    an empty table stays empty; further columns stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_lm.keep(docs, labels.filter("quality = 1 and toxic = 0").select("doc_id"))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near duplicates.

    Null texts, texts without words and rows without a key link with nothing and stay; repeated rows are one
    document and stay or go together; an empty table stays empty; further columns stay.
    """
    return ngram_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover less than a twentieth.

    Null texts and texts without words stay; every row is judged for itself; an empty table or benchmark removes
    nothing; further columns stay.
    """
    return decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of its source want it.

    Texts without words count as empty; a null source comes last; repeated rows share their copies out; an empty
    table stays empty; further columns stay.
    """
    return mixing.apply(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with shard and slot; every shard holds the sources in proportion.

    Null texts, sources and keys are rows like others; repeated rows get slots of their own; an empty table stays
    empty; further columns stay, but one named like a result is replaced.
    """
    return sharding.interleave(docs, SHARDS)


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", join_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

# Perplexities, pivotal rounding and connected components are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    pin(spark)
    use_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
