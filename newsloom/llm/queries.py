"""The operators over the supplied tables, each as one registered query."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import (
    decontamination, lexical_search, license_scan, line_dedup, mixing, ngram_join, pii, quality_lm, quality_rules, sharding,
    source_audit, substring_dedup, suffix_dedup,
)
from newsloom.session import pin

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SHARDS = 16


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(pin(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir)).select(
        "doc_id", "source", "size", "source_size", "target", "copies", "taken")


@query
def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    utf8 = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents(spark, sf_dir).select(
        "doc_id", "source", (F.octet_length(utf8) + 1).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"))
    return sharding.interleave(rows, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("row_id"), "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.judge(rows, items).withColumnRenamed("row_id", "doc_id")


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "source", "text")
    return quality_rules.judge(rows).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "removed_words")


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(documents(spark, sf_dir))


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(documents(spark, sf_dir)))


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedupe(documents(spark, sf_dir)).drop("kept")


@query
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(documents(spark, sf_dir))


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as good and not toxic."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 and toxic = 0").select("doc_id")


@query
def op8_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.classify(documents(spark, sf_dir), trusted(spark, sf_dir)).select(
        "doc_id", "lang", "n_words", "perplexity", "score", "low", "high", "kept")


# A real key comes from the caller's key store; this one makes reruns agree.
PII_KEY = "registered query"


@query
def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymize(documents(spark, sf_dir).select("doc_id", "text"), PII_KEY)
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], "text")


@query
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedupe(documents(spark, sf_dir)).drop("spans")


@query
def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(documents(spark, sf_dir))


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
