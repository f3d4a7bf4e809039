"""Landed feed files to feed entries. Downloading them is somebody else's job.

Layout: ``<landing>/<source>/<file>.xml``; the folder name is the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RSS = "title string, link string, guid string, description string, pubDate string, _corrupt string"
_ATOM = (
    "title string, link struct<_href: string>, id string, summary string, "
    "published string, updated string, _corrupt string"
)


def _source_of(path: Column) -> Column:
    return F.url_decode(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))


def _unreadable() -> Column:
    """The text of a broken item. It names another column too (and takes nothing from it), as
    Spark does not read files for this column alone."""
    return F.concat("_corrupt", F.substring(F.coalesce("title", F.lit("")), 1, 0)).alias("corrupt")


def _scan(spark: SparkSession, landing: str, tag: str, schema, stream: bool) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return (
        reader.format("xml")
        .option("rowTag", tag)
        .option("recursiveFileLookup", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .schema(schema)
        .load(landing)
        .withColumn("_file", F.col("_metadata.file_path"))
        .withColumn("_block", F.col("_metadata.file_block_start"))
    )


def scan_rss(spark: SparkSession, landing: str, stream: bool = False) -> DataFrame:
    """One row per RSS item; one that cannot be read has its text in ``corrupt``."""
    return _scan(spark, landing, "item", _RSS, stream).select(
        _source_of(F.col("_file")).alias("source"),
        "_file", "_block", "link",
        F.col("guid").alias("id"), "title", F.col("description").alias("summary"),
        F.col("pubDate").alias("published"), F.lit(None).cast("string").alias("updated"),
        _unreadable(),
    )


def scan_atom(spark: SparkSession, landing: str, stream: bool = False) -> DataFrame:
    """One row per Atom entry."""
    return _scan(spark, landing, "entry", _ATOM, stream).select(
        _source_of(F.col("_file")).alias("source"),
        "_file", "_block", F.col("link._href").alias("link"),
        "id", "title", "summary", "published", "updated", _unreadable(),
    )


def in_file_order(entries: DataFrame) -> DataFrame:
    """Add ``pos``, a text that sorts entries as they stand in their files:
    file, split of the file, row within the split."""
    row = F.monotonically_increasing_id()
    return entries.withColumn(
        "pos",
        F.concat(
            "_file", F.lit("#"), F.lpad(F.col("_block").cast("string"), 15, "0"),
            F.lit("#"), F.lpad(row.cast("string"), 20, "0"),
        ),
    ).drop("_file", "_block")
