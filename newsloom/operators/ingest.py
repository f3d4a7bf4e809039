"""Feed entries to news rows, and the health of the feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom import lexicon as lx
from newsloom.functions import text as tx
from newsloom.functions import values as vl
from newsloom.functions.once import compute_once


def first_per_feed(entries: DataFrame, limit: int | None = lx.ITEMS_PER_FEED) -> DataFrame:
    """The first ``limit`` entries of every feed, before any are dropped.

    Spark cuts each task's rows to ``limit`` per feed ahead of the shuffle, so
    one huge feed does not land in one task.
    """
    if limit is None:
        return entries
    order = Window.partitionBy("source").orderBy("pos")
    return (
        entries.withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= limit)
        .drop("_n")
    )


def news_items(
    entries: DataFrame, fetched_at: Column, limit: int | None = lx.ITEMS_PER_FEED
) -> DataFrame:
    """News rows of the entries; entries without a headline are dropped.

    Each cleaning is one generated row, so that nothing above repeats it.
    """
    named = compute_once(first_per_feed(entries, limit), headline=tx.clean_html(F.col("title"))).filter(F.col("headline") != "")
    cleaned = compute_once(named, _summary=tx.clean_html(F.col("summary")))
    return compute_once(cleaned, full_text=tx.full_text(F.col("headline"), F.col("_summary"))).select(
        vl.stable_id(F.col("source"), F.col("link"), F.col("id"), F.col("title")).alias("news_id"),
        "source",
        "headline",
        "full_text",
        F.coalesce("link", F.lit("")).alias("url"),
        vl.entry_time(F.col("published"), F.col("updated")).alias("published_at"),
        fetched_at.alias("fetched_at"),
        "pos",
    )


def source_health(feeds: DataFrame, entries: DataFrame, checked_at: Column) -> DataFrame:
    """One row per feed: how many entries it held, before any cut.

    A feed without a readable entry counts as failed. ``feeds`` has one row per
    configured feed.
    """
    counts = entries.groupBy("source").agg(F.count("*").alias("item_count"))
    ok = F.col("item_count").isNotNull()
    return feeds.join(counts, "source", "left").select(
        "source",
        "url",
        F.when(ok, "ok").otherwise("error").alias("status"),
        F.coalesce("item_count", F.lit(0)).cast("bigint").alias("item_count"),
        F.when(ok, "").otherwise(lx.FEED_FAILED).alias("error"),
        checked_at.alias("checked_at"),
    )


def by_source(health: DataFrame) -> DataFrame:
    return health.orderBy("source")


def first_per_id(items: DataFrame, *order: str) -> DataFrame:
    """The first row of every ``news_id`` in arrival order. Copies are dropped
    within each task ahead of the shuffle."""
    rank = Window.partitionBy("news_id").orderBy(*order)
    return items.withColumn("_n", F.row_number().over(rank)).filter("_n = 1").drop("_n")


def unseen(items: DataFrame, stored_ids: DataFrame) -> DataFrame:
    """Items whose id is not stored yet."""
    return items.join(stored_ids.select("news_id"), "news_id", "left_anti")
