"""One run over a batch of feed entries: news in, scored signals and alerts out.

Every step reads what the step before has written to the store, so nothing is
computed twice, lineage stays short and a lost executor costs one task. All
writes replace what ``batch_id`` has in a table, and a batch keeps the time it
first ran at, so running it again gives the same tables.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import lexicon as lx
from newsloom.operators import alerts, extract, feed, ingest, prices, scoring
from newsloom.plans.outbox import deliver_once
from newsloom.session import cut, release
from newsloom.sources import known
from newsloom.sources import vectors as stored_vectors
from newsloom.sources.tables import Deliver, Store, news_day

DEDUP_MODES = ("id", "lexical", "semantic")


@dataclass
class Settings:
    """What a run needs besides its entries."""

    feeds: DataFrame                              # feed_no, source, url
    bars: DataFrame                               # ticker, day, close, volume
    dedup: str = "id"
    limit: int | None = lx.ITEMS_PER_FEED
    model_name: str = "rules"
    watchlist: tuple[str, ...] = lx.WATCHLIST
    ask: Callable[[pd.Series], pd.Series] | None = None      # texts -> responses
    encode: Callable[[pd.Series], pd.Series] | None = None   # texts -> vectors
    channels: tuple[str, ...] = ("local",)
    deliver: dict[str, Deliver] = field(default_factory=dict)
    title: str = "New Signal"


COUNTS = ("fetched", "inserted", "duplicates", "processed", "errors")


@dataclass
class Result:
    fetched: int = 0
    inserted: int = 0
    duplicates: int = 0
    processed: int = 0
    errors: int = 0
    status: str = "ok"


def run_batch(
    spark: SparkSession,
    store: Store,
    entries: DataFrame,
    settings: Settings,
    as_of: Column,
    batch_id: str,
    reason: str = "manual",
    wait_seconds: float = 0,
    stale_seconds: float | None = None,
) -> Result:
    """Process ``entries`` and log the run; a failure is logged and raised.

    ``as_of`` is evaluated once, when the batch id is first seen. One run works
    on a store at a time: while another one does, this one waits for
    ``wait_seconds``, then logs ``busy`` and changes nothing else.
    """
    if store.is_compacted(batch_id):
        raise ValueError(f"batch {batch_id} was compacted and cannot be repeated")
    end = time.monotonic() + wait_seconds
    while not store.acquire(batch_id, stale_seconds):
        if time.monotonic() >= end:
            result = Result(status="busy")
            log_run(store, f"{batch_id}-busy-{uuid.uuid4()}", "busy", reason, as_of, result, f"{store.holder()} is running")
            return result
        time.sleep(min(1.0, max(end - time.monotonic(), 0)))
    try:
        as_of = F.lit(store.pin_time(batch_id, as_of)).cast("timestamp")
        try:
            result = _run(spark, store, entries, settings, as_of, batch_id)
        except Exception as error:
            log_run(store, batch_id, "error", reason, as_of, Result(errors=1), str(error))
            raise
        log_run(store, batch_id, "ok", reason, as_of, result)
        return result
    finally:
        store.free(batch_id)


def log_run(
    store: Store, batch_id: str, status: str, reason: str, as_of: Column,
    result: Result, message: str = "",
) -> None:
    row = store.spark.range(1).select(
        F.lit(status).alias("status"), F.lit(reason).alias("reason"), as_of.alias("ran_at"),
        *[F.lit(getattr(result, n)).cast("bigint").alias(n) for n in COUNTS],
        F.lit(message).alias("message"),
    )
    store.write("run_log", row, batch_id)


def last_run(store: Store) -> DataFrame:
    """The latest run; status ``idle`` when there was none."""
    log = store.read("run_log")
    idle = store.spark.range(1).select(F.lit("idle").alias("status"))
    return (
        log.unionByName(idle, allowMissingColumns=True)
        .orderBy(F.desc_nulls_last("ran_at"), F.desc_nulls_last("batch_id"))
        .limit(1)
    )


def _run(spark, store, entries, settings, as_of, batch_id) -> Result:
    if settings.dedup not in DEDUP_MODES:
        raise ValueError(f"dedup must be one of {DEDUP_MODES}")
    stamp = F.concat(F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    feed_no = settings.feeds.select("source", "feed_no")
    pos = F.col("pos")
    if entries.schema["pos"].dataType.simpleString() != "string":
        pos = F.lpad(pos.cast("string"), 20, "0")

    unreadable = None
    if "corrupt" in entries.columns:
        unreadable = entries.filter(F.col("corrupt").isNotNull())
        entries = entries.filter(F.col("corrupt").isNull()).drop("corrupt")

    # Entries -> items, staged once.
    items = ingest.news_items(entries.withColumn("pos", pos), stamp, settings.limit)
    every = F.count(F.lit(1))
    seen = store.write("items", items.join(feed_no, "source", "left"), batch_id,
                       n=every, bad=F.count_if(F.col("news_id").isNull()))
    items = store.read("items", batch_id)
    _write_health(store, settings, entries, as_of)

    # Rows that cannot be keyed go to the error table, the others go on.
    bad = items.filter(F.col("news_id").isNull())
    errors = bad.select(F.coalesce("headline", F.lit("")).alias("headline"), F.lit("source is missing").alias("error"))
    if unreadable is not None:
        errors = errors.unionByName(unreadable.select(
            F.coalesce("title", F.lit("")).alias("headline"), F.concat(F.lit("unreadable item: "), "corrupt").alias("error")))
    good = items.filter(F.col("news_id").isNotNull())
    stored = store.known_keys(good, batch_id)
    new = ingest.unseen(ingest.first_per_id(good, "feed_no", "pos"), stored)
    day = news_day(F.col("published_at"), F.col("fetched_at"))
    added = store.write("news_raw", new.withColumn("day", day), batch_id, n=every)["n"]

    # Similar news keep their raw row, but give no signal.
    raw = store.read("news_raw", batch_id)
    order = items.select("news_id", "feed_no", "pos")
    fresh, failed, left = _drop_similar(store, settings, raw, order, batch_id)
    inserted = added if left is None else left
    extracted, asked = _extract(fresh, settings)
    errors = errors.withColumn("lost", F.lit(False))
    for part, lost in ((failed, True), (asked, False)):
        if part is not None:
            errors = errors.unionByName(part.withColumn("lost", F.lit(lost)))
    noted = store.write("errors", errors, batch_id, n=every, lost=F.count_if("lost"))
    scored = scoring.score_signals(extract.settle_tickers(extracted), as_of, settings.model_name)
    priced = prices.price_signals(scored, settings.bars, as_of)
    processed = store.write("signals", priced, batch_id, n=every)["n"]

    _alert(store, settings, as_of, batch_id)
    store.add_keys(raw, batch_id)
    return Result(
        fetched=seen["n"],
        inserted=inserted,
        duplicates=seen["n"] - seen["bad"] - noted["lost"] - inserted,
        processed=processed,
        errors=noted["n"],
    )


def _write_health(store, settings, entries, as_of) -> None:
    """A feed that is absent from this drop keeps the row it has."""
    health = ingest.source_health(settings.feeds, entries, as_of)
    known = cut(store.read("source_health").select("source"))
    absent = health.filter("item_count = 0").join(known, "source", "left_anti")
    store.write("source_health", health.filter("item_count > 0").unionByName(absent))
    release(known)


def _drop_similar(store, settings, raw, order, batch_id) -> tuple[DataFrame, DataFrame | None, int | None]:
    """News that go on, errors of those that could not be compared, and how many go on (none: all)."""
    if settings.dedup == "id":
        return raw, None, None
    place = order.groupBy("news_id").agg(F.min(F.struct("feed_no", "pos")).alias("ord"))
    placed = raw.join(place, "news_id")
    if settings.dedup == "lexical":
        _, left = known.lexical_run(store, placed, batch_id)
        kept = store.read("fingerprints", batch_id).select("news_id")
        return raw.join(kept, "news_id", "left_semi"), None, left
    if settings.encode is None:
        raise ValueError("semantic dedup needs settings.encode")
    vectors = cut(extract.add_embeddings(raw, settings.encode))
    failed = vectors.filter("error is not null").join(raw.select("news_id", "headline"), "news_id").select("headline", "error")
    vectors = vectors.filter("error is null").drop("error")
    _, left = stored_vectors.semantic_run(store, vectors.join(place, "news_id"), batch_id)
    kept = store.read("embeddings", batch_id).select("news_id")
    return raw.join(kept, "news_id", "left_semi"), failed, left


def _extract(news: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame | None]:
    """Extracted signals, and the errors of the hook; the rules stand in where it failed."""
    if settings.ask is None:
        return extract.extract_by_rules(news, settings.watchlist), None
    asked = cut(extract.add_responses(news, settings.ask, error="hook_error"))
    failed = asked.filter("hook_error is not null").select("headline", F.col("hook_error").alias("error"))
    return extract.normalize_responses(asked.drop("hook_error"), watchlist=settings.watchlist).drop(
        "raw_response", "origin"
    ), failed


def reprocess(
    spark: SparkSession, store: Store, settings: Settings, as_of: Column, batch_id: str,
    news: DataFrame | None = None,
) -> int:
    """Extract and score stored news again (all, or those of ``news``): new values replace the
    stored ones, but a signal keeps its first price, its day and its batch."""
    as_of = F.lit(store.pin_time(batch_id, as_of)).cast("timestamp")
    rows = store.read("news_raw")
    if news is not None:
        rows = rows.join(news.select("news_id"), "news_id", "left_semi")
    day = rows.select("news_id", "day")
    extracted, failed = _extract(rows.drop("day", "batch_id"), settings)
    scored = scoring.score_signals(extract.settle_tickers(extracted), as_of, settings.model_name)
    priced = prices.price_signals(scored, settings.bars, as_of).join(day, "news_id")
    fields = [f.name for f in store.TABLES["signals"][0].fields if f.name != "batch_id"]
    store.merge_signals(priced.select(fields), batch_id)
    if failed is not None:
        store.write("errors", failed, batch_id)
    return priced.count()


def _alert(store, settings, as_of, batch_id) -> None:
    """Build, deliver and log what this run has to announce, per channel; each row once (see ``outbox``)."""
    view = feed.load_signals(
        store.read("news_raw", batch_id), store.read("signals", batch_id), limit=None
    )
    for channel in settings.channels:
        if channel != "local" and channel not in settings.deliver:
            continue                    # not configured: nothing is sent or logged
        log = store.read("alert_log", before=batch_id).filter(F.col("channel") == channel)
        if channel in ("local", "webhook"):
            due = alerts.new_alerts(view, log, as_of, channel)
        else:
            due = alerts.new_notifications(view, log, as_of, channel, title=settings.title)
        deliver_once(store, due, channel, settings.deliver.get(channel), batch_id)


def notify_one(
    store: Store, news_id: str, as_of: Column, deliver: Deliver | None,
    channel: str = "telegram_manual", title: str = "New Signal",
) -> str:
    """Send one stored signal on request; the log keeps the latest sending.

    Returns the status; without a ``deliver`` hook nothing is sent or logged.
    """
    if deliver is None:
        return "not_configured"
    signal = feed.signal_by_id(store.read("news_raw"), store.read("signals"), news_id)
    row = signal.select(
        "news_id", F.lit(channel).alias("channel"), F.lit("sent").alias("status"),
        alerts.notification_html(title).alias("message"), as_of.alias("sent_at"),
    )
    row = cut(deliver(row))
    found = row.select("status").head()
    if found is None:
        return "signal not found"
    store.log_manual(row, news_id)
    return found["status"]
