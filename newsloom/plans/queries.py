"""Registered queries: each operator over whole supplied tables.

Results hold only plain columns (arrays as joined text, times as text), so
they can be compared between engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import lexicon as lx
from newsloom import schemas
from newsloom.functions import text as tx
from newsloom.functions import values as vl
from newsloom.operators import (
    alerts, approximate, dedup, extract, feed, ingest, keywords, prices, scoring, summary,
)
from newsloom.plans import outbox, run
from newsloom.session import cut, pin, use_checkpoint_dir
from newsloom.sources import known, samples, tables, vectors
from newsloom.streaming import refresh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

VECTOR_THRESHOLD = 1.25     # the supplied vectors have no pair below 0.18


def query(fn: Query) -> Query:
    @wraps(fn)
    def pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(pin(spark), sf_dir)

    QUERIES[fn.__name__] = pinned
    return pinned


def joined(name: str) -> Column:
    return F.array_join(name, "|").alias(name)


def time_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def big(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


# --- shared inputs -----------------------------------------------------------

def rule_signals(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """Signals of all documents by the rules, scored; keeps the news columns."""
    rows = extract.extract_by_rules(samples.news(spark, sf, *extra))
    return scoring.score_signals(extract.settle_tickers(rows), samples.as_of())


def response_signals(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples.with_response(samples.news(spark, sf, "doc_id"))
    rows = extract.normalize_responses(rows).drop("raw_response", "origin", "doc_id")
    return scoring.score_signals(extract.settle_tickers(rows), samples.as_of(), "responses")


NEWS_ONLY = [f.name for f in schemas.NEWS.fields if f.name != "news_id"]


def stored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """News and signals as two tables."""
    signals = rule_signals(spark, sf).drop(*NEWS_ONLY)
    for name in ("price_at_signal", "price_change_pct"):
        signals = signals.withColumn(name, F.lit(None).cast("double"))
    signals = signals.withColumn("price_checked_at", F.lit(None).cast("timestamp"))
    return samples.news(spark, sf), signals


def loaded_feed(spark: SparkSession, sf: str, filters: dict | None = None) -> DataFrame:
    return feed.load_signals(*stored(spark, sf), filters)


def positioned_feed(spark: SparkSession, sf: str) -> DataFrame:
    return feed.with_position(loaded_feed(spark, sf))


def brief(rows: DataFrame, *more) -> DataFrame:
    return rows.select(
        "news_id", "source", "suggestion", "priority", "confidence", "signal_score",
        joined("stocks"), *more,
    )


# --- ingest --------------------------------------------------------------------

@query
def clean_html_pages(spark, sf):
    return samples.table(spark, sf, "pages").select(
        "page_id", tx.clean_html(F.col("html")).alias("clean_text")
    )


@query
def stable_ids(spark, sf):
    e = samples.feed_entries(spark, sf)
    return e.select(
        F.col("pos").alias("page_id"),
        vl.stable_id(F.col("source"), F.col("link"), F.col("id"), F.col("title")).alias("news_id"),
    )


@query
def feed_first_n(spark, sf):
    first = ingest.first_per_feed(samples.feed_entries(spark, sf))
    return first.filter(F.col("title") != "").select("source", "pos", "title")


@query
def news_items(spark, sf):
    items = ingest.news_items(
        samples.feed_entries(spark, sf), F.lit(samples.FETCHED), limit=None
    )
    return items.select(*[f.name for f in schemas.NEWS.fields], "pos")


@query
def source_health(spark, sf):
    entries, feeds = samples.feed_entries(spark, sf), samples.feeds(spark)
    health = ingest.source_health(feeds, entries, samples.as_of())
    return ingest.by_source(health).withColumn("checked_at", time_text(F.col("checked_at")))


@query
def new_news_anti_join(spark, sf):
    news = samples.news(spark, sf, "doc_id")
    known = news.join(samples.stored_docs(spark, sf), "doc_id", "left_semi")
    again = news.unionByName(news.withColumn("doc_id", F.col("doc_id") + 1_000_000_000))
    return ingest.unseen(ingest.first_per_id(again, "doc_id"), known).select("news_id", "doc_id")


@query
def json_arrays(spark, sf):
    rows = rule_signals(spark, sf, "doc_id").select(
        "doc_id", vl.encode_array(F.col("stocks")).alias("encoded")
    )
    # Some texts are damaged: they must decode to an empty list.
    text = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.regexp_replace("encoded", r"^\[", "")).otherwise(
        F.col("encoded")
    )
    decoded = vl.decode_array(text)
    return rows.select(
        "doc_id", "encoded", F.size(decoded).cast("bigint").alias("n"),
        F.array_join(decoded, "|").alias("decoded"),
    )


# --- dedup ---------------------------------------------------------------------

@query
def tokens_fingerprints(spark, sf):
    words, fp = tx.tokens(F.col("text")), tx.fingerprint(F.col("text"))
    return samples.table(spark, sf, "documents").select(
        "doc_id",
        F.size(words).cast("bigint").alias("n_tokens"),
        F.size(fp).cast("bigint").alias("n_words"),
        F.md5(F.array_join(F.array_sort(fp), " ")).alias("words_md5"),
    )


@query
def jaccard_adjacent_turns(spark, sf):
    """Overlap of every turn with the turn before it in its conversation."""
    turns = samples.table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.fingerprint(F.col("text")).alias("fp")
    )
    before = turns.select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("fp").alias("fp_before")
    )
    both = turns.join(before, ["conv_id", "turn"])
    overlap = F.array_intersect("fp", "fp_before")
    union = F.array_union("fp", "fp_before")
    return both.select(
        "conv_id", "turn",
        F.size(overlap).cast("bigint").alias("overlap"),
        F.size(union).cast("bigint").alias("union_size"),
        F.floor(tx.jaccard(F.col("fp"), F.col("fp_before")) * 10000).alias("jaccard_1e4"),
        tx.jaccard_at_least(F.col("fp"), F.col("fp_before"), 82).alias("duplicate"),
    )


def _document_flags(spark, sf):
    docs = samples.table(spark, sf, "documents")
    return dedup.lexical_dedup(docs, "doc_id", "text", "doc_id")


@query
def lexical_dedup_kept(spark, sf):
    return _document_flags(spark, sf).select("doc_id", big("fp_size"), "exact_copy", "kept")


@query
def incremental_dedup_kept(spark, sf):
    """Documents in two runs over one store, the labelled ones first."""
    store = tables.Store(spark, _run_folder(spark)).create("fingerprints", "postings", "word_order")
    docs, first = samples.table(spark, sf, "documents"), samples.stored_docs(spark, sf).select("doc_id")
    runs = [docs.join(first, "doc_id", how).select("doc_id", "text") for how in ("left_semi", "left_anti")]
    flags = [known.lexical_run(store, rows, f"run-{i}", "doc_id", "text", "doc_id")[0] for i, rows in enumerate(runs)]
    return flags[0].unionByName(flags[1]).select("doc_id", big("fp_size"), "kept")


@query
def vector_dedup_kept(spark, sf):
    rows = samples.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return dedup.vector_dedup(rows, "vec_id", "vec_id", threshold=VECTOR_THRESHOLD)


@query
def lexical_dedup_lsh(spark, sf):
    """The approximate option beside the exact decision."""
    docs = samples.table(spark, sf, "documents").select("doc_id", "text")
    exact = _document_flags(spark, sf).select("doc_id", "kept")
    found = approximate.lexical_dedup_lsh(docs, "doc_id", "text", "doc_id").withColumnRenamed("kept", "kept_lsh")
    return exact.join(found, "doc_id")


@query
def vector_dedup_lsh(spark, sf):
    """The same for vectors."""
    rows = samples.table(spark, sf, "embeddings").select("vec_id", "embedding")
    exact = dedup.vector_dedup(rows, "vec_id", "vec_id", threshold=VECTOR_THRESHOLD)
    found = approximate.vector_dedup_lsh(rows, "vec_id", "vec_id", VECTOR_THRESHOLD).withColumnRenamed("kept", "kept_lsh")
    return exact.join(found, "vec_id")


@query
def incremental_vectors_kept(spark, sf):
    """Vectors in two runs over one store, those of even labels first."""
    store = tables.Store(spark, _run_folder(spark)).create("embeddings", "vector_pivots", "vector_cells")
    rows = samples.table(spark, sf, "embeddings")
    runs = [rows.filter(F.pmod("label", F.lit(2)) == i).select("vec_id", "embedding") for i in (0, 1)]
    flags = [vectors.semantic_run(store, r, f"run-{i}", "vec_id", "vec_id", VECTOR_THRESHOLD, cell_rows=64)[0] for i, r in enumerate(runs)]
    return flags[0].unionByName(flags[1])


@query
def deduped_signal_counts(spark, sf):
    """Signals of the documents that are left after the lexical dedup."""
    kept = _document_flags(spark, sf).filter("kept").select("doc_id")
    signals = rule_signals(spark, sf, "doc_id").select("doc_id", *summary.FACETS)
    return summary.dimension_counts(signals.join(kept, "doc_id", "left_semi"))


# --- extraction and scoring ------------------------------------------------------

@query
def ticker_normalize(spark, sf):
    """Tickers named by the responses, raw and normalized."""
    docs = samples.with_response(samples.table(spark, sf, "documents").select("doc_id"))
    listed = F.from_json(
        F.get_json_object("raw_response", "$.stocks"), "array<string>"
    )
    ticker = vl.normalize_ticker(F.col("raw"))
    return docs.select("doc_id", F.posexplode(listed).alias("n", "raw")).select(
        "doc_id", big("n"), "raw", ticker.alias("ticker"),
        vl.is_tradable(ticker).alias("tradable"),
    )


EXTRACTED = (
    "news_id", "event_type", "sentiment", "impact_horizon", "suggestion", "confidence",
)


@query
def rule_extract(spark, sf):
    raw = extract.extract_by_rules(samples.news(spark, sf))
    raw = raw.withColumn("mentioned", F.array_join("stocks", "|"))
    return extract.settle_tickers(raw).select(*EXTRACTED, "mentioned", joined("stocks"))


@query
def response_normalize(spark, sf):
    rows = samples.with_response(samples.news(spark, sf, "doc_id"))
    rows = extract.normalize_responses(rows)
    rows = rows.withColumn("listed", F.array_join("stocks", "|"))
    return extract.settle_tickers(rows).select(
        *EXTRACTED, "origin", "listed", joined("stocks"), "reasoning"
    )


ALL_KEYWORDS = tuple(
    dict.fromkeys(
        (*lx.BROKER_KEYWORDS, *lx.MACRO_KEYWORDS, *lx.FUND_KEYWORDS, *lx.GLOBAL_KEYWORDS,
         *lx.POSITIVE_WORDS, *lx.NEGATIVE_WORDS, *lx.STRONG_WORDS, *lx.WEAK_WORDS)
    )
)


@query
def keyword_hits(spark, sf):
    return extract.keyword_hits(samples.news(spark, sf), "full_text", ALL_KEYWORDS)


@query
def keyword_table_hits(spark, sf):
    """Documents that hold each long word of any document, as a substring."""
    docs = samples.table(spark, sf, "documents").select("doc_id", "text")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{7,}"), F.lit(0))).alias("keyword"))
    return keywords.keyword_counts(docs, words, "doc_id", "text")


@query
def freshness(spark, sf):
    f = scoring.freshness(F.col("published_at"), F.col("fetched_at"), samples.as_of())
    return samples.news(spark, sf).withColumn("f", f).select(
        "news_id", F.col("f.score").cast("bigint").alias("score"), F.col("f.reason").alias("reason")
    )


@query
def specificity_language(spark, sf):
    rows = extract.settle_tickers(extract.extract_by_rules(samples.news(spark, sf)))
    parts = scoring.part_scores(rows, samples.as_of())
    return parts.select(
        "news_id",
        tx.word_count(F.col("_text")).cast("bigint").alias("word_count"),
        F.col("_specificity").cast("bigint").alias("specificity"),
        F.col("_strong").cast("bigint").alias("strong_hits"),
        F.col("_weak").cast("bigint").alias("weak_hits"),
        F.col("_language").cast("bigint").alias("language"),
        F.col("_consistency").cast("bigint").alias("consistency"),
    )


def _scored(rows):
    return rows.select(
        "news_id", joined("stocks"), "event_type", "sentiment", "impact_horizon", "suggestion",
        "confidence", "signal_score", "priority", "risk_level", joined("confidence_reasons"),
        "model_name", time_text(F.col("processed_at")).alias("processed_at"),
    )


@query
def score_signals(spark, sf):
    return _scored(rule_signals(spark, sf))


@query
def score_responses(spark, sf):
    return _scored(response_signals(spark, sf))


# --- served views ----------------------------------------------------------------

@query
def signal_feed(spark, sf):
    rows = loaded_feed(spark, sf)
    at = vl.feed_time(F.col("published_at"), F.col("fetched_at"))
    return rows.select(
        "news_id", "source", "headline", "full_text", "url", "published_at", "fetched_at",
        joined("stocks"), "event_type", "sentiment", "impact_horizon", "suggestion",
        "confidence", "signal_score", "priority", "risk_level", joined("confidence_reasons"),
        "price_at_signal", "price_change_pct", "reasoning", "model_name",
        time_text(at).alias("feed_time"),
    )


@query
def feed_filtered(spark, sf):
    wanted = {"suggestion": "SELL", "source": "LiveMint", "event_type": "", "min_confidence": 0.7}
    return brief(loaded_feed(spark, sf, wanted), "event_type")


@query
def stock_history(spark, sf):
    """Partial match: LT.NS is also found within longer names."""
    return brief(feed.stock_history(*stored(spark, sf), "k.ns"))


@query
def signal_lookup(spark, sf):
    name = "EconomicTimes:https://news.example.com/7"
    return brief(
        feed.signal_by_id(*stored(spark, sf), str(uuid.uuid5(uuid.NAMESPACE_URL, name))),
        "headline",
    )


@query
def watchlist_feed(spark, sf):
    rows = positioned_feed(spark, sf).filter(feed.on_watchlist(["sbin.ns", " ITC.NS", "INFY.NS"]))
    return brief(rows, big("feed_pos"))


@query
def search_feed(spark, sf):
    return brief(positioned_feed(spark, sf).filter(feed.mentions(" Block DEAL ")), big("feed_pos"))


@query
def date_presets(spark, sf):
    """All signals, with the presets that each falls into."""
    at = samples.as_of() - F.expr("interval 20 hours")
    rows = rule_signals(spark, sf)
    return rows.select(
        "news_id",
        *[feed.in_dates(at, p).alias(f"in_{p}") for p in feed.PRESETS],
        feed.in_dates(at).alias("readable"),
        feed.in_dates(at, "last7", zone="Asia/Kolkata").alias("in_last7_kolkata"),
    ).select(
        "news_id", "readable",
        *[F.coalesce(f"in_{p}", F.lit(False)).alias(f"in_{p}") for p in feed.PRESETS],
        F.coalesce("in_last7_kolkata", F.lit(False)).alias("in_last7_kolkata"),
    )


@query
def date_custom(spark, sf):
    keep = feed.in_dates(samples.as_of(), "custom", "2024-01-10", "2024-01-20")
    rows = feed.matching(rule_signals(spark, sf), {"min_confidence": 0.6}).filter(keep)
    return brief(rows, "published_at")


def _sorted_query(mode: str) -> None:
    def ranked(spark, sf):
        shown = feed.explore(positioned_feed(spark, sf), samples.as_of(), sort=mode)
        rank = F.row_number().over(feed.Window.orderBy(*feed.sort_keys(mode)))
        return brief(shown.withColumn("rank", rank), big("rank"))

    ranked.__name__ = f"feed_sorted_{mode}"
    query(ranked)


for _mode in ("newest", "oldest", "score", "confidence", "priority"):
    _sorted_query(_mode)


@query
def day_groups(spark, sf):
    shown = feed.explore(positioned_feed(spark, sf), samples.as_of(), sort="newest")
    return feed.day_groups(shown).select(
        "news_id", "day_label", "starts_group", big("group_no"),
        tx.display_label(F.col("impact_horizon")).alias("horizon_label"),
    )


# --- summaries ---------------------------------------------------------------------

@query
def kpi_summary(spark, sf):
    return summary.kpis(response_signals(spark, sf))


@query
def dimension_counts(spark, sf):
    return summary.dimension_counts(response_signals(spark, sf))


@query
def client_summary(spark, sf):
    """Reader totals of the loaded feed under a confidence filter."""
    shown = feed.explore(
        positioned_feed(spark, sf), samples.as_of(), filters={"min_confidence": 0.7}
    )
    return summary.reader_kpis(shown)


@query
def client_dimension_counts(spark, sf):
    shown = feed.explore(
        positioned_feed(spark, sf), samples.as_of(), filters={"min_confidence": 0.7}
    )
    return summary.dimension_counts(shown, summary.READER_DIMENSIONS, default_level=None)


@query
def shown_of_total(spark, sf):
    keep = (F.col("confidence") >= 0.7) & feed.in_dates(samples.as_of(), "last30")
    return summary.shown_of_total(rule_signals(spark, sf), keep)


@query
def top_stocks(spark, sf):
    rows = response_signals(spark, sf)
    return summary.top_stocks(rows, summary.feed_order_values()).select(
        big("rank"), "ticker", "n", "share_pct"
    )


@query
def facets(spark, sf):
    return summary.facets(response_signals(spark, sf))


@query
def quote_tickers(spark, sf):
    order = summary.feed_order_values()
    rows = response_signals(spark, sf)
    return summary.first_seen_tickers(rows, order).select("ticker", big("pos"))


@query
def client_quote_tickers(spark, sf):
    order = summary.feed_order_values()
    rows = response_signals(spark, sf)
    return summary.first_seen_tickers(rows, order, only_exchange=True).select(
        "ticker", big("pos")
    )


@query
def action_queue(spark, sf):
    rows = response_signals(spark, sf)
    return brief(summary.action_queue(rows, summary.feed_order_values()))


@query
def action_queue_client(spark, sf):
    shown = feed.explore(positioned_feed(spark, sf), samples.as_of(), sort="oldest")
    return brief(summary.reader_action_queue(shown, feed.sort_keys("oldest")))


@query
def result_document(spark, sf):
    return summary.result_document(positioned_feed(spark, sf), samples.as_of())


@query
def stock_document(spark, sf):
    rows = feed.with_position(loaded_feed(spark, sf, {"stock": "TCS.NS"}))
    return summary.result_document(rows, samples.as_of(), "TCS.NS")


# --- prices ------------------------------------------------------------------------

@query
def daily_bars(spark, sf):
    """The last five bars of every ticker."""
    return prices.recent_bars(samples.prices(spark, sf), samples.as_of()).select(
        "ticker", F.col("day").cast("string").alias("day"), "close", "volume", big("n")
    )


@query
def quote_snapshot(spark, sf):
    order = summary.feed_order_values()
    asked = summary.first_seen_tickers(response_signals(spark, sf), order)
    rows = prices.quote_snapshot(asked, samples.prices(spark, sf), samples.as_of())
    return rows.select("ticker", "close", "change_pct", big("volume"), big("pos"))


@query
def price_at_signal(spark, sf):
    rows = prices.price_signals(
        response_signals(spark, sf), samples.prices(spark, sf), samples.as_of()
    )
    return rows.select(
        "news_id", joined("stocks"), "price_at_signal", "price_change_pct",
        time_text(F.col("price_checked_at")).alias("price_checked_at"),
    )


# --- keyed writes --------------------------------------------------------------------

def _old_and_new(spark, sf):
    """Stored signals (labelled documents; the price is missing where the label
    says toxic) and new signals of all documents but those labelled as bad."""
    every = rule_signals(spark, sf, "doc_id").withColumn(
        "price_at_signal", F.col("doc_id").cast("double")
    ).join(samples.stored_docs(spark, sf), "doc_id", "left")
    # Written once: both sides read it, some of them several times.
    every = cut(every.select("news_id", "suggestion", "confidence", "price_at_signal", "quality", "toxic"))
    old = every.filter("quality is not null").select(
        "news_id",
        F.lit("WATCH").alias("suggestion"),
        F.lit(0.5).alias("confidence"),
        F.when(F.col("toxic") == 0, F.lit(1.25)).alias("price_at_signal"),
    )
    return old, every.filter("quality is null or quality = 1").select(*old.columns)


@query
def upsert_ignore(spark, sf):
    old, new = _old_and_new(spark, sf)
    return old.unionByName(tables.insert_ignore(old, new, ["news_id"], "confidence"))


@query
def upsert_last(spark, sf):
    """Twice-written signals: the later version replaces the stored one."""
    old, new = _old_and_new(spark, sf)
    versions = new.withColumn("version", F.lit(1)).unionByName(
        new.withColumn("version", F.lit(2)).withColumn("confidence", F.lit(0.35))
    )
    return tables.upsert_last(
        old.withColumn("version", F.lit(0)), versions, ["news_id"], [F.desc("version")]
    ).withColumn("version", big("version"))


@query
def upsert_first_price(spark, sf):
    return tables.upsert_signals(*_old_and_new(spark, sf))


@query
def referenced_signals(spark, sf):
    """Signals left when only the labelled news are."""
    news = samples.news(spark, sf, "doc_id").join(
        samples.stored_docs(spark, sf), "doc_id", "left_semi"
    )
    return tables.with_news(rule_signals(spark, sf), news).select("news_id", "suggestion")


@query
def schema_evolve(spark, sf):
    old, _ = _old_and_new(spark, sf)
    rows = tables.evolve(old, schemas.SIGNALS)
    return rows.select(
        "news_id", "suggestion", "confidence", "price_at_signal", "signal_score", "priority",
        "risk_level", "price_change_pct",
    )


# --- alerts ----------------------------------------------------------------------------

def _alert_log(spark, sf):
    """Alerts sent earlier: for all labelled documents of good quality."""
    return (
        samples.news(spark, sf, "doc_id")
        .join(samples.stored_docs(spark, sf).filter("quality = 1"), "doc_id")
        .select(
            "news_id", F.lit("local").alias("channel"), F.lit("recorded").alias("status"),
            F.concat(F.lit("earlier: "), "headline").alias("message"),
            F.timestamp_seconds(
                F.unix_seconds(samples.as_of()) - F.col("doc_id") % 86400
            ).alias("sent_at"),
        )
    )


def _log_rows(rows):
    return rows.withColumn("sent_at", time_text(F.col("sent_at")))


@query
def alerts_new(spark, sf):
    """Due on two channels, of which the log knows one."""
    due = cut(response_signals(spark, sf).filter(alerts.should_alert()))
    log = _alert_log(spark, sf)
    rows = [alerts.new_alerts(due, log, samples.as_of(), channel) for channel in ("local", "webhook")]
    return rows[0].unionByName(rows[1]).select("news_id", "channel", "status")


@query
def alerts_outbox(spark, sf):
    """Alerts of one batch on two channels, delivered twice; one hook dies after it has sent."""
    folder = _run_folder(spark)
    store = tables.Store(spark, folder).create("alert_log", "outbox")
    due = cut(response_signals(spark, sf).filter(alerts.should_alert()))
    none = spark.createDataFrame([], schemas.ALERTS)
    handed = f"{folder}/handed"
    none.select("news_id", "channel").write.parquet(handed)

    def hook(dies: bool):
        def send(rows):
            rows.select("news_id", "channel").write.mode("append").parquet(handed)
            if dies:
                raise ConnectionError("no answer")
            return rows.withColumn("status", F.lit("sent"))
        return send

    for channel, dies in (("webhook", False), ("telegram", True)):
        rows = alerts.new_alerts(due, none, samples.as_of(), channel)
        for _ in range(2):
            try:
                outbox.deliver_once(store, rows, channel, hook(dies), "batch")
            except ConnectionError:
                pass
    got = spark.read.parquet(handed).groupBy("news_id", "channel").agg(F.count("*").alias("n_handed"))
    return store.read("alert_log").join(got, ["news_id", "channel"], "left").select("news_id", "channel", "status", "n_handed")


@query
def alert_messages(spark, sf):
    none = spark.createDataFrame([], schemas.ALERTS)
    return _log_rows(alerts.new_alerts(response_signals(spark, sf), none, samples.as_of()))


@query
def notification_html(spark, sf):
    return response_signals(spark, sf).select(
        "news_id", alerts.notification_html().alias("message")
    )


@query
def alert_log_top(spark, sf):
    return _log_rows(alerts.newest_alerts(_alert_log(spark, sf)))


# --- runs ------------------------------------------------------------------------------

def _feed_run(spark, sf, store, times: int = 1) -> None:
    """One batch over all feed entries, run ``times`` times. Each page is delivered twice,
    the second time some come without a source."""
    entries = samples.feed_entries(spark, sf)
    nameless = F.when(F.pmod("pos", F.lit(31)) == 0, F.lit(None)).otherwise(F.col("source"))
    again = entries.withColumn("source", nameless).withColumn("pos", F.col("pos") + 1_000_000_000)
    settings = run.Settings(feeds=samples.feeds(spark), bars=samples.prices(spark, sf), limit=None)
    for _ in range(times):
        run.run_batch(spark, store, entries.unionByName(again), settings, samples.as_of(), "feed-batch")


@query
def run_stats(spark, sf):
    """What a run logs about itself."""
    store = tables.Store(spark, _run_folder(spark)).create()
    _feed_run(spark, sf, store)
    return store.read("run_log").select(*run.COUNTS, "status")


@query
def run_twice(spark, sf):
    """The news of a batch that was run twice, with what other tables hold of each."""
    store = tables.Store(spark, _run_folder(spark)).create()
    _feed_run(spark, sf, store, times=2)
    rows = store.read("news_raw")
    for name, column in (("signals", "n_signals"), ("news_keys", "n_keys")):
        rows = rows.join(store.read(name).groupBy("news_id").agg(F.count("*").alias(column)), "news_id", "left")
    return rows.select("news_id", "source", "headline", "full_text", "url", "published_at", "n_signals", "n_keys")


DROPS = 3


def _documents_stream(spark, sf, folder):
    """The documents as four landed drops, one per micro-batch; the last brings the labelled ones again.

    A drop is as many files as there are cores, so that each is written and read by all of them.
    """
    files = spark.sparkContext.defaultParallelism
    docs = samples.table(spark, sf, "documents")

    def land(rows: DataFrame) -> None:
        rows.repartition(files).sortWithinPartitions("doc_id").write.mode("append").parquet(f"{folder}/landed")

    for drop in range(DROPS):
        land(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(DROPS)) == drop))
    known = samples.stored_docs(spark, sf).select("doc_id")
    land(docs.join(known, "doc_id", "left_semi"))
    return spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/landed")


def _run_folder(spark) -> str:
    """A new folder next to the checkpoints, which all machines share."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/run-{uuid.uuid4()}"


@query
def stream_signals(spark, sf):
    """Signals of the documents as a stream: new ids only, batch by batch."""
    folder = _run_folder(spark)
    store = tables.Store(spark, folder).create("signals", "news_keys")

    def each(batch, number):
        batch_id = f"stream-{number}"
        news = samples.news_of(batch)
        new = ingest.unseen(ingest.first_per_id(news, "url"), store.known_keys(news, batch_id))
        rows = scoring.score_signals(
            extract.settle_tickers(extract.extract_by_rules(new)), samples.as_of()
        )
        day = tables.news_day(F.col("published_at"), F.col("fetched_at"))
        store.write(
            "signals",
            tables.evolve(rows.withColumn("day", day), schemas.SIGNALS),
            batch_id,
        )
        store.add_keys(store.read("signals", batch_id), batch_id)

    refresh.each_batch(
        _documents_stream(spark, sf, folder), each, f"{folder}/checkpoint", once=True
    ).awaitTermination()
    return store.read("signals").select(
        "news_id", joined("stocks"), "suggestion", "confidence", "signal_score", "priority"
    )


def _scored_stream(spark, sf, folder):
    news = samples.with_response(samples.news_of(_documents_stream(spark, sf, folder), "doc_id"))
    rows = extract.normalize_responses(news).drop("raw_response", "origin", "doc_id")
    return scoring.score_signals(extract.settle_tickers(rows), samples.as_of(), "responses")


@query
def stream_alerts_once(spark, sf):
    """Streaming alert rule with each id announced a single time."""
    folder = _run_folder(spark)
    rows = _scored_stream(spark, sf, folder)
    time = F.coalesce(vl.feed_time(F.col("published_at"), F.col("fetched_at")), samples.as_of())
    once = refresh.announce_once(rows.withColumn("seen_at", time), "seen_at", "60 days").select(
        "news_id", alerts.alert_message().alias("message"))
    refresh.to_files(once, f"{folder}/out", f"{folder}/checkpoint", once=True).awaitTermination()
    return spark.read.schema("news_id string, message string").parquet(f"{folder}/out")


@query
def stream_alerts_expiring(spark, sf):
    """The same with a state that forgets an id after a day."""
    folder = _run_folder(spark)
    once = refresh.announce_while(_scored_stream(spark, sf, folder), alerts.alert_message(), 86400)
    refresh.to_files(once, f"{folder}/out", f"{folder}/checkpoint", once=True,
                     state_parts=spark.sparkContext.defaultParallelism).awaitTermination()
    return spark.read.schema("news_id string, message string").parquet(f"{folder}/out")
