"""Served views of the signals: filters, sort orders, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom import lexicon as lx
from newsloom.functions import text as tx
from newsloom.functions import values as vl
from newsloom.schemas import SIGNAL_VIEW

EQUALITY_FIELDS = (
    "event_type", "sentiment", "suggestion", "source", "priority", "risk_level"
)
NEWS_COLUMNS = SIGNAL_VIEW[:7]


def newest_first(published: str = "published_at", fetched: str = "fetched_at") -> list[Column]:
    """Feed order: newest first, rows without a readable time last."""
    return [
        vl.feed_time(F.col(published), F.col(fetched)).desc_nulls_last(), F.asc("news_id")
    ]


def with_defaults(rows: DataFrame) -> DataFrame:
    """Nulls of the stored form as a reader sees them; prices stay null."""
    empty = F.array().cast("array<string>")
    return (
        rows.withColumn("stocks", vl.clean_tickers(F.col("stocks")))
        .withColumn("confidence_reasons", F.coalesce("confidence_reasons", empty))
        .withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
        .withColumn("signal_score", F.coalesce("signal_score", F.lit(0.0)))
    )


def stock_contains(argument: str) -> Column:
    """Partial, case-blind match on the stored list text; % and _ are wildcards."""
    return vl.spaced_array_text(F.coalesce("stocks", F.array().cast("array<string>"))).ilike(
        f"%{argument}%"
    )


def has_stock(ticker: str) -> Column:
    return F.array_contains("stocks", ticker)


def matching(rows: DataFrame, filters: dict | None = None) -> DataFrame:
    """Apply the given filters; empty values are off.

    Keys: the equality fields, ``min_confidence``, ``stock`` (partial match)
    and ``ticker`` (exact match).
    """
    for name, value in (filters or {}).items():
        if value in (None, ""):
            continue
        if name in EQUALITY_FIELDS:
            rows = rows.filter(F.col(name) == value)
        elif name == "min_confidence":
            rows = rows.filter(F.col("confidence") >= float(value))
        elif name == "stock":
            rows = rows.filter(stock_contains(value))
        elif name == "ticker":
            rows = rows.filter(has_stock(value))
    return rows


def load_signals(
    news: DataFrame,
    signals: DataFrame,
    filters: dict | None = None,
    limit: int | None = lx.FEED_LIMIT,
) -> DataFrame:
    """The newest signals with their news, filtered before the limit.

    With a limit the texts are fetched late: filters, order and limit run on
    the signals and the narrow news columns, and the news table is read a second
    time only for the at most ``limit`` ids that won, which is what makes the
    broadcast of them safe. The wide text never goes through a shuffle.
    """
    if limit is None:
        rows = news.select(*NEWS_COLUMNS).join(signals, "news_id")
        return with_defaults(matching(rows, filters)).select(*SIGNAL_VIEW)
    narrow = news.select("news_id", "source", "published_at", "fetched_at")
    top = (
        matching(narrow.join(signals, "news_id"), filters)
        .orderBy(*newest_first())
        .limit(limit)
        .drop("source", "published_at", "fetched_at")
    )
    rows = news.select(*NEWS_COLUMNS).join(top, "news_id")
    return with_defaults(rows).select(*SIGNAL_VIEW).orderBy(*newest_first())


def signal_by_id(news: DataFrame, signals: DataFrame, news_id: str) -> DataFrame:
    """Point lookup; the filter reaches both scans."""
    one = F.col("news_id") == news_id
    rows = news.select(*NEWS_COLUMNS).filter(one).join(signals.filter(one), "news_id")
    return with_defaults(rows).select(*SIGNAL_VIEW)


def stock_history(news: DataFrame, signals: DataFrame, ticker: str, **kwargs) -> DataFrame:
    return load_signals(news, signals, {"stock": ticker.upper()}, **kwargs)


def with_position(feed: DataFrame) -> DataFrame:
    """Add ``feed_pos``. For a limited feed only: it numbers rows in one task."""
    return feed.withColumn("feed_pos", F.row_number().over(Window.orderBy(*newest_first())))


# --- reader-side filters, on a loaded feed -------------------------------------


def on_watchlist(tickers) -> Column:
    wanted = F.array(*[F.lit(t.strip().upper()) for t in tickers if t.strip()])
    return F.arrays_overlap(F.transform("stocks", F.upper), wanted)


def mentions(search: str) -> Column:
    fields = (
        "headline", "source", "reasoning", "event_type", "sentiment", "suggestion",
        "priority", "risk_level",
    )
    line = tx.haystack(*[F.col(f) for f in fields], stocks=F.col("stocks"))
    return F.contains(line, F.lit(search.strip().lower()))


# First and last day of each preset, relative to today.
PRESETS = {"today": (0, 0), "yesterday": (-1, -1), "last7": (-6, 0), "last30": (-29, 0)}


def in_dates(
    as_of: Column,
    preset: str | None = None,
    from_day: str | None = None,
    to_day: str | None = None,
    zone: str = "UTC",
) -> Column:
    """Whole days in the reader's time zone. A preset ignores from and to; a row
    whose time cannot be read never passes, not even without any limit."""
    ts = vl.signal_time(F.col("published_at"), F.col("fetched_at"))
    keep = ts.isNotNull()

    def midnight(day: Column) -> Column:
        return F.to_utc_timestamp(day.cast("timestamp"), zone)

    if preset in PRESETS:
        first, last = PRESETS[preset]
        today = F.to_date(F.from_utc_timestamp(as_of, zone))
        return (
            keep
            & (ts >= midnight(F.date_add(today, first)))
            & (ts < midnight(F.date_add(today, last + 1)))
        )
    if from_day:
        keep = keep & (ts >= midnight(F.lit(from_day).cast("date")))
    if to_day:
        keep = keep & (ts < midnight(F.date_add(F.lit(to_day).cast("date"), 1)))
    return keep


def sort_keys(mode: str = "newest") -> list[Column]:
    """Sort orders of the reader; ``feed_pos`` keeps ties in feed order."""
    ts = vl.signal_time(F.col("published_at"), F.col("fetched_at"))
    size = F.abs("signal_score")
    rank = priority_rank()
    keys = {
        "newest": [ts.desc()],
        "oldest": [ts.asc()],
        "score": [size.desc()],
        "confidence": [F.desc("confidence")],
        "priority": [rank.desc(), size.desc(), F.desc("confidence"), ts.desc()],
    }
    return [*keys[mode], F.asc("feed_pos")]


def priority_rank() -> Column:
    p = F.col("priority")
    return F.when(p == "HIGH", 3).when(p == "MEDIUM", 2).when(p == "LOW", 1).otherwise(0)


def explore(
    feed: DataFrame,
    as_of: Column,
    search: str = "",
    watchlist=(),
    filters: dict | None = None,
    preset: str | None = None,
    from_day: str | None = None,
    to_day: str | None = None,
    zone: str = "UTC",
    sort: str = "newest",
) -> DataFrame:
    """Filter and sort a loaded feed (with ``feed_pos``) as its reader asks."""
    rows = matching(feed, filters).filter(in_dates(as_of, preset, from_day, to_day, zone))
    if search.strip():
        rows = rows.filter(mentions(search))
    if any(t.strip() for t in watchlist):
        rows = rows.filter(on_watchlist(watchlist))
    return rows.orderBy(*sort_keys(sort))


def day_groups(shown: DataFrame, sort: str = "newest") -> DataFrame:
    """Mark rows that start a new day in the current order, and number the
    groups. For a loaded feed: the order is a single sequence."""
    order = Window.orderBy(*sort_keys(sort))
    label = vl.day_label(
        vl.parse_iso(F.coalesce(vl.filled(F.col("published_at")), vl.filled(F.col("fetched_at"))))
    )
    rows = shown.withColumn("day_label", label).withColumn(
        "starts_group",
        ~F.col("day_label").eqNullSafe(F.lag("day_label").over(order)),
    )
    return rows.withColumn("group_no", F.sum(F.col("starts_group").cast("int")).over(order))
