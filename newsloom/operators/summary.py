"""Counts, averages and top lists over signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom import lexicon as lx
from newsloom.functions import values as vl
from newsloom.session import cut

SERVER_DIMENSIONS = {
    "suggestions": "suggestion", "sentiments": "sentiment", "event_types": "event_type",
    "priorities": "priority", "risks": "risk_level",
}
READER_DIMENSIONS = {k: v for k, v in SERVER_DIMENSIONS.items() if k != "sentiments"}
FACETS = ("event_type", "sentiment", "suggestion", "priority", "risk_level")


def _rounded_mean(col: Column, places: int) -> Column:
    """Mean of an exact column, half up; 0 without rows."""
    scale = 10**places
    total = F.coalesce(F.sum(col), F.lit(0))
    n = F.count("*")
    units = F.call_function("div", total * F.lit(2 * scale) + n, n * F.lit(2))
    return F.when(n > 0, units / F.lit(float(scale))).otherwise(F.lit(0.0))


def kpis(signals: DataFrame) -> DataFrame:
    """Server totals in one row."""

    def how_many(column: str, value: str) -> Column:
        return F.count_if(F.col(column) == value)

    return signals.agg(
        F.count("*").alias("total"),
        how_many("suggestion", "BUY").alias("buy"),
        how_many("suggestion", "SELL").alias("sell"),
        how_many("suggestion", "WATCH").alias("watch"),
        how_many("suggestion", "HOLD").alias("hold"),
        _rounded_mean(vl.exact(F.col("confidence")), 2).alias("avg_confidence"),
        _rounded_mean(F.abs(vl.exact(F.col("signal_score"))), 1).alias("avg_score"),
        how_many("priority", "HIGH").alias("high_priority"),
    )


def reader_kpis(signals: DataFrame) -> DataFrame:
    """Reader totals: averages are not rounded, watch and hold not counted."""
    n = F.count("*")

    def mean(col: Column) -> Column:
        return F.when(n > 0, F.sum(col).cast("double") / n).otherwise(F.lit(0.0))

    return signals.agg(
        n.alias("total"),
        F.count_if(F.col("suggestion") == "BUY").alias("buy"),
        F.count_if(F.col("suggestion") == "SELL").alias("sell"),
        F.count_if(F.col("priority") == "HIGH").alias("high_priority"),
        mean(vl.exact(F.col("confidence"))).alias("avg_confidence"),
        mean(F.abs(vl.exact(F.col("signal_score")))).alias("avg_score"),
    )


def dimension_counts(
    signals: DataFrame, dimensions=SERVER_DIMENSIONS, default_level: str | None = "LOW"
) -> DataFrame:
    """``(dimension, value, n)`` for all dimensions in one pass.

    Rows are unpivoted in the map task and counted there before the shuffle,
    which carries a handful of rows per task.
    """
    levels = ("priority", "risk_level")

    def value(column: str) -> Column:
        col = F.col(column)
        if column in levels and default_level is not None:
            return F.coalesce(vl.filled(col), F.lit(default_level))
        return col

    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("dimension"), value(column).alias("value"))
            for name, column in dimensions.items()
        ]
    )
    return (
        signals.select(F.explode(pairs).alias("p"))
        .groupBy("p.dimension", "p.value")
        .agg(F.count("*").alias("n"))
    )


def facets(signals: DataFrame) -> DataFrame:
    """Distinct non-empty values per filter field, for sorted pick lists."""
    pairs = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FACETS]
    )
    return (
        signals.select(F.explode(pairs).alias("p"))
        .select("p.field", "p.value")
        .filter(F.coalesce(F.col("value"), F.lit("")) != "")
        .distinct()
    )


def mention_counts(signals: DataFrame, order: list[Column]) -> DataFrame:
    """Mentions per ticker and where it was seen first.

    ``order`` are ascending sort values of a row; comparing them avoids
    numbering all rows. Both aggregates combine in the map tasks.
    """
    return (
        signals.select(
            F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("_at"),
            F.posexplode("stocks").alias("_pos", "ticker"),
        )
        .groupBy("ticker")
        .agg(F.count("*").alias("n"), F.min(F.struct("_at", "_pos")).alias("first_seen"))
    )


def feed_order_values() -> list[Column]:
    """Feed order as ascending values: unread times last, newest first, id."""
    ts = vl.feed_time(F.col("published_at"), F.col("fetched_at"))
    return [ts.isNull(), -F.unix_seconds(ts), F.col("news_id")]


def top_stocks(
    signals: DataFrame, order: list[Column], size: int = lx.TOP_STOCKS
) -> DataFrame:
    """Most mentioned tickers, ties by first mention, with the share of the
    largest count in whole percent."""
    top = mention_counts(signals, order).orderBy(F.desc("n"), "first_seen").limit(size)
    rank = Window.orderBy(F.desc("n"), "first_seen")        # at most ``size`` rows
    most = F.greatest(F.max("n").over(Window.partitionBy(F.lit(1))), F.lit(1))
    share = F.call_function("div", F.col("n") * F.lit(200) + most, most * F.lit(2))
    return top.select(
        F.row_number().over(rank).alias("rank"), "ticker", "n", share.alias("share_pct")
    )


def first_seen_tickers(
    signals: DataFrame,
    order: list[Column],
    size: int = lx.QUOTE_LIST,
    only_exchange: bool = False,
) -> DataFrame:
    """The first distinct tickers in feed order: ``ticker, pos``. The reader's
    variant takes exchange tickers only, before the cut."""
    counts = mention_counts(signals, order)
    if only_exchange:
        counts = counts.filter(F.endswith("ticker", F.lit(".NS")))
    first = counts.orderBy("first_seen").limit(size)
    return first.select(
        "ticker", F.row_number().over(Window.orderBy("first_seen")).alias("pos")
    )


def actionable() -> Column:
    return F.col("suggestion").isin("BUY", "SELL")


def action_queue(
    signals: DataFrame, order: list[Column], size: int = lx.QUEUE_SIZE
) -> DataFrame:
    """Strongest actionable signals: high priority first, then score, confidence."""
    keys = [
        F.coalesce(F.col("priority") == "HIGH", F.lit(False)).desc(),
        F.abs("signal_score").desc(), F.desc("confidence"), *[c.asc() for c in order],
    ]
    return signals.filter(actionable()).orderBy(*keys).limit(size)


def reader_action_queue(shown: DataFrame, sort: list[Column], size: int = lx.QUEUE_SIZE) -> DataFrame:
    """Actionable signals by score; ties keep the order on screen."""
    return shown.filter(actionable()).orderBy(F.abs("signal_score").desc(), *sort).limit(size)


def shown_of_total(feed: DataFrame, keep: Column) -> DataFrame:
    return feed.agg(F.count_if(keep).alias("shown"), F.count("*").alias("total"))


def result_document(feed: DataFrame, as_of: Column, ticker: str | None = None) -> DataFrame:
    """One JSON text ``{signals, summary}`` of a loaded (limited) feed, for one ticker
    with its name. The feed is evaluated once; every part reads its written rows."""
    feed = cut(feed)
    order = [F.col("feed_pos")]
    signal = F.struct(*[c for c in feed.columns if c != "feed_pos"])

    def in_order(rows: DataFrame, place: Column, value: Column, name: str) -> DataFrame:
        pair = F.struct(place, value.alias("value"))
        return rows.agg(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["value"]).alias(name))

    counts = dimension_counts(feed).groupBy().agg(*[
        F.map_from_entries(F.array_sort(F.collect_list(
            F.when(F.col("dimension") == name, F.struct("value", "n"))))).alias(name)
        for name in SERVER_DIMENSIONS
    ])
    queue = action_queue(feed, order)
    strength = F.struct(
        (F.coalesce(F.col("priority"), F.lit("")) != "HIGH").alias("o0"), (-F.abs("signal_score")).alias("o1"),
        (-F.col("confidence")).alias("o2"), F.col("feed_pos").alias("o3")).alias("place")
    parts = [
        in_order(feed, F.col("feed_pos").alias("place"), signal, "signals"),
        kpis(feed), counts,
        in_order(top_stocks(feed, order), F.col("rank").alias("place"), F.struct("ticker", "n"), "top_stocks"),
        in_order(queue, strength, signal, "action_queue"),
    ]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, how="cross")          # one row each
    summary = F.struct(
        *[c for p in parts[1:] for c in p.columns],
        F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"),
    ).alias("summary")
    head = [F.lit(ticker.upper()).alias("ticker")] if ticker else []
    return joined.select(F.to_json(F.struct(*head, "signals", summary)).alias("document"))
