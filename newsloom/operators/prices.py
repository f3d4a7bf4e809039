"""Quotes from daily bars, and the price at the time of a signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom import lexicon as lx
from newsloom.functions import values as vl


HISTORY_DAYS = 7          # five trading days


def recent_bars(prices: DataFrame, as_of: Column, days: int = 5, history_days: int = HISTORY_DAYS) -> DataFrame:
    """The last ``days`` bars per ticker of the ``history_days`` up to ``as_of``; ``n`` is 1 for
    the latest. A ticker with older bars only has none. Both bounds reach the
    scan; rows past ``days`` are dropped in each task before the shuffle."""
    newest = Window.partitionBy("ticker").orderBy(F.desc("day"))
    return (
        prices.filter((F.col("day") <= F.to_date(as_of)) & (F.col("day") > F.date_sub(F.to_date(as_of), history_days)))
        .withColumn("n", F.row_number().over(newest))
        .filter(F.col("n") <= days)
    )


def quotes(prices: DataFrame, as_of: Column) -> DataFrame:
    """Last close, change against the bar before (0 for a single bar), volume."""
    bars = recent_bars(prices, as_of, 2)
    last = F.max(F.when(F.col("n") == 1, F.col("close")))
    previous = F.max(F.when(F.col("n") == 2, F.col("close")))
    volume = F.max(F.when(F.col("n") == 1, F.col("volume")))
    return bars.groupBy("ticker").agg(
        F.round(vl.exact(last), 2).cast("double").alias("close"),
        vl.percent_change(last, F.coalesce(previous, last)).alias("change_pct"),
        F.coalesce(volume, F.lit(0)).alias("volume"),
    )


def quote_snapshot(
    requested: DataFrame, prices: DataFrame, as_of: Column, limit: int = lx.QUOTE_LIMIT
) -> DataFrame:
    """Quotes of the first ``limit`` requested tickers (``ticker, pos``).

    The list is cut before tickers that are not tradable or have no bars drop out.
    """
    listed = requested.orderBy("pos").limit(limit).filter(vl.is_tradable(F.col("ticker")))
    return (
        listed.join(quotes(prices, as_of), "ticker")
        .withColumn("checked_at", as_of)
        .select("pos", "ticker", "close", "change_pct", "volume", "checked_at")
    )


def price_signals(
    signals: DataFrame, prices: DataFrame, as_of: Column, first: int = lx.SIGNAL_QUOTES
) -> DataFrame:
    """Attach the quote of the first of the first four tickers that has one.

    One left join per list position on the quote table, which has one row per
    ticker: while Spark measures it as small it is broadcast (built once, used
    four times) and the signals are not shuffled at all; a larger one is
    joined by shuffle, where adaptive execution splits a hot ticker.
    """
    table = quotes(prices, as_of).select(
        F.col("ticker").alias("_t"), F.struct("close", "change_pct").alias("_q")
    )
    out = signals
    for i in range(first):
        ticker = F.get("stocks", F.lit(i))
        side = table.select(F.col("_t").alias(f"_t{i}"), F.col("_q").alias(f"_q{i}"))
        out = out.join(
            side, F.when(vl.is_tradable(ticker), ticker) == F.col(f"_t{i}"), "left"
        )
    quote = F.coalesce(*[F.col(f"_q{i}") for i in range(first)])
    helpers = [f"_{c}{i}" for i in range(first) for c in "tq"]
    return (
        out.withColumn("price_at_signal", quote["close"])
        .withColumn("price_checked_at", F.when(quote.isNotNull(), as_of))
        .withColumn("price_change_pct", quote["change_pct"])
        .drop(*helpers)
    )
