"""Which signals to announce, the messages, and announcing each only once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import lexicon as lx
from newsloom.functions import text as tx
from newsloom.functions import values as vl


def should_alert(min_score: float = lx.ALERT_SCORE) -> Column:
    return (
        (F.col("priority") == "HIGH")
        & F.col("suggestion").isin("BUY", "SELL")
        & (F.abs(F.coalesce("signal_score", F.lit(0.0))) >= min_score)
    )


def alert_message() -> Column:
    return F.concat(
        F.col("suggestion"), F.lit(" "), F.array_join("stocks", ", "),
        F.lit(" score "), F.col("signal_score").cast("string"),
        F.lit(" confidence "), F.col("confidence").cast("string"),
        F.lit(": "), F.col("headline"),
    )


def notification_html(title: str = "New Signal", limit: int = lx.MESSAGE_CHARS) -> Column:
    """The full message: one line per field, escaped, cut at ``limit``."""

    def shown(name: str, default: str) -> Column:
        return tx.escape_html(F.coalesce(F.col(name), F.lit(default)))

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"<b>{label}:</b> "), value)

    def number(name: str, pattern: str) -> Column:
        return F.format_string(pattern, F.coalesce(name, F.lit(0.0)))

    when = F.coalesce(vl.filled(F.col("published_at")), F.col("fetched_at"), F.lit(""))
    stocks = F.coalesce(vl.filled(F.array_join("stocks", ", ")), F.lit("No tradable ticker"))
    notes = F.array_join(
        F.transform(
            F.slice("confidence_reasons", 1, 4),
            lambda r: F.concat(F.lit("- "), tx.escape_html(r)),
        ),
        "\n",
    )
    lines = [
        F.lit(f"<b>{title}</b>"),
        line("Headline", shown("headline", "")),
        line("Source", shown("source", "")),
        line("Published", tx.escape_html(when)),
        line("Stocks", tx.escape_html(stocks)),
        line("Suggestion", shown("suggestion", "WATCH")),
        line("Sentiment", shown("sentiment", "NEUTRAL")),
        line("Event", shown("event_type", "PRICE_ACTION")),
        line("Horizon", shown("impact_horizon", "SHORT_TERM")),
        line("Priority", shown("priority", "MEDIUM")),
        line("Risk", shown("risk_level", "MEDIUM")),
        line("Confidence", number("confidence", "%.2f")),
        line("Action Score", number("signal_score", "%.1f")),
        line("Reasoning", shown("reasoning", "")),
        F.lit("<b>Confidence Notes:</b>"),
        F.coalesce(vl.filled(notes), F.lit("- No extra confidence notes")),
        F.when(
            F.coalesce("url", F.lit("")) != "", line("Link", tx.escape_html(F.col("url")))
        ),
    ]
    return F.substring(F.array_join(F.array_compact(F.array(*lines)), "\n"), 1, limit)


def not_yet_sent(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Rows whose ``(news_id, channel)`` is not in the log."""
    return rows.join(log.select("news_id", "channel"), ["news_id", "channel"], "left_anti")


def new_alerts(
    signals: DataFrame,
    log: DataFrame,
    as_of: Column,
    channel: str = "local",
    status: str = "recorded",
) -> DataFrame:
    """Alert-log rows for signals that pass the rule and were not logged yet.

    ``signals`` is the served view (it has the headline).
    """
    due = signals.filter(should_alert()).withColumn("channel", F.lit(channel))
    return not_yet_sent(due, log).select(
        "news_id", "channel", F.lit(status).alias("status"),
        alert_message().alias("message"), as_of.alias("sent_at"),
    )


def new_notifications(
    signals: DataFrame,
    log: DataFrame,
    as_of: Column,
    channel: str = "telegram",
    status: str = "recorded",
    title: str = "New Signal",
) -> DataFrame:
    """The same for the full message, which goes out for every new signal."""
    due = signals.withColumn("channel", F.lit(channel))
    return not_yet_sent(due, log).select(
        "news_id", "channel", F.lit(status).alias("status"),
        notification_html(title).alias("message"), as_of.alias("sent_at"),
    )


def newest_alerts(log: DataFrame, limit: int = lx.ALERT_LIMIT) -> DataFrame:
    return log.orderBy(F.desc("sent_at"), "news_id", "channel").limit(limit)
