"""What a reader of the store asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators import alerts, feed, ingest, prices, summary
from newsloom.sources.tables import Store


def signals(store: Store, filters: dict | None = None, **kwargs) -> DataFrame:
    return feed.load_signals(store.read("news_raw"), store.read("signals"), filters, **kwargs)


def stock(store: Store, ticker: str) -> DataFrame:
    return signals(store, {"stock": ticker.upper()})


def dashboard(store: Store, filters: dict | None = None, as_of: Column | None = None) -> DataFrame:
    """The ``{signals, summary}`` document of the newest signals."""
    as_of = F.current_timestamp() if as_of is None else as_of
    return summary.result_document(feed.with_position(signals(store, filters)), as_of)


def stock_document(store: Store, ticker: str, as_of: Column | None = None) -> DataFrame:
    """The same of one ticker, with its name."""
    as_of = F.current_timestamp() if as_of is None else as_of
    return summary.result_document(feed.with_position(stock(store, ticker)), as_of, ticker)


def quote_list(store: Store, bars: DataFrame, as_of: Column, tickers: list[str] | None = None):
    """Quotes of the given tickers, or of those first seen in the feed."""
    asked = [t.strip().upper() for t in tickers or [] if t.strip()]
    if asked:
        listed = store.spark.createDataFrame(
            list(zip(asked, range(1, len(asked) + 1))), "ticker string, pos int"
        )
    else:
        order = summary.feed_order_values()
        listed = summary.first_seen_tickers(signals(store), order)
    return prices.quote_snapshot(listed, bars, as_of)


def health(store: Store) -> DataFrame:
    return ingest.by_source(store.read("source_health"))


def alert_log(store: Store) -> DataFrame:
    return alerts.newest_alerts(store.read("alert_log"))


def facets(store: Store) -> DataFrame:
    return summary.facets(signals(store)).orderBy("field", "value")


def export(store: Store, path: str, filters: dict | None = None) -> None:
    """Write the served signals as JSON lines."""
    signals(store, filters).write.mode("overwrite").json(path)
