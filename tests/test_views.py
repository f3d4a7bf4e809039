from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.operators import alerts, feed, prices, summary
from newsloom.sources import tables


def signals(rows, *items):
    """Served rows from (news_id, stocks, suggestion, priority, confidence, published)."""
    ddl = ("news_id string, stocks array<string>, suggestion string, priority string, "
           "confidence double, published_at string")
    score = F.col("confidence") * 100 * F.when(F.col("suggestion") == "SELL", -1).otherwise(1)
    return (
        rows(ddl, list(items))
        .withColumn("signal_score", F.round(score, 1))
        .withColumn("fetched_at", F.lit(None).cast("string"))
        .withColumn("sentiment", F.lit("NEUTRAL")).withColumn("event_type", F.lit("MACRO"))
        .withColumn("risk_level", F.lit(None).cast("string"))
    )


def ids(df):
    return [r["news_id"] for r in df.collect()]


def test_stock_filters(rows):
    df = signals(rows, ("1", ["LT.NS"], "BUY", "HIGH", 0.9, None),
                 ("2", ["ABCLT.NS"], "BUY", "HIGH", 0.9, None), ("3", [], "BUY", "HIGH", 0.9, None),
                 ("4", ["A", "B"], "BUY", "HIGH", 0.9, None))
    assert ids(feed.matching(df, {"stock": "lt.ns"})) == ["1", "2"]
    assert ids(feed.matching(df, {"ticker": "LT.NS"})) == ["1"]
    assert ids(feed.matching(df, {"stock": "%C_T"})) == ["2"]
    assert ids(feed.matching(df, {"stock": 'A", "B'})) == ["4"]
    assert len(ids(feed.matching(df, {"stock": "", "min_confidence": None}))) == 4


def test_date_filter_edges(rows):
    at = F.lit("2024-01-10 12:00:00").cast("timestamp")
    times = ["2024-01-10T00:00:00Z", "2024-01-09T23:59:59.999999Z", "2024-01-10T23:59:59.999999Z",
             "2024-01-11T00:00:00Z", "n/a", None]
    df = signals(rows, *[(str(i), [], "BUY", "LOW", 0.5, t) for i, t in enumerate(times)])
    assert ids(df.filter(feed.in_dates(at, "today"))) == ["0", "2"]
    assert ids(df.filter(feed.in_dates(at, "yesterday"))) == ["1"]
    assert ids(df.filter(feed.in_dates(at))) == ["0", "1", "2", "3", "5"]
    assert ids(df.filter(feed.in_dates(at, None, "2024-01-10", "2024-01-10"))) == ["0", "2"]
    assert ids(df.filter(feed.in_dates(at, "custom", None, "2024-01-09"))) == ["1", "5"]
    assert ids(df.filter(feed.in_dates(at, "last7", "2030-01-01"))) == ["0", "1", "2"]


def test_summaries(rows):
    none = signals(rows, ("1", [], "BUY", "LOW", 0.5, None)).filter("false")
    row = summary.kpis(none).head().asDict()
    assert set(row.values()) == {0}
    assert summary.reader_kpis(none).head()["avg_score"] == 0.0
    df = signals(rows, ("1", ["B", "A"], "BUY", None, 0.85, "2024-01-03"),
                 ("2", ["A", "B"], "SELL", "HIGH", 0.9, "2024-01-02"),
                 ("3", ["C"], "WATCH", "HIGH", 0.7, "bad"))
    row = summary.kpis(df).head()
    assert (row["avg_confidence"], row["avg_score"], row["high_priority"]) == (0.82, 81.7, 2)
    counts = {(r["dimension"], r["value"]): r["n"] for r in summary.dimension_counts(df).collect()}
    assert counts["priorities", "LOW"] == 1 and counts["risks", "LOW"] == 3
    raw = summary.dimension_counts(df, summary.READER_DIMENSIONS, None).collect()
    assert {r["value"] for r in raw if r["dimension"] == "risks"} == {None}
    order = summary.feed_order_values()
    top = [(r["ticker"], r["n"], r["share_pct"]) for r in summary.top_stocks(df, order).collect()]
    assert top == [("B", 2, 100), ("A", 2, 100), ("C", 1, 50)]
    assert ids(summary.action_queue(df, order)) == ["2", "1"]


def test_day_groups_can_repeat(rows):
    df = signals(rows, ("1", [], "BUY", "LOW", 0.9, "2024-01-01"),
                 ("2", [], "BUY", "LOW", 0.8, "2024-01-02"), ("3", [], "BUY", "LOW", 0.7, "2024-01-01"))
    df = df.withColumn("feed_pos", F.col("news_id").cast("int"))
    got = feed.day_groups(df, "score").orderBy("group_no").collect()
    assert [(r["day_label"], r["starts_group"], r["group_no"]) for r in got] == [
        ("Mon, 01 Jan 2024", True, 1), ("Tue, 02 Jan 2024", True, 2), ("Mon, 01 Jan 2024", True, 3)]


def test_quotes(rows):
    bars = rows("ticker string, day string, close double, volume bigint", [
        ("A.NS", "2024-01-01", 10.0, 1), ("A.NS", "2024-01-02", 0.0, 2), ("A.NS", "2024-01-03", 5.0, 3),
        ("B.NS", "2024-01-02", 7.0, 4), ("C.NS", "2024-01-09", 7.0, 4), ("D", "2024-01-02", 1.0, 1),
    ]).withColumn("day", F.col("day").cast("date"))
    at = F.lit("2024-01-05 00:00:00").cast("timestamp")
    asked = rows("ticker string, pos int", [("D", 1), ("B.NS", 2), ("A.NS", 3), ("C.NS", 4)])
    got = prices.quote_snapshot(asked, bars, at).orderBy("pos").collect()
    assert [(r["ticker"], r["close"], r["change_pct"], r["volume"]) for r in got] == [
        ("B.NS", 7.0, 0.0, 4), ("A.NS", 5.0, 0.0, 3)]
    assert ids_of(prices.quote_snapshot(asked, bars, at, limit=2)) == ["B.NS"]


def ids_of(df):
    return [r["ticker"] for r in df.collect()]


def test_alert_rule_and_channels(rows):
    df = signals(rows, ("1", ["A.NS"], "BUY", "HIGH", 0.8, None), ("2", ["A.NS"], "BUY", "HIGH", 0.79, None),
                 ("3", ["A.NS"], "WATCH", "HIGH", 0.9, None), ("4", ["A.NS", "B.NS"], "SELL", "HIGH", 0.9, None))
    df = df.withColumn("headline", F.lit("H"))
    log = rows("news_id string, channel string, status string, message string, sent_at timestamp",
               [("1", "webhook", "sent", "", None), ("4", "local", "sent", "", None)])
    at = F.lit("2024-01-05 00:00:00").cast("timestamp")
    got = alerts.new_alerts(df, log, at).collect()
    assert [(r["news_id"], r["message"]) for r in got] == [("1", "BUY A.NS score 80.0 confidence 0.8: H")]


def test_notification_defaults(rows):
    df = rows("headline string, source string, url string, published_at string, fetched_at string",
              [("<H>", "S", "", None, None)])
    df = tables.evolve(df, schemas.SIGNALS).withColumn("url", F.lit("http://x?a&b"))
    text = df.select(alerts.notification_html()).head()[0].split("\n")
    assert len(text) == 17
    assert text[1] == "<b>Headline:</b> &lt;H&gt;" and text[3] == "<b>Published:</b> "
    assert text[4].endswith("No tradable ticker") and text[9].endswith("MEDIUM")
    assert text[11].endswith("0.00") and text[15] == "- No extra confidence notes"
    assert text[16].endswith("http://x?a&amp;b")
    long = df.withColumn("reasoning", F.repeat(F.lit("x"), 5000))
    assert len(long.select(alerts.notification_html()).head()[0]) == 3900


def test_insert_ignore_and_upserts(rows):
    old = rows("news_id string, v int", [("a", 1), ("b", 2)])
    new = rows("news_id string, v int", [("b", 9), ("c", 5), ("c", 4)])
    got = tables.insert_ignore(old, new, ["news_id"], "v").collect()
    assert [tuple(r) for r in got] == [("c", 4)]
    got = tables.upsert_last(old, new, ["news_id"], [F.desc("v")]).collect()
    assert sorted(tuple(r) for r in got) == [("a", 1), ("b", 9), ("c", 5)]
    s = rows("news_id string, price_at_signal double, v int", [("a", 1.0, 1), ("b", None, 2)])
    n = rows("news_id string, price_at_signal double, v int", [("a", 7.0, 3), ("b", 8.0, 4), ("c", None, 5)])
    once = tables.upsert_signals(s, n)
    want = [("a", 1.0, 3), ("b", 8.0, 4), ("c", None, 5)]
    assert sorted(tuple(r) for r in once.collect()) == want
    assert sorted(tuple(r) for r in tables.upsert_signals(once, n).collect()) == want


def test_plans(spark):
    """No Python, no cross join, no full sort where a few rows are asked for."""
    from newsloom.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"

    def plan(name):
        return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()

    for name in ("score_responses", "signal_feed", "top_stocks", "notification_html"):
        text = plan(name)
        assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text
    assert "TakeOrderedAndProject" in plan("signal_feed")
    assert "WindowGroupLimit" in plan("feed_first_n")
    assert "text:string" not in plan("freshness").split("ReadSchema")[1]
