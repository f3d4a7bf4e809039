"""Feed files to tables: one run, repeated runs, streams."""

import os
import time
from xml.sax.saxutils import escape

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsloom.operators import ingest
from newsloom.plans import outbox, queries, run, views
from newsloom.sources import feeds, tables
from newsloom.streaming import refresh

AS_OF = "2024-01-02 00:00:00"


def rss(path, source, items):
    os.makedirs(f"{path}/{source}", exist_ok=True)
    number = len(os.listdir(f"{path}/{source}"))
    body = "".join(
        f"<item><title>{escape(t)}</title><link>{link}</link><guid isPermaLink=\"false\">g</guid>"
        f"<description>{escape(d)}</description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate>"
        "</item>" for t, link, d in items
    )
    with open(f"{path}/{source}/{number}.xml", "w") as f:
        f.write(f"<?xml version=\"1.0\"?><rss><channel><title>c</title>{body}</channel></rss>")


DROPS = [
    [("LiveMint", [("RELIANCE &amp; record profit upgrade", "u1", "<p>target price</p>"),
                   ("", "u2", "no headline"), ("TCS crash", "u3", "weak guidance")])],
    [("LiveMint", [("TCS crash", "u3", "weak guidance"), ("SBIN rally on order", "u4", "x")]),
     ("NSEIndia", [("INFY surge, stake buy", "u5", "record inflow of rs 500 crore")])],
    [("NSEIndia", [("Quiet day", "u6", "nothing"), ("ITC gain", "u7", "beats")])],
]


def land(path, drops):
    for drop in drops:
        for source, items in drop:
            rss(path, source, items)


@pytest.fixture
def as_of():
    return F.lit(AS_OF).cast("timestamp")


@pytest.fixture
def settings(rows):
    return run.Settings(
        feeds=rows("feed_no int, source string, url string",
                   [(0, "LiveMint", "a"), (1, "NSEIndia", "b"), (2, "Quiet", "c")]),
        bars=rows("ticker string, day string, close double, volume bigint", [
            ("TCS.NS", "2024-01-01", 100.0, 5), ("TCS.NS", "2024-01-02", 110.0, 7),
            ("SBIN.NS", "2024-01-01", 50.0, 1), ("SBIN.NS", "2024-01-05", 99.0, 1),
        ]).withColumn("day", F.col("day").cast("date")),
        channels=("local", "telegram", "webhook"),
        deliver={"telegram": lambda due: due.withColumn("status", F.lit("sent"))},
    )


def headlines(store, table="news_raw"):
    return sorted(r["headline"] for r in store.read(table).collect())


def test_entries_of_feed_files(spark, tmp_path):
    land(tmp_path, DROPS[:1])
    got = feeds.in_file_order(feeds.scan_rss(spark, str(tmp_path))).orderBy("pos").collect()
    assert [(r["source"], r["title"], r["link"], r["id"]) for r in got] == [
        ("LiveMint", "RELIANCE &amp; record profit upgrade", "u1", "g"),
        ("LiveMint", "", "u2", "g"), ("LiveMint", "TCS crash", "u3", "g"),
    ]


def test_atom_entries(spark, tmp_path):
    os.makedirs(tmp_path / "Wire")
    (tmp_path / "Wire" / "a.xml").write_text(
        "<feed><entry><title>T</title><link href='http://x'/><id>i</id><summary>s</summary>"
        "<updated>2024-01-01T00:00:00Z</updated></entry></feed>")
    row = feeds.in_file_order(feeds.scan_atom(spark, str(tmp_path))).head()
    assert (row["source"], row["link"], row["updated"]) == ("Wire", "http://x", "2024-01-01T00:00:00Z")


def test_limit_is_cut_before_empty_headlines_drop(rows):
    df = rows("source string, pos int, link string, id string, title string, summary string, "
              "published string, updated string",
              [("S", 1, "a", "", "", "", "", ""), ("S", 2, "b", "", "x", "", "", ""),
               ("S", 3, "c", "", "y", "", "", "")])
    items = ingest.news_items(df, F.lit("f"), limit=2).collect()
    assert [r["headline"] for r in items] == ["x"]


def test_runs_and_repeats(spark, tmp_path, settings, as_of):
    landing, store = f"{tmp_path}/in", tables.Store(spark, f"{tmp_path}/db", 4).create()
    assert run.last_run(store).head()["status"] == "idle"
    land(landing, DROPS[:1])
    entries = feeds.in_file_order(feeds.scan_rss(spark, landing))
    first = run.run_batch(spark, store, entries, settings, as_of, "b1")
    assert (first.fetched, first.inserted, first.duplicates, first.processed) == (2, 2, 0, 2)
    again = run.run_batch(spark, store, entries, settings, as_of, "b1")
    assert again == first and store.read("signals").count() == 2

    land(landing, DROPS[1:])
    entries = feeds.in_file_order(feeds.scan_rss(spark, landing))
    second = run.run_batch(spark, store, entries, settings, as_of, "b2")
    assert (second.fetched, second.inserted, second.duplicates) == (7, 4, 3)
    assert headlines(store) == [
        "INFY surge, stake buy", "ITC gain", "Quiet day", "RELIANCE & record profit upgrade",
        "SBIN rally on order", "TCS crash"]
    prices = {r["stocks"][0]: (r["price_at_signal"], r["price_change_pct"])
              for r in store.read("signals").collect() if r["stocks"]}
    assert prices["TCS.NS"] == (110.0, 10.0) and prices["SBIN.NS"] == (50.0, 0.0)
    health = {r["source"]: (r["status"], r["item_count"]) for r in views.health(store).collect()}
    assert health == {"LiveMint": ("ok", 5), "NSEIndia": ("ok", 3), "Quiet": ("error", 0)}
    log = store.read("alert_log")
    assert log.count() == log.select("news_id", "channel").distinct().count()
    assert log.filter("channel = 'telegram' and status = 'sent'").count() == 6
    assert log.filter("channel = 'webhook'").count() == 0        # not configured
    assert run.last_run(store).head()["batch_id"] == "b2"
    assert views.signals(store).count() == 6
    assert [r["stocks"] for r in views.stock(store, "tcs.ns").collect()] == [["TCS.NS"]]
    assert views.quote_list(store, settings.bars, as_of, ["tcs.ns", "X"]).head()["close"] == 110.0
    assert views.quote_list(store, settings.bars, as_of).count() == 2
    assert '"total":6' in views.dashboard(store).head()["document"]
    assert views.alert_log(store).count() <= 50
    assert views.facets(store).count() > 5

    news_id = store.read("signals").head()["news_id"]
    assert run.notify_one(store, news_id, as_of, None) == "not_configured"
    for status in ("failed:500", "sent"):
        sent = run.notify_one(
            store, news_id, as_of, lambda d, s=status: d.withColumn("status", F.lit(s)))
        assert sent == status
    manual = store.read("alert_log").filter("channel = 'telegram_manual'").collect()
    assert [r["status"] for r in manual] == ["sent"]

    # Writing a known signal again keeps its first price and its place.
    old = store.read("signals").filter(F.array_contains("stocks", "TCS.NS"))
    store.merge_signals(old.withColumn("price_at_signal", F.lit(1.0))
                        .withColumn("suggestion", F.lit("HOLD")), "b3")
    row = store.read("signals").filter(F.array_contains("stocks", "TCS.NS")).collect()
    assert [(r["price_at_signal"], r["suggestion"], r["batch_id"]) for r in row] == [
        (110.0, "HOLD", "b1")]
    assert store.read("signals").count() == 6

    # A moved day finds the stored signal all the same.
    moved = store.read("signals").filter(F.array_contains("stocks", "TCS.NS"))
    store.merge_signals(moved.withColumn("day", F.lit("2031-05-05").cast("date")), "b4")
    assert store.read("signals").count() == 6
    assert run.reprocess(spark, store, settings, as_of, "again") == 6
    assert store.read("signals").count() == 6

    def plain():
        return {name: sorted(map(str, store.read(name).drop("batch_id").collect())) for name in store.OF_BATCHES}

    before = plain()
    store.compact(["b1", "b2"], "old")
    assert plain() == before
    store.compact(["b1", "b2"], "old")                       # a repeat changes nothing
    assert plain() == before
    for name in ("signals", "news_raw", "news_keys"):
        assert [r[0] for r in store.read(name).select("batch_id").distinct().collect()] == ["old"], name
    with pytest.raises(ValueError, match="compacted"):
        run.run_batch(spark, store, entries, settings, as_of, "b1")
    assert run.run_batch(spark, store, entries, settings, as_of, "b5").inserted == 0

    # Deleting news deletes their signals, and only those.
    gone = store.read("news_raw").filter(F.col("headline").isin("TCS crash", "Quiet day")).select("news_id")
    gone = spark.createDataFrame(gone.collect())
    store.delete_news(gone)
    assert headlines(store) == ["INFY surge, stake buy", "ITC gain", "RELIANCE & record profit upgrade", "SBIN rally on order"]
    assert store.read("signals").count() == 4 == views.signals(store).count()
    store.delete_news(store.read("news_raw").select("news_id"))
    assert store.read("signals").count() == store.read("news_raw").count() == 0

    store.reset()
    assert all(store.read(name).count() == 0 for name in store.TABLES)


def test_missing_source_goes_to_the_error_table(spark, rows, tmp_path, settings, as_of):
    store = tables.Store(spark, f"{tmp_path}/db", 2).create()
    df = rows("source string, pos int, link string, id string, title string, summary string, "
              "published string, updated string",
              [(None, 1, "a", "", "bad", "", "", ""), ("LiveMint", 2, "b", "", "ok", "", "", "")])
    result = run.run_batch(spark, store, df, settings, as_of, "b")
    assert (result.fetched, result.errors, result.processed) == (2, 1, 1)
    assert headlines(store, "errors") == ["bad"]


def test_similarity_modes(spark, rows, tmp_path, settings, as_of):
    text = " ".join(f"common{i}" for i in range(20))
    df = rows("source string, pos int, link string, id string, title string, summary string, "
              "published string, updated string",
              [("LiveMint", i, f"l{i}", "", "gain", t, "", "")
               for i, t in enumerate([text, text + " extra", "other words here"])])
    settings.ask = lambda texts: texts.map(lambda t: '{"confidence":0.9}')
    for mode in ("lexical", "semantic"):
        store = tables.Store(spark, f"{tmp_path}/{mode}", 2).create()
        settings.dedup = mode
        settings.encode = lambda texts: pd.Series(
            [[1.0, 0.0] if "common" in t else [0.0, 1.0] for t in texts])
        result = run.run_batch(spark, store, df, settings, as_of, "b1")
        assert (result.inserted, result.duplicates, result.processed) == (2, 1, 2)
        assert store.read("news_raw").count() == 3
        later = df.withColumn("link", F.concat("link", F.lit("x")))
        result = run.run_batch(spark, store, later, settings, as_of, "b2")
        assert (result.inserted, result.duplicates) == (0, 3)


def test_stream_equals_batch(spark, tmp_path, settings, as_of):
    landing = f"{tmp_path}/in"
    one, two = (tables.Store(spark, f"{tmp_path}/{n}", 2).create() for n in "ab")
    settings.channels = ("local",)
    for drop in DROPS:
        land(landing, [drop])
        refresh.refresh(spark, landing, one, settings, f"{tmp_path}/cp",
                        as_of=lambda: F.lit(AS_OF).cast("timestamp"), once=True
                        ).awaitTermination()
    refresh.refresh(spark, landing, one, settings, f"{tmp_path}/cp", once=True).awaitTermination()
    entries = feeds.in_file_order(feeds.scan_rss(spark, landing))
    run.run_batch(spark, two, entries, settings, as_of, "all")
    columns = ["news_id", "stocks", "suggestion", "confidence", "priority"]

    def content(store):
        return sorted(map(str, store.read("signals").select(*columns).collect()))

    assert content(one) == content(two) and len(content(one)) == 6
    assert {r["reason"] for r in one.read("run_log").collect()} == {"scheduler"}


ENTRY = ("source string, pos int, link string, id string, title string, summary string, "
         "published string, updated string")


def contents(store):
    return {name: sorted(map(str, store.read(name).collect())) for name in store.TABLES if name != "run_log"}


def test_two_streams_and_a_new_checkpoint_keep_all_rows(spark, tmp_path, settings):
    """RSS, Atom and a second checkpoint over one store."""
    store = tables.Store(spark, f"{tmp_path}/db", 2).create()
    settings.channels = ("local",)
    land(f"{tmp_path}/rss", DROPS[:2])
    os.makedirs(tmp_path / "atom" / "NSEIndia")
    for i in range(3):
        (tmp_path / "atom" / "NSEIndia" / f"{i}.xml").write_text(
            f"<feed><entry><title>INFY gain {i}</title><link href='http://x/{i}'/><id>i{i}</id><summary>s</summary>"
            "<updated>2024-01-01T00:00:00Z</updated></entry></feed>")

    def go(folder, checkpoint, **kind):
        query = refresh.refresh(spark, f"{tmp_path}/{folder}", store, settings, f"{tmp_path}/{checkpoint}", once=True,
                                as_of=lambda: F.lit(AS_OF).cast("timestamp"), **kind)
        query.awaitTermination()
        return query.name

    first = go("rss", "one")
    rss_rows = headlines(store)
    assert len(rss_rows) == 4
    second = go("atom", "two", atom=True)
    assert headlines(store) == sorted([*rss_rows, "INFY gain 0", "INFY gain 1", "INFY gain 2"])
    assert first != second and go("rss", "one") == first
    go("rss", "three")                                      # all over again: nothing new, nothing lost
    assert len(headlines(store)) == 7 == store.read("signals").count()


def test_hooks_get_a_row_once(spark, rows, tmp_path, settings, as_of):
    """A repeated batch, also one that died between delivery and log."""
    entries = rows(ENTRY, [("LiveMint", 1, "a", "", "RELIANCE upgrade", "", "", ""), ("LiveMint", 2, "b", "", "TCS crash", "", "", "")])
    store = tables.Store(spark, f"{tmp_path}/db", 2).create()
    got = []

    def hook(due):
        got.append(due.count())
        return due.withColumn("status", F.lit("sent"))

    settings.channels, settings.deliver = ("telegram",), {"telegram": hook}
    run.run_batch(spark, store, entries, settings, as_of, "b")
    run.run_batch(spark, store, entries, settings, as_of, "b")
    assert got == [2] and [r["status"] for r in store.read("alert_log").collect()] == ["sent"] * 2

    def dies(due):
        got.append(due.count())
        raise RuntimeError("gone")

    more = entries.withColumn("link", F.concat("link", F.lit("2")))
    settings.deliver = {"telegram": dies}
    with pytest.raises(RuntimeError):
        run.run_batch(spark, store, more, settings, as_of, "c")
    settings.deliver = {"telegram": hook}
    run.run_batch(spark, store, more, settings, as_of, "c")
    assert got == [2, 2]
    assert sorted(r["status"] for r in store.read("alert_log").collect()) == ["sent"] * 2 + ["unconfirmed"] * 2
    outbox.claim_again(store, "telegram", "c")
    run.run_batch(spark, store, more, settings, as_of, "c")
    assert got == [2, 2, 2]
    assert sorted(r["status"] for r in store.read("alert_log").collect()) == ["sent"] * 4
    run.run_batch(spark, store, more, settings, as_of, "d")
    assert got == [2, 2, 2]


def test_one_run_at_a_time(spark, rows, tmp_path, settings, as_of):
    entries = rows(ENTRY, [("LiveMint", 1, "a", "", "RELIANCE upgrade", "", "", "")])
    store = tables.Store(spark, f"{tmp_path}/db", 2).create()
    inside = []

    def hook(due):
        """While this run delivers, another one finds the store busy."""
        other = tables.Store(spark, f"{tmp_path}/db", 2)
        inside.append(run.run_batch(spark, other, entries, run.Settings(settings.feeds, settings.bars), as_of, "second"))
        return due.withColumn("status", F.lit("sent"))

    settings.channels, settings.deliver = ("telegram",), {"telegram": hook}
    first = run.run_batch(spark, store, entries, settings, as_of, "first")
    assert first.status == "ok" and [r.status for r in inside] == ["busy"]
    log = {r["status"]: r for r in store.read("run_log").collect()}
    assert set(log) == {"ok", "busy"} and log["busy"]["message"] == "first is running"
    assert store.read("news_raw").filter("batch_id = 'second'").count() == 0
    assert store.holder() is None

    assert store.acquire("x") and store.acquire("x") and not store.acquire("y")
    assert run.run_batch(spark, store, entries, settings, as_of, "third", wait_seconds=2).status == "busy"
    assert store.acquire("y", stale_seconds=-1)             # left behind by a dead run
    store.free("x")
    assert store.holder() == "y"
    store.free("y")
    with pytest.raises(ValueError):
        run.run_batch(spark, store, entries, run.Settings(settings.feeds, settings.bars, dedup="no"), as_of, "bad")
    assert store.holder() is None
    assert {r["status"] for r in store.read("run_log").collect()} == {"ok", "busy", "error"}


def test_progress_in_the_run_log(spark, tmp_path, settings):
    store = tables.Store(spark, f"{tmp_path}/db", 2).create()
    settings.channels = ("local",)
    land(f"{tmp_path}/in", DROPS[:1])
    spark.conf.set("spark.sql.streaming.noDataProgressEventInterval", "100")
    query = refresh.refresh(spark, f"{tmp_path}/in", store, settings, f"{tmp_path}/cp", seconds=1)
    listener = refresh.log_progress(store, query)
    try:
        for _ in range(90):
            log = store.read("run_log").filter("reason = 'progress'").collect()
            if {r["status"] for r in log} == {"ok", "idle"}:
                break
            time.sleep(1)
    finally:
        query.stop()
        spark.streams.removeListener(listener)
        spark.conf.unset("spark.sql.streaming.noDataProgressEventInterval")
    # Spark counts a row of a micro-batch each time it is read.
    assert {(r["status"], r["fetched"] % 3, r["fetched"] > 0) for r in log} == {("ok", 0, True), ("idle", 0, False)}
    assert '"numInputRows" : ' in next(r["message"] for r in log if r["status"] == "ok")


def test_a_repeated_batch_replaces_all_it_wrote(spark, rows, tmp_path, settings):
    """Across midnight, with fewer rows, and after a crash behind any write."""
    two = rows(ENTRY, [("LiveMint", 1, "a", "", "RELIANCE upgrade", "", "", ""), ("LiveMint", 2, "b", "", "TCS crash", "", "", "")])
    late, early = (F.lit(f"2024-01-0{d}").cast("timestamp") for d in ("2 23:59:30", "3 00:00:30"))
    store = tables.Store(spark, f"{tmp_path}/db", 2).create()
    run.run_batch(spark, store, two, settings, late, "b/1:x")
    first = contents(store)
    assert run.run_batch(spark, store, two, settings, early, "b/1:x").inserted == 2
    assert contents(store) == first
    one = run.run_batch(spark, store, two.limit(1), settings, early, "b/1:x")
    assert (one.inserted, one.duplicates) == (1, 0)
    assert store.read("news_raw").count() == store.read("signals").count() == store.read("news_keys").count() == 1
    log = store.read("alert_log")
    assert log.count() == log.select("news_id", "channel").distinct().count()

    write = store.write
    for stop in ("items", "news_raw", "errors", "signals", "alert_log"):
        def failing(name, *args, **kwargs):
            totals = write(name, *args, **kwargs)
            if name == stop:
                raise RuntimeError("lost")
            return totals
        store.write = failing
        with pytest.raises(RuntimeError):
            run.run_batch(spark, store, two, settings, early, "b/1:x")
        store.write = write
        run.run_batch(spark, store, two, settings, early, "b/1:x")
        assert contents(store) == first, stop


def test_broken_items_and_failing_hooks(spark, tmp_path, settings, as_of):
    landing = f"{tmp_path}/in"
    rss(landing, "LiveMint", [("RELIANCE upgrade", "u1", "x"), ("poison text", "u2", "x"), ("TCS crash", "u3", "x")])
    with open(f"{landing}/LiveMint/9.xml", "w") as f:
        f.write("<rss><channel><item><title>half</title><link>z</item></channel></rss>")

    def ask(texts):
        if texts.str.contains("poison").any():
            raise ValueError("cannot read this")
        return texts.map(lambda t: '{"confidence":0.9,"suggestion":"BUY"}')

    settings.ask = ask
    store = tables.Store(spark, f"{tmp_path}/db", 2).create()
    entries = feeds.in_file_order(feeds.scan_rss(spark, landing))
    result = run.run_batch(spark, store, entries, settings, as_of, "b")
    assert (result.fetched, result.inserted, result.processed, result.errors) == (3, 3, 3, 2)
    errors = {r["headline"]: r["error"] for r in store.read("errors").collect()}
    assert "cannot read this" in errors.pop("poison text")
    assert [("unreadable item" in e, "half" in e) for e in errors.values()] == [(True, True)]
    assert views.signals(store).count() == 3

    settings.dedup, settings.ask = "semantic", None

    def encode(texts):
        if texts.str.contains("poison").any():
            raise ValueError("no vector")
        return pd.Series([[1.0, float(i)] for i in range(len(texts))], index=texts.index)

    settings.encode = encode
    other = tables.Store(spark, f"{tmp_path}/other", 2).create()
    result = run.run_batch(spark, other, entries, settings, as_of, "b")
    assert result.errors == 2 and "poison text" not in {r["headline"] for r in views.signals(other).collect()}


def test_health_outlives_quiet_drops(spark, tmp_path, settings):
    landing, store = f"{tmp_path}/in", tables.Store(spark, f"{tmp_path}/db", 2).create()
    got = []
    for number, drop in enumerate(DROPS):
        land(landing, [drop])
        refresh.refresh(spark, landing, store, settings, f"{tmp_path}/cp", once=True,
                        as_of=lambda n=number: F.lit(f"2024-01-0{n + 1}").cast("timestamp")).awaitTermination()
        got.append({r["source"]: (r["status"], r["item_count"], r["checked_at"].day) for r in views.health(store).collect()})
    assert got[0] == {"LiveMint": ("ok", 3, 1), "NSEIndia": ("error", 0, 1), "Quiet": ("error", 0, 1)}
    assert got[2] == {"LiveMint": ("ok", 2, 2), "NSEIndia": ("ok", 2, 3), "Quiet": ("error", 0, 1)}


def test_old_bars_give_no_price(rows, as_of):
    from newsloom.operators import prices
    bars = rows("ticker string, day string, close double, volume bigint", [
        ("OLD.NS", "2015-01-01", 9.0, 1), ("NEW.NS", "2023-12-28", 5.0, 1), ("NEW.NS", "2023-12-27", 4.0, 1)]
    ).withColumn("day", F.col("day").cast("date"))
    assert [r["ticker"] for r in prices.quotes(bars, as_of).collect()] == ["NEW.NS"]


def test_a_drop_of_documents_is_landed_by_all_cores(spark, tmp_path):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.lit("en").alias("lang"),
                                    F.lit("src1").alias("source"), F.lit(9).cast("bigint").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/sf/documents.parquet")
    docs.filter("doc_id % 4 = 0").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/sf/labels.parquet")
    drops = []
    stream = queries._documents_stream(spark, f"{tmp_path}/sf", f"{tmp_path}/run")
    refresh.each_batch(stream, lambda batch, n: drops.append(sorted(r[0] for r in batch.select("doc_id").collect())),
                       f"{tmp_path}/cp", once=True).awaitTermination()
    assert len(drops) == 4 and sorted(sum(drops[:3], [])) == list(range(2000)) and drops[3] == list(range(0, 2000, 4))
    files = spark.read.parquet(f"{tmp_path}/run/landed").groupBy(F.input_file_name()).count().collect()
    cores = spark.sparkContext.defaultParallelism
    assert len(files) == 4 * cores and max(r["count"] for r in files) <= 2 * 2000 / 3 / cores


def test_a_stream_deals_its_state_to_the_parts_it_is_told(spark, tmp_path):
    spark.range(20).select(F.concat(F.lit("n"), "id").alias("news_id")).write.parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    ids = spark.readStream.schema("news_id string").parquet(f"{tmp_path}/in").dropDuplicates(["news_id"])
    refresh.to_files(ids, f"{tmp_path}/out", f"{tmp_path}/cp", once=True, state_parts=3).awaitTermination()
    assert spark.read.schema("news_id string").parquet(f"{tmp_path}/out").count() == 20
    parts = [p for p in os.listdir(f"{tmp_path}/cp/state/0") if p.isdigit()]
    assert len(parts) == 3 and spark.conf.get("spark.sql.shuffle.partitions") == before
