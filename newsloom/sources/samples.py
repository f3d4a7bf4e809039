"""Views that give the supplied test tables the shape of this library's inputs.

Only column expressions: every row of the base table comes through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import lexicon as lx
from newsloom.functions import text as tx
from newsloom.functions import values as vl

AS_OF = "2024-01-31 00:00:00"
FETCHED = "2024-01-30T12:00:00+00:00"

PHRASES = (
    "Broker upgrade: RELIANCE target price raised after record profit",
    "TCS shares crash after weak guidance",
    "RBI holds rate as inflation may ease",
    "FII inflow lifts INFY and WIPRO in Q3 FY25",
    "Nasdaq rally boosts global cues for SBIN, order of 5 crore",
    "Outlook could consider proposal, plans likely",
    "ITC, LT, MARUTI and SUNPHARMA surge in block deal",
    "HDFCBANK under SEBI probe, loss widens",
    "Strong buy call despite sell pressure on HCLTECH",
    "Crude and rupee: ICICIBANK expects stake result",
    "Mutual fund outflow hits BAJFINANCE",
    "China demand and TATAMOTORS beats, insider gain",
    "AXISBANK rating downgrade, rs 900 target price",
    "KOTAKBANK steady",
    "BHARTIARTL decline, misses estimates",
    "",
)
SOURCES = ("Moneycontrol", "EconomicTimes", "LiveMint", "BusinessStandard", "NSEIndia")
# Three watchlist names have no bars, three others have.
BAR_TICKERS = (*lx.WATCHLIST[:17], "ONGC.NS", "NTPC.NS", "^NSEI")

# Model responses by ``doc_id % 10``; None stands for no response.
RESPONSES = (
    None,
    '{"stocks":["TCS.NS","INFY"],"event_type":"FUND_FLOW","sentiment":"NEUTRAL",'
    '"impact_horizon":"LONG_TERM","suggestion":"HOLD","confidence":0.93,"reasoning":"steady flow"}',
    'Sure: {"stocks":["SBIN.NS"],"event_type":"MACRO","sentiment":"POSITIVE",'
    '"impact_horizon":"SHORT_TERM","suggestion":"BUY","confidence":0.7,"reasoning":"rate cut"} Thanks',
    "not json",
    '{"stocks":["LT.NS"],"event_type":"WEATHER","sentiment":"HAPPY",'
    '"impact_horizon":"NEVER","suggestion":"SHORT","confidence":0.6,"reasoning":"odd"}',
    '{"stocks":" axis bank ","event_type":"PRICE_ACTION","sentiment":"NEGATIVE",'
    '"impact_horizon":"SHORT_TERM","suggestion":"SELL","confidence":0.8,"reasoning":"one name"}',
    '{"stocks":["NIFTY","TICKER","MARKET.NS","X","ABC.BO","^ABC","M&M","m&m","WIPRO","ITC.NS"],'
    '"event_type":"GLOBAL","sentiment":"POSITIVE","impact_horizon":"INTRADAY","suggestion":"BUY",'
    '"confidence":0.65,"reasoning":"many"}',
    '{"stocks":[],"event_type":"BROKER_CALL","sentiment":"NEGATIVE","impact_horizon":"INTRADAY",'
    '"suggestion":"SELL","confidence":1.7,"reasoning":"' + "long " * 140 + '"}',
    "{}",
    '{"stocks":["ITC.NS"],"event_type":"MACRO","sentiment":"NEUTRAL",'
    '"impact_horizon":"SHORT_TERM","suggestion":"WATCH","confidence":"high","reasoning":"x"}',
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table, dealt over all cores where its files do not feed them: a small one is a single row group."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    parts = rows.groupBy(F.spark_partition_id().alias("part")).count()
    held, largest, total = parts.agg(F.count("*"), F.max("count"), F.sum("count")).first()
    return rows if held >= cores and largest * cores <= 2 * total else rows.repartition(cores)


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def _pick(number: Column, options) -> Column:
    """The option at ``number`` modulo their count."""
    slot = F.pmod(number, F.lit(len(options)))
    return reduce(
        lambda chain, item: chain.when(slot == item[0], F.lit(item[1])),
        enumerate(options[1:], 1),
        F.when(slot == 0, F.lit(options[0])),
    )


def _every(number: Column, n: int) -> Column:
    return F.pmod(number, F.lit(n)) == 0


def news(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """News rows, one per document; ``extra`` keeps columns such as ``doc_id``."""
    return news_of(table(spark, sf_dir, "documents"), *extra)


def news_of(documents: DataFrame, *extra: str) -> DataFrame:
    d = F.col("doc_id")
    source = F.coalesce(_pick(d, (*SOURCES, None)), F.col("source"))
    headline = F.trim(F.concat(_pick(d, PHRASES), F.lit(" #"), d.cast("string")))
    start = F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    minute = F.timestamp_seconds(start + F.pmod(d * 43, F.lit(43200)) * 60)
    published = F.concat(F.date_format(minute, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    url = F.when(_every(d, 29), "").otherwise(
        F.concat(F.lit("https://news.example.com/"), d.cast("string"))
    )
    return (
        documents.select("doc_id", source.alias("source"), headline.alias("headline"),
                url.alias("url"), "text",
                F.when(_every(d, 17), None).when(_every(d, 23), "n/a").otherwise(published)
                .alias("published_at"),
                F.when(_every(d, 391), "n/a").otherwise(FETCHED).alias("fetched_at"))
        .select(
            vl.stable_id(
                F.col("source"), F.col("url"), F.lit(None).cast("string"), F.col("headline")
            ).alias("news_id"),
            "source", "headline",
            F.concat("headline", F.lit(" "), tx.squeeze(F.col("text"))).alias("full_text"),
            "url", "published_at", "fetched_at", *extra,
        )
    )


def with_response(rows: DataFrame) -> DataFrame:
    """Add ``raw_response`` by ``doc_id``."""
    return rows.withColumn("raw_response", _pick(F.col("doc_id"), RESPONSES))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars from the events of a ticker's users."""
    return (
        table(spark, sf_dir, "events")
        .select(
            _pick(F.col("user_id"), BAR_TICKERS).alias("ticker"),
            F.to_date("ts").alias("day"), "value", "ts", "event_id",
        )
        .groupBy("ticker", "day")
        .agg(
            F.max_by("value", F.struct("ts", "event_id")).alias("close"),
            F.count("*").alias("volume"),
        )
    )


def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed entries, one per page; ``pos`` is the order within a feed."""
    p = F.col("page_id")
    start = F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    ts = F.timestamp_seconds(start + F.pmod(p * 61, F.lit(43200)) * 60)
    stamp = F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss")
    zone = F.when(_every(p, 5), " +0530").otherwise(" GMT")
    return table(spark, sf_dir, "pages").select(
        _pick(p, SOURCES).alias("source"),
        p.alias("pos"),
        F.when(_every(p, 11), "").otherwise(F.col("url")).alias("link"),
        F.when(_every(p, 22), "").otherwise(F.concat(F.lit("page-"), p.cast("string"))).alias("id"),
        F.when(_every(p, 7), "").otherwise(
            F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"),
        F.col("html").alias("summary"),
        F.when(_every(p, 13), None).when(_every(p, 17), "soon")
        .otherwise(F.concat(stamp, zone)).alias("published"),
        F.when(_every(p, 13), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("updated"),
    )


def feeds(spark: SparkSession) -> DataFrame:
    """The configured feeds, and one that never delivers."""
    rows = [(i, s, u) for i, (s, u) in enumerate(lx.FEEDS.items())]
    rows.append((len(rows), "QuietWire", "https://quiet.example.com/rss"))
    return spark.createDataFrame(rows, "feed_no int, source string, url string")


def stored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that stand for news stored by earlier runs: the labelled ones."""
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
