import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsloom import lexicon as lx
from newsloom.operators import extract, scoring

NEWS = ("news_id string, source string, headline string, full_text string, url string, "
        "published_at string, fetched_at string")


def news(rows, *texts):
    return rows(NEWS, [(str(i), "S", "h", t, "", None, None) for i, t in enumerate(texts)])


def by_id(df):
    return [r.asDict() for r in sorted(df.collect(), key=lambda r: int(r["news_id"]))]


def test_rules(rows):
    got = by_id(extract.extract_by_rules(news(
        rows, "Reliance gains", "record loss", "nothing", "Kotak on inflation", "FII and GDP",
        "mutual fund", "china result",
    )))
    assert [(r["stocks"], r["event_type"], r["sentiment"], r["suggestion"]) for r in got] == [
        (["RELIANCE.NS"], "PRICE_ACTION", "POSITIVE", "BUY"),
        (["MARKET.NS"], "PRICE_ACTION", "NEGATIVE", "SELL"),
        (["MARKET.NS"], "PRICE_ACTION", "NEUTRAL", "WATCH"),
        (["MARKET.NS"], "BROKER_CALL", "NEUTRAL", "WATCH"),
        (["MARKET.NS"], "MACRO", "NEUTRAL", "WATCH"),
        (["MARKET.NS"], "FUND_FLOW", "NEUTRAL", "WATCH"),
        (["LT.NS"], "GLOBAL", "NEUTRAL", "WATCH"),
    ]
    settled = by_id(extract.settle_tickers(extract.extract_by_rules(news(rows, "record loss"))))
    assert (settled[0]["stocks"], settled[0]["suggestion"], settled[0]["sentiment"]) == (
        [], "WATCH", "NEGATIVE")


RESPONSES = {
    None: "rules",
    "": "blank",
    "no json": "blank",
    "null": "blank",
    "{}": "blank",
    "[]": "blank",
    "0": "blank",
    "12": "rules",
    "[1]": "rules",
    '"text"': "rules",
    "{broken}": "rules",
    '{"a":1} {"b":2}': "rules",
    "{'a':1}": "rules",
    'see {"confidence":0.7} ok': "response",
    '{"confidence":null}': "rules",
    '{"confidence":"high"}': "rules",
    '{"confidence":"0.7"}': "response",
    '{"stocks":{"a":1}}': "rules",
    '{"stocks":5}': "rules",
    '{"stocks":null}': "response",
}


def test_response_origin(rows):
    data = [(str(i), "S", "h", "t", "", None, None, r) for i, r in enumerate(RESPONSES)]
    df = rows(NEWS + ", raw_response string", data)
    got = by_id(extract.normalize_responses(df))
    assert {r: g["origin"] for r, g in zip(RESPONSES, got)} == RESPONSES


def test_response_values(rows):
    data = [
        ("0", "S", "h", "quiet", "", None, None,
         '{"stocks":"tcs","event_type":"X","sentiment":"POSITIVE","impact_horizon":"LONG_TERM",'
         '"suggestion":"HOLD","confidence":3,"reasoning":null}'),
        ("1", "S", "h", "a broker says", "", None, None,
         '{"stocks":["A1","A2","A3","A4","A5","A6","A7","A8","A9"],"event_type":"MACRO",'
         '"confidence":-1,"reasoning":"' + "é" * 700 + '"}'),
    ]
    a, b = by_id(extract.normalize_responses(rows(NEWS + ", raw_response string", data)))
    assert (a["stocks"], a["event_type"], a["sentiment"], a["impact_horizon"], a["suggestion"],
            a["confidence"], a["reasoning"]) == (
        ["tcs"], "PRICE_ACTION", "POSITIVE", "LONG_TERM", "HOLD", 0.95, "None")
    assert (len(b["stocks"]), b["event_type"], b["sentiment"], b["suggestion"], b["confidence"],
            len(b["reasoning"])) == (8, "BROKER_CALL", "NEUTRAL", "WATCH", 0.0, 600)


def test_hooks(rows):
    df = news(rows, "one", "two")

    def fail(texts):
        raise RuntimeError("no model")

    assert {r["raw_response"] for r in extract.add_responses(df, fail).collect()} == {None}
    ok = extract.add_responses(df, lambda t: "{} " + t)
    assert sorted(r["raw_response"] for r in ok.collect()) == ["{} one", "{} two"]
    vectors = extract.add_embeddings(df, lambda t: pd.Series([[float(len(x)), 1.0] for x in t]))
    assert {tuple(r["embedding"]) for r in vectors.collect()} == {(3.0, 1.0)}


def test_keyword_hits(rows):
    got = extract.keyword_hits(news(rows, "Buy buy", "sell", "BUYER"), "full_text", ["buy", "x"])
    assert [tuple(r) for r in got.collect()] == [("buy", 2)]


def float_confidence(source, event, action, fresh, spec, lang, cons, raw):
    total = (source * 0.14 + event * 0.12 + action * 0.1 + fresh * 0.18 + spec * 0.18
             + lang * 0.16 + cons * 0.12)
    total += -0.05 if raw < 0.6 else 0.025 if raw > 0.9 else 0
    return max(0.35, min(0.95, total))


def test_confidence_is_the_weighted_sum(rows):
    rng = random.Random(5)
    grid = list(itertools.product(
        (72, 78, 80, 82, 84, 86), (64, 66, 68, 70, 74, 78), (62, 72, 100),
        (46, 58, 68, 84, 94), (54, 62, 72, 82, 92), (500, 620, 675, 840), (55, 72, 82, 90),
        (0.0, 0.55, 0.6, 0.7, 0.9, 0.93),
    ))
    data = [(i, *row) for i, row in enumerate(rng.sample(grid, 2000))]
    names = ("source", "event", "action", "freshness", "specificity", "language", "consistency")
    df = rows("i int, " + ", ".join(f"{n} int" for n in names) + ", raw double", data)
    got = df.select("i", scoring.calibrated(F.col("raw"), **{n: F.col(n) for n in names}).alias("h"))
    got = {r["i"]: r["h"] for r in got.collect()}
    for i, *parts, raw in data:
        *most, lang, cons = parts
        want = float_confidence(*[p / 100 for p in most], lang / 1000, cons / 100, raw or 0.55)
        assert abs(got[i] - want * 100) <= 0.5 + 1e-6


@pytest.mark.parametrize(
    "suggestion,event,horizon,n,confidence,risk",
    [("BUY", "MACRO", "SHORT_TERM", 1, 0.7, "HIGH"), ("BUY", "FUND_FLOW", "INTRADAY", 1, 0.7, "HIGH"),
     ("SELL", "FUND_FLOW", "SHORT_TERM", 1, 0.7, "MEDIUM"),
     ("HOLD", "FUND_FLOW", "SHORT_TERM", 4, 0.7, "MEDIUM"),
     ("HOLD", "FUND_FLOW", "SHORT_TERM", 3, 0.7, "LOW")],
)
def test_risk(rows, suggestion, event, horizon, n, confidence, risk):
    df = rows(
        NEWS + ", stocks array<string>, event_type string, sentiment string, "
        "impact_horizon string, suggestion string, confidence double",
        [("1", "NSEIndia", "h", "t", "", None, None, [f"T{i}.NS" for i in range(n)], event,
          "NEUTRAL", horizon, suggestion, confidence)],
    )
    assert scoring.score_signals(df, F.current_timestamp()).head()["risk_level"] == risk


def test_scored_row(rows):
    df = news(rows, "Broker upgrade: RELIANCE target price raised after record profit, may rise")
    df = df.withColumn("source", F.lit("")).withColumn("published_at", F.lit("2024-01-01T00:00:00Z"))
    as_of = F.lit("2024-01-01 01:00:00").cast("timestamp")
    row = scoring.score_signals(extract.settle_tickers(extract.extract_by_rules(df)), as_of).head()
    # .14*.72 + .12*.78 + .1 + .18*.94 + .18*.72 + .16*.8 + .12*.9 - .05
    assert (row["confidence"], row["signal_score"], row["priority"]) == (0.78, 78.0, "MEDIUM")
    assert row["confidence_reasons"] == [
        "Unknown source source", "fresh", "broker call event", "strong market wording",
        "sentiment matches action",
    ]


def test_lookup_by_join_uses_the_default(rows):
    df = rows("k string", [("a",), ("z",)])
    table = rows("k string, w double", [("a", 0.5)])
    got = scoring.lookup_by_join(df, table, "k", "w", 0.72).collect()
    assert {r["k"]: r["w"] for r in got} == {"a": 0.5, "z": 0.72}


def test_word_lists_are_plain():
    assert len(lx.STRONG_WORDS) == 20 and len(lx.WATCHLIST) == 20
