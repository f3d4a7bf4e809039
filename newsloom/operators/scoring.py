"""Calibrated confidence, score, priority, risk and reasons of a signal.

The confidence is a weighted sum of finite decimals. It is computed in whole
units of 1e-5, so it is exact and rounds half up everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import lexicon as lx
from newsloom.functions import text as tx
from newsloom.functions import values as vl
from newsloom.functions.once import compute_once

# Weights per hundredth (language: per thousandth), in 1e-5.
WEIGHTS = {
    "source": 140, "event": 120, "action": 100, "freshness": 180,
    "specificity": 180, "language": 16, "consistency": 120,
}

# Fixed value: a number or currency word on its own. The look-ahead only
# rejects most positions early.
NUMERIC_DETAIL = r"(?U)(?=[rcqlf₹$%])\b(rs|₹|\$|%|crore|lakh|q[1-4]|fy\d{2})\b"


def _lookup(col: Column, table: dict[str, int], default: int) -> Column:
    chain = None
    for key, value in table.items():
        chain = F.when(col == key, value) if chain is None else chain.when(col == key, value)
    return chain.otherwise(F.lit(default))


def lookup_by_join(
    df: DataFrame, table: DataFrame, key: str, value: str, default
) -> DataFrame:
    """Dictionary lookup for a dictionary kept as a table: left join, default."""
    return df.join(table.select(key, value), key, "left").withColumn(
        value, F.coalesce(F.col(value), F.lit(default))
    )


def freshness(published_at: Column, fetched_at: Column, as_of: Column) -> Column:
    """``struct(score, reason)`` of the age at ``as_of``."""
    ts = F.coalesce(vl.parse_iso(published_at), vl.parse_iso(fetched_at))
    age = F.unix_micros(as_of) - F.unix_micros(ts)

    def band(score, reason):
        return F.struct(F.lit(score).alias("score"), F.lit(reason).alias("reason"))

    chain = F.when(age.isNull(), band(*lx.UNKNOWN_AGE))
    for hours, score, reason in lx.FRESHNESS_BANDS:
        chain = chain.when(age <= hours * 3_600_000_000, band(score, reason))
    return chain.otherwise(band(*lx.STALE))


def specificity(n_stocks: Column, long: Column, detail: Column) -> Column:
    """``long``: 35 words or more; ``detail``: a number or currency word."""
    base = F.when(n_stocks.between(1, 3), 72).when(n_stocks > 3, 62).otherwise(54)
    bonus = F.when(long, 10).otherwise(0) + F.when(detail, 10).otherwise(0)
    return vl.clamp(base + bonus, 40, 92)


def language_strength(strong: Column, weak: Column) -> Column:
    points = F.lit(620) + F.least(strong, F.lit(4)) * 55 - F.least(weak, F.lit(3)) * 40
    return vl.clamp(points, 420, 900)


def consistency(suggestion: Column, sentiment: Column) -> Column:
    acts = suggestion.isin("BUY", "SELL")
    agrees = ((suggestion == "BUY") & (sentiment == "POSITIVE")) | (
        (suggestion == "SELL") & (sentiment == "NEGATIVE")
    )
    return (
        F.when(agrees, 90)
        .when(suggestion.isin("HOLD", "WATCH") & (sentiment == "NEUTRAL"), 82)
        .when(acts & (sentiment == "NEUTRAL"), 55)
        .otherwise(72)
    )


def calibrated(raw: Column, **scores: Column) -> Column:
    """Confidence in hundredths from the seven part scores and the raw one."""
    total = sum((scores[name] * weight for name, weight in WEIGHTS.items()), F.lit(0))
    raw = F.coalesce(F.nullif(raw, F.lit(0.0)), F.lit(0.55))
    total = total + F.when(raw < 0.6, -5000).when(raw > 0.9, 2500).otherwise(0)
    return F.floor((vl.clamp(total, 35000, 95000) + 500) / 1000).cast("int")


def part_scores(signals: DataFrame, as_of: Column) -> DataFrame:
    """Add the part scores as ``_``-columns; the texts are scanned once."""
    text = F.col("_text")
    scanned = compute_once(
        signals.withColumn("_text", tx.scored_text(F.col("headline"), F.col("full_text"))),
        _strong=tx.count_hits(text, lx.STRONG_WORDS),
        _weak=tx.count_hits(text, lx.WEAK_WORDS),
        _long=tx.has_words(text, 35),
        _detail=text.rlike(NUMERIC_DETAIL),
        _fresh=freshness(F.col("published_at"), F.col("fetched_at"), as_of),
    )
    return (
        scanned
        .withColumn("_source", _lookup(F.col("source"), lx.SOURCE_RELIABILITY, lx.SOURCE_DEFAULT))
        .withColumn("_event", _lookup(F.col("event_type"), lx.EVENT_WEIGHT, lx.EVENT_DEFAULT))
        .withColumn("_action", _lookup(F.col("suggestion"), lx.ACTION_WEIGHT, lx.ACTION_DEFAULT))
        .withColumn(
            "_specificity", specificity(F.size("stocks"), F.col("_long"), F.col("_detail"))
        )
        .withColumn("_language", language_strength(F.col("_strong"), F.col("_weak")))
        .withColumn("_consistency", consistency(F.col("suggestion"), F.col("sentiment")))
    )


PARTS = (
    "_text", "_long", "_detail", "_source", "_event", "_action", "_fresh", "_specificity", "_strong",
    "_weak", "_language", "_consistency", "_hundredths",
)


def score_signals(
    signals: DataFrame, as_of: Column, model_name: str = "rules"
) -> DataFrame:
    """Score extracted signals; ``confidence`` on input is the raw one."""
    suggestion = F.col("suggestion")
    h = F.col("_hundredths")
    direction = F.when(suggestion == "BUY", 1).when(suggestion == "SELL", -1).otherwise(0)
    acts = suggestion.isin("BUY", "SELL")
    risk = (
        F.when(
            F.col("event_type").isin("GLOBAL", "MACRO")
            | (F.col("impact_horizon") == "INTRADAY"), "HIGH")
        .when(acts | (F.size("stocks") > 3), "MEDIUM")
        .otherwise("LOW")
    )
    priority = (
        F.when((h >= 82) & (F.abs("signal_score") >= 75), "HIGH")
        .when((h >= 68) | acts, "MEDIUM")
        .otherwise("LOW")
    )
    event = F.lower(tx.display_label(F.coalesce(F.col("event_type"), F.lit("event"))))
    source = F.coalesce(vl.filled(F.col("source")), F.lit("Unknown source"))
    reasons = F.array(
        F.concat(source, F.lit(" source")),
        F.col("_fresh.reason"),
        F.concat(event, F.lit(" event")),
        F.when(F.col("_strong") > 0, "strong market wording"),
        F.when(F.col("_specificity") >= 75, "specific stock or numeric detail"),
        F.when(F.col("_consistency") >= 88, "sentiment matches action"),
        F.when(F.col("_weak") > 0, "speculative wording penalty"),
    )
    parts = part_scores(signals, as_of)
    hundredths = calibrated(
        F.col("confidence"),
        source=F.col("_source"), event=F.col("_event"), action=F.col("_action"),
        freshness=F.col("_fresh.score"), specificity=F.col("_specificity"),
        language=F.col("_language"), consistency=F.col("_consistency"),
    )
    return (
        compute_once(parts, _hundredths=hundredths)
        .withColumn("confidence", h / F.lit(100.0))
        .withColumn("signal_score", (h * direction).cast("double"))
        .withColumn("priority", priority)
        .withColumn("risk_level", risk)
        .withColumn("confidence_reasons", F.slice(F.array_compact(reasons), 1, 5))
        .withColumn("model_name", F.lit(model_name))
        .withColumn("processed_at", as_of)
        .drop(*PARTS)
    )
