"""News text or a stored model response to a structured signal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType

from newsloom import lexicon as lx
from newsloom.functions import text as tx
from newsloom.functions import values as vl
from newsloom.functions.once import compute_once


def _stem(ticker: str) -> str:
    return ticker.replace(".NS", "").lower()


def rule_event_type(lower: Column) -> Column:
    return (
        F.when(tx.contains_any(lower, lx.BROKER_KEYWORDS), "BROKER_CALL")
        .when(tx.contains_any(lower, lx.MACRO_KEYWORDS), "MACRO")
        .when(tx.contains_any(lower, lx.FUND_KEYWORDS), "FUND_FLOW")
        .when(tx.contains_any(lower, lx.GLOBAL_KEYWORDS), "GLOBAL")
        .otherwise("PRICE_ACTION")
    )


def rule_stocks(lower: Column, watchlist=lx.WATCHLIST) -> Column:
    """Watchlist tickers whose stem occurs anywhere in the text, in list order."""
    hits = F.array_compact(
        F.array(*[F.when(F.contains(lower, F.lit(_stem(t))), t) for t in watchlist])
    )
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(lx.MARKET_TICKER)))


def rule_sentiment(lower: Column) -> Column:
    """Negative wording beats positive."""
    return (
        F.when(tx.contains_any(lower, lx.NEGATIVE_WORDS), "NEGATIVE")
        .when(tx.contains_any(lower, lx.POSITIVE_WORDS), "POSITIVE")
        .otherwise("NEUTRAL")
    )


def rule_suggestion(sentiment: Column) -> Column:
    return (
        F.when(sentiment == "NEGATIVE", "SELL")
        .when(sentiment == "POSITIVE", "BUY")
        .otherwise("WATCH")
    )


def extract_by_rules(news: DataFrame, watchlist=lx.WATCHLIST) -> DataFrame:
    """Add the rule result of ``full_text`` as columns."""
    lower = F.col("_lower")
    found = compute_once(
        news.withColumn("_lower", F.lower("full_text")),
        stocks=rule_stocks(lower, watchlist),
        event_type=rule_event_type(lower),
        sentiment=rule_sentiment(lower),
    )
    return found.select(
        *[F.col(c) for c in news.columns],
        "stocks", "event_type", "sentiment",
        F.lit("SHORT_TERM").alias("impact_horizon"),
        rule_suggestion(F.col("sentiment")).alias("suggestion"),
        F.lit(0.55).alias("confidence"),
        F.lit(lx.RULE_REASONING).alias("reasoning"),
    )


# A response that is JSON but says nothing: the rules apply.
_FALSY = r"\A\s*(null|false|-?0+(\.0*)?([eE][+-]?[0-9]+)?|\"\"|\[\s*\]|\{\s*\})\s*\z"


def _single_json(text: Column) -> Column:
    """Parse a text that holds exactly one JSON value, else null."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    alone = F.try_variant_get(wrapped, "$[1]", "variant").isNull()
    return F.when(alone, F.try_variant_get(wrapped, "$[0]", "variant"))


def _kind(value: Column) -> Column:
    """First word of the JSON type: OBJECT, ARRAY, STRING, VOID, ..."""
    return F.regexp_extract(F.schema_of_variant(value), r"\A[A-Z]+", 0)


def _text_of(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "string")


def _one_of(value: Column, allowed, default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def normalize_responses(
    news: DataFrame, raw: str = "raw_response", watchlist=lx.WATCHLIST
) -> DataFrame:
    """Turn ``raw`` into a signal; use the rules wherever it cannot be read.

    ``origin`` tells which way a row went: ``response``, ``blank`` (readable but
    empty: rules, then normalized) or ``rules``.
    """
    text = F.col(raw)
    rules = extract_by_rules(news, watchlist)
    slice_ = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    parsed = compute_once(rules, _whole=_single_json(text), _slice=slice_)
    parsed = compute_once(
        parsed,
        _json=F.coalesce("_whole", _single_json(vl.filled(F.col("_slice")))),
    )
    json = F.col("_json")
    stocks = F.try_variant_get(json, "$.stocks", "variant")
    given = F.try_variant_get(json, "$.confidence", "variant")
    confidence = F.when(given.isNull(), F.lit(0.5)).otherwise(
        F.try_variant_get(given, "$", "double")
    )
    falsy = F.when(F.col("_whole").isNotNull(), text.rlike(_FALSY)).otherwise(
        (F.col("_slice") == "") | F.col("_slice").rlike(_FALSY)
    )
    as_list = F.when(
        _kind(stocks) == "STRING", F.array(F.try_variant_get(stocks, "$", "string"))
    ).otherwise(F.try_variant_get(stocks, "$", "array<string>"))
    reasoning = F.when(
        F.try_variant_get(json, "$.reasoning", "variant").isNull(), F.lit(lx.NO_REASONING)
    ).otherwise(F.coalesce(_text_of(json, "reasoning"), F.lit("None")))
    read = compute_once(
        parsed,
        _falsy=falsy,
        _is_object=_kind(json) == "OBJECT",
        _stocks_kind=F.when(stocks.isNull() | F.is_variant_null(stocks), "NONE").otherwise(
            _kind(stocks)
        ),
        _listed=as_list,
        _confidence=confidence,
        _event=_one_of(_text_of(json, "event_type"), lx.EVENT_TYPES, "PRICE_ACTION"),
        _sentiment=_one_of(_text_of(json, "sentiment"), lx.SENTIMENTS, "NEUTRAL"),
        _horizon=_one_of(_text_of(json, "impact_horizon"), lx.HORIZONS, "SHORT_TERM"),
        _suggestion=_one_of(_text_of(json, "suggestion"), lx.SUGGESTIONS, "WATCH"),
        _reasoning=F.substring(reasoning, 1, lx.REASONING_CHARS),
    )
    readable = (
        F.col("_is_object")
        & F.col("_confidence").isNotNull()
        & F.col("_stocks_kind").isin("NONE", "ARRAY", "STRING")
    )
    origin = (
        F.when(text.isNull(), "rules")
        .when(F.col("_falsy"), "blank")
        .when(F.coalesce(readable, F.lit(False)), "response")
        .otherwise("rules")
    )
    listed = F.filter(F.slice("_listed", 1, 8), lambda t: F.coalesce(t, F.lit("")) != "")
    listed = F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit(lx.MARKET_TICKER)))
    answered = F.col("origin") == "response"

    def chosen(name: str, value: Column) -> Column:
        return F.when(answered, value).otherwise(F.col(name)).alias(name)

    return read.withColumn("origin", origin).select(
        *[F.col(c) for c in news.columns],
        "origin",
        F.when(answered, listed)
        .when(F.col("origin") == "blank", F.slice("stocks", 1, 8))
        .otherwise(F.col("stocks"))
        .alias("stocks"),
        # A broker named in the text overrides the response.
        chosen(
            "event_type",
            F.when(F.col("event_type") == "BROKER_CALL", "BROKER_CALL").otherwise(F.col("_event")),
        ),
        chosen("sentiment", F.col("_sentiment")),
        chosen("impact_horizon", F.col("_horizon")),
        chosen("suggestion", F.col("_suggestion")),
        chosen("confidence", vl.clamp(F.col("_confidence"), 0.0, 0.95)),
        chosen("reasoning", F.col("_reasoning")),
    )


def settle_tickers(extracted: DataFrame) -> DataFrame:
    """Clean the tickers; a signal without one is only worth watching."""
    cleaned = compute_once(extracted, stocks=vl.clean_tickers(F.col("stocks")))
    return cleaned.withColumn(
        "suggestion",
        F.when(F.size("stocks") == 0, F.lit("WATCH")).otherwise(F.col("suggestion")),
    )


def _each_alone(call: Callable[[pd.Series], pd.Series], texts: pd.Series) -> tuple[pd.Series, pd.Series]:
    """Results of a hook and error texts: a batch that fails is tried again row by row."""
    none = pd.Series([None] * len(texts), index=texts.index, dtype=object)
    try:
        return call(texts), none
    except Exception:
        answers, errors = none.copy(), none
        for i in texts.index:
            try:
                answers[i] = call(texts.loc[[i]]).iloc[0]
            except Exception as error:
                errors[i] = f"{type(error).__name__}: {error}"
        return answers, errors


def add_responses(
    news: DataFrame, call: Callable[[pd.Series], pd.Series], raw: str = "raw_response",
    error: str | None = None,
) -> DataFrame:
    """Extraction hook: ``call`` maps a batch of texts to response texts.

    A text whose call fails gets a null response, so the rules apply to it;
    with ``error`` the reason goes to a column of that name.
    """
    extra = [StructField(name, StringType()) for name in (raw, error) if name]
    schema = StructType([*news.schema.fields, *extra])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = _each_alone(call, batch["full_text"])
            batch = batch.assign(**{raw: answers})
            yield batch.assign(**{error: errors}) if error else batch

    return news.mapInPandas(run, schema)


def add_embeddings(
    news: DataFrame, encode: Callable[[pd.Series], pd.Series], name: str = "embedding"
) -> DataFrame:
    """Embedding hook: ``encode`` maps a batch of texts to vectors. A text whose
    call fails gets a null vector and the reason in ``error``."""
    schema = StructType.fromDDL(f"news_id string, text string, {name} array<float>, error string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors, errors = _each_alone(encode, batch["text"])
            yield batch.assign(**{name: vectors, "error": errors})

    return news.select("news_id", F.col("full_text").alias("text")).mapInPandas(run, schema)


def keyword_hits(texts: DataFrame, text: str, keywords) -> DataFrame:
    """For every keyword the number of texts that hold it as a substring.

    One pass over the texts; the list is a job parameter and stays in the plan,
    so there is no join, and counts are combined before the shuffle.
    """
    words = F.array(*[F.lit(w) for w in keywords])
    found = F.filter(words, lambda w: F.contains(F.col("_lower"), w))
    return (
        texts.select(F.lower(F.col(text)).alias("_lower"))
        .select(F.explode(found).alias("keyword"))
        .groupBy("keyword")
        .agg(F.count("*").alias("n"))
    )
