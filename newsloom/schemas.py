"""Row shapes of the tables and of the records in flight."""

from pyspark.sql.types import (
    ArrayType, BooleanType, DataType, DateType, DoubleType, FloatType, IntegerType,
    LongType, StringType, StructField, StructType, TimestampType,
)

_TYPES: dict[str, DataType] = {
    "string": StringType(), "double": DoubleType(), "bigint": LongType(),
    "int": IntegerType(), "date": DateType(), "timestamp": TimestampType(),
    "boolean": BooleanType(), "array<string>": ArrayType(StringType()),
    "array<float>": ArrayType(FloatType()),
}


def struct(fields: str) -> StructType:
    """Schema of ``name type, name type, ...``; needs no running session."""
    pairs = [f.split() for f in fields.split(",")]
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


NEWS = struct(
    "news_id string, source string, headline string, full_text string, "
    "url string, published_at string, fetched_at string"
)
ENTRY = struct(
    "source string, pos bigint, link string, id string, title string, "
    "summary string, published string, updated string"
)
SIGNALS = struct(
    "news_id string, stocks array<string>, event_type string, sentiment string, "
    "impact_horizon string, suggestion string, confidence double, signal_score double, "
    "priority string, risk_level string, confidence_reasons array<string>, "
    "price_at_signal double, price_checked_at timestamp, price_change_pct double, "
    "reasoning string, model_name string, processed_at timestamp"
)
HEALTH = struct(
    "source string, url string, status string, item_count bigint, error string, "
    "checked_at timestamp"
)
ALERTS = struct(
    "news_id string, channel string, status string, message string, sent_at timestamp"
)
FINGERPRINTS = struct("news_id string, fp array<string>")
EMBEDDINGS = struct("news_id string, text string, embedding array<float>")
PRICES = struct("ticker string, day date, close double, volume bigint")
ERRORS = struct("headline string, error string")
RUN_LOG = struct(
    "status string, reason string, ran_at timestamp, fetched bigint, inserted bigint, "
    "duplicates bigint, processed bigint, errors bigint, message string"
)

# Columns of the served signal view, in order.
SIGNAL_VIEW = (
    "news_id", "source", "headline", "full_text", "url", "published_at", "fetched_at",
    "stocks", "event_type", "sentiment", "impact_horizon", "suggestion", "confidence",
    "signal_score", "priority", "risk_level", "confidence_reasons", "price_at_signal",
    "price_checked_at", "price_change_pct", "reasoning", "model_name", "processed_at",
)
