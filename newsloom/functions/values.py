"""Ids, times, numbers, tickers and JSON arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import lexicon


# --- ids ---------------------------------------------------------------------

def uuid_v5(name: Column, namespace_hex: str = lexicon.URL_NAMESPACE) -> Column:
    """Name-based UUID: SHA-1 digest with version and variant digits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.translate(
        F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab"
    )
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant,
        F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def filled(col: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(col, F.lit(""))


def stable_id(source: Column, link: Column, entry_id: Column, title: Column) -> Column:
    key = F.coalesce(filled(link), filled(entry_id), title, F.lit(""))
    return uuid_v5(F.concat(source, F.lit(":"), key))


# --- times -------------------------------------------------------------------

# Zone names of RFC 822, and common others, as offsets.
_ZONES = {
    "GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "IST": "+0530",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
    "BST": "+0100", "CET": "+0100", "CEST": "+0200", "EET": "+0200", "EEST": "+0300",
    "MSK": "+0300", "SGT": "+0800", "HKT": "+0800", "JST": "+0900",
    "AEST": "+1000", "AEDT": "+1100", "NZST": "+1200", "NZDT": "+1300",
}


def parse_iso(col: Column) -> Column:
    """ISO-8601 text to timestamp; null when it is not a date. UTC if no zone."""
    return F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}"), col.try_cast("timestamp"))


def _parse_feed_time(col: Column) -> Column:
    """Mail-style date, or ISO text; a zone name that is not listed counts as UTC."""
    text = F.trim(F.regexp_replace(col, r"^\s*[A-Za-z]{3,9},\s*", ""))
    zone = F.regexp_extract(text, r" ([A-Z]{1,5})$", 1)
    names = F.create_map(*[F.lit(x) for pair in _ZONES.items() for x in pair])
    text = F.when(
        zone != "", F.concat(F.regexp_replace(text, r"[A-Z]{1,5}$", ""),
                            F.coalesce(F.try_element_at(names, zone), F.lit("+0000")))
    ).otherwise(text)
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm Z")),
        parse_iso(text),
    )


def entry_time(published: Column, updated: Column) -> Column:
    """Time of a feed entry as ISO text in UTC, or null."""
    ts = F.coalesce(_parse_feed_time(published), _parse_feed_time(updated))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def feed_time(published_at: Column, fetched_at: Column) -> Column:
    """Sort key of the feed: a bad published text does not fall back."""
    return F.date_trunc("second", parse_iso(F.coalesce(published_at, fetched_at)))


def signal_time(published_at: Column, fetched_at: Column) -> Column:
    """Time shown to a reader: epoch 0 when none is given, null when bad."""
    text = F.coalesce(filled(published_at), filled(fetched_at))
    return F.when(text.isNull(), F.timestamp_seconds(F.lit(0))).otherwise(parse_iso(text))


def day_label(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "EEE, dd MMM yyyy"), F.lit("No Date"))


# --- numbers -----------------------------------------------------------------

def clamp(col: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def exact(col: Column) -> Column:
    """A price or score as a decimal, so that sums do not depend on row order."""
    return col.cast("decimal(20,4)")


def percent_change(close: Column, previous: Column) -> Column:
    """Change in percent, two decimals, half up, in exact arithmetic."""
    c, p = exact(close), exact(previous)
    p = F.when(p == 0, c).otherwise(p)
    hundredths = F.call_function(
        "div", F.abs(c - p) * F.lit(20000) + F.abs(p), F.abs(p) * F.lit(2)
    )
    sign = F.signum(((c - p) * F.signum(p)).cast("double"))
    return F.when(p == 0, F.lit(0.0)).otherwise(sign * hundredths / F.lit(100.0))


# --- tickers -----------------------------------------------------------------

def _bare(raw: Column) -> Column:
    """Upper case, without any blanks."""
    trimmed = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    return F.replace(F.upper(trimmed), F.lit(" "), F.lit(""))


def _exchange(t: Column, invalid, indexes) -> Column:
    chain = None
    for name, symbol in indexes.items():
        chain = (F if chain is None else chain).when(t == name, F.lit(symbol))
    return (
        chain.when(t.isin(*invalid), None)
        .when(F.startswith(t, F.lit("^")), t)
        .when(t.rlike(r"\A[A-Z0-9&-]{2,20}\z"), F.concat(t, F.lit(".NS")))
        .when(t.rlike(r"\A[A-Z0-9&-]{2,20}\.NS\z"), t)
    )


def normalize_ticker(
    raw: Column,
    invalid=lexicon.INVALID_TICKERS,
    indexes=lexicon.INDEX_TICKERS,
) -> Column:
    """Exchange ticker of a free text, or null."""
    return _exchange(_bare(raw), invalid, indexes)


def clean_tickers(
    values: Column, invalid=lexicon.INVALID_TICKERS, indexes=lexicon.INDEX_TICKERS
) -> Column:
    """Normalized tickers, first occurrences in order; empty for null."""
    bare = F.transform(values, lambda v: _bare(v))
    good = F.transform(bare, lambda t: _exchange(t, invalid, indexes))
    return F.coalesce(
        F.array_distinct(F.filter(good, lambda t: t.isNotNull())),
        F.array().cast("array<string>"),
    )


def is_tradable(ticker: Column) -> Column:
    return F.coalesce(
        F.endswith(ticker, F.lit(".NS")) | F.startswith(ticker, F.lit("^")), F.lit(False)
    )


# --- JSON arrays -------------------------------------------------------------

def decode_array(text: Column) -> Column:
    """Array of texts; empty for null or bad JSON."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def encode_array(values: Column) -> Column:
    return F.to_json(values)


def spaced_array_text(values: Column) -> Column:
    """JSON text with a blank after each comma, as the stored form has it."""
    return F.when(F.size(values) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit('["'), F.array_join(values, '", "'), F.lit('"]'))
    )
