"""Text expressions: cleaning, tokens, fingerprints, escaping."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from html.entities import html5
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F

_HIDDEN = ("script", "style", "template")
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]{0,31};?)"


# What numbers 0x80 to 0x9F mean; those that windows-1252 leaves open stay as they are.
_WINDOWS = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0))


def squeeze(col: Column) -> Column:
    """Collapse every run of Unicode white space to one blank, and trim."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def _character(point: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")


def _code_point(reference: Column) -> Column:
    """The character of a numeric reference, by the rules of HTML: numbers of the C1 range
    mean windows-1252, impossible ones give U+FFFD, control and non-characters nothing."""
    is_hex = F.lower(F.substring(reference, 3, 1)) == "x"
    digits = F.regexp_extract(reference, r"&#[xX]?0*([0-9a-fA-F]*)", 1)
    point = F.when(F.length(digits) > 8, F.lit(0x7FFFFFFF)).when(
        digits == "", F.lit(0)).when(is_hex, F.conv(digits, 16, 10).cast("bigint")).otherwise(digits.try_cast("bigint"))
    c1 = F.substring(F.lit(_WINDOWS), (point - 0x7F).cast("int"), F.lit(1))
    control = (
        point.between(1, 8) | (point == 0x0B) | point.between(0x0E, 0x1F) | point.between(0x7F, 0x9F)
        | point.between(0xFDD0, 0xFDEF) | (F.pmod(point, F.lit(0x10000)) >= 0xFFFE)
    )
    return (
        F.when((point == 0) | point.between(0xD800, 0xDFFF) | (point > 0x10FFFF), F.lit("\ufffd"))
        .when(point == 0x0D, F.lit("\r"))
        .when(point.between(0x80, 0x9F), c1)
        .when(control, F.lit(""))
        .otherwise(_character(point))
    )


NAME_TABLES = 1024           # a map is searched from its start, so the names are dealt to small ones
_OLD = 6                     # letters of the longest name that is known without its semicolon


def _name_tables() -> Column:
    """The table of HTML 5 (of the standard library), dealt by the checksum of a name."""
    tables: list[dict[str, str]] = [{} for _ in range(NAME_TABLES)]
    for name, characters in html5.items():
        tables[crc32(name.encode()) % NAME_TABLES][name] = characters
    return F.from_json(F.lit(json.dumps(tables)), "array<map<string,string>>")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _named(reference: Column, tables: Column) -> Column:
    """The text of a named reference. Without a known end, the longest old name that it begins with counts."""
    def look_up(name: Column) -> Column:
        slot = F.pmod(F.crc32(name.cast("binary")), F.lit(NAME_TABLES)).cast("int")
        return F.try_element_at(F.get(tables, slot), name)

    def beginning(n: int) -> Column:
        end = F.lit(n + 1)
        return F.when(F.length(reference) >= end, F.concat(
            look_up(F.substring(reference, F.lit(2), F.lit(n))), F.substring(reference, end + 1, F.length(reference))))

    whole = F.when(F.endswith(reference, F.lit(";")), look_up(F.substring(reference, F.lit(2), F.length(reference))))
    return F.coalesce(whole, *[beginning(n) for n in range(_OLD, 1, -1)], reference)


def decode_entities(col: Column) -> Column:
    """Character references decoded once.

    References are taken out of the text, decoded, and put back between its
    other parts; texts without an ampersand are left alone.
    """
    tables = _name_tables()

    def decode(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
        decoded = F.transform(
            found, lambda r: F.when(F.startswith(r, F.lit("&#")), _code_point(r)).otherwise(_named(r, tables)))
        parts = F.zip_with(F.split(text, _REFERENCE, -1), decoded, lambda t, d: F.concat(t, F.coalesce(d, F.lit(""))))
        return F.when(F.contains(text, F.lit("&")), F.array_join(parts, "")).otherwise(text)

    return _let(col, decode)


def clean_html(col: Column) -> Column:
    """Visible text of an HTML fragment. Tags leave no blank behind."""
    text = F.coalesce(col, F.lit(""))
    for tag in _HIDDEN:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?(</{tag}\s*>|\z)", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?(-->|\z)", "")
    text = F.regexp_replace(text, r"<[!/?a-zA-Z][^>]*>", "")
    return squeeze(decode_entities(text))


def full_text(headline: Column, summary: Column) -> Column:
    """Headline and summary, both cleaned already, cleaned once more."""
    return clean_html(F.concat_ws(" ", headline, summary))


def tokens(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9]+"), F.lit(0))


def scored_text(headline: Column, body: Column) -> Column:
    """The lower-case text that word counts and wording tests look at."""
    blank = F.lit("")
    return F.lower(F.concat(F.coalesce(headline, blank), F.lit(" "), F.coalesce(body, blank)))


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def has_words(text: Column, n: int) -> Column:
    """``word_count(text) >= n`` for a lower-case text, without building the
    token array: an anchored, possessive match that stops at the n-th word."""
    return text.rlike(rf"\A[^a-z0-9]*+(?:[a-z0-9]++[^a-z0-9]++){{{n - 1}}}[a-z0-9]")


def fingerprint(col: Column) -> Column:
    """Distinct words of more than three characters."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9]{4,}"), F.lit(0))
    )


def jaccard(a: Column, b: Column) -> Column:
    """Overlap over union of two sets; 0 when either is empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def jaccard_at_least(a: Column, b: Column, percent: int) -> Column:
    """Exact integer form of ``jaccard(a, b) >= percent / 100``."""
    both = F.size(F.array_intersect(a, b))
    sizes = F.size(a) + F.size(b)
    return (sizes > 0) & (both * (100 + percent) >= sizes * percent)


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def count_hits(text: Column, words) -> Column:
    """How many of ``words`` occur in ``text`` as substrings."""
    return reduce(
        lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words]
    )


def escape_html(col: Column) -> Column:
    for char, entity in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")
    ):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def display_label(col: Column) -> Column:
    return F.replace(col, F.lit("_"), F.lit(" "))


def haystack(*fields: Column, stocks: Column) -> Column:
    """One lower-case line to search in: the fields and the tickers."""
    parts = [F.coalesce(f, F.lit("")) for f in fields]
    return F.lower(F.concat_ws(" ", *parts, F.array_join(stocks, " ")))
