import re
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.functions import values as vl
from newsloom.operators import scoring

X = None        # the column under test


@pytest.fixture(autouse=True)
def _column(spark):
    global X
    X = F.col("x")


def test_clean_html(values):
    cases = {
        "<p>a</p><p>b</p>": "ab",
        "a &amp; b &lt;c&gt; &quot;d&quot;": 'a & b <c> "d"',
        "&#8377;500 &#x20b9;7 &#0; &#xD800;": "₹500 ₹7 � �",
        "x  y&nbsp;z\n\t w": "x y z w",
        '<script>var t="</p>"; a<b</script>x<style>p{}</style>y': "xy",
        "a<!-- no > no -->b": "ab",
        "<b>open": "open",
        "&amp;lt;": "&lt;",
        "5 < 6": "5 < 6",
        "": "",
    }
    assert values(tx.clean_html(X), [*cases, None]) == [*cases.values(), ""]


def test_full_text_cleans_escaped_tags_a_second_time(rows):
    df = rows("t string, s string", [("&lt;b&gt;Up", "more &lt;i&gt;news")])
    headline = tx.clean_html(F.col("t"))
    got = df.select(headline, tx.full_text(headline, tx.clean_html(F.col("s")))).head()
    assert tuple(got) == ("<b>Up", "Up more news")


def test_tokens_and_fingerprint(values):
    text = "Rs5, TCS-up! abcd ABCD x1y2z3"
    assert values(tx.tokens(X), [text]) == [["rs5", "tcs", "up", "abcd", "abcd", "x1y2z3"]]
    assert values(tx.fingerprint(X), [text, ""]) == [["abcd", "x1y2z3"], []]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab1 .-é", max_size=60), min_size=1, max_size=40))
def test_has_words_equals_word_count(values, texts):
    got = values(tx.has_words(X, 5), texts)
    assert got == [len(re.findall("[a-z0-9]+", t)) >= 5 for t in texts]


def test_jaccard_boundary(rows):
    a = [f"w{i:03d}" for i in range(50)]
    df = rows("a array<string>, b array<string>", [(a, a[:41]), (a, a[:40]), ([], []), (a, [])])
    got = df.select(
        tx.jaccard_at_least(F.col("a"), F.col("b"), 82), tx.jaccard(F.col("a"), F.col("b"))
    ).collect()
    assert [tuple(r) for r in got] == [(True, 0.82), (False, 0.8), (False, 0.0), (False, 0.0)]


def test_escape_html(values):
    assert values(tx.escape_html(X), ["<a href=\"x\">&'"]) == [
        "&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"
    ]


def test_uuid_matches_the_standard(values):
    names = ["", "a:b", "Ünï:₹", "x" * 500]
    assert values(vl.uuid_v5(X), names) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_stable_id_falls_back(rows):
    data = [("l", "i", "t"), ("", "i", "t"), (None, "", "t"), (None, None, None)]
    df = rows("l string, i string, t string", data)
    got = [r[0] for r in df.select(
        vl.stable_id(F.lit("S"), F.col("l"), F.col("i"), F.col("t"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, f"S:{k}")) for k in ("l", "i", "t", "")]


def test_entry_time(values):
    cases = {
        "Mon, 01 Jan 2024 10:00:00 GMT": "2024-01-01T10:00:00+00:00",
        "1 Jan 2024 10:00:00 +0530": "2024-01-01T04:30:00+00:00",
        "Mon, 01 Jan 2024 10:00 EST": "2024-01-01T15:00:00+00:00",
        "2024-01-01T10:00:00Z": "2024-01-01T10:00:00+00:00",
        "soon": None,
        "": None,
    }
    got = values(vl.entry_time(X, F.lit(None).cast("string")), [*cases, None])
    assert got == [*cases.values(), None]


def test_feed_time_does_not_fall_back_but_freshness_does(rows):
    data = [
        ("2024-01-01T00:00:00+00:00", None), (None, "2024-01-02T00:00:00Z"),
        ("n/a", "2024-01-02T00:00:00Z"), ("n/a", "n/a"), (None, None),
    ]
    df = rows("p string, f string", data)
    as_of = F.lit("2024-01-02 06:00:00").cast("timestamp")
    got = df.select(
        F.unix_seconds(vl.feed_time(F.col("p"), F.col("f"))).isNull(),
        scoring.freshness(F.col("p"), F.col("f"), as_of)["reason"],
        vl.signal_time(F.col("p"), F.col("f")).cast("string"),
    ).collect()
    assert [tuple(r) for r in got] == [
        (False, "recent", "2024-01-01 00:00:00"),
        (False, "fresh", "2024-01-02 00:00:00"),
        (True, "fresh", None),
        (True, "unknown age", None),
        (True, "unknown age", "1970-01-01 00:00:00"),
    ]


def test_freshness_bands(values):
    as_of = F.lit("2024-01-10 00:00:00").cast("timestamp")
    cases = {
        "2024-01-09T18:00:00": 94, "2024-01-09T17:59:59.999999": 84,
        "2024-01-09T00:00:00Z": 84, "2024-01-07T00:00:00+00:00": 68,
        "2024-01-06T23:59:59": 46, "2024-02-01": 94, "2024-01-09T23:30:00+05:30": 94,
        "bad": 58,
    }
    f = scoring.freshness(X, F.lit(None).cast("string"), as_of)["score"]
    assert values(f, list(cases)) == list(cases.values())


def test_day_label(values):
    got = values(vl.day_label(vl.parse_iso(X)), ["2024-01-01T05:00:00Z", None])
    assert got == ["Mon, 01 Jan 2024", "No Date"]


def test_normalize_ticker(values):
    cases = {
        "": None, " reliance ": "RELIANCE.NS", "M&M": "M&M.NS", "BAJAJ-AUTO": "BAJAJ-AUTO.NS",
        "nifty": "^NSEI", "BANK NIFTY": "^NSEBANK", "SENSEX.NS": None, "SEBI": None,
        "TICKER": "TICKER.NS", "TICKER.NS": None, "MARKET": "MARKET.NS", "^X": "^X", "A": None,
        "A" * 21: None, "TCS.BO": None, "TCS.NS": "TCS.NS", "TCS\n": "TCS.NS", "T_X": None,
    }
    assert values(vl.normalize_ticker(X), [*cases, None]) == [*cases.values(), None]


def test_clean_tickers_keeps_first_occurrences(values):
    got = values(
        vl.clean_tickers(X), [["tcs", "TCS.NS", None, "MARKET.NS", "itc"], [], None],
        "array<string>",
    )
    assert got == [["TCS.NS", "ITC.NS"], [], []]


def test_is_tradable(values):
    assert values(vl.is_tradable(X), ["TCS.NS", "^NSEI", "TCS.BO", None]) == [
        True, True, False, False
    ]


def test_json_arrays(values):
    got = values(vl.decode_array(X), ['["a","b"]', "bad", None, '"A"', "[]"])
    assert got == [["a", "b"], [], [], [], []]
    assert values(vl.encode_array(X), [["a", "b"], []], "array<string>") == ['["a","b"]', "[]"]


def test_percent_change(rows):
    df = rows("c double, p double", [(110.0, 100.0), (1.0, 3.0), (5.0, 0.0), (0.0, 0.0), (2.0, 2.0)])
    got = [r[0] for r in df.select(vl.percent_change(F.col("c"), F.col("p"))).collect()]
    assert got == [10.0, -66.67, 0.0, 0.0, 0.0]


def test_numeric_detail(values):
    cases = {
        "5% up": False, "5%x": True, "₹500": False, "a₹5": True, "rs 5": True, "érs 5": False,
        "in q4": True, "q5": False, "fy25": True, "fy2": False, "ten crore": True, "xcrore": False,
    }
    assert values(X.rlike(scoring.NUMERIC_DETAIL), list(cases)) == list(cases.values())


def test_character_references_follow_html(values):
    """Every named reference, with and without end, and all kinds of numbers."""
    import html
    from html.entities import html5
    texts = [f"x&{name}y z" for name in html5] + [f"&{name.rstrip(';')}" for name in html5]
    numbers = [*range(0, 0x110), 0x2019, 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE,
               0x10FFFF, 0x110000, 10**9, 10**30]
    texts += [f"a&#{n};b" for n in numbers] + [f"a&#x{n:X}b" for n in numbers] + [f"&#X{n:x};" for n in numbers]
    texts += ["&#0000000039;", "&#x000000000027;", "AT&ampT", "&lt3", "&notit;", "&amp;lt;", "&lt;&amp;&lt;", "&;", "& b", "&#;", "&#x;",
              "&unknown;", "a && b &", "&&lt;", "", "no reference", "&ampamp;", "&Eacute;&eacute"]
    got = values(tx.decode_entities(F.col("x")), texts)
    wrong = [(t, g, html.unescape(t)) for t, g in zip(texts, got) if g != html.unescape(t)]
    assert wrong == []


def test_time_zones_by_name(values):
    got = values(vl.entry_time(F.col("x"), F.lit(None).cast("string")), [
        "Mon, 01 Jan 2024 10:00:00 CEST", "Mon, 01 Jan 2024 10:00:00 AEST", "Mon, 01 Jan 2024 10:00:00 XYZT"])
    assert got == ["2024-01-01T08:00:00+00:00", "2024-01-01T00:00:00+00:00", "2024-01-01T10:00:00+00:00"]
