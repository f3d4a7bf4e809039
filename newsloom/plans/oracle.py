"""The registered queries as SQL for DuckDB, written independently.

Each query is a chain of common table expressions; ``sql`` adds the ones that
a query needs in front of it.
"""

from __future__ import annotations

import re

from newsloom import lexicon as lx
from newsloom.plans.queries import ALL_KEYWORDS, VECTOR_THRESHOLD
from newsloom.sources import samples


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def pick(number: str, options) -> str:
    arms = " ".join(f"WHEN {i} THEN {q(o)}" for i, o in enumerate(options))
    return f"CASE {number} % {len(options)} {arms} END"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def array(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def any_in(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def hits(text: str, words) -> str:
    return "(" + " + ".join(f"contains({text}, {q(w)})::INT" for w in words) + ")"


def lookup(col: str, table: dict[str, int], default: int) -> str:
    arms = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in table.items())
    return f"CASE {col} {arms} ELSE {default} END"


WS = r"[\s\p{Z}\x{85}\x0b]+"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def uuid5(name: str) -> str:
    d = f"sha1(unhex('{lx.URL_NAMESPACE}') || encode({name}))"
    return (
        f"(substr({d},1,8) || '-' || substr({d},9,4) || '-5' || substr({d},14,3) || '-' || "
        f"translate(substr({d},17,1),'0123456789abcdef','89ab89ab89ab89ab') || "
        f"substr({d},18,3) || '-' || substr({d},21,12))"
    )


# Named references that the supplied pages use; "&amp;" comes last.
PAGE_ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®",
    "trade": "™", "middot": "·", "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—",
    "euro": "€", "pound": "£", "eacute": "é",
}


def clean(x: str) -> str:
    for tag in ("script", "style", "template"):
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?(</{tag}\s*>|\z)', '', 'g')"
    x = rf"regexp_replace({x}, '(?s)<!--.*?(-->|\z)', '', 'g')"
    x = f"regexp_replace({x}, '<[!/?a-zA-Z][^>]*>', '', 'g')"
    for name, char in PAGE_ENTITIES.items():
        x = f"replace({x}, '&{name};', {q(char)})"
    x = f"replace({x}, '&amp;', '&')"
    return squeeze(x)


def ts(x: str) -> str:
    """Naive UTC time of the ISO texts in the samples."""
    return f"try_cast(replace(replace({x}, 'T', ' '), '+00:00', '') AS TIMESTAMP)"


AS_OF = f"TIMESTAMP '{samples.AS_OF}'"
WORD = r"[\p{L}\p{N}\p{M}_]"

# Ticker of a raw text, as a macro-like expression.
def ticker(raw: str) -> str:
    t = f"replace(upper(trim({raw})), ' ', '')"
    alias = " ".join(f"WHEN {t} = {q(k)} THEN {q(v)}" for k, v in lx.INDEX_TICKERS.items())
    return (
        f"CASE {alias} WHEN {t} IN {in_list(lx.INVALID_TICKERS)} THEN NULL "
        f"WHEN {t} LIKE '^%' THEN {t} "
        f"WHEN regexp_full_match({t}, '[A-Z0-9&-]{{2,20}}') THEN {t} || '.NS' "
        f"WHEN regexp_full_match({t}, '[A-Z0-9&-]{{2,20}}\\.NS') THEN {t} END"
    )


def clean_list(values: str) -> str:
    """Normalized, without nulls, first occurrences in order."""
    good = f"list_filter(list_transform({values}, lambda v: {ticker('v')}), lambda v: v IS NOT NULL)"
    return (
        f"list_filter({good}, lambda v, i: list_position({good}, v) = i)"
    )


CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTE[name] = (needs, body)


def sql(body: str, *needs: str, recursive: bool = False) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for n in CTE[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    if not order:
        return body
    word = "WITH RECURSIVE" if recursive else "WITH"
    # The recursion reads "late" in each of its steps: compute it once.
    kind = dict.fromkeys(("late", "late2", "late3"), "AS MATERIALIZED")
    return f"{word} " + ",\n".join(
        f"{n} {kind.get(n, 'AS')} ({CTE[n][1]})" for n in order
    ) + "\n" + body


# --- samples -------------------------------------------------------------------

cte("news0", f"""
    SELECT doc_id,
      coalesce({pick('doc_id', (*samples.SOURCES, None))}, source) AS source,
      trim({pick('doc_id', samples.PHRASES)} || ' #' || doc_id) AS headline,
      CASE WHEN doc_id % 29 = 0 THEN '' ELSE 'https://news.example.com/' || doc_id END AS url,
      text,
      CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 23 = 0 THEN 'n/a'
           ELSE strftime(TIMESTAMP '2024-01-01' + to_minutes((doc_id * 43) % 43200),
                         '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS published_at,
      CASE WHEN doc_id % 391 = 0 THEN 'n/a' ELSE '{samples.FETCHED}' END AS fetched_at
    FROM documents""")
cte("news", f"""
    SELECT doc_id, {uuid5("source || ':' || CASE WHEN url <> '' THEN url ELSE headline END")}
        AS news_id,
      source, headline, headline || ' ' || {squeeze('text')} AS full_text, url,
      published_at, fetched_at
    FROM news0""", "news0")
cte("feed_entries", f"""
    SELECT {pick('page_id', samples.SOURCES)} AS source, page_id AS pos,
      CASE WHEN page_id % 11 = 0 THEN '' ELSE url END AS link,
      CASE WHEN page_id % 22 = 0 THEN '' ELSE 'page-' || page_id END AS id,
      CASE WHEN page_id % 7 = 0 THEN ''
           ELSE regexp_extract(html, '(?s)<title>(.*?)</title>', 1) END AS title,
      html AS summary,
      TIMESTAMP '2024-01-01' + to_minutes((page_id * 61) % 43200) AS shown,
      page_id % 5 = 0 AS india, page_id % 13 = 0 AS only_updated,
      page_id % 17 = 0 AS unreadable
    FROM pages""")
cte("items", f"""
    SELECT {uuid5("source || ':' || CASE WHEN link <> '' THEN link WHEN id <> '' THEN id ELSE title END")}
        AS news_id,
      source, headline, {clean(f"(headline || ' ' || body)")} AS full_text, link AS url,
      CASE WHEN only_updated THEN strftime(shown, '%Y-%m-%dT%H:%M:%S') || '+00:00'
           WHEN unreadable THEN NULL
           ELSE strftime(shown - CASE WHEN india THEN INTERVAL 330 MINUTE
                                      ELSE INTERVAL 0 MINUTE END,
                         '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS published_at,
      '{samples.FETCHED}' AS fetched_at, pos
    FROM (SELECT *, {clean('title')} AS headline, {clean('summary')} AS body FROM feed_entries)
    WHERE headline <> ''""", "feed_entries")
cte("bars", f"""
    SELECT {pick('user_id', samples.BAR_TICKERS)} AS ticker, ts::DATE AS day,
      arg_max(value, (ts, event_id)) AS close, count(*) AS volume
    FROM events GROUP BY 1, 2""")
cte("recent", """
    SELECT ticker, day, close, volume,
      row_number() OVER (PARTITION BY ticker ORDER BY day DESC) AS n
    FROM bars WHERE day <= DATE '2024-01-31' AND day > DATE '2024-01-24'""", "bars")
cte("quotes", """
    SELECT ticker, c / 100.0 AS close,
      CASE WHEN c >= p THEN 1 ELSE -1 END
        * ((abs(c - p) * 20000 + p) // (2 * p)) / 100.0 AS change_pct, volume
    FROM (
      SELECT a.ticker, round(a.close * 100)::BIGINT AS c,
        CASE WHEN coalesce(b.close, 0) = 0 THEN round(a.close * 100)::BIGINT
             ELSE round(b.close * 100)::BIGINT END AS p, a.volume
      FROM recent a LEFT JOIN recent b ON a.ticker = b.ticker AND b.n = 2 WHERE a.n = 1)""",
    "recent")

# --- signals ---------------------------------------------------------------------

stems = [t.replace(".NS", "").lower() for t in lx.WATCHLIST]
cte("ruled", f"""
    SELECT *, CASE WHEN len(named) > 0 THEN named ELSE ['{lx.MARKET_TICKER}'] END AS listed
    FROM (
      SELECT *,
        list_filter({array(lx.WATCHLIST)},
          lambda w: contains(low, lower(replace(w, '.NS', '')))) AS named,
        CASE WHEN {any_in('low', lx.BROKER_KEYWORDS)} THEN 'BROKER_CALL'
             WHEN {any_in('low', lx.MACRO_KEYWORDS)} THEN 'MACRO'
             WHEN {any_in('low', lx.FUND_KEYWORDS)} THEN 'FUND_FLOW'
             WHEN {any_in('low', lx.GLOBAL_KEYWORDS)} THEN 'GLOBAL'
             ELSE 'PRICE_ACTION' END AS event_type,
        CASE WHEN {any_in('low', lx.NEGATIVE_WORDS)} THEN 'NEGATIVE'
             WHEN {any_in('low', lx.POSITIVE_WORDS)} THEN 'POSITIVE'
             ELSE 'NEUTRAL' END AS sentiment,
        'SHORT_TERM' AS impact_horizon, 0.55::DOUBLE AS confidence,
        {q(lx.RULE_REASONING)} AS reasoning
      FROM (SELECT *, lower(full_text) AS low FROM news))""", "news")
cte("rules", f"""
    SELECT * EXCLUDE (named, low, listed), array_to_string(listed, '|') AS mentioned,
      {clean_list('listed')} AS stocks,
      CASE WHEN len(named) = 0 THEN 'WATCH' WHEN sentiment = 'NEGATIVE' THEN 'SELL'
           WHEN sentiment = 'POSITIVE' THEN 'BUY' ELSE 'WATCH' END AS suggestion
    FROM ruled""", "ruled")


def enum(field: str, allowed, default: str) -> str:
    v = f"json_extract_string(js, '$.{field}')"
    return f"CASE WHEN {v} IN {in_list(allowed)} THEN {v} ELSE '{default}' END"


cte("answered", f"""
    SELECT *, CASE WHEN raw IS NULL THEN 'rules' WHEN slice = '' THEN 'blank'
                   WHEN NOT json_valid(slice) THEN 'rules'
                   WHEN js::VARCHAR = '{{}}' THEN 'blank'
                   WHEN conf IS NULL THEN 'rules' ELSE 'response' END AS origin
    FROM (
      SELECT *, CASE WHEN json_exists(js, '$.confidence')
                     THEN try_cast(json_extract_string(js, '$.confidence') AS DOUBLE)
                     ELSE 0.5 END AS conf
      FROM (
        SELECT *, CASE WHEN slice <> '' THEN slice::JSON END AS js
        FROM (SELECT *, {pick('doc_id', samples.RESPONSES)} AS raw,
                regexp_extract({pick('doc_id', samples.RESPONSES)}, '(?s)\\{{.*\\}}', 0) AS slice
              FROM ruled)))""", "ruled")
cte("response_lists", f"""
    SELECT * EXCLUDE (event_type, sentiment, impact_horizon, confidence, reasoning, listed),
      CASE WHEN origin <> 'response' THEN event_type
           WHEN event_type = 'BROKER_CALL' THEN 'BROKER_CALL'
           ELSE {enum('event_type', lx.EVENT_TYPES, 'PRICE_ACTION')} END AS event_type,
      CASE WHEN origin <> 'response' THEN sentiment
           ELSE {enum('sentiment', lx.SENTIMENTS, 'NEUTRAL')} END AS sentiment,
      CASE WHEN origin <> 'response' THEN impact_horizon
           ELSE {enum('impact_horizon', lx.HORIZONS, 'SHORT_TERM')} END AS impact_horizon,
      CASE WHEN origin <> 'response' THEN confidence
           ELSE greatest(0.0, least(conf, 0.95))::DOUBLE END AS confidence,
      CASE WHEN origin <> 'response' THEN reasoning
           ELSE substr(coalesce(json_extract_string(js, '$.reasoning'),
                                {q(lx.NO_REASONING)}), 1, 600) END AS reasoning,
      CASE WHEN origin = 'rules' THEN listed WHEN origin = 'blank' THEN listed[1:8]
           WHEN json_type(js, '$.stocks') = 'VARCHAR'
             THEN [json_extract_string(js, '$.stocks')]
           WHEN coalesce(json_array_length(js, '$.stocks'), 0) = 0 THEN ['{lx.MARKET_TICKER}']
           ELSE json_extract_string(js, '$.stocks[*]')[1:8] END AS listed,
      CASE WHEN origin <> 'response'
             THEN CASE sentiment WHEN 'NEGATIVE' THEN 'SELL' WHEN 'POSITIVE' THEN 'BUY'
                                 ELSE 'WATCH' END
           ELSE {enum('suggestion', lx.SUGGESTIONS, 'WATCH')} END AS asked
    FROM answered""", "answered")
cte("responses", f"""
    SELECT * EXCLUDE (listed, asked), array_to_string(listed, '|') AS listed,
      CASE WHEN len(stocks) = 0 THEN 'WATCH' ELSE asked END AS suggestion
    FROM (SELECT *, {clean_list('listed')} AS stocks FROM response_lists)""", "response_lists")


def parts(name: str, source: str) -> None:
    detail = (
        rf"(^|[^\p{{L}}\p{{N}}\p{{M}}_])(rs|crore|lakh|q[1-4]|fy\p{{Nd}}{{2}})"
        rf"($|[^\p{{L}}\p{{N}}\p{{M}}_])|{WORD}[₹$%]{WORD}"
    )
    cte(name, f"""
    SELECT *,
      least(92, greatest(40,
        CASE WHEN len(stocks) BETWEEN 1 AND 3 THEN 72 WHEN len(stocks) > 3 THEN 62 ELSE 54 END
        + CASE WHEN word_count >= 35 THEN 10 ELSE 0 END
        + CASE WHEN regexp_matches(txt, '{detail}') THEN 10 ELSE 0 END)) AS specificity,
      least(900, greatest(420, 620 + 55 * least(strong_hits, 4) - 40 * least(weak_hits, 3)))
        AS language,
      CASE WHEN (suggestion = 'BUY' AND sentiment = 'POSITIVE')
             OR (suggestion = 'SELL' AND sentiment = 'NEGATIVE') THEN 90
           WHEN suggestion IN ('HOLD', 'WATCH') AND sentiment = 'NEUTRAL' THEN 82
           WHEN suggestion IN ('BUY', 'SELL') AND sentiment = 'NEUTRAL' THEN 55
           ELSE 72 END AS consistency,
      CASE WHEN age IS NULL THEN 58 WHEN age <= 21600 THEN 94 WHEN age <= 86400 THEN 84
           WHEN age <= 259200 THEN 68 ELSE 46 END AS fresh,
      CASE WHEN age IS NULL THEN 'unknown age' WHEN age <= 21600 THEN 'fresh'
           WHEN age <= 86400 THEN 'same day' WHEN age <= 259200 THEN 'recent'
           ELSE 'stale' END AS fresh_reason
    FROM (
      SELECT *, len(regexp_extract_all(txt, '[a-z0-9]+')) AS word_count,
        {hits('txt', lx.STRONG_WORDS)} AS strong_hits,
        {hits('txt', lx.WEAK_WORDS)} AS weak_hits,
        epoch({AS_OF}) - epoch(coalesce({ts('published_at')}, {ts('fetched_at')})) AS age
      FROM (SELECT *, lower(headline || ' ' || full_text) AS txt FROM {source}))""", source)


def scored(name: str, source: str, model: str) -> None:
    parts(f"{name}_parts", source)
    cte(name, f"""
    SELECT * EXCLUDE (h, confidence), h / 100.0 AS confidence, 
      CASE suggestion WHEN 'BUY' THEN h WHEN 'SELL' THEN -h ELSE 0 END::DOUBLE AS signal_score,
      CASE WHEN event_type IN ('GLOBAL', 'MACRO') OR impact_horizon = 'INTRADAY' THEN 'HIGH'
           WHEN suggestion IN ('BUY', 'SELL') OR len(stocks) > 3 THEN 'MEDIUM'
           ELSE 'LOW' END AS risk_level,
      CASE WHEN h >= 82 AND suggestion IN ('BUY', 'SELL') THEN 'HIGH'
           WHEN h >= 68 OR suggestion IN ('BUY', 'SELL') THEN 'MEDIUM' ELSE 'LOW' END AS priority,
      list_filter([source || ' source', fresh_reason,
        lower(replace(event_type, '_', ' ')) || ' event',
        CASE WHEN strong_hits > 0 THEN 'strong market wording' END,
        CASE WHEN specificity >= 75 THEN 'specific stock or numeric detail' END,
        CASE WHEN consistency >= 88 THEN 'sentiment matches action' END,
        CASE WHEN weak_hits > 0 THEN 'speculative wording penalty' END],
        lambda x: x IS NOT NULL)[1:5] AS confidence_reasons,
      '{model}' AS model_name, '{samples.AS_OF}' AS processed_at,
      {ts('coalesce(published_at, fetched_at)')} AS feed_time,
      {ts("coalesce(published_at, fetched_at)")} AS signal_time
    FROM (
      SELECT *, ((least(95000, greatest(35000,
          140 * {lookup('source', lx.SOURCE_RELIABILITY, lx.SOURCE_DEFAULT)}
          + 120 * {lookup('event_type', lx.EVENT_WEIGHT, lx.EVENT_DEFAULT)}
          + 100 * {lookup('suggestion', lx.ACTION_WEIGHT, lx.ACTION_DEFAULT)}
          + 180 * fresh + 180 * specificity + 16 * language + 120 * consistency
          + CASE WHEN confidence = 0 OR confidence < 0.6 THEN -5000
                 WHEN confidence > 0.9 THEN 2500 ELSE 0 END)) + 500) // 1000)::INT AS h
      FROM {name}_parts)""", f"{name}_parts")


scored("signals", "rules", "rules")
scored("rsignals", "responses", "responses")

NEWEST = "feed_time DESC NULLS LAST, news_id"
cte("feed", f"""
    SELECT *, row_number() OVER (ORDER BY {NEWEST}) AS feed_pos
    FROM signals ORDER BY {NEWEST} LIMIT 250""", "signals")
cte("shown", """SELECT * FROM feed WHERE signal_time IS NOT NULL""", "feed")

BRIEF = (
    "news_id, source, suggestion, priority, confidence, signal_score, "
    "array_to_string(stocks, '|') AS stocks"
)


def top(filters: str) -> str:
    return f"FROM signals WHERE {filters} ORDER BY {NEWEST} LIMIT 250"


def mentions(name: str, source: str) -> None:
    cte(name, f"""
    SELECT ticker, count(*) AS n,
      min(row(feed_time IS NULL, -epoch(coalesce(feed_time, TIMESTAMP '1970-01-01')),
              news_id, i)) AS first_seen
    FROM (SELECT feed_time, news_id, unnest(stocks) AS ticker,
                 generate_subscripts(stocks, 1) AS i FROM {source})
    GROUP BY ticker""", source)


mentions("rmentions", "rsignals")
cte("asked", """
    SELECT ticker, row_number() OVER (ORDER BY first_seen) AS pos
    FROM rmentions ORDER BY first_seen LIMIT 12""", "rmentions")


def escape(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = f"replace({x}, {q(a)}, '{b}')"
    return x


def counts(source: str, dims: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {c} AS value, count(*) AS n FROM {source} GROUP BY {c}"
        for d, c in dims.items()
    )


DIMS = {
    "suggestions": "suggestion", "sentiments": "sentiment", "event_types": "event_type",
    "priorities": "priority", "risks": "risk_level",
}


def mean(total: str, places: int) -> str:
    """Half-up mean of whole units given ``places`` decimals below the result."""
    return f"((2 * {total} + count(*)) // (2 * count(*)))::BIGINT / {10 ** places}.0"


ORACLE: dict[str, str] = {}

ORACLE["clean_html_pages"] = f"SELECT page_id, {clean('html')} AS clean_text FROM pages"
ORACLE["stable_ids"] = sql(
    f"""SELECT pos AS page_id, {uuid5("source || ':' || CASE WHEN link <> '' THEN link WHEN id <> '' THEN id ELSE title END")}
    AS news_id FROM feed_entries""", "feed_entries")
ORACLE["feed_first_n"] = sql(
    """SELECT source, pos, title FROM (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS n FROM feed_entries)
    WHERE n <= 30 AND title <> ''""", "feed_entries")
ORACLE["news_items"] = sql("SELECT * FROM items", "items")
ORACLE["source_health"] = sql(
    f"""SELECT f.source, f.url, CASE WHEN n IS NULL THEN 'error' ELSE 'ok' END AS status,
      coalesce(n, 0) AS item_count,
      CASE WHEN n IS NULL THEN '{lx.FEED_FAILED}' ELSE '' END AS error,
      '{samples.AS_OF}' AS checked_at
    FROM (VALUES {", ".join(f"({q(s)}, {q(u)})" for s, u in
                            [*lx.FEEDS.items(), ("QuietWire", "https://quiet.example.com/rss")])})
      f(source, url)
    LEFT JOIN (SELECT source, count(*) AS n FROM feed_entries GROUP BY 1) c
      ON f.source = c.source""", "feed_entries")
ORACLE["new_news_anti_join"] = sql(
    """SELECT news_id, min(doc_id) AS doc_id FROM news
    WHERE news_id NOT IN (SELECT news_id FROM news WHERE doc_id IN (SELECT doc_id FROM labels))
    GROUP BY news_id""", "news")
ORACLE["json_arrays"] = sql(
    """SELECT doc_id, encoded, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE len(stocks) END AS n,
      CASE WHEN doc_id % 7 = 0 THEN '' ELSE array_to_string(stocks, '|') END AS decoded
    FROM (SELECT *, to_json(stocks)::VARCHAR AS encoded FROM signals)""", "signals")

cte("docwords", """
    SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS fp,
      len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens
    FROM documents""")
ORACLE["tokens_fingerprints"] = sql(
    """SELECT doc_id, n_tokens, len(fp) AS n_words,
      md5(array_to_string(list_sort(fp), ' ')) AS words_md5 FROM docwords""", "docwords")
ORACLE["jaccard_adjacent_turns"] = """
WITH t AS (
  SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS fp
  FROM conversations),
p AS (
  SELECT a.conv_id, a.turn, len(list_intersect(a.fp, b.fp)) AS overlap,
    len(list_distinct(list_concat(a.fp, b.fp))) AS union_size
  FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)
SELECT conv_id, turn, overlap, union_size,
  CASE WHEN union_size > 0 THEN overlap * 10000 // union_size ELSE 0 END AS jaccard_1e4,
  union_size > 0 AND overlap * 100 >= union_size * 82 AS duplicate
FROM p"""

# Greedy dedup: rows that have an earlier match are taken one by one, in order,
# against the list of rows kept so far; the others are kept from the start.
cte("words", "SELECT doc_id, len(fp) AS n, unnest(fp) AS w FROM docwords", "docwords")
cte("near", """
    SELECT b.doc_id AS id, a.doc_id AS other
    FROM words a JOIN words b ON a.w = b.w AND a.doc_id < b.doc_id
      AND b.n * 100 >= a.n * 82 AND a.n * 100 >= b.n * 82
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING count(*) * 182 >= 82 * (a.n + b.n)""", "words")


def greedy(pairs: str, mark: str = "") -> None:
    """CTEs that walk through the pair table; ``dropped`` is the last state."""
    cte(f"late{mark}", f"""
    SELECT id, list(other) AS others, row_number() OVER (ORDER BY id) AS step
    FROM {pairs} GROUP BY id""", pairs)
    cte(f"walk{mark}", f"""
    SELECT 0::BIGINT AS step, []::BIGINT[] AS dropped
    UNION ALL
    SELECT l.step,
      CASE WHEN len(list_filter(l.others, lambda o: NOT list_contains(walk{mark}.dropped, o))) > 0
           THEN list_append(walk{mark}.dropped, l.id) ELSE walk{mark}.dropped END
    FROM walk{mark} JOIN late{mark} l ON l.step = walk{mark}.step + 1""", f"late{mark}")
    cte(f"dropped{mark}", f"SELECT unnest(dropped) AS id FROM walk{mark} WHERE step = (SELECT max(step) FROM walk{mark})",
        f"walk{mark}")


greedy("near")
cte("doc_flags", """
    SELECT doc_id, len(fp) AS fp_size,
      len(fp) > 0 AND row_number() OVER (PARTITION BY list_sort(fp) ORDER BY doc_id) > 1
        AS exact_copy,
      doc_id NOT IN (SELECT id FROM dropped) AS kept
    FROM docwords""", "docwords", "dropped")
ORACLE["lexical_dedup_kept"] = sql("SELECT * FROM doc_flags", "doc_flags", recursive=True)

# Two runs: the place of a document is its rank with the labelled ones first.
cte("places", """
    SELECT doc_id, row_number() OVER (ORDER BY doc_id NOT IN (SELECT doc_id FROM labels), doc_id) AS place FROM documents""")
cte("near2", """
    SELECT greatest(a.place, b.place) AS id, least(a.place, b.place) AS other
    FROM near n JOIN places a ON a.doc_id = n.id JOIN places b ON b.doc_id = n.other""", "near", "places")
greedy("near2", "2")
ORACLE["incremental_dedup_kept"] = sql(
    """SELECT doc_id, len(fp) AS fp_size, place NOT IN (SELECT id FROM dropped2) AS kept
    FROM docwords JOIN places USING (doc_id)""", "docwords", "places", "dropped2", recursive=True)
cte("left_over", "SELECT * FROM signals WHERE doc_id IN (SELECT doc_id FROM doc_flags WHERE kept)",
    "signals", "doc_flags")
ORACLE["deduped_signal_counts"] = sql(counts("left_over", DIMS), "left_over", recursive=True)

cte("close_vectors", f"""
    SELECT b.vec_id AS id, a.vec_id AS other
    FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
    WHERE list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) < sqrt({VECTOR_THRESHOLD})""")
greedy("close_vectors")
ORACLE["vector_dedup_kept"] = sql(
    "SELECT vec_id, vec_id NOT IN (SELECT id FROM dropped) AS kept FROM embeddings",
    "dropped", recursive=True)
cte("vec_places", "SELECT vec_id, row_number() OVER (ORDER BY label % 2, vec_id) AS place FROM embeddings")
cte("close3", """
    SELECT greatest(a.place, b.place) AS id, least(a.place, b.place) AS other
    FROM close_vectors c JOIN vec_places a ON a.vec_id = c.id JOIN vec_places b ON b.vec_id = c.other""",
    "close_vectors", "vec_places")
greedy("close3", "3")
ORACLE["incremental_vectors_kept"] = sql(
    "SELECT vec_id, place NOT IN (SELECT id FROM dropped3) AS kept FROM vec_places", "vec_places", "dropped3", recursive=True)

cte("raw_tickers", f"""
    SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS n
    FROM (SELECT doc_id, json_extract_string(raw, '$.stocks[*]') AS l
          FROM (SELECT doc_id, {pick('doc_id', samples.RESPONSES)} AS raw FROM documents)
          WHERE json_valid(raw))""")
ORACLE["ticker_normalize"] = sql(
    f"""SELECT doc_id, n, raw, ticker, ticker IS NOT NULL AS tradable
    FROM (SELECT *, {ticker('raw')} AS ticker FROM raw_tickers)""", "raw_tickers")
EXTRACTED = "news_id, event_type, sentiment, impact_horizon, suggestion, confidence"
ORACLE["rule_extract"] = sql(
    f"SELECT {EXTRACTED}, mentioned, array_to_string(stocks, '|') AS stocks FROM rules", "rules")
ORACLE["response_normalize"] = sql(
    f"""SELECT {EXTRACTED}, origin, listed, array_to_string(stocks, '|') AS stocks, reasoning
    FROM responses""", "responses")
ORACLE["keyword_hits"] = sql(
    f"""SELECT keyword, count(*) AS n
    FROM (SELECT lower(full_text) AS low FROM news), (SELECT unnest({array(ALL_KEYWORDS)}) AS keyword)
    WHERE contains(low, keyword) GROUP BY 1""", "news")
ORACLE["keyword_table_hits"] = """
WITH keywords AS (
  SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]{7,}')) AS keyword FROM documents)
SELECT keyword, count(*) AS n FROM keywords JOIN (SELECT lower(text) AS low FROM documents) ON contains(low, keyword)
GROUP BY keyword"""
ORACLE["freshness"] = sql(
    "SELECT news_id, fresh AS score, fresh_reason AS reason FROM signals", "signals")
ORACLE["specificity_language"] = sql(
    """SELECT news_id, word_count, specificity, strong_hits, weak_hits, language, consistency
    FROM signals_parts""", "signals_parts")
SCORED = """SELECT news_id, array_to_string(stocks, '|') AS stocks, event_type, sentiment,
  impact_horizon, suggestion, confidence, signal_score, priority, risk_level,
  array_to_string(confidence_reasons, '|') AS confidence_reasons, model_name, processed_at FROM """
ORACLE["score_signals"] = sql(SCORED + "signals", "signals")
ORACLE["score_responses"] = sql(SCORED + "rsignals", "rsignals")

ORACLE["signal_feed"] = sql(
    """SELECT news_id, source, headline, full_text, url, published_at, fetched_at,
      array_to_string(stocks, '|') AS stocks, event_type, sentiment, impact_horizon, suggestion,
      confidence, signal_score, priority, risk_level,
      array_to_string(confidence_reasons, '|') AS confidence_reasons,
      NULL::DOUBLE AS price_at_signal, NULL::DOUBLE AS price_change_pct, reasoning, model_name,
      strftime(feed_time, '%Y-%m-%d %H:%M:%S') AS feed_time
    FROM feed""", "feed")
ORACLE["feed_filtered"] = sql(
    f"""SELECT {BRIEF}, event_type
    {top("suggestion = 'SELL' AND source = 'LiveMint' AND confidence >= 0.7")}""", "signals")
ORACLE["stock_history"] = sql(
    f"""SELECT {BRIEF} {top("array_to_string(stocks, ',') || ',' ILIKE '%K.NS%'")}""", "signals")
ORACLE["signal_lookup"] = sql(
    f"""SELECT {BRIEF}, headline FROM signals
    WHERE source = 'EconomicTimes' AND url = 'https://news.example.com/7'""", "signals")
ORACLE["watchlist_feed"] = sql(
    f"""SELECT {BRIEF}, feed_pos FROM feed
    WHERE list_has_any(stocks, ['SBIN.NS', 'ITC.NS', 'INFY.NS'])""", "feed")
ORACLE["search_feed"] = sql(
    f"""SELECT {BRIEF}, feed_pos FROM feed
    WHERE contains(lower(concat_ws(' ', headline, source, reasoning, event_type, sentiment,
      suggestion, priority, risk_level, array_to_string(stocks, ' '))), 'block deal')""", "feed")


def within(first: str, last: str) -> str:
    return (
        f"coalesce(signal_time >= TIMESTAMP '{first}' AND signal_time < TIMESTAMP '{last}', FALSE)"
    )


# The reader's clock stands at 2024-01-30 04:00 UTC.
ORACLE["date_presets"] = sql(
    f"""SELECT news_id, signal_time IS NOT NULL AS readable,
      {within('2024-01-30', '2024-01-31')} AS in_today,
      {within('2024-01-29', '2024-01-30')} AS in_yesterday,
      {within('2024-01-24', '2024-01-31')} AS in_last7,
      {within('2024-01-01', '2024-01-31')} AS in_last30,
      {within('2024-01-23 18:30:00', '2024-01-30 18:30:00')} AS in_last7_kolkata
    FROM signals""", "signals")
ORACLE["date_custom"] = sql(
    f"""SELECT {BRIEF}, published_at FROM signals
    WHERE confidence >= 0.6 AND {within('2024-01-10', '2024-01-21')}""", "signals")

SORTS = {
    "newest": "signal_time DESC", "oldest": "signal_time",
    "score": "abs(signal_score) DESC", "confidence": "confidence DESC",
    "priority": "CASE priority WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END "
                "DESC, abs(signal_score) DESC, confidence DESC, signal_time DESC",
}
for mode, keys in SORTS.items():
    ORACLE[f"feed_sorted_{mode}"] = sql(
        f"SELECT {BRIEF}, row_number() OVER (ORDER BY {keys}, feed_pos) AS rank FROM shown",
        "shown")
ORACLE["day_groups"] = sql(
    """SELECT news_id, day_label, starts_group,
      sum(starts_group::INT) OVER (ORDER BY signal_time DESC, feed_pos)::BIGINT AS group_no,
      'SHORT TERM' AS horizon_label
    FROM (SELECT *, day_label IS DISTINCT FROM
            lag(day_label) OVER (ORDER BY signal_time DESC, feed_pos) AS starts_group
          FROM (SELECT *, strftime(signal_time, '%a, %d %b %Y') AS day_label FROM shown))""",
    "shown")

TOTALS = """count(*) AS total, count(*) FILTER (suggestion = 'BUY') AS buy,
  count(*) FILTER (suggestion = 'SELL') AS sell"""
SUM_CONF = "sum(round(confidence * 100)::BIGINT)"
SUM_SCORE = "sum(abs(signal_score)::BIGINT)"
ORACLE["kpi_summary"] = sql(
    f"""SELECT {TOTALS}, count(*) FILTER (suggestion = 'WATCH') AS watch,
      count(*) FILTER (suggestion = 'HOLD') AS hold,
      {mean(SUM_CONF, 2)} AS avg_confidence, {mean('10 * ' + SUM_SCORE, 1)} AS avg_score,
      count(*) FILTER (priority = 'HIGH') AS high_priority
    FROM rsignals""", "rsignals")
ORACLE["dimension_counts"] = sql(counts("rsignals", DIMS), "rsignals")
cte("confident", "SELECT * FROM shown WHERE confidence >= 0.7", "shown")
ORACLE["client_summary"] = sql(
    f"""SELECT {TOTALS}, count(*) FILTER (priority = 'HIGH') AS high_priority,
      ({SUM_CONF} / 100.0)::DOUBLE / count(*) AS avg_confidence,
      {SUM_SCORE}::DOUBLE / count(*) AS avg_score
    FROM confident""", "confident")
ORACLE["client_dimension_counts"] = sql(
    counts("confident", {k: v for k, v in DIMS.items() if k != "sentiments"}), "confident")
ORACLE["shown_of_total"] = sql(
    f"""SELECT count(*) FILTER (confidence >= 0.7 AND {within('2024-01-02', '2024-02-01')}) AS shown,
      count(*) AS total FROM signals""", "signals")
ORACLE["top_stocks"] = sql(
    """SELECT row_number() OVER (ORDER BY n DESC, first_seen) AS rank, ticker, n,
      ((n * 200 + max(n) OVER ()) // (2 * max(n) OVER ()))::BIGINT AS share_pct
    FROM (SELECT * FROM rmentions ORDER BY n DESC, first_seen LIMIT 8)""", "rmentions")
ORACLE["facets"] = sql(
    " UNION ".join(
        f"SELECT '{f}' AS field, {f} AS value FROM rsignals WHERE {f} <> ''"
        for f in ("event_type", "sentiment", "suggestion", "priority", "risk_level")), "rsignals")
ORACLE["quote_tickers"] = sql("SELECT * FROM asked", "asked")
ORACLE["client_quote_tickers"] = sql(
    """SELECT ticker, row_number() OVER (ORDER BY first_seen) AS pos
    FROM rmentions WHERE ticker LIKE '%.NS' ORDER BY first_seen LIMIT 12""", "rmentions")
ORACLE["action_queue"] = sql(
    f"""SELECT {BRIEF} FROM rsignals WHERE suggestion IN ('BUY', 'SELL')
    ORDER BY priority = 'HIGH' DESC, abs(signal_score) DESC, confidence DESC, {NEWEST}
    LIMIT 6""", "rsignals")
ORACLE["action_queue_client"] = sql(
    f"""SELECT {BRIEF} FROM shown WHERE suggestion IN ('BUY', 'SELL')
    ORDER BY abs(signal_score) DESC, signal_time, feed_pos LIMIT 6""", "shown")

ORACLE["daily_bars"] = sql(
    "SELECT ticker, day::VARCHAR AS day, close, volume, n FROM recent WHERE n <= 5", "recent")
ORACLE["quote_snapshot"] = sql(
    """SELECT q.ticker, q.close, q.change_pct, q.volume, a.pos
    FROM asked a JOIN quotes q ON a.ticker = q.ticker
    WHERE a.pos <= 16 AND (a.ticker LIKE '%.NS' OR a.ticker LIKE '^%')""", "asked", "quotes")
ORACLE["price_at_signal"] = sql(
    f"""SELECT s.news_id, array_to_string(s.stocks, '|') AS stocks, p.close AS price_at_signal,
      p.change_pct AS price_change_pct,
      CASE WHEN p.close IS NOT NULL THEN '{samples.AS_OF}' END AS price_checked_at
    FROM rsignals s LEFT JOIN (
      SELECT news_id, arg_min(q.close, i) AS close, arg_min(q.change_pct, i) AS change_pct
      FROM (SELECT news_id, unnest(stocks) AS ticker, generate_subscripts(stocks, 1) AS i
            FROM rsignals) t JOIN quotes q ON q.ticker = t.ticker
      WHERE i <= 4 GROUP BY news_id) p ON p.news_id = s.news_id""", "rsignals", "quotes")

cte("new_rows", """SELECT news_id, suggestion, confidence, doc_id::DOUBLE AS price_at_signal
    FROM signals WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality <> 1)""", "signals")
cte("old_rows", """
    SELECT news_id, 'WATCH' AS suggestion, 0.5::DOUBLE AS confidence,
      CASE WHEN toxic = 0 THEN 1.25::DOUBLE END AS price_at_signal
    FROM signals JOIN labels USING (doc_id)""", "signals")
ORACLE["upsert_ignore"] = sql(
    """SELECT * FROM old_rows UNION ALL
    SELECT * FROM new_rows WHERE news_id NOT IN (SELECT news_id FROM old_rows)""",
    "old_rows", "new_rows")
ORACLE["upsert_last"] = sql(
    """SELECT news_id, suggestion, 0.35::DOUBLE AS confidence, price_at_signal, 2 AS version
    FROM new_rows
    UNION ALL SELECT *, 0 FROM old_rows WHERE news_id NOT IN (SELECT news_id FROM new_rows)""", "new_rows", "old_rows")
ORACLE["upsert_first_price"] = sql(
    """SELECT n.news_id, n.suggestion, n.confidence,
      coalesce(o.price_at_signal, n.price_at_signal) AS price_at_signal
    FROM new_rows n LEFT JOIN old_rows o USING (news_id)
    UNION ALL SELECT * FROM old_rows WHERE news_id NOT IN (SELECT news_id FROM new_rows)""", "new_rows", "old_rows")
ORACLE["referenced_signals"] = sql(
    "SELECT news_id, suggestion FROM signals WHERE doc_id IN (SELECT doc_id FROM labels)",
    "signals")
ORACLE["schema_evolve"] = sql(
    """SELECT *, NULL::DOUBLE AS signal_score, NULL::VARCHAR AS priority,
      NULL::VARCHAR AS risk_level, NULL::DOUBLE AS price_change_pct FROM old_rows""", "old_rows")

cte("log", f"""
    SELECT news_id, 'local' AS channel, 'recorded' AS status, 'earlier: ' || headline AS message,
      strftime({AS_OF} - to_seconds(doc_id % 86400), '%Y-%m-%d %H:%M:%S') AS sent_at
    FROM news JOIN labels USING (doc_id) WHERE quality = 1""", "news")
cte("due", """SELECT * FROM rsignals WHERE priority = 'HIGH' AND suggestion IN ('BUY', 'SELL')
    AND abs(signal_score) >= 80""", "rsignals")
MESSAGE = """suggestion || ' ' || array_to_string(stocks, ', ') || ' score ' || signal_score
  || ' confidence ' || confidence::DOUBLE || ': ' || headline AS message"""
ORACLE["alerts_new"] = sql(
    """SELECT news_id, 'local' AS channel, 'recorded' AS status FROM due
    WHERE news_id NOT IN (SELECT news_id FROM log)
    UNION ALL SELECT news_id, 'webhook', 'recorded' FROM due""", "due", "log")
ORACLE["alert_messages"] = sql(
    f"""SELECT news_id, 'local' AS channel, 'recorded' AS status, {MESSAGE},
      '{samples.AS_OF}' AS sent_at FROM due""", "due")


def line(label: str, value: str) -> str:
    return f"'<b>{label}:</b> ' || {value}"


ORACLE["notification_html"] = sql(
    "SELECT news_id, substr(concat_ws(chr(10), " + ", ".join([
        "'<b>New Signal</b>'",
        line("Headline", escape("headline")), line("Source", escape("source")),
        line("Published", escape("coalesce(published_at, fetched_at)")),
        line("Stocks", escape("CASE WHEN len(stocks) = 0 THEN 'No tradable ticker' "
                              "ELSE array_to_string(stocks, ', ') END")),
        line("Suggestion", "suggestion"), line("Sentiment", "sentiment"),
        line("Event", "event_type"), line("Horizon", "impact_horizon"),
        line("Priority", "priority"), line("Risk", "risk_level"),
        line("Confidence", "printf('%.2f', confidence::DOUBLE)"),
        line("Action Score", "printf('%.1f', signal_score)"),
        line("Reasoning", escape("reasoning")),
        "'<b>Confidence Notes:</b>'",
        f"array_to_string(list_transform(confidence_reasons[1:4], "
        f"lambda r: '- ' || {escape('r')}), chr(10))",
        f"CASE WHEN url <> '' THEN {line('Link', escape('url'))} END",
    ]) + "), 1, 3900) AS message FROM rsignals", "rsignals")
ORACLE["alert_log_top"] = sql(
    "SELECT * FROM log ORDER BY sent_at DESC, news_id, channel LIMIT 50", "log")

ORACLE["run_stats"] = sql(
    """SELECT 2 * count(*) AS fetched, count(DISTINCT news_id) AS inserted,
      2 * count(*) - count(*) FILTER (pos % 31 = 0) - count(DISTINCT news_id) AS duplicates,
      count(DISTINCT news_id) AS processed, count(*) FILTER (pos % 31 = 0) AS errors, 'ok' AS status FROM items""", "items")
ORACLE["run_twice"] = sql(
    """SELECT news_id, arg_min(source, pos) AS source, arg_min(headline, pos) AS headline,
      arg_min(full_text, pos) AS full_text, arg_min(url, pos) AS url,
      arg_min(row(published_at), pos)[1] AS published_at, 1 AS n_signals, 1 AS n_keys
    FROM items GROUP BY news_id""", "items")
ORACLE["alerts_outbox"] = sql(
    """SELECT news_id, 'webhook' AS channel, 'sent' AS status, 1 AS n_handed FROM due
    UNION ALL SELECT news_id, 'telegram', 'unconfirmed', 1 FROM due""", "due")
ORACLE["stream_signals"] = sql(
    """SELECT news_id, array_to_string(stocks, '|') AS stocks, suggestion, confidence,
      signal_score, priority FROM signals""", "signals")
ORACLE["stream_alerts_once"] = ORACLE["stream_alerts_expiring"] = sql(f"SELECT news_id, {MESSAGE} FROM due", "due")


# --- result documents: JSON texts in which a missing value leaves its field out ---

SIGNAL_FIELDS = {
    **{c: c for c in ("news_id", "source", "headline", "full_text", "url", "published_at", "fetched_at", "stocks", "event_type",
                      "sentiment", "impact_horizon", "suggestion")},
    "confidence": "confidence::DOUBLE", "signal_score": "signal_score",
    **{c: c for c in ("priority", "risk_level", "confidence_reasons", "reasoning", "model_name")},
    "processed_at": f"'{samples.AS_OF.replace(' ', 'T')}.000Z'",
}
SIGNAL_JSON = ("json_merge_patch('{}', json_object(" + ", ".join(f"'{k}', {v}" for k, v in SIGNAL_FIELDS.items()) + "))::VARCHAR")


def listed(rows: str, value: str, order: str) -> str:
    return f"(SELECT '[' || coalesce(string_agg({value}, ',' ORDER BY {order}), '') || ']' FROM {rows})"


def counted(rows: str, column: str) -> str:
    return (f"(SELECT '{{' || coalesce(string_agg(to_json({column})::VARCHAR || ':' || n, ',' ORDER BY {column}), '') || '}}' "
            f"FROM (SELECT {column}, count(*) AS n FROM {rows} GROUP BY {column}))")


def document(rows: str, ticker: str | None = None) -> str:
    """The document of the CTE ``rows``, which has ``feed_pos``."""
    mentions(f"{rows}_mentions", rows)
    cte(f"{rows}_top", f"SELECT * FROM {rows}_mentions ORDER BY n DESC, first_seen LIMIT 8", f"{rows}_mentions")
    cte(f"{rows}_queue", f"""SELECT * FROM {rows} WHERE suggestion IN ('BUY', 'SELL')
    ORDER BY priority = 'HIGH' DESC, abs(signal_score) DESC, confidence DESC, feed_pos LIMIT 6""", rows)
    kinds = {k: f"count(*) FILTER (suggestion = '{k.upper()}')" for k in ("buy", "sell", "watch", "hold")}
    totals = {
        "total": "count(*)", **kinds, "avg_confidence": f"coalesce({mean(SUM_CONF, 2)}, 0.0)",
        "avg_score": f"coalesce({mean('10 * ' + SUM_SCORE, 1)}, 0.0)", "high_priority": "count(*) FILTER (priority = 'HIGH')"}
    parts = [f"""'"{k}":' || (SELECT to_json({v})::VARCHAR FROM {rows})""" for k, v in totals.items()]
    parts += [f"""'"{k}":' || {counted(rows, v)}""" for k, v in DIMS.items()]
    parts += [
        f"""'"top_stocks":' || {listed(f"{rows}_top", "json_object('ticker', ticker, 'n', n)::VARCHAR", "n DESC, first_seen")}""",
        f"""'"action_queue":' || {listed(f"{rows}_queue", SIGNAL_JSON, "priority = 'HIGH' DESC, abs(signal_score) DESC, confidence DESC, feed_pos")}""",
        f"""'"generated_at":"{samples.AS_OF.replace(' ', 'T')}"'"""]
    head = f"""'"ticker":"{ticker}",' || """ if ticker else ""
    summary = " || ',' || ".join(parts)
    return f"""SELECT '{{' || {head}'"signals":' || {listed(rows, SIGNAL_JSON, "feed_pos")} || ',"summary":{{' || {summary} || '}}}}' AS document"""


cte("stock_rows", f"""SELECT *, row_number() OVER (ORDER BY {NEWEST}) AS feed_pos
    {top("array_to_string(stocks, ',') || ',' ILIKE '%TCS.NS%'")}""", "signals")
ORACLE["result_document"] = sql(document("feed"), "feed", "feed_mentions", "feed_top", "feed_queue")
ORACLE["stock_document"] = sql(document("stock_rows", "TCS.NS"), "stock_rows", "stock_rows_mentions", "stock_rows_top", "stock_rows_queue")

# Regular expressions must not see doubled backslashes.
assert not any(re.search(r"\\\\p\{", text) for text in ORACLE.values())
