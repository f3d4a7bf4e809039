"""DuckDB SQL for those registered operators that SQL can express over whole tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_SPACE = r"[\x20\x09-\x0D]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE["op9_quality_rules"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') || CASE WHEN source IS NULL THEN '?' ELSE '!' END AS host,
         coalesce(text, '') AS body
  FROM documents
), w AS (
  SELECT doc_id, unnest(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+')) AS word,
         generate_subscripts(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+'), 1) AS pos
  FROM d
), n AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY doc_id
), run AS (
  SELECT a.doc_id, a.pos, a.word || ' ' || b.word || ' ' || c.word AS three
  FROM w a JOIN w b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 JOIN w c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2
), again AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, three) AS c
                          FROM run WHERE three IS NOT NULL) WHERE c > 1
), repeated AS (
  SELECT doc_id, count(*) AS n_repeat_words
  FROM (SELECT DISTINCT doc_id, pos + k AS pos FROM again, (VALUES (0), (1), (2)) AS o(k)) GROUP BY doc_id
), line AS (
  SELECT doc_id, host, body, unnest(string_split(body, chr(10))) AS raw FROM d
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines FROM line
  WHERE regexp_matches(raw, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), norm AS (
  SELECT doc_id, host, body,
         trim(regexp_replace(translate(raw, '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS line
  FROM line
), texts AS (
  SELECT host, count(DISTINCT doc_id) AS texts FROM d GROUP BY host
), common AS (
  SELECT host, line FROM (
    SELECT host, line, count(DISTINCT doc_id) AS n_docs FROM norm WHERE line <> '' GROUP BY host, line
  ) JOIN texts USING (host)
  WHERE n_docs > greatest(10, floor(texts / 1000))
), lost AS (
  SELECT doc_id, sum(len(string_split(line, ' '))) AS removed_words
  FROM norm JOIN common USING (host, line) GROUP BY doc_id
), figures AS (
  SELECT d.doc_id, coalesce(n.n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         len(regexp_extract_all(body, '[#*$%&|<>]')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(removed_words, 0) AS removed_words
  FROM d LEFT JOIN n USING (doc_id) LEFT JOIN dup USING (doc_id)
  LEFT JOIN repeated USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND removed_words * 100 <= n_words * 50 AS kept,
       removed_words::BIGINT AS removed_words
FROM figures
"""

ORACLE["op3_line_dedup"] = f"""
WITH line AS (
  SELECT doc_id, pos, lines[pos] AS line,
         translate(regexp_replace(lines[pos], '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines,
               unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS pos
        FROM documents)
), shared AS (
  SELECT k, max(doc_id) AS head FROM line WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, pos, line, head IS NOT NULL AND doc_id <> head AS dropped FROM line LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

# Bytes as pairs of hex digits, so that one character is half a byte wherever a text is cut.
ORACLE["op11_suffix_dedup"] = """
WITH d AS (
  SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), win AS (
  SELECT doc_id, pos, substr(h, 2 * pos + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(generate_series(0, n - 50)) AS pos FROM d WHERE n >= 50)
), gone AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY s) AS head FROM win) WHERE doc_id > head
), step AS (
  SELECT doc_id, pos, coalesce(pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50, true) AS new FROM gone
), span AS (
  SELECT doc_id, min(pos) AS first, max(pos) + 50 AS last
  FROM (SELECT doc_id, pos, count(*) FILTER (WHERE new) OVER (PARTITION BY doc_id ORDER BY pos) AS number FROM step)
  GROUP BY doc_id, number
), piece AS (
  SELECT doc_id, last AS begin, lead(first) OVER (PARTITION BY doc_id ORDER BY first) AS finish FROM span
  UNION ALL SELECT doc_id, 0, min(first) FROM span GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * begin + 1, 2 * (coalesce(finish, n) - begin)), '' ORDER BY begin) AS rest
  FROM piece JOIN d USING (doc_id) GROUP BY doc_id
), total AS (
  SELECT doc_id, sum(last - first) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN total USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE["op12_source_audit"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS body
  FROM documents
), word AS (
  SELECT row, lang, source, unnest(regexp_extract_all(body, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM word GROUP BY lang, term HAVING count(DISTINCT row) >= 10
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), here AS (
  SELECT DISTINCT lang, source FROM d
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM word SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), sizes AS (
  SELECT lang, source, sum(n) AS size FROM counted GROUP BY lang, source
), every AS (
  SELECT h.lang, h.source, k.term, coalesce(c.n, 0) AS n, coalesce(s.size, 0) + 2 * l.v AS whole,
         k.n AS lang_n, l.total + 2 * l.v AS lang_whole
  FROM here h JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN sizes s ON s.lang = h.lang AND s.source = h.source
  LEFT JOIN counted c ON c.lang = h.lang AND c.source = h.source AND c.term = k.term
), shares AS (
  SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 2) // whole) AS p,
         (1 + 1000000000::HUGEINT * (lang_n + 2) // lang_whole) AS q
  FROM every
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM here a JOIN here b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
"""

ORACLE["op13_lexical_search"] = f"""
WITH word AS (
  SELECT row, doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'),
                                                '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, * FROM documents)
), size AS (
  SELECT row, doc_id, count(*) AS n FROM word GROUP BY row, doc_id
), whole AS (
  SELECT count(*) AS docs, sum(n) AS terms FROM size
), wanted AS (
  SELECT DISTINCT item, item_id, term FROM (
    SELECT item, item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'),
                                                    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS item, * FROM benchmark))
), posting AS (
  SELECT row, term, count(*) AS tf FROM word SEMI JOIN wanted USING (term) GROUP BY row, term
), weight AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM posting, whole GROUP BY term
), value AS (
  SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n::HUGEINT * docs) // terms))) AS v
  FROM posting JOIN size USING (row) JOIN weight USING (term), whole
), score AS (
  SELECT item, item_id, row, doc_id, sum(v) AS score FROM wanted JOIN value USING (term) GROUP BY item, item_id, row, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score::BIGINT AS score FROM ranked WHERE rank <= 10
"""
