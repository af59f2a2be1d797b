"""DuckDB SQL of the queries that SQL expresses in reasonable time."""

from __future__ import annotations

import string

from .rules import RULES

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def lower(x: str) -> str:
    """A-Z only."""
    return f"translate({x}, '{UPPER}', '{LOWER}')"


OP1 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
keyed AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM windows),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM keyed) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM hit),
lost AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_STATS = {
    "n_symbols": "len(regexp_extract_all(t, '[#*$%&|<>]'))", "n_upper": "len(regexp_extract_all(t, '[A-ZÀ-Þ]'))", "n_letters": r"len(regexp_extract_all(t, '[A-Za-z]|[^\x00-\x7F]'))", "n_bangs": "len(regexp_extract_all(t, '!'))",
    "n_pipes": r"len(regexp_extract_all(t, '\|'))", "word_chars": "coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)", "n_long_words": "len(list_filter(w, lambda x: strlen(x) > 20))", "n_lines": "len(l)", "n_dup_lines": "len(l) - len(list_distinct(l))",
}
_FAILS = {
    "symbols": "10 * n_symbols > n_words", "capitals": "100 * n_upper > 40 * n_letters", "exclamation": "5 * n_bangs > n_words", "table": "5 * n_pipes > n_words", "echo": "5 * coalesce(n_echo_words, 0) > n_words",
    "one word": "100 * coalesce(n_top_word, 0) > 30 * n_words AND n_words >= 50", "lines": "2 * n_dup_lines > n_lines AND n_lines >= 4", "word length": "word_chars > 15 * n_words OR word_chars < 2 * n_words", "long words": "10 * n_long_words > n_words",
}
if set(_FAILS) != set(RULES):
    raise AssertionError("each rule of the cascade needs its SQL")

OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
s AS (SELECT doc_id, len(w) AS n_words, {', '.join(f'{v} AS {k}' for k, v in _STATS.items())} FROM d),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 4]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
again AS (SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS i FROM grams WHERE n > 1) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM (SELECT doc_id, list_transform(w, lambda x: {lower('x')}) AS w FROM d)),
top AS (SELECT doc_id, max(n) AS n_top_word FROM (SELECT doc_id, count(*) AS n FROM word GROUP BY doc_id, x) GROUP BY doc_id),
echo AS (SELECT doc_id, count(*) AS n_echo_words FROM (SELECT doc_id, x = lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS same FROM word) WHERE same GROUP BY doc_id),
every AS (SELECT *, coalesce(n_repeat_words, 0) AS repeats FROM s LEFT JOIN again USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN echo USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(repeats AS BIGINT) AS n_repeat_words,
  n_words < 10 OR 100 * repeats > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * repeats > 20 * n_words OR {' OR '.join(f'({x})' for x in _FAILS.values())}) AS kept FROM every"""

_TEST = rf"regexp_extract_all({lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9 = f"""
WITH d AS (SELECT doc_id, {_TEST} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_TEST} AS w FROM benchmark),
patterns AS (SELECT DISTINCT item, least(len(w), 10) AS k, w[i:i + least(len(w), 10) - 1] AS p FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM items WHERE len(w) > 0)),
windows AS (SELECT doc_id, i, k, w[i:i + k - 1] AS p FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM patterns) WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, windows.k, item FROM windows JOIN patterns USING (p)),
words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS i FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"""

OP10 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM d),
keyed AS (SELECT *, {lower(r"regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS k FROM lines),
judged AS (SELECT *, len(k) >= 10 AND min(doc_id) OVER (PARTITION BY k) < doc_id AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM judged GROUP BY doc_id"""
