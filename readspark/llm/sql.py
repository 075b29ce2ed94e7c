"""SQL (DuckDB's) for the queries that it can express, over the same tables."""

from __future__ import annotations

from .quality_rules import FAMILIES, STATISTICS, STEPS

#: The words of each row's text, in order.
_WORDS = r"""
    rows AS (SELECT row_number() OVER () AS r, doc_id, text, lang, source FROM documents),
    split AS (SELECT r, doc_id, [x for x in string_split_regex(coalesce(text, ''), '[ \t-\r]+') if x <> ''] AS words FROM rows),
    places AS (SELECT r, doc_id, unnest(range(1, len(words) + 1)) AS i, words FROM split)"""

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM m"""

OP10 = f"""
WITH {_WORDS},
    windows AS (SELECT r, doc_id, i, array_to_string(words[i:i + 12], ' ') AS w FROM places WHERE i + 12 <= len(words) AND doc_id IS NOT NULL),
    least AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
    gone AS (SELECT DISTINCT r, i + unnest(range(13)) AS i FROM windows JOIN least USING (w) WHERE doc_id > first),
    kept AS (SELECT r, string_agg(words[i], ' ' ORDER BY i) AS text, count(*) AS n FROM places ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (r)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"[x for x in string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> '']"

OP7 = f"""
WITH items AS (SELECT item_id::VARCHAR AS id, {_ITEM_WORDS} AS words FROM benchmark WHERE item_id IS NOT NULL),
    starts AS (SELECT id, words, least(8, len(words)) AS size, unnest(range(1, len(words) + 1)) AS i FROM items),
    item_windows AS (SELECT DISTINCT id, size, array_to_string(words[i:i + size - 1], ' ') AS w FROM starts WHERE i + size - 1 <= len(words)),
    rows AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS words FROM documents),
    places AS (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM rows),
    windows AS (SELECT r, i, size, array_to_string(words[i:i + size - 1], ' ') AS w FROM places, (SELECT DISTINCT size FROM item_windows) WHERE i + size - 1 <= len(words)),
    found AS (SELECT r, i, size, id FROM windows JOIN item_windows USING (size, w)),
    hit AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, i + unnest(range(size)) AS place FROM found) GROUP BY r),
    named AS (SELECT r, count(DISTINCT id) AS n, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM found GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(named.n, 0) >= 2 AS contaminated
FROM rows LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""


def _quartiles(level: str, keys: str) -> str:
    by = f"{keys}, stat" if keys else "stat"
    return f"""
    {level}_sketch AS (SELECT {by}, b, sum(n) AS n FROM sketch GROUP BY {by}, b),
    {level}_seen AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY b) AS seen, sum(n) OVER (PARTITION BY {by}) AS total FROM {level}_sketch),
    {level} AS (SELECT {by}, max(total) AS total, min(b) FILTER (seen * 4 >= total) AS q1, min(b) FILTER (seen * 4 >= total * 3) AS q3 FROM {level}_seen GROUP BY {by})"""


_FLOOR = f"(b % {2 * STEPS}) << (b // {2 * STEPS})"
_SHIFT = f"greatest(length(bin(v)) - {STEPS.bit_length()}, 0)"
_STACKED = " UNION ALL ".join(f"SELECT lang, source, '{s}' AS stat, {s} AS v FROM rates" for s in STATISTICS)
_OUTSIDE = " + ".join("(" + " OR ".join(f"{s} < low['{s}'] OR {s} > high['{s}']" for s in family) + ")::INT" for family in FAMILIES.values())

OP2 = f"""
WITH {_WORDS},
    windows AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM places WHERE i + 2 <= len(words)),
    twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows),
    covered AS (SELECT DISTINCT r, i + unnest(range(3)) AS i FROM twice WHERE n > 1),
    repeated AS (SELECT r, count(*) AS n FROM covered GROUP BY r),
    lined AS (SELECT r, [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^ \\t-\\r]')] AS lines FROM rows),
    counts AS (
        SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
            (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
            (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words
        FROM rows JOIN (SELECT r, words FROM split) USING (r) JOIN lined USING (r) LEFT JOIN repeated USING (r)),
    rates AS (
        SELECT *, CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END AS symbol_rate,
            CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_line_rate,
            CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeat_rate,
            CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS mean_chars
        FROM counts),
    stacked AS ({_STACKED}),
    sketch AS (SELECT lang, source, stat, {_SHIFT} * {2 * STEPS} + (v >> {_SHIFT}) AS b, count(*) AS n FROM stacked GROUP BY ALL),
    {_quartiles("own", "lang, source")},
    {_quartiles("language", "lang")},
    {_quartiles("corpus", "")},
    picked AS (
        SELECT o.lang, o.source, stat, CASE WHEN o.total >= 50 THEN o.q1 WHEN l.total >= 50 THEN l.q1 ELSE c.q1 END AS b1, CASE WHEN o.total >= 50 THEN o.q3 WHEN l.total >= 50 THEN l.q3 ELSE c.q3 END AS b3
        FROM own o JOIN language l USING (stat) JOIN corpus c USING (stat) WHERE o.lang IS NOT DISTINCT FROM l.lang),
    floors AS (SELECT lang, source, stat, {_FLOOR.replace("b ", "b1 ")} AS q1, {_FLOOR.replace("b ", "b3 ")} AS q3 FROM picked),
    fences AS (SELECT lang, source, map_from_entries(list((stat, q1 - (q3 - q1) * 1.5))) AS low, map_from_entries(list((stat, q3 + (q3 - q1) * 1.5))) AS high FROM floors GROUP BY lang, source),
    judged AS (
        SELECT r.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_OUTSIDE} AS n_outside
        FROM rates r JOIN fences f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_outside < 2 AS kept
FROM judged"""

ORACLE_SQL = {"op1_warc": OP1, "op2_quality_rules": OP2, "op7_decontaminate": OP7, "op10_substring_dedup": OP10}
