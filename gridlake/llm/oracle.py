"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_MIX = r"""
WITH sizes AS (
    SELECT doc_id, source, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
    FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::DOUBLE AS weight
    FROM sizes GROUP BY source),
caps AS (SELECT *, source_size::DOUBLE * 3 AS cap FROM sources),
levels AS (
    SELECT *, cap / weight AS ratio,
        ((SELECT sum(source_size) FROM sources)::DOUBLE
            - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS FIRST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / ((SELECT sum(weight) FROM sources)
            - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS FIRST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
    FROM caps),
targets AS (
    SELECT source, source_size,
        least(cap, coalesce((SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio), 1e300) * weight)
            AS target
    FROM levels),
plans AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole
    FROM targets),
running AS (
    SELECT s.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
        sum(size) OVER (PARTITION BY s.source ORDER BY h) AS upto,
        sum(size) OVER (PARTITION BY s.source, h) AS together
    FROM sizes s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
    (size * (whole + (rest > 0 AND 2 * rest > 2 * upto - together)::INT))::BIGINT AS taken
FROM running
"""

_TOOL_CALLS = r"""
WITH calls AS (
    SELECT conv_id, 'c' || turn AS call_id, turn, ['search', 'write', 'translate'][turn % 3 + 1] AS tool,
        text, length(text) AS size,
        turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS chain
    FROM conversations WHERE role = 'assistant'),
ordered AS (
    SELECT *, (row_number() OVER (PARTITION BY conv_id, turn % 2, chain ORDER BY turn) - 1)::INTEGER AS depth
    FROM calls),
results AS (
    SELECT conv_id, 'c' || (turn - 1) AS call_id, text AS result FROM conversations WHERE role = 'user'),
written AS (
    SELECT o.*, r.result,
        '{' || CASE WHEN text IS NULL THEN '' ELSE '"query":' || to_json(text)::VARCHAR END
            || CASE WHEN text IS NULL THEN '' ELSE ',"size":' || size END || '}' AS arguments
    FROM ordered o LEFT JOIN results r USING (conv_id, call_id))
SELECT conv_id, call_id, row_number() OVER (PARTITION BY conv_id ORDER BY depth, turn, call_id)::INTEGER AS position,
    depth, tool, arguments,
    concat_ws('; ',
        CASE WHEN tool = 'translate' THEN '$.target: missing' END,
        CASE WHEN tool <> 'write' AND size < 1 THEN '$.query: too short' END,
        CASE WHEN tool <> 'write' AND size > 1000 THEN '$.query: too long' END,
        CASE WHEN tool = 'search' AND size > 800 THEN '$.size: too large' END,
        CASE WHEN tool = 'write' AND size < 200 THEN '$.size: too small' END) AS problems,
    result, (result IS NOT NULL)::BIGINT AS n_results,
    '{"arguments":' || arguments || ',"id":' || to_json(call_id)::VARCHAR
        || ',"result":' || coalesce(to_json(result)::VARCHAR, 'null') || ',"tool":' || to_json(tool)::VARCHAR || '}'
        AS call_json
FROM written
"""

_DECONTAMINATE = r"""
WITH fold AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents),
items AS (
    SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark),
item_windows AS (
    SELECT DISTINCT item, least(13, len(words)) AS m,
        array_to_string(list_slice(words, pos, pos + least(13, len(words)) - 1), ' ') AS gram
    FROM items, unnest(generate_series(1, len(words) - least(13, len(words)) + 1)) AS u(pos)
    WHERE len(words) > 0),
lengths AS (SELECT DISTINCT m FROM item_windows),
doc_windows AS (
    SELECT doc_id, pos, m, array_to_string(list_slice(words, pos, pos + m - 1), ' ') AS gram
    FROM fold, lengths, unnest(generate_series(1, len(words) - m + 1)) AS u(pos)),
hits AS (SELECT doc_id, pos, m, item FROM doc_windows JOIN item_windows USING (m, gram)),
places AS (
    SELECT doc_id, count(DISTINCT w) AS n_hit
    FROM (SELECT DISTINCT doc_id, pos, m FROM hits), unnest(generate_series(pos, pos + m - 1)) AS u(w)
    GROUP BY doc_id),
names AS (
    SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
    FROM hits GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM fold LEFT JOIN places USING (doc_id) LEFT JOIN names USING (doc_id)
"""

_SEARCH = r"""
WITH texts AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents),
totals AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS all_terms FROM texts WHERE len(terms) > 0),
counts AS (
    SELECT row, doc_id, n, term, count(*)::BIGINT AS tf
    FROM (SELECT row, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM texts) GROUP BY ALL),
weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM counts, totals GROUP BY term, docs),
wanted AS (
    SELECT item, item_id, term, count(*)::BIGINT AS times
    FROM (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark) GROUP BY ALL),
scores AS (
    SELECT item, item_id, row, doc_id, sum(times * w * ((1000000000 * tf)
        // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // all_terms))))::BIGINT AS score
    FROM wanted JOIN weights USING (term) JOIN counts USING (term), totals GROUP BY ALL)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank
    FROM scores WHERE score > 0)
WHERE rank <= 10
"""

ORACLE: dict[str, str] = {
    "op1_mix": _MIX,
    "op2_tool_calls": _TOOL_CALLS,
    "op7_decontaminate": _DECONTAMINATE,
    "op12_search": _SEARCH,
}
