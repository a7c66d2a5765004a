"""DuckDB SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

from terratess.llm.op02_urlfilter import BLOCKED_HOSTS
from terratess.llm.op03_mixing import SEED, SEEDS
from terratess.llm.op09_rules import LEAST_STOP, MARKS, stop_forms

_OWN = " OR ".join(f"'.' || host LIKE '%.{h}'" for h in BLOCKED_HOSTS)

OP2 = rf"""
WITH rules(rule, verdict, host, path) AS (VALUES
    ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
    ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
parts AS (
    SELECT row_number() OVER () AS row, page_id,
        translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages),
best AS (
    SELECT p.row, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
    FROM parts p JOIN rules r ON '.' || p.host LIKE '%.' || r.host AND starts_with(p.path, r.path)
    GROUP BY p.row)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, CASE WHEN {_OWN} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best b USING (row)
"""

OP3 = rf"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS digest FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
    SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight, source_size * 3 AS cap FROM per),
sums AS (
    SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight
    FROM weighed
    WINDOW before AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, rest::DOUBLE / open_weight::DOUBLE AS level FROM sums),
marked AS (
    SELECT *, min((cap <= level * weight)::INTEGER) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS capped FROM levels),
shared AS (SELECT arg_min(level, (cap::DOUBLE / weight, source)) FILTER (NOT capped) AS level FROM marked),
aims AS (
    SELECT m.source, m.source_size, CASE WHEN m.capped THEN m.cap::DOUBLE ELSE s.level * m.weight END AS target FROM marked m, shared s),
drawn AS (
    SELECT d.*, a.source AS own, a.source_size, a.target, coalesce(a.target / nullif(a.source_size, 0)::DOUBLE, 0) AS rate
    FROM sized d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source),
tried AS (
    SELECT *, k, (('0x' || substr(digest, k + 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate))::BIGINT AS one
    FROM drawn, range({SEEDS}) AS seeds(k)),
nearest AS (
    SELECT own, arg_min(k, (far, k)) AS k FROM (
        SELECT own, k, abs((floor(any_value(rate))::BIGINT * any_value(source_size) + sum(size * one))::DOUBLE - any_value(target)) AS far FROM tried GROUP BY own, k)
    GROUP BY own)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + one))::BIGINT AS taken
FROM tried t JOIN nearest n ON t.own IS NOT DISTINCT FROM n.own AND t.k = n.k
"""

OP6 = r"""
WITH v AS (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.row <> c.row AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in stop_forms())

_MARKS = MARKS.replace("'", "''")

OP9 = rf"""
WITH split AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT row, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM split),
triples AS (SELECT row, i, a, lead(a, 1) OVER one AS b, lead(a, 2) OVER one AS c FROM places WINDOW one AS (PARTITION BY row ORDER BY i)),
repeated AS (SELECT row, a, b, c FROM triples WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
windows AS (SELECT row, i FROM triples JOIN repeated USING (row, a, b, c)),
covered AS (
    SELECT row, count(DISTINCT j)::BIGINT AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS j FROM windows) GROUP BY row),
stats AS (
    SELECT s.row, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(c.n, 0) AS n_repeat_words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
        len(list_filter(w, lambda x: trim(x, '{_MARKS}') IN ({_STOP})))::BIGINT AS n_stop_words
    FROM split s LEFT JOIN covered c ON s.row = c.row),
counted AS (
    SELECT * EXCLUDE (row, lines), len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND word_chars BETWEEN 2 * n_words AND 25 * n_words AND 100 * n_symbols <= 20 * n_words AND 100 * n_stop_words >= {LEAST_STOP} * n_words AND 100 * n_dup_lines <= 40 * n_lines AS kept,
    n_stop_words, n_lines
FROM counted
"""

ORACLES = {"op2_url_filters": OP2, "op3_mixing": OP3, "op6_exact_topk": OP6, "op9_quality_rules": OP9}
