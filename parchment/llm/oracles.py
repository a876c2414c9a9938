"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from parchment.llm.quality_rules import PHRASES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_PHRASES = PHRASES.replace("'", "''")

SQL: dict[str, str] = {}

SQL["op2_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM p),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, x FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
f AS (SELECT doc_id, x, length(x) AS n,
  length(x) - length(regexp_replace(x, '[|»›·•]', '', 'g')) >= 3
  OR (length(x) <= 200 AND regexp_matches(x, '(?i)(^|[^\p{{L}}])({_PHRASES})($|[^\p{{L}}])'))
  OR length(x) - length(regexp_replace(x, '[#*$%&|<>{{}}\\^~=+@]', '', 'g')) > 0.1 * length(x)
  OR (length(x) - length(replace(x, '!', '')) > 0.05 * length(x) AND contains(x, '!!'))
  OR (length(x) <= 30 AND NOT regexp_matches(x, '[.!?…:;,"''»”’)\]][\x20\x09-\x0D]*$')) AS failed FROM l),
s AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines, count(*) FILTER (failed) AS n_lines_failed, coalesce(sum(n) FILTER (NOT failed), 0) AS good, sum(n) AS every FROM f GROUP BY doc_id),
b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines_failed, 0) AS n_lines_failed,
  coalesce(1 - good / nullif(every, 0), 0) AS lost FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.5 AS kept, n_lines_failed FROM b"""

SQL["op3_chat_formatting"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
  CAST(sum(length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM t"""

SQL["op5_sharding"] = """
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS doc_bytes, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h FROM documents),
e AS (SELECT doc_id, doc_bytes, h, depth, h >> CAST(60 - depth AS INTEGER) AS bucket FROM (SELECT *, unnest(range(0, 61)) AS depth FROM d)),
s AS (SELECT depth, bucket, sum(doc_bytes) AS shard_bytes FROM e GROUP BY depth, bucket),
f AS (SELECT e.doc_id, e.h, min(e.depth) AS depth FROM e JOIN s ON s.depth = e.depth AND s.bucket = e.bucket WHERE shard_bytes <= 262144 OR e.depth = 60 GROUP BY e.doc_id, e.h)
SELECT d.doc_id, d.doc_bytes, CASE WHEN f.depth = 0 THEN '' ELSE lpad(bin(s.bucket), CAST(f.depth AS INTEGER), '0') END AS shard,
  CAST(f.depth AS INTEGER) AS depth, CAST(s.shard_bytes AS BIGINT) AS shard_bytes, s.shard_bytes > 262144 AS oversize
FROM d JOIN f ON f.doc_id = d.doc_id AND f.h = d.h JOIN s ON s.depth = f.depth AND s.bucket = d.h >> CAST(60 - f.depth AS INTEGER)"""

SQL["op7_mixing"] = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0 * sum(size) AS cap FROM d GROUP BY source),
n AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nth FROM n),
v AS (SELECT a.*, (SELECT 1.5 * sum(source_size) FROM r) AS total, coalesce((SELECT sum(cap) FROM r b WHERE b.nth < a.nth), 0) AS done, (SELECT sum(weight) FROM r b WHERE b.nth >= a.nth) AS rest FROM r a),
k AS (SELECT (total - done) / rest AS level FROM v WHERE (total - done) / rest < cap / weight ORDER BY nth LIMIT 1),
t AS (SELECT source, source_size, CAST(least(cap, coalesce((SELECT level FROM k) * weight, cap)) AS DOUBLE) AS target FROM r),
x AS (SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY u, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, round(target - whole * source_size) - before)) AS BIGINT) AS taken FROM x"""

SQL["op10_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
