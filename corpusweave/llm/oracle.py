"""DuckDB SQL for the queries of this package that SQL can express.

Each works its result out another way than the operator: levels by trying every source as the last that
is limited, queues by one window per source, lines by unnesting, turns by ordered aggregates.
"""

from __future__ import annotations

W = "[^\\x20\\x09-\\x0D]+"

_MIXING = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{W}')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), n AS (
  SELECT source, source_size, 3 * source_size AS top,
         (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight
  FROM s
), tried AS (
  SELECT a.top / a.weight AS level,
         (SELECT sum(least(b.top::DOUBLE, b.weight * (a.top / a.weight))) FROM n b) AS words
  FROM n a
), limited AS (
  SELECT coalesce(max(level), -1) AS level FROM tried WHERE words <= (SELECT sum(source_size) FROM n)
), rest AS (
  SELECT ((SELECT sum(source_size) FROM n) - coalesce(sum(CASE WHEN top / weight <= level THEN top END), 0))::DOUBLE
         / sum(CASE WHEN top / weight > level THEN weight END) AS level
  FROM n, limited
), t AS (
  SELECT source, source_size,
         coalesce(least(top::DOUBLE, weight * (SELECT level FROM rest)), top::DOUBLE) AS target
  FROM n
), q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (
           PARTITION BY d.source
           ORDER BY substr(md5('42:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.size::VARCHAR), 1, 15), d.doc_id, d.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, floor(target) - start))
        + greatest(0, least(size, floor(target) - start - source_size))
        + greatest(0, least(size, floor(target) - start - 2 * source_size)))::BIGINT AS taken
FROM q
"""

_QUALITY = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '{W}') AS words FROM d
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), repeated AS (
  SELECT r, count(DISTINCT i + j) AS n FROM windows, range(0, 3) AS g(j) WHERE n > 1 GROUP BY r
), lines AS MATERIALIZED (
  SELECT row_number() OVER () AS l, r, line, lower(line) AS low, regexp_extract_all(line, '{W}') AS words
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w)
), frequent AS (
  SELECT l, max(n) AS most FROM (SELECT l, count(*) AS n FROM (SELECT l, unnest(words) AS word FROM lines) GROUP BY l, word) GROUP BY l
), rated AS (
  SELECT r, line, words, len(words) AS n,
         regexp_matches(low, 'all rights reserved|terms of (use|service)|privacy policy|cookie policy'
           || '|accept (all )?cookies|use of cookies|enable javascript|javascript is disabled|lorem ipsum'
           || '|subscribe to our newsletter|sign up for our newsletter|skip to (main )?content|back to top'
           || '|powered by wordpress|click here to|page not found|read more »') AS stock,
         len(list_filter(words, lambda x: x IN ('|', '>', '<', '/', '\\', '-', '»', '•', '·', '::'))) AS separators,
         len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
         len(list_filter(words, lambda x: regexp_matches(x, '[!?]$'))) AS shouted,
         len(list_filter(words, lambda x: regexp_matches(x, '[.!?]$'))) AS closed,
         regexp_matches(words[-1], '[.!?"'':;)”…。]$') AS ends,
         most
  FROM lines JOIN frequent USING (l) WHERE len(words) > 0
), failed AS (
  SELECT r, list_sum(list_transform(words, lambda x: strlen(x))) AS size,
         stock OR n >= 4 AND (separators > 0.2 * n OR symbols > 0.3 * n OR shouted > 0.3 * n
                              OR NOT ends AND closed = 0 OR n >= 8 AND most > 0.5 * n) AS fails
  FROM rated
), lost AS (
  SELECT r, count(*) FILTER (fails) AS n, coalesce(sum(size) FILTER (fails), 0) AS size, sum(size) AS whole FROM failed GROUP BY r
), same AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE len(words) > 0 GROUP BY r
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(same.n, 0)::BIGINT AS n_dup_lines,
         coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
         coalesce(lost.n, 0)::BIGINT AS n_failed_lines,
         coalesce(lost.size::DOUBLE / lost.whole, 0.0) AS lost_share
  FROM w LEFT JOIN repeated USING (r) LEFT JOIN same USING (r) LEFT JOIN lost USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_share <= 0.5 AS kept,
       n_failed_lines, lost_share
FROM m
"""

_CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(role) + length(text) + length('<|turn|><|msg|><|end|>')
            + len(regexp_extract_all(role, '[<\[]\\*(\||/?s>|/?INST\]|/?SYS>|/?think>)'))
            + len(regexp_extract_all(text, '[<\[]\\*(\||/?s>|/?INST\]|/?SYS>|/?think>)')) AS size
  FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns, sum(size)::BIGINT AS formatted_chars,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS trained
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(trained) AS loss_chars,
       sha256(trained) AS loss_sha256, formatted_chars
FROM g
"""


def _round(before: str, after: str) -> str:
    """One round: the nearest of the centroids ``before`` for every vector, then the centroids ``after``."""
    return f"""
near_{after} AS MATERIALIZED (
  SELECT r, vec_id, x, k, list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d
  FROM kept, {before} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1
), mean_{after} AS (
  SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
  FROM (SELECT k, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM near_{after}, range(1, 65) AS g(i) GROUP BY k, i) GROUP BY k
), {after} AS MATERIALIZED (
  SELECT b.k, coalesce(m.c::BIGINT[], b.c) AS c FROM {before} b LEFT JOIN mean_{after} m USING (k)
), """


_CENTROIDS = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS k, x AS c
  FROM kept QUALIFY k < 16
), {_round("c0", "c1")}{_round("c1", "c2")}{_round("c2", "c3")}last AS (
  SELECT r, vec_id, k, c, list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d
  FROM kept, c3 QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1
)
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM last
"""

_LAYOUTS = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, ((coalesce(conv_id, 0) % 12) + 12) % 12 AS k
  FROM conversations
), g AS (
  SELECT conv_id, k, count(*) AS n_turns, string_agg(role, ',' ORDER BY turn NULLS FIRST, role, text) AS roles,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said
  FROM c GROUP BY conv_id, k
), f AS (
  SELECT *, k < 5 AND roles IN ('user,assistant', 'system,user,assistant') AS flat FROM g
)
SELECT conv_id, CASE WHEN roles LIKE 'system,%' AND (flat OR k % 2 = 0) THEN 'system_' ELSE '' END
         || CASE WHEN flat THEN ['prompt_completion', 'prompt_response', 'question_answer', 'instruction', 'instruction_input'][k + 1]
                 WHEN k % 3 = 0 THEN 'conversations' ELSE 'messages' END AS layout,
       n_turns, sha256(said) AS turns_sha256
FROM f
"""

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": _MIXING,
    "op3_quality_rules": _QUALITY,
    "op10_chat_formatting": _CHAT,
    "op13_centroids": _CENTROIDS,
    "chat_json_layouts": _LAYOUTS,
}
