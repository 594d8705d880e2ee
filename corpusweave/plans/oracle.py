"""The same results in SQL, worked out token by token rather than by operators.

Packing here numbers single tokens, shards come from ``ntile`` and positions from one
global ``row_number``, so the SQL shares no method with the Spark plans.
"""

from __future__ import annotations

WORDS = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '')"

SHUFFLED = "substr(md5('42:' || doc_id), 1, 15), doc_id"


def vocab(name: str = "vocab", where: str = "TRUE", size: int = 4096) -> str:
    """CTE of a frequency vocabulary behind four special tokens."""
    return f"""
{name}_counts AS (
  SELECT token, count(*) AS n
  FROM (SELECT unnest({WORDS}) AS token FROM documents WHERE {where}) GROUP BY token),
{name} AS (
  SELECT token, CAST(r + 3 AS INTEGER) AS id
  FROM (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS r FROM {name}_counts)
  WHERE r <= {size - 4}
  UNION ALL SELECT * FROM (VALUES ('<pad>', 0), ('<eos>', 1), ('<bos>', 2), ('<unk>', 3)))"""


def encoded(docs: str) -> str:
    """CTE ``tokens`` of (doc_id, p, id) with a closing EOS, for a set of documents."""
    return f"""
placed_words AS (
  SELECT doc_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS p
  FROM (SELECT doc_id, {WORDS} AS ws FROM {docs})),
tokens AS (
  SELECT doc_id, p, coalesce(id, 3) AS id FROM placed_words LEFT JOIN vocab USING (token)
  UNION ALL SELECT doc_id, 2147483647 AS p, 1 AS id FROM {docs})"""


def ids(expression: str = "id", order: str = "p") -> str:
    return f"string_agg(CAST({expression} AS VARCHAR), ',' ORDER BY {order})"


def packed(docs: str, keys: str, shards: int, batch_rows: int, length: int = 128) -> str:
    """CTE ``blocks`` from documents with (doc_id, split, pos) and CTE ``tokens``."""
    chunk = length - 1
    return f"""
sharded AS (SELECT *, ntile({shards}) OVER (PARTITION BY split ORDER BY pos) - 1 AS shard FROM {docs}),
batched AS (
  SELECT *, (row_number() OVER (PARTITION BY split, shard ORDER BY pos) - 1) // {batch_rows} AS batch FROM sharded),
stream AS (
  SELECT {keys}, id, row_number() OVER (PARTITION BY {keys} ORDER BY pos, p) - 1 AS t,
    count(*) OVER (PARTITION BY {keys}) AS total
  FROM batched JOIN tokens USING (doc_id)),
blocks AS (
  SELECT {keys}, t // {chunk} AS block, '2,' || {ids(order="t")} AS input_ids
  FROM stream WHERE t < (total // {chunk}) * {chunk} GROUP BY {keys}, t // {chunk})"""


BY_LANGUAGE = """
docs AS (
  SELECT doc_id, text, lang AS split, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS split_rows
  FROM documents)"""


def held_out(source: str, n_val: int = 30, n_test: int = 50) -> str:
    """CTE ``parts`` of (doc_id, text, split, pos) after a holdout from ``source``."""
    return f"""
ranked AS (
  SELECT *, row_number() OVER (ORDER BY {SHUFFLED}) - 1 AS r, count(*) OVER () AS n
  FROM {source} WHERE split = 'train'),
parts AS (
  SELECT doc_id, text, CASE WHEN r >= n - {n_val} THEN 'validation'
    WHEN r >= n - {n_val + n_test} THEN 'test' ELSE 'train' END AS split,
    CASE WHEN r >= n - {n_val} THEN r - (n - {n_val})
    WHEN r >= n - {n_val + n_test} THEN r - (n - {n_val + n_test}) ELSE r END AS pos
  FROM ranked)"""


def permuted(source: str) -> str:
    """CTE ``walked`` of (doc_id, place, n): the train rows of a source, permuted by one round a step of a recursion."""
    polynomial = "((({v} * k[1] + k[2]) % p * (({v} * k[1] + k[2]) % p) + k[3]) % p * k[4] + k[5]) % p"
    return f"""
round_keys AS (
  SELECT r, list(('0x' || substr(md5('42:' || r || ':' || i), 1, 7))::BIGINT | 1 ORDER BY i) AS k
  FROM range(6) AS rounds(r), range(5) AS numbers(i) GROUP BY r),
digits AS (
  SELECT doc_id, n, a, (n + a - 1) // a AS b, pos FROM (
    SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n,
      CAST(ceil(sqrt(count(*) OVER ())) AS BIGINT) AS a FROM {source} WHERE split = 'train')),
walk AS (
  SELECT doc_id, n, a, b, pos // b AS x, pos % b AS y, 0 AS r FROM digits
  UNION ALL
  SELECT doc_id, n, a, b, CASE WHEN r % 2 = 0 THEN (x + {polynomial.format(v='y')}) % a ELSE x END,
    CASE WHEN r % 2 = 1 THEN (y + {polynomial.format(v='x')}) % b ELSE y END, r + 1
  FROM (SELECT doc_id, n, a, b, x, y, CASE WHEN r = 6 THEN 0 ELSE r END AS r, 2147483647 AS p
    FROM walk WHERE r < 6 OR x * b + y >= n) JOIN round_keys USING (r)),
walked AS (SELECT doc_id, x * b + y AS place, n FROM walk WHERE r = 6 AND x * b + y < n)"""


def permuted_parts(n_val: int = 30, n_test: int = 50) -> str:
    """CTE ``parts`` of (doc_id, split, pos) after a holdout by permuted places."""
    return f"""
parts AS (
  SELECT doc_id, CASE WHEN place >= n - {n_val} THEN 'validation' WHEN place >= n - {n_val + n_test} THEN 'test' ELSE 'train' END AS split,
    place - CASE WHEN place >= n - {n_val} THEN n - {n_val} WHEN place >= n - {n_val + n_test} THEN n - {n_val + n_test} ELSE 0 END AS pos
  FROM walked)"""


FAR_IDS = """
far AS (
  SELECT ((doc_id * 7919) % 1009 - 500) * CAST(9007199254740992 AS BIGINT) + doc_id AS doc_id, text, lang FROM documents)"""

TRAIN = "corpus AS (SELECT doc_id, text, 'train' AS split FROM documents)"

NUMBERED = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY shard, batch, block) - 1 AS pos FROM blocks)"""

HELD_OUT_BLOCKS = (
    f"WITH {vocab()}, {TRAIN}, {held_out('corpus')}, {encoded('documents')}, "
    f"{packed('parts', 'split, shard, batch', 4, 100)}, {NUMBERED}"
)

TRUNCATED = """
cut AS (
  SELECT doc_id, p, id FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS place FROM tokens) WHERE place <= 128),
rows_cut AS (
  SELECT doc_id, list(id ORDER BY p) AS input_ids, count(*) AS n FROM cut GROUP BY doc_id)"""


def collated(batch_size: int, pad: int) -> str:
    return f"""
sized AS (
  SELECT split, pos, pos // {batch_size} AS batch, input_ids, n,
    max(n) OVER (PARTITION BY split, pos // {batch_size}) AS width
  FROM rows_cut JOIN docs USING (doc_id)),
padded AS (
  SELECT split, batch, pos, list_concat(list_transform(range(width - n), lambda x: {pad}), input_ids) AS input_ids,
    list_concat(list_transform(range(width - n), lambda x: 0), list_transform(input_ids, lambda x: 1))
      AS attention_mask
  FROM sized)"""


def labels(pad: int) -> str:
    return f"array_to_string(list_transform(input_ids, lambda x: CASE WHEN x = {pad} THEN -100 ELSE x END), ',')"


def piece_vocab(size: int = 4096, longest: int = 3) -> str:
    """CTE ``vocab`` of special tokens, a word's beginning, bytes and the most frequent parts of words."""
    return f"""
word_counts AS (
  SELECT token, count(*) AS n, regexp_extract_all(token, '(?s).') AS letters
  FROM (SELECT unnest({WORDS}) AS token FROM documents) GROUP BY token),
word_parts AS (
  SELECT token, n FROM word_counts
  UNION ALL
  SELECT CASE WHEN i = 1 THEN '' ELSE '##' END || array_to_string(letters[i:i + l - 1], '') AS part, n
  FROM (SELECT *, unnest(range(1, len(letters) + 1)) AS i FROM word_counts), range(1, {longest + 1}) AS lengths(l)
  WHERE i + l - 1 <= len(letters) AND (i > 1 OR l < len(letters))),
fixed AS (
  SELECT * FROM (VALUES ('<pad>', 0), ('<eos>', 1), ('<bos>', 2), ('<unk>', 3), ('<w>', 4)) AS f(token, id)
  UNION ALL SELECT printf('<0x%02X>', b), CAST(b + 5 AS INTEGER) FROM range(256) AS bytes(b)),
vocab AS (
  SELECT token, CAST(r + 260 AS INTEGER) AS id FROM (
    SELECT token, row_number() OVER (ORDER BY sum(n) DESC, token) AS r
    FROM word_parts WHERE token NOT IN (SELECT token FROM fixed) GROUP BY token)
  WHERE r <= {size} - 261
  UNION ALL SELECT * FROM fixed)"""


def cut_in_pieces(docs: str) -> str:
    """CTE ``encoded`` of (doc_id, input_ids): each distinct word cut one piece per step of the recursion."""
    blank = "[ \\t\\n\\x0b\\x0c\\r]"
    return f"""
pieces AS (
  SELECT id, token LIKE '##_%' AS inside, CASE WHEN token LIKE '##_%' THEN substr(token, 3) ELSE token END AS body
  FROM vocab WHERE id > 260),
split_texts AS (
  SELECT doc_id, regexp_split_to_array(text, '{blank}') AS ws,
    list_concat([''], regexp_extract_all(text, '{blank}')) AS blanks FROM {docs}),
units AS (
  SELECT doc_id, unnest(ws) AS word, unnest(blanks) AS before, unnest(list_concat(blanks[2:], [''])) AS after,
    generate_subscripts(ws, 1) AS p FROM split_texts),
cut AS (
  SELECT DISTINCT word, 1::BIGINT AS place, 0 AS step, '' AS ids FROM units WHERE word <> ''
  UNION ALL
  SELECT word, CAST(place + coalesce(l, least(step, 1)) AS BIGINT), step + 1,
    CASE WHEN id IS NOT NULL THEN id::VARCHAR WHEN step = 0 THEN '4'
      ELSE array_to_string(list_transform(range(0, length(hex(substr(word, place, 1))) // 2),
        lambda b: ('0x' || substr(hex(substr(word, place, 1)), 2 * b + 1, 2))::INTEGER + 5), ',') END
  FROM (
    SELECT word, place, step, arg_max(pieces.id, l) FILTER (pieces.id IS NOT NULL) AS id, max(l) FILTER (pieces.id IS NOT NULL) AS l
    FROM (
      SELECT word, place, step, unnest(range(1, least(length(word) - place + 1, (SELECT max(length(body)) FROM pieces)) + 1)) AS l
      FROM cut WHERE place <= length(word)) AS tried
    LEFT JOIN pieces ON body = substr(word, place, l) AND inside = (step > 0)
    GROUP BY word, place, step)),
word_ids AS (SELECT word, string_agg(ids, ',' ORDER BY step) AS ids FROM cut WHERE step > 0 GROUP BY word),
unit_ids AS (
  SELECT doc_id, p, concat_ws(',', CASE WHEN before NOT IN ('', ' ') THEN (ascii(before) + 5)::VARCHAR END,
    CASE WHEN word <> '' THEN ids WHEN ' ' IN (before, after) THEN '4' END) AS ids
  FROM units LEFT JOIN word_ids USING (word)),
encoded AS (
  SELECT doc_id, concat_ws(',', string_agg(ids, ',' ORDER BY p) FILTER (ids <> ''), '1') AS input_ids
  FROM unit_ids GROUP BY doc_id)"""


ENCODED_BY_LANGUAGE = f"WITH {vocab()}, {BY_LANGUAGE}, {encoded('documents')}"

NOT_GERMAN = "lang <> 'de'"

TWO_VOCABS = f"WITH {vocab('a')}, {vocab('b', where=NOT_GERMAN)}"


def steps(label: str = "label") -> str:
    """CTE ``losses`` of (seq_id, pos, target, loss)."""
    return f"""
WITH steps AS (
  SELECT vec_id // 8 AS seq_id, vec_id % 8 AS pos, embedding, {label} AS label FROM embeddings),
shifted AS (
  SELECT *, lead(label) OVER (PARTITION BY seq_id ORDER BY pos) AS target FROM steps),
losses AS (
  SELECT seq_id, pos, target,
    ln(list_sum(list_transform(embedding, lambda z: exp(CAST(z AS DOUBLE)))))
      - CAST(embedding[target + 1] AS DOUBLE) AS loss
  FROM shifted WHERE target <> -100)"""


def sharp_steps() -> str:
    """The same for logits 200 times as large; the greatest one comes off before the exponential."""
    sharp = """
WITH steps AS (
  SELECT vec_id // 8 AS seq_id, vec_id % 8 AS pos, list_transform(embedding, lambda z: CAST(z AS DOUBLE) * 200) AS z, label
  FROM embeddings),
shifted AS (
  SELECT *, lead(label) OVER (PARTITION BY seq_id ORDER BY pos) AS target, list_max(z) AS top FROM steps),
losses AS (
  SELECT target, top + ln(list_sum(list_transform(z, lambda x: exp(x - top)))) - z[target + 1] AS loss
  FROM shifted WHERE target <> -100)"""
    return sharp


PARTLY_IGNORED = "CASE WHEN label = 0 THEN -100 ELSE label END"

# White space of the texts at hand, to strip by.
BLANK = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31))"


def behind_role(line: str) -> str:
    """What a line without its opening tag holds behind its role marker, by prefix tests; null without one."""
    roles = ("assistant", "model", "user", "system")
    marks = [f"<{a}{role}{z}>" for role in roles for a in ("|", "") for z in ("|", "")] + list(roles)
    cases = " ".join(f"WHEN starts_with(lower({line}), '{m}') THEN ltrim(substr({line}, {len(m) + 1}), {BLANK})" for m in marks)
    return f"CASE {cases} WHEN starts_with(lower({line}), 'a:') THEN substr({line}, 2) END"


def stripped(source: str) -> str:
    """Markers stripped from ``text`` of a source with (conv_id, turn, text): line by line, without patterns."""
    return f"""
WITH source AS ({source}),
found AS (
  SELECT *, lower(text) AS folded,
    length(text) - instr(reverse(lower(text)), reverse('model')) - 4 AS model_at,
    length(text) - instr(reverse(lower(text)), reverse('assistant')) - 8 AS assistant_at,
    contains(lower(text), 'model') AS has_model, contains(lower(text), 'assistant') AS has_assistant FROM source),
last AS (
  SELECT *, CASE WHEN has_model AND (NOT has_assistant OR model_at > assistant_at) THEN model_at
      WHEN has_assistant THEN assistant_at END AS last_at,
    CASE WHEN has_model AND (NOT has_assistant OR model_at > assistant_at) THEN 5 ELSE 9 END AS chars FROM found),
tails AS (
  SELECT *, CASE WHEN last_at IS NOT NULL AND contains(substr(folded, 1, last_at), 'user')
    THEN trim(ltrim(substr(text, last_at + chars + 1), ': ' || chr(10) || chr(9)), {BLANK}) END AS tail FROM last),
lines AS (
  SELECT conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS n
  FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM tails)),
opened AS (
  SELECT *, CASE WHEN starts_with(lower(ltrim(line, {BLANK})), '<start_of_turn>')
    THEN ltrim(substr(ltrim(line, {BLANK}), 16), {BLANK}) ELSE ltrim(line, {BLANK}) END AS o FROM lines),
rests AS (SELECT *, {behind_role('o')} AS rest FROM opened),
marked AS (SELECT *, min(CASE WHEN rest IS NOT NULL THEN n END) OVER (PARTITION BY conv_id, turn) AS hit FROM rests),
dropped AS (
  SELECT conv_id, turn, coalesce(string_agg(line || chr(10), '' ORDER BY n) FILTER (hit IS NULL OR n < hit), '') AS head,
    ltrim(max(CASE WHEN n = hit THEN CASE WHEN starts_with(rest, ':') THEN substr(rest, 2) ELSE rest END END) || chr(10)
      || coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (n > hit), ''), {BLANK}) AS behind
  FROM marked GROUP BY conv_id, turn)
SELECT conv_id, turn, CASE WHEN text IS NULL OR text = '' THEN text
  WHEN length(tail) >= 10 AND length(tail) < length(text) * CAST(0.9 AS DOUBLE) THEN tail
  ELSE ltrim(trim(CASE WHEN behind IS NULL THEN head ELSE rtrim(head, {BLANK}) || chr(10) || behind END, {BLANK}),
    ':-•*>' || {BLANK}) END AS text
FROM tails LEFT JOIN dropped USING (conv_id, turn)"""


ORACLE_SQL: dict[str, str] = {
    "corpus_scan": """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, 'train' AS split, text,
  row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS split_rows FROM documents""",
    "text_projection": "SELECT doc_id, text FROM documents",
    "shard_sample": "SELECT text FROM benchmark",
    "row_positions_any_id": f"""
WITH {FAR_IDS}
SELECT doc_id, lang AS split, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos,
  count(*) OVER (PARTITION BY lang) AS split_rows FROM far""",
    "split_any_id": f"""
WITH {FAR_IDS}, corpus AS (SELECT doc_id, text, 'train' AS split FROM far), {held_out('corpus')}
SELECT doc_id, split FROM parts""",
    "row_positions": f"WITH {BY_LANGUAGE} SELECT doc_id, split, pos, split_rows FROM docs",
    "seeded_shuffle": f"SELECT doc_id, row_number() OVER (ORDER BY {SHUFFLED}) - 1 AS pos FROM documents",
    "split_holdout": f"WITH {TRAIN}, {held_out('corpus')} SELECT doc_id, split FROM parts",
    "split_limit": f"""
WITH {TRAIN}, {held_out('corpus')}
SELECT doc_id, split FROM parts WHERE split <> 'train' OR pos < 100""",
    "split_delivered": f"""
WITH corpus AS (
  SELECT doc_id, text, CASE source WHEN 'src0' THEN 'validation' WHEN 'src1' THEN 'extra' ELSE 'train' END AS split
  FROM documents), {held_out('corpus')}
SELECT doc_id, split FROM parts
UNION ALL SELECT doc_id, split FROM corpus WHERE split = 'extra'""",
    "seeded_permutation": f"WITH RECURSIVE {TRAIN}, {permuted('corpus')} SELECT doc_id, place AS pos FROM walked",
    "split_permuted": f"""
WITH RECURSIVE {TRAIN}, {permuted('corpus')}, {permuted_parts()}
SELECT doc_id, split, pos, count(*) OVER (PARTITION BY split) AS split_rows FROM parts
WHERE split <> 'train' OR pos < 100""",
    "split_permuted_delivered": f"""
WITH RECURSIVE corpus AS (
  SELECT doc_id, text, CASE source WHEN 'src0' THEN 'validation' WHEN 'src1' THEN 'extra' ELSE 'train' END AS split
  FROM documents), {permuted('corpus')}, {permuted_parts()}, whole AS (
  SELECT * FROM parts UNION ALL
  SELECT doc_id, split, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM corpus WHERE split = 'extra')
SELECT *, count(*) OVER (PARTITION BY split) AS split_rows FROM whole""",
    "split_file_order": "SELECT doc_id, 'train' AS split FROM documents ORDER BY doc_id LIMIT 100",
    "split_sizes": f"""
WITH {TRAIN}, {held_out('corpus')}, sizes AS (
  SELECT split, count(*) AS rows_before,
    CASE split WHEN 'train' THEN 100 WHEN 'validation' THEN 30 ELSE 50 END AS asked
  FROM parts GROUP BY split)
SELECT split, rows_before, CAST(least(rows_before, asked) AS BIGINT) AS rows_after, rows_before < asked AS short
FROM sizes""",
    "splits_round_trip": f"""
WITH {TRAIN}, {held_out('corpus')}
SELECT split, count(*) AS split_rows, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars,
  CAST(0 AS BIGINT) AS first_pos, count(*) - 1 AS last_pos FROM parts GROUP BY split""",
    "vocab_frequency": f"WITH {vocab()} SELECT token, id FROM vocab",
    "encode_corpus": f"""
WITH {vocab()}, {encoded('documents')}
SELECT doc_id, {ids()} AS input_ids FROM tokens GROUP BY doc_id""",
    "encode_corpus_join": f"""
WITH {vocab()}, {encoded('documents')}
SELECT doc_id, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY p) FILTER (p < 2147483647), '') AS input_ids
FROM tokens GROUP BY doc_id""",
    "attention_mask": f"""
SELECT doc_id, array_to_string(list_transform(range(len({WORDS}) + 1), lambda x: 1), ',') AS attention_mask
FROM documents""",
    "encode_repeated_tokens": f"""
WITH {vocab()}, {encoded('documents')}, once AS (
SELECT doc_id, {ids()} AS input_ids FROM tokens GROUP BY doc_id)
SELECT once.*, form FROM once, (VALUES ('lookup'), ('lookup'), ('join'), ('join')) AS forms(form)""",
    "encode_prompts": f"""
WITH {vocab()}, prompts AS (
  SELECT conv_id * 1000 + turn AS doc_id, conv_id, turn, text FROM conversations WHERE role = 'user'),
{encoded('prompts')}, asked AS (
SELECT doc_id, concat_ws(',', '2', string_agg(CAST(id AS VARCHAR), ',' ORDER BY p) FILTER (p < 2147483647))
  AS input_ids FROM tokens GROUP BY doc_id)
SELECT conv_id, turn, input_ids FROM asked JOIN prompts USING (doc_id)""",
    "decode_tokens": f"""
WITH {vocab()}, {encoded('documents')}
SELECT doc_id, coalesce(string_agg(token, ' ' ORDER BY p) FILTER (tokens.id > 3), '') AS text
FROM tokens JOIN vocab ON tokens.id = vocab.id GROUP BY doc_id""",
    "decode_join": f"""
WITH {vocab()}, {encoded('documents')}
SELECT doc_id, coalesce(string_agg(token, ' ' ORDER BY p) FILTER (tokens.id > 3), '') AS text
FROM tokens JOIN vocab ON tokens.id = vocab.id GROUP BY doc_id""",
    "decode_skips_specials": f"""
WITH {vocab()}, {encoded('documents')}
SELECT doc_id, coalesce(string_agg(token, ' ' ORDER BY p) FILTER (tokens.id > 5), '') AS text
FROM tokens JOIN vocab ON tokens.id = vocab.id GROUP BY doc_id""",
    "vocab_pieces": f"WITH {piece_vocab()} SELECT token, id FROM vocab",
    "encode_pieces": f"""
WITH RECURSIVE {piece_vocab()}, {cut_in_pieces('documents')}
SELECT doc_id, input_ids FROM encoded""",
    "encode_prompt_pieces": f"""
WITH RECURSIVE {piece_vocab()}, prompts AS (
  SELECT conv_id * 1000 + turn AS doc_id, conv_id, turn, text FROM conversations WHERE role = 'user'),
{cut_in_pieces('prompts')}
SELECT conv_id, turn, '2' || left(',' || input_ids, -2) AS input_ids FROM encoded JOIN prompts USING (doc_id)""",
    "decode_pieces": "SELECT doc_id, text FROM documents",
    "prepare_pieces": f"""
WITH RECURSIVE {piece_vocab()}, {TRAIN}, {held_out('corpus')}, {cut_in_pieces('documents')},
tokens AS (
  SELECT doc_id, unnest(all_ids)::INTEGER AS id, generate_subscripts(all_ids, 1) AS p
  FROM (SELECT doc_id, string_split(input_ids, ',') AS all_ids FROM encoded)),
{packed('parts', 'split, shard, batch', 4, 100)}, {NUMBERED}
SELECT split, shard, batch, block, pos, input_ids FROM numbered""",
    "pack_groups": f"""
WITH {BY_LANGUAGE}, sharded AS (
  SELECT *, ntile(12) OVER (PARTITION BY split ORDER BY pos) - 1 AS shard FROM docs)
SELECT doc_id, split, pos, shard,
  (row_number() OVER (PARTITION BY split, shard ORDER BY pos) - 1) // 30 AS batch FROM sharded""",
    "pack_blocks": f"""
{ENCODED_BY_LANGUAGE}, {packed('docs', 'split, shard, batch', 1, 300)}
SELECT split, batch, block, input_ids FROM blocks""",
    "packed_by_udtf": f"""
{ENCODED_BY_LANGUAGE}, {packed('docs', 'split, shard, batch', 1, 300)}
SELECT split, batch, block, input_ids FROM blocks""",
    "pack_sharded": f"""
{ENCODED_BY_LANGUAGE}, {packed('docs', 'split, shard, batch', 12, 30)}
SELECT split, shard, batch, block, input_ids,
  array_to_string(list_transform(range(128), lambda x: 1), ',') AS attention_mask FROM blocks""",
    "pack_global": f"""
{ENCODED_BY_LANGUAGE}, {packed('docs', 'split', 1, 300)}
SELECT split, block, input_ids FROM blocks""",
    "pack_stats": f"""
WITH {BY_LANGUAGE}, totals AS (
  SELECT split, pos // 300 AS batch, sum(len({WORDS}) + 1) AS total FROM docs GROUP BY split, pos // 300)
SELECT split, CAST(sum(total // 127) AS BIGINT) AS blocks, CAST(sum(total) AS BIGINT) AS tokens_in,
  CAST(sum(total % 127) AS BIGINT) AS tokens_dropped FROM totals GROUP BY split""",
    "truncate_sequences": f"""
{ENCODED_BY_LANGUAGE}, {TRUNCATED}
SELECT doc_id, split, array_to_string(input_ids, ',') AS input_ids,
  array_to_string(list_transform(input_ids, lambda x: 1), ',') AS attention_mask
FROM rows_cut JOIN docs USING (doc_id)""",
    "collate_left_pad": f"""
{ENCODED_BY_LANGUAGE}, {TRUNCATED}, {collated(2, 0)}
SELECT split, batch, pos, array_to_string(input_ids, ',') AS input_ids,
  array_to_string(attention_mask, ',') AS attention_mask FROM padded""",
    "collate_right_pad": f"""
{ENCODED_BY_LANGUAGE}, {TRUNCATED}, {collated(4, 0)}, turned AS (
  SELECT split, batch, pos, list_sort(list_transform(input_ids, lambda x, i: [CASE WHEN x = 0 THEN 1 ELSE 0 END, i, x]))
    AS places, attention_mask FROM padded),
righted AS (SELECT *, list_transform(places, lambda p: p[3]) AS input_ids FROM turned)
SELECT split, batch, pos, array_to_string(input_ids, ',') AS input_ids,
  array_to_string(list_reverse_sort(attention_mask), ',') AS attention_mask, {labels(0)} AS labels FROM righted""",
    "collate_labels": f"""
{ENCODED_BY_LANGUAGE}, {TRUNCATED}, {collated(8, 0)}
SELECT split, batch, pos, {labels(0)} AS labels FROM padded""",
    "collate_drop_last": f"""
{ENCODED_BY_LANGUAGE}, {TRUNCATED}, {collated(7, 0)}
SELECT split, batch, pos, {labels(0)} AS labels FROM padded
QUALIFY count(*) OVER (PARTITION BY split, batch) = 7""",
    "collate_pad_is_eos": f"""
{ENCODED_BY_LANGUAGE}, {TRUNCATED}, {collated(2, 1)}
SELECT split, batch, pos, array_to_string(input_ids, ',') AS input_ids, {labels(1)} AS labels FROM padded""",
    "vocab_invert": f"""
{TWO_VOCABS}
SELECT id, max(token) AS token FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id""",
    "vocab_shared_ids": f"{TWO_VOCABS} SELECT a.id FROM a JOIN b ON a.id = b.id AND a.token = b.token",
    "vocab_token_sets": f"""
{TWO_VOCABS}
SELECT token, 'both' AS membership FROM (SELECT token FROM a INTERSECT SELECT token FROM b)
UNION ALL SELECT token, 'only_first' FROM (SELECT token FROM a EXCEPT SELECT token FROM b)
UNION ALL SELECT token, 'only_second' FROM (SELECT token FROM b EXCEPT SELECT token FROM a)""",
    "vocab_common_ids": f"""
{TWO_VOCABS} SELECT a.id, a.token AS token_1, b.token AS token_2 FROM a JOIN b ON a.id = b.id""",
    "vocab_overlap_summary": f"""
{TWO_VOCABS}
SELECT (SELECT count(*) FROM a) AS vocab_size_1, (SELECT count(*) FROM b) AS vocab_size_2,
  (SELECT count(*) FROM a JOIN b USING (token)) AS shared_token_count,
  (SELECT count(*) FROM a JOIN b USING (token) WHERE a.id = b.id) AS same_token_same_id,
  (SELECT count(*) FROM a JOIN b USING (token) WHERE a.id <> b.id) AS same_token_diff_id,
  (SELECT count(*) FROM a JOIN b USING (id)) AS same_id_count,
  (SELECT count(*) FROM a JOIN b USING (id) WHERE a.token = b.token) AS same_id_same_token,
  (SELECT count(*) FROM a JOIN b USING (id) WHERE a.token <> b.token) AS same_id_diff_token,
  (SELECT count(*) FROM a WHERE token NOT IN (SELECT token FROM b)) AS only_in_1,
  (SELECT count(*) FROM b WHERE token NOT IN (SELECT token FROM a)) AS only_in_2""",
    "vocab_id_lookup": f"""
{TWO_VOCABS}, asked AS (
  SELECT label AS id FROM embeddings UNION SELECT CAST(max(vec_id) AS INTEGER) * 10 FROM embeddings)
SELECT asked.id, a.token AS token_1, b.token AS token_2
FROM asked LEFT JOIN a ON asked.id = a.id LEFT JOIN b ON asked.id = b.id""",
    "vocab_head_tail": f"""
{TWO_VOCABS}, shared AS (SELECT a.id FROM a JOIN b ON a.id = b.id AND a.token = b.token)
SELECT * FROM (SELECT id, 'head' AS part FROM shared ORDER BY id LIMIT 3)
UNION ALL SELECT * FROM (SELECT id, 'tail' AS part FROM shared ORDER BY id DESC LIMIT 3)""",
    "freeze_ids": f"""
{TWO_VOCABS}
SELECT CAST(a.id AS BIGINT) AS id FROM a JOIN b ON a.id = b.id AND a.token = b.token
WHERE a.id < (SELECT count(*) FROM embeddings)""",
    "freeze_bitmap": f"""
{TWO_VOCABS}, met AS (SELECT CAST(a.id AS BIGINT) AS id FROM a JOIN b ON a.id = b.id AND a.token = b.token
  WHERE a.id IN (SELECT vec_id FROM embeddings))
SELECT 'id' AS what, id AS value FROM met UNION ALL SELECT 'ids', count(*) FROM met""",
    "bitmap_members": """
WITH asked AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN -doc_id * 40009 ELSE doc_id END AS id FROM documents),
members AS (SELECT -vec_id * 3 * 40009 AS id FROM embeddings UNION SELECT c_custkey FROM customer)
SELECT doc_id, id, id IN (SELECT id FROM members) AS member FROM asked""",
    "freeze_counts": f"""
{TWO_VOCABS}
SELECT a.id < (SELECT count(*) FROM embeddings) AS valid, count(*) AS ids
FROM a JOIN b ON a.id = b.id AND a.token = b.token GROUP BY 1""",
    "unique_sorted_ids": "SELECT DISTINCT label AS id FROM embeddings ORDER BY id",
    "eot_ids": f"""
WITH {vocab()}, chat AS (
  SELECT * FROM vocab UNION ALL SELECT * FROM (VALUES ('</s>', 4096), ('<end_of_turn>', 4097)))
SELECT id FROM chat WHERE id <> 3 AND token IN ('<|eot_id|>', '<|im_end|>', '<|endoftext|>', '</s>', '<end_of_turn>',
  '<eot_id>', '<|eot|>', '<EOT>')
UNION SELECT 1""",
    "token_loss": f"{steps()} SELECT seq_id, pos, target, round(loss, 6) AS loss FROM losses",
    "token_loss_bucketed": f"{steps(PARTLY_IGNORED)} SELECT seq_id, pos, target, round(loss, 6) AS loss FROM losses",
    "token_loss_by_sequence": f"{steps(PARTLY_IGNORED)} SELECT seq_id, pos, target, round(loss, 6) AS loss FROM losses",
    "perplexity": f"""
{steps()} SELECT round(avg(loss), 6) AS eval_loss, round(exp(avg(loss)), 6) AS perplexity FROM losses""",
    "token_loss_gaps": f"""
{steps().replace('FROM embeddings)', 'FROM embeddings WHERE (vec_id // 8 + vec_id % 8 * 5) % 3 <> 0)')}
SELECT seq_id, pos, target, round(loss, 6) AS loss FROM losses""",
    "perplexity_by_sequence": f"""
{steps()} SELECT round(avg(loss), 6) AS eval_loss, round(exp(avg(loss)), 6) AS perplexity FROM losses""",
    "perplexity_capped": f"""
{sharp_steps()}
SELECT target, round(avg(loss), 6) AS eval_loss,
  CASE WHEN exp(avg(loss)) > 1e10 THEN CAST('inf' AS DOUBLE) ELSE round(exp(avg(loss)), 6) END AS perplexity
FROM losses GROUP BY target""",
    "perplexity_nan": """
WITH s AS (SELECT vec_id // 8 AS seq_id, count(*) AS n FROM embeddings GROUP BY 1)
SELECT seq_id % 11 = 0 AS is_nan, count(*) AS sequences, CAST(sum(CASE WHEN seq_id % 11 = 0 THEN 1 ELSE 0 END) AS BIGINT)
  AS nan_losses FROM s WHERE n > 1 GROUP BY 1""",
    "perplexity_by_group": f"""
{steps(PARTLY_IGNORED)}
SELECT target, round(avg(loss), 6) AS eval_loss, round(exp(avg(loss)), 6) AS perplexity
FROM losses GROUP BY target""",
    "perplexity_exact": f"""
{steps(PARTLY_IGNORED)}, kept AS (
  SELECT target, CAST(round(loss * 1e18) AS HUGEINT) AS loss FROM losses
  UNION ALL SELECT -1, CAST(round(loss * 1e18) AS HUGEINT) FROM losses)
SELECT target, round(sum(loss) / 1e18 / count(*), 6) AS eval_loss, round(exp(sum(loss) / 1e18 / count(*)), 6) AS perplexity
FROM kept GROUP BY target""",
    "l1_exact": """
WITH parts AS (
  SELECT list_sum(list_transform(embedding, lambda z: CAST(abs(CAST(z AS DOUBLE)) * 1152921504606846976 AS HUGEINT))) AS l1,
    vec_id IN (SELECT label FROM embeddings) AS hit FROM embeddings)
SELECT round(sum(l1) / 1152921504606846976.0, 6) AS total_l1,
  round(coalesce(sum(l1) FILTER (hit), 0) / 1152921504606846976.0, 6) AS frozen_l1 FROM parts""",
    "perplexity_empty": f"""
{steps().replace('vec_id // 8', 'vec_id').replace('vec_id % 8', '0')}
SELECT coalesce(avg(loss), CAST('inf' AS DOUBLE)) AS eval_loss,
  coalesce(exp(avg(loss)), CAST('inf' AS DOUBLE)) AS perplexity FROM losses""",
    "matrix_zero_rows": """
SELECT vec_id, array_to_string(list_transform(embedding, lambda z:
    CAST(round(CASE WHEN hit THEN 0 ELSE CAST(z AS DOUBLE) END, 6) AS DECIMAL(12,6))), ',') AS embedding
FROM (SELECT vec_id, embedding, vec_id IN (SELECT label FROM embeddings) AS hit FROM embeddings)""",
    "matrix_zero_by_bitmap": """
SELECT e.vec_id, array_to_string(list_transform(embedding, lambda z:
    CAST(round(CASE WHEN frozen.vec_id IS NOT NULL THEN 0 ELSE CAST(z AS DOUBLE) END, 6) AS DECIMAL(12,6))), ',') AS embedding
FROM embeddings e LEFT JOIN (SELECT DISTINCT label AS vec_id FROM embeddings) frozen ON e.vec_id = frozen.vec_id""",
    "matrix_output": """
SELECT matrix, flag, vec_id, hit AND (matrix = 'input' OR flag)
  OR list_max(list_transform(embedding, lambda z: abs(z))) = 0 AS zero
FROM (SELECT vec_id, embedding, vec_id IN (SELECT label FROM embeddings) AS hit FROM embeddings),
  (VALUES ('input'), ('output')) AS m(matrix), (VALUES (true), (false)) AS f(flag)""",
    "matrix_l1": """
WITH norms AS (
  SELECT list_sum(list_transform(embedding, lambda z: abs(CAST(z AS DOUBLE)))) AS l1,
    vec_id IN (SELECT label FROM embeddings) AS hit FROM embeddings)
SELECT 'before' AS state, round(sum(l1), 6) AS total_l1, round(coalesce(sum(l1) FILTER (hit), 0), 6) AS frozen_l1
FROM norms
UNION ALL
SELECT 'after', round(coalesce(sum(l1) FILTER (NOT hit), 0), 6), CAST(0 AS DOUBLE) FROM norms""",
    "frozen_matrix": f"""
{TWO_VOCABS}
SELECT vec_id, vec_id IN (SELECT a.id FROM a JOIN b ON a.id = b.id AND a.token = b.token) AS frozen FROM embeddings""",
    "strip_role_markers": stripped("SELECT conv_id, turn, role || ': ' || text AS text FROM conversations"),
    "strip_echoed_dialogue": stripped(
        "SELECT q.conv_id, q.turn, q.role || ': ' || q.text || chr(10) || r.role || ': ' || r.text AS text "
        "FROM conversations q JOIN conversations r ON q.conv_id = r.conv_id AND q.turn + 1 = r.turn"
    ),
    "batched_map": """
SELECT doc_id, CAST(n - 1 AS BIGINT) AS line_no, line FROM (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))""",
    "batched_groups": f"""
WITH {BY_LANGUAGE}, sharded AS (
  SELECT *, ntile(12) OVER (PARTITION BY split ORDER BY pos) - 1 AS shard FROM docs),
batched AS (
  SELECT *, (row_number() OVER (PARTITION BY split, shard ORDER BY pos) - 1) // 30 AS batch FROM sharded)
SELECT split, shard, batch, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars
FROM batched JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id) GROUP BY split, shard, batch""",
    "preview_rows": """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, substring(lang, 1, 20) AS lang, substring(source, 1, 20) AS source,
  substring(text, 1, 20) AS text FROM documents ORDER BY documents.doc_id LIMIT 20""",
    "prepare_corpus": f"""
{HELD_OUT_BLOCKS}
SELECT split, shard, batch, block, pos, input_ids FROM numbered""",
    "prepare_collated": f"""
{HELD_OUT_BLOCKS}
SELECT split, pos // 2 AS batch, pos, input_ids, array_to_string(list_transform(range(128), lambda x: 1), ',') AS attention_mask,
  array_to_string(list_transform(string_split(input_ids, ','), lambda x: CASE WHEN x = '0' THEN '-100' ELSE x END), ',') AS labels
FROM numbered""",
    "preview_blocks": f"""
{HELD_OUT_BLOCKS}
SELECT split, CAST(pos AS VARCHAR) AS pos, substring(input_ids, 1, 30) AS input_ids
FROM numbered ORDER BY numbered.split, numbered.pos LIMIT 5""",
    "prepare_global": f"""
WITH {vocab()}, {TRAIN}, {held_out('corpus')}, {encoded('documents')}, limited AS (
  SELECT * FROM parts WHERE split <> 'train' OR pos < 100), {packed('limited', 'split', 1, 1000)}
SELECT split, block, block AS pos, input_ids FROM blocks""",
    "accounts_global": f"""
WITH {TRAIN}, {held_out('corpus')}, totals AS (
  SELECT split, sum(len({WORDS}) + 1) AS total FROM parts WHERE split <> 'train' OR pos < 100 GROUP BY split)
SELECT split, CAST(total // 127 AS BIGINT) AS blocks, CAST(total AS BIGINT) AS tokens_in,
  CAST(total % 127 AS BIGINT) AS tokens_dropped FROM totals""",
    "prepare_without_nulls": f"""
WITH {vocab()}, corpus AS (SELECT doc_id, text, 'train' AS split FROM documents WHERE doc_id % 7 <> 0),
{held_out('corpus')}, {encoded('documents')}, {packed('parts', 'split, shard, batch', 4, 100)}, {NUMBERED}
SELECT split, shard, batch, block, pos, input_ids FROM numbered""",
    "blocks_by_number": f"""
{HELD_OUT_BLOCKS}, filed AS (SELECT split, pos, pos // 64 AS file, input_ids FROM numbered)
SELECT split, pos, file, input_ids, min(pos) OVER f AS first, max(pos) OVER f AS last, count(*) OVER f AS blocks,
  md5(string_agg(md5(input_ids), ',') OVER (PARTITION BY split, file ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS digest
FROM filed WINDOW f AS (PARTITION BY split, file)""",
    "blocks_of_range": f"""
{HELD_OUT_BLOCKS} SELECT split, pos, input_ids FROM numbered WHERE split = 'train' AND pos BETWEEN 20 AND 70""",
    "prepare_permuted": f"""
WITH RECURSIVE {vocab()}, {TRAIN}, {permuted('corpus')}, {permuted_parts()}, {encoded('documents')},
{packed('parts', 'split, shard, batch', 4, 100)}, {NUMBERED}
SELECT split, shard, batch, block, pos, input_ids FROM numbered""",
    "prepare_file_limit": f"""
WITH {vocab()}, first AS (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100), {encoded('first')}, {TRUNCATED}
SELECT 'train' AS split, doc_id AS pos, doc_id, array_to_string(input_ids, ',') AS input_ids FROM rows_cut""",
    "prepare_delivered": f"""
WITH {vocab()}, docs AS (
  SELECT doc_id, text, split, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS pos FROM (
    SELECT *, CASE source WHEN 'src0' THEN 'validation' WHEN 'src1' THEN 'extra' ELSE 'train' END AS split FROM documents)),
{encoded('documents')}, {packed('docs', 'split, shard, batch', 4, 100)}, {NUMBERED}
SELECT split, shard, batch, block, pos, input_ids FROM numbered""",
    "prepare_file_order": f"""
WITH {vocab()}, docs AS (
  SELECT doc_id, 'train' AS split, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents),
{encoded('documents')}, {packed('docs', 'split, shard, batch', 12, 30)}, {NUMBERED}
SELECT split, shard, batch, block, pos, input_ids FROM numbered""",
    "prepare_truncated": f"""
WITH {vocab()}, {TRAIN}, {held_out('corpus')}, {encoded('documents')}, {TRUNCATED}
SELECT split, pos, doc_id, array_to_string(input_ids, ',') AS input_ids FROM rows_cut JOIN parts USING (doc_id)""",
}
