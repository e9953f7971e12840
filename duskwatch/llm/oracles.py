"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from duskwatch.llm.quality import LINE_SHARE, MIN_WORDS, NGRAM_SHARES, REPEAT_PERCENT

#: The polynomial of CRC-32, bits reversed.
_POLYNOMIAL = 0xEDB88320


def _crc_table() -> list[int]:
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (_POLYNOMIAL if value & 1 else 0)
        table.append(value)
    return table


SHARDS = f"""
WITH sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, hex(encode(coalesce(text, ''))) AS digits FROM documents
), summed AS (
  SELECT doc_id, size, {_crc_table()}::BIGINT[] AS t,
    list_transform(range(0, length(digits) // 2), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::BIGINT) AS bytes
  FROM sized
), checked AS (
  SELECT doc_id, size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)])), 4294967295) AS text_crc32
  FROM summed
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before,
    sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id, text_crc32, size) AS position
  FROM checked
), cut AS (
  SELECT *, ((2 * before + size) * 40 // (2 * total))::INT AS shard FROM placed
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
  (position - min(position) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard
FROM cut
"""

_ESCAPED = "length(replace(replace(coalesce({0}, ''), '\\', '\\\\'), '<|', '<\\|'))"


def chat(tricky: str) -> str:
    return f"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{tricky}'), (-7, 1, 'assistant', '{tricky}')
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, count(*) OVER (PARTITION BY conv_id) AS total,
    sum(32 + {_ESCAPED.format('role')} + {_ESCAPED.format('text')})
      OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR n = total))::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""


#: Exact, as the query is on tables that are smaller than its windows.
NEIGHBOURS = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


def quality() -> str:
    """Windows of words as text; a word is covered if a repeated window starts at most n - 1 words before it."""
    sizes = sorted({5, *NGRAM_SHARES})
    follow = ", ".join(f"lead(word, {k}) OVER o AS w{k}" for k in range(1, max(sizes)))
    grams = ", ".join("concat_ws(' ', word, " + ", ".join(f"w{k}" for k in range(1, n)) + f") AS g{n}, w{n - 1} IS NOT NULL AS whole{n}" for n in sizes)
    again = ", ".join(f"whole{n} AND row_number() OVER (PARTITION BY doc_id, g{n}, whole{n} ORDER BY i) > 1 AS again{n}" for n in sizes)
    inside = ", ".join(f"bool_or(again{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS in{n}" for n in sizes)
    shares = ", ".join(f"coalesce(sum(length(word)) FILTER (in{n}), 0)::DOUBLE / sum(length(word)) AS s{n}" for n in sizes)
    good = " AND ".join(f"coalesce(s{n}, 0) <= {NGRAM_SHARES[n]!r}" for n in NGRAM_SHARES)
    return f"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)
), f AS (
  SELECT *, {follow} FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), g AS (
  SELECT doc_id, word, i, {grams} FROM f
), a AS (
  SELECT doc_id, word, i, {again}, whole5 AND count(*) OVER (PARTITION BY doc_id, g5, whole5) > 1 AS twice FROM g
), c AS (
  SELECT doc_id, word, {inside},
    bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS repeated
  FROM a
), words AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (repeated) AS n_repeat_words, {shares}
  FROM c GROUP BY doc_id
), l AS (
  SELECT doc_id, line, length(line) AS chars, row_number() OVER (PARTITION BY doc_id, line) > 1 AS dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), lines AS (
  SELECT doc_id, count(*) FILTER (dup) AS n_dup_lines, coalesce(sum(chars) FILTER (dup), 0)::DOUBLE / sum(chars) AS line_share
  FROM l GROUP BY doc_id
), m AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_words, 0) < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
    coalesce(line_share, 0) <= {LINE_SHARE!r} AND {good} AS fine
  FROM documents LEFT JOIN words USING (doc_id) LEFT JOIN lines USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, fine AND NOT base_failed AS kept FROM m
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def collocations(least: int = 30, longest: int = 4, best: int = 2000, covered: int = 80) -> str:
    """Every phrase as text, cut everywhere; its parts and the phrases around it are looked up by text."""
    return f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p
), g AS (
  SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, (SELECT unnest(range(1, {longest + 1})) AS size))
), c AS (
  SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM c WHERE size = 1 GROUP BY lang
), cand AS (
  SELECT lang, size, phrase, string_split(phrase, ' ') AS ws, f AS a FROM c WHERE size > 1 AND f >= {least}
), inside AS (
  SELECT lang, array_to_string(ws[i:i + short - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, size - short + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS short FROM cand))
  GROUP BY ALL
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand)
), scored AS (
  SELECT u.lang, u.phrase, u.a, k, x.f AS l, y.f AS r, 2000000::HUGEINT * a // (x.f + y.f) AS score
  FROM cuts u JOIN c x ON x.lang = u.lang AND x.phrase = u.head JOIN c y ON y.lang = u.lang AND y.phrase = u.tail
  QUALIFY row_number() OVER (PARTITION BY u.lang, u.phrase ORDER BY score, k) = 1
), kept AS (
  SELECT s.* FROM scored s LEFT JOIN inside i USING (lang, phrase) WHERE longer IS NULL OR longer::HUGEINT * 100 < {covered} * a::HUGEINT
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l,
  r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= {best}
"""


NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id,
    list_reduce(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2]), lambda x, y: x + y) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
