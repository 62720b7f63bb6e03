"""SQL that checks those queries of this subpackage which SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS width, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS words
  FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT r, i, width, array_to_string(w[i : i + width - 1], ' ') AS words
  FROM (SELECT d.*, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, (SELECT DISTINCT width FROM windows) WHERE len(w) >= width)
), found AS (
  SELECT r, i, p.width, item_id FROM places p JOIN windows v ON p.width = v.width AND p.words = v.words
), hit AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + width)) AS k FROM found) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT r, cast(item_id AS varchar) AS item FROM found) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS raw_role, text AS raw_text
  FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *,
    length(text) + length(text) - length(replace(text, '\', ''))
      + len(regexp_extract_all(text, '</?s>|\[/?INST\]|\[/?ROLE\]|\[/TURN\]')) AS own,
    length(role) + length(role) - length(replace(role, '\', ''))
      + len(regexp_extract_all(role, '</?s>|\[/?INST\]|\[/?ROLE\]|\[/TURN\]')) AS named
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), ''
    ORDER BY turn NULLS FIRST, raw_role NULLS FIRST, raw_text NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, raw_text NULLS FIRST) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  sum(CASE role WHEN 'user' THEN own + 18 WHEN 'assistant' THEN own + 5 ELSE own + named + 20 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

LINES = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), parts AS (
  SELECT r, host, text, line, {_LOWER.replace("coalesce(text, '')", "line")} AS low
  FROM (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), lines AS (
  SELECT r, host, text, line,
    array_to_string(regexp_extract_all(regexp_replace(low, '[1-9]', '0', 'g'), '[^\x20\x09-\x0D]+'), ' ') AS plain,
    len(regexp_extract_all(low, '[^\x20\x09-\x0D]+')) AS words
  FROM parts
), frequent AS (
  SELECT host, plain FROM lines GROUP BY host, plain HAVING count(DISTINCT text) > 20
), lost AS (
  SELECT r, sum(words) AS removed_words FROM lines JOIN frequent USING (host, plain) GROUP BY r
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY r
), windows AS (
  SELECT r, i, array_to_string(w[i : i + 7], ' ') AS words
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, words) AS n FROM windows) WHERE n > 1
), hit AS (
  SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS k FROM repeated) GROUP BY r
), figures AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN hit USING (r) LEFT JOIN lost USING (r)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM figures
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND removed_words <= 0.5 * n_words AS kept, removed_words
FROM judged"""

REPEATS = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT r, doc_id, 500 * c + p AS p, substr(part, 2 * p + 1, 100) AS s
  FROM (SELECT *, unnest(range(0, len(part) // 2 - 49)) AS p
    FROM (SELECT r, doc_id, c, substr(h, 1000 * c + 1, 1098) AS part FROM (SELECT *, unnest(range(0, len(h) // 1000 + 1)) AS c FROM d)))
), first_doc AS (
  SELECT s, min(doc_id) AS m FROM w GROUP BY s
), gone AS (
  SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM w JOIN first_doc USING (s) WHERE m < doc_id
), spans AS (
  SELECT r, min(p) AS a, max(p) + 50 AS z
  FROM (SELECT r, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS k FROM gone)
  GROUP BY r, k
), gaps AS (
  SELECT r, a, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM spans
), figures AS (
  SELECT r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS last FROM spans GROUP BY r
), heads AS (
  SELECT r, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head FROM gaps JOIN d USING (r) GROUP BY r
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN figures USING (r) LEFT JOIN heads USING (r)"""

REPEATED_LINES = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT r, doc_id, i, parts[i] AS line, {_LOWER.replace("coalesce(text, '')", r"trim(parts[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM d)
), keepers AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), kept AS (
  SELECT r, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM lines LEFT JOIN keepers USING (k)
  WHERE keeper IS NULL OR doc_id = keeper GROUP BY r
)
SELECT doc_id, len(parts)::BIGINT AS n_lines, (len(parts) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""

PHRASES = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, {_LOWER} AS low FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(low, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)
), grams AS (
  SELECT lang, m, w[i : i + m - 1] AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
    FROM (SELECT lang, w, unnest(range(1, 6)) AS m FROM pieces WHERE len(w) > 0) WHERE len(w) >= m)
), f AS (
  SELECT lang, m, g, count(*) AS a FROM grams GROUP BY lang, m, g HAVING count(*) >= 100
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), cuts AS (
  SELECT c.lang, c.m, c.g, c.a, k, x.a AS l, y.a AS r, n, (1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS score
  FROM (SELECT *, unnest(range(1, f.m)) AS k FROM f WHERE f.m > 1) c JOIN total USING (lang)
  JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1 : c.m]
), inside AS (
  SELECT DISTINCT lang, g FROM (
    SELECT lang, g[i : i + s - 1] AS g, a AS longer
    FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM f WHERE m > 2))
  ) JOIN f USING (lang, g) WHERE longer >= a
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM cuts) WHERE o = 1
), ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM best ANTI JOIN inside USING (lang, g)
)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked
) WHERE rank <= 2000"""

SQL = {
    "op2_decontamination": DECONTAMINATION,
    "op6_suffix_dedup": REPEATS,
    "op9_chat_format": CHAT,
    "op10_line_frequency": LINES,
    "op11_line_dedup": REPEATED_LINES,
    "op12_phrase_collocations": PHRASES,
}
