"""SQL counterparts of the corpus queries that SQL can express, written independently of the Spark code."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"



def _crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint)"
    byte = "list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda crc, b: {byte}))"


JACCARD = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY ALL),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(s.n, 0)::bigint AS n_shingles, m.low AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) m ON m.a = d.doc_id"""

HOST_RULES = rf"""
WITH split AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
dup AS (
  SELECT doc_id, sum(n - 1)::bigint AS n_dup_lines FROM (
    SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM split)
    WHERE regexp_matches(line, '{_WORD}') GROUP BY ALL) GROUP BY doc_id),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM split WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
repeated AS (SELECT doc_id, count(DISTINCT p)::bigint AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
rules AS (
  SELECT doc_id, host, len(w)::bigint AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols, coalesce(n_dup_lines, 0)::bigint AS n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint AS n_repeat_words
  FROM split LEFT JOIN dup USING (doc_id) LEFT JOIN repeated USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM rules),
hosts AS (SELECT host, count(*) AS docs, count(*) FILTER (WHERE base_failed) AS failed FROM judged WHERE host IS NOT NULL GROUP BY host),
moments AS (
  SELECT count(*) FILTER (WHERE docs >= 5) AS n, avg(failed / docs) FILTER (WHERE docs >= 5) AS mean,
    var_samp(failed / docs) FILTER (WHERE docs >= 5) AS spread, avg(1.0::double / docs) FILTER (WHERE docs >= 5) AS inverse,
    sum(failed) / sum(docs) AS overall FROM hosts),
fitted AS (
  SELECT CASE WHEN n >= 2 AND mean > 0 AND mean < 1 THEN mean ELSE overall END AS mean,
    CASE WHEN n >= 2 AND mean > 0 AND mean < 1 THEN
      CASE WHEN spread - mean * (1 - mean) * inverse > 0
        THEN least(greatest(mean * (1 - mean) / (spread - mean * (1 - mean) * inverse) - 1, 1), 1e6) ELSE 1e6 END
    ELSE 5.0 END AS weight FROM moments),
bad AS (
  SELECT host FROM hosts, fitted
  WHERE (failed + least(greatest(mean, 1e-9), 1 - 1e-9) * weight) / (docs + weight) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (host IS NULL OR host NOT IN (SELECT host FROM bad)) AS kept, host
FROM judged"""

RUNS = rf"""
WITH given AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, {_crc32("doc_id::varchar")} AS h FROM documents),
placed AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS parts FROM given),
words AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w
    ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // parts) + 1] END) END AS w FROM placed),
single AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(0, n)) AS i FROM words),
same AS (
  SELECT l.doc_id, l.i, r.i - l.i AS p FROM single l JOIN single r ON r.doc_id = l.doc_id AND r.x = l.x AND r.i > l.i
  WHERE 2 * (r.i - l.i) <= l.n),
islands AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM same),
stretches AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM islands GROUP BY doc_id, p, k),
runs AS (SELECT doc_id, start, length, min(p) AS period FROM stretches WHERE length >= 2 * p AND length >= 12 GROUP BY doc_id, start, length),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    first(struct_pack(s := start, l := length, q := period) ORDER BY length DESC, start, period) AS best FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
collapsed AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS c FROM single ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::bigint AS n_runs, best.s::bigint AS start, best.l::bigint AS length, best.q::bigint AS period,
  (1000 * best.l // best.q)::bigint AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN collapsed USING (doc_id)"""

TRIE = rf"""
WITH numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
convs AS (SELECT conv_id, count(*) AS n, {_crc32("conv_id::varchar")} % 9 AS h FROM numbered GROUP BY conv_id),
heads AS (SELECT c.conv_id, c.h, least(c.h, coalesce(d.n, 0)) AS taken FROM convs c LEFT JOIN convs d ON d.conv_id = c.conv_id - c.conv_id % 5),
turns AS (
  SELECT c.conv_id, t.i, role, text FROM heads c JOIN numbered t ON t.conv_id = c.conv_id - c.conv_id % 5 WHERE t.i <= c.h
  UNION ALL SELECT c.conv_id, c.taken + t.i - c.h, role, text FROM heads c JOIN numbered t ON t.conv_id = c.conv_id WHERE t.i > c.h),
lists AS (
  SELECT c.conv_id, coalesce(list(sha256(len(role) || ':' || role || text) ORDER BY i) FILTER (WHERE i IS NOT NULL), []) AS ways,
    coalesce(list(strlen(text) ORDER BY i) FILTER (WHERE i IS NOT NULL), []) AS sizes FROM convs c LEFT JOIN turns USING (conv_id) GROUP BY c.conv_id),
members AS (
  SELECT conv_id, d, len(ways) = d AS ends, array_to_string(ways[1:d], '') AS way, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size
  FROM (SELECT *, unnest(range(0, len(ways) + 1)) AS d FROM lists)),
nodes AS (
  SELECT d, way, min(conv_id) AS conv_id, count(*) AS n, max(size) AS size, sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends
  FROM members GROUP BY d, way),
children AS (SELECT left(way, 64 * (d - 1)) AS way, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
linked AS (SELECT v.*, coalesce(c.n, 0) AS n_children FROM nodes v LEFT JOIN children c ON c.way = v.way),
subtree AS (
  SELECT left(way, 64 * a) AS way, count(*) FILTER (WHERE n_children = 0) AS leaves, sum((n - 1) * size) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM linked) GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs, v.n_children, s.leaves AS n_leaves, s.saved::bigint AS saved_tokens, v.ends AS ends_sha256
FROM linked v JOIN subtree s ON s.way = v.way LEFT JOIN nodes p ON v.d > 0 AND p.way = left(v.way, 64 * (v.d - 1))"""
