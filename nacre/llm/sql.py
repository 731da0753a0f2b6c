"""DuckDB equivalents of the queries that SQL can express."""

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP4 = rf"""
WITH d AS (
  SELECT doc_id, source AS host, {_WORDS} AS words,
         length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS gram
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n >= 2),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(0, 8) AS t(k) GROUP BY doc_id),
m AS (SELECT d.doc_id, host, len(words) AS n_words, word_chars, n_symbols, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS failed
      FROM m),
h AS (SELECT host, count(*) AS n, sum(failed::INT) AS f FROM f GROUP BY host),
t AS (SELECT sum(n) AS n, sum(f) AS f, count(*) AS k, sum(f * f / n::DOUBLE) AS sq FROM h),
p AS (SELECT (f + 0.5::DOUBLE) / (n + 1) AS mean, n / k::DOUBLE AS per_host, (sq - f * f / n::DOUBLE) / greatest(k - 1, 1) AS between_ FROM t),
q AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest((between_ - mean * (1 - mean)) / per_host, 1e-9) - 1, 2.0), 10000.0) AS strength FROM p),
v AS (SELECT host, (f + mean * strength) / (n + strength) <= 0.5 AS host_kept FROM h, q)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
FROM f JOIN v ON f.host IS NOT DISTINCT FROM v.host
"""

OP8 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len({_WORDS}) AS size, md5('mix-0:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
-- Clamping round by round: what is above its cap is set to it, the rest is shared anew.
w AS (SELECT 0 AS round, source, source_size, weight, false AS clamped FROM s
  UNION ALL
  SELECT round + 1, source, source_size, weight, clamped OR above FROM (
    SELECT *, NOT clamped AND (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (clamped) OVER (), 0)) * weight
                 > 3 * source_size * sum(weight) FILTER (NOT clamped) OVER () AS above FROM w) x
  WHERE round < 100),
l AS (SELECT * FROM w WHERE round = 100),
t AS (SELECT source, source_size, CASE WHEN clamped THEN (3 * source_size)::DOUBLE ELSE
        ((sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (clamped) OVER (), 0)) * weight)::DOUBLE / (sum(weight) FILTER (NOT clamped) OVER ())::DOUBLE END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
x AS (SELECT *, round(target - whole * source_size)::BIGINT AS extra FROM e),
a AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM d)
SELECT doc_id, size::BIGINT AS size, source_size, target, (whole * size + greatest(0, least(size, extra - pos)))::BIGINT AS taken
FROM a JOIN x ON a.source IS NOT DISTINCT FROM x.source
"""

OP5 = r"""
WITH l AS (
  SELECT doc_id, u.i, u.line, regexp_matches(u.line, '[^\x20\x09-\x0D]') AS ink
  FROM (SELECT doc_id, string_split(text, chr(10)) AS xs FROM documents WHERE text IS NOT NULL) t,
       LATERAL (SELECT unnest(xs) AS line, generate_subscripts(xs, 1) AS i) u),
k AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos,
             len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n FROM l WHERE ink),
w AS (
  SELECT doc_id, pos, 3 AS lines, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS content FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
  UNION ALL SELECT doc_id, pos, 2, CASE WHEN n + lead(n, 1) OVER o >= 50 THEN line || chr(10) || lead(line, 1) OVER o END FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
  UNION ALL SELECT doc_id, pos, 1, line FROM k WHERE n >= 50),
r AS (SELECT *, row_number() OVER (PARTITION BY lines, content ORDER BY doc_id, pos) AS r FROM w WHERE content IS NOT NULL),
c AS (SELECT DISTINCT doc_id, pos + j AS pos FROM r, range(0, 3) AS t(j) WHERE r > 1 AND j < lines),
s AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (new) AS n_runs
      FROM (SELECT doc_id, pos, coalesce(pos > 1 + lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), true) AS new FROM c) GROUP BY doc_id),
t AS (SELECT l.doc_id, count(*) FILTER (l.ink) AS n_lines, md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (c.pos IS NULL), '')) AS kept_md5
      FROM l LEFT JOIN k USING (doc_id, i) LEFT JOIN c ON c.doc_id = k.doc_id AND c.pos = k.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs, coalesce(kept_md5, md5('')) AS kept_md5
FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN s USING (doc_id)
"""

OP6 = "SELECT doc_id, lang, source, n_chars, md5(coalesce(text, '')) AS text_md5 FROM documents"

OP3 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT * FROM v WHERE x IS NOT NULL AND len(x) > 0 AND NOT list_contains(list_transform(x, lambda c: c IS NULL OR NOT isfinite(c)), true) AND list_contains(list_transform(x, lambda c: c <> 0), true)),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS of FROM v UNION SELECT e.b, r.of FROM r JOIN e ON e.a = r.id)
SELECT vec_id, (SELECT count(*) FROM e WHERE e.a = v.vec_id)::BIGINT AS n_links, m.of AS component_id, m.of = vec_id AS kept
FROM v JOIN (SELECT id, min(of) AS of FROM r GROUP BY id) m ON m.id = vec_id
"""

OP7 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS of FROM documents UNION SELECT e.b, r.of FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.of AS component_id, m.of = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(of) AS of FROM r GROUP BY id) m ON m.id = d.doc_id
"""

# Bytes as two hexadecimal digits each, so that windows of 50 bytes are substrings of 100 digits.
OP10 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, h[2 * i - 1 : 2 * i + 98] AS s FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS i FROM d WHERE length(h) >= 100)),
r AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS m FROM w) WHERE doc_id > m),
g AS (SELECT doc_id, i, coalesce(i > 50 + lag(i) OVER (PARTITION BY doc_id ORDER BY i), true) AS new FROM r),
k AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
s AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, k),
c AS (SELECT doc_id, k, coalesce(lag(b) OVER o, 1) AS a, a AS b FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY k)
      UNION ALL SELECT doc_id, max(k) + 1, max(b), NULL FROM s GROUP BY doc_id),
p AS (SELECT doc_id, string_agg(CASE WHEN c.b IS NULL THEN h[2 * a - 1 :] WHEN c.b > a THEN h[2 * a - 1 : 2 * c.b - 2] ELSE '' END, '' ORDER BY k) AS kept FROM c JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM s GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN p USING (doc_id)
"""
