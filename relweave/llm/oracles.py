"""DuckDB SQL for the queries that SQL can express."""

OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
grams AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)
),
twice AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 8) AS o(k) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT d.doc_id,
    len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(dup.n_lines, 0)::BIGINT AS n_lines,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x)))::BIGINT AS n_caps
  FROM d JOIN words USING (r) LEFT JOIN covered USING (r) LEFT JOIN dup USING (r)
),
f AS (
  SELECT *,
    n_words < 20 AS f0, 100 * n_repeat_words > 30 * n_words AS f1, 100 * n_symbols > 50 * n_words AS f2,
    n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines AS f3,
    word_chars < 2 * n_words OR word_chars > 15 * n_words AS f4, 100 * n_caps > 50 * n_words AS f5
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  f0 OR f1 AS base_failed, NOT (f0 OR f1 OR f2 OR f3 OR f4 OR f5) AS kept,
  (f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT + 32 * f5::INT)::BIGINT AS fail_bits
FROM f
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {_TERMS} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
hits AS (SELECT r, item_id, i, n FROM doc_windows JOIN item_windows USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r),
places AS (SELECT r, p, w[p] AS term FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
item_terms AS (SELECT w, w[i] AS term, min(i) AS i FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT DISTINCT w FROM b WHERE len(w) > 0)) GROUP BY w, term),
freq AS (SELECT term, count(*) AS freq FROM places WHERE term IN (SELECT term FROM item_terms) GROUP BY term),
rare AS (
  SELECT w, term, freq, count(*) OVER (PARTITION BY w) AS least, min(freq) OVER (PARTITION BY w) AS fewest
  FROM (SELECT w, term, coalesce(freq, 0) AS freq FROM item_terms LEFT JOIN freq USING (term) QUALIFY row_number() OVER (PARTITION BY w ORDER BY coalesce(freq, 0), i) <= 5)
),
found AS (SELECT r, p, w, term, least FROM places JOIN rare USING (term) WHERE fewest > 0),
near AS (SELECT DISTINCT r, w FROM (SELECT x.r, x.w, x.p FROM found x JOIN found y ON x.r = y.r AND x.w = y.w AND y.p BETWEEN x.p AND x.p + 15 GROUP BY x.r, x.w, x.p, x.least HAVING count(DISTINCT y.term) = x.least)),
near_items AS (SELECT r, count(*) AS n_near, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id FROM near JOIN b USING (w)) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0)::BIGINT AS n_near, sha256(coalesce(near_items.s, '')) AS near_sha256
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r) LEFT JOIN near_items USING (r)
"""

OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * o >= 75 * (p.n + q.n - o)
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS v, doc_id AS c FROM d
  UNION
  SELECT edges.b, reach.c FROM reach JOIN edges ON edges.a = reach.v
)
SELECT d.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM d LEFT JOIN sizes USING (doc_id) JOIN (SELECT v, min(c) AS c FROM reach GROUP BY v) m ON m.v = d.doc_id
"""

_NEAREST = """
  SELECT q.r, q.p, any_value(q.c) AS c, min(64 * list_sum(list_transform(list_zip(q.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + b.entry) AS m
  FROM q JOIN {books} b USING (p) GROUP BY q.r, q.p
"""
_MOVED = """
  SELECT b.p, b.entry, coalesce(n.c, b.c) AS c
  FROM {books} b LEFT JOIN (
    SELECT p, entry, list((s - (s % n + n) % n) // n ORDER BY j) AS c
    FROM (SELECT p, entry, j, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT p, m % 64 AS entry, unnest(c) AS v, unnest(range(1, len(c) + 1)) AS j FROM {nearest}) GROUP BY p, entry, j)
    GROUP BY p, entry
  ) n USING (p, entry)
"""

OP11 = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, embedding AS e, len(embedding) // 16 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
q AS MATERIALIZED (SELECT r, vec_id, p, list_transform(e[p * w + 1 : (p + 1) * w], lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c FROM k, range(16) AS o(p)),
b0 AS MATERIALIZED (SELECT p, c, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS entry FROM q QUALIFY entry < 64),
a1 AS MATERIALIZED ({_NEAREST.format(books="b0")}),
b1 AS MATERIALIZED ({_MOVED.format(books="b0", nearest="a1")}),
a2 AS MATERIALIZED ({_NEAREST.format(books="b1")}),
b2 AS MATERIALIZED ({_MOVED.format(books="b1", nearest="a2")}),
a3 AS MATERIALIZED ({_NEAREST.format(books="b2")}),
coded AS (SELECT r, string_agg(lower(printf('%02x', m % 64)), '' ORDER BY p) AS code, sum(m // 64)::BIGINT AS error FROM a3 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, entry, j)) FROM (SELECT p, entry, unnest(c) AS v, unnest(range(1, len(c) + 1)) AS j FROM b2)) AS codebooks_sha256
FROM k JOIN coded USING (r)
"""

OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents
),
draws AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM draws
),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""

ORACLES: dict[str, str] = {"op2_quality_rules": OP2, "op4_decontamination": OP4, "op10_jaccard_join": OP10, "op11_exponion": OP11, "op12_fim": OP12}
