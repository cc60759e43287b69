"""DuckDB SQL for the rows of the queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

OP2 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines, words,
    len(list_filter(words, lambda x: x = upper(x) AND x <> lower(x) AND strlen(x) > 3))::BIGINT AS n_caps_words,
    len(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_shouts,
    coalesce(list_max(map_values(list_histogram(words))), 0)::BIGINT AS top_word
  FROM w),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, n_words - 6)) AS i FROM m WHERE n_words > 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM twice, range(0, 8) AS x(k) GROUP BY doc_id),
a AS (
  SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN r USING (doc_id)),
f AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 10 * word_chars THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines AND n_dup_lines > 1 THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 16 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_caps_words > 30 * n_words THEN 64 ELSE 0 END + CASE WHEN 100 * n_shouts > 30 * n_words THEN 128 ELSE 0 END
    + CASE WHEN 100 * top_word > 30 * n_words THEN 256 ELSE 0 END)::BIGINT AS failed_bits
  FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM f
"""

OP3 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
r AS (SELECT *, (3 * source_size)::DOUBLE AS cap, (3 * source_size)::DOUBLE / weight AS ratio FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS caps, coalesce(sum(weight) OVER b, 0) AS weights FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - caps) / (sum(weight) OVER () - weights) AS level FROM c),
t AS (SELECT source, source_size, least(cap, weight * max(CASE WHEN level <= ratio THEN level END) OVER ()) AS target FROM l),
k AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || text)[1:13])::BIGINT::DOUBLE / 4503599627370496.0 AS coin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM k
"""

OP6 = r"""
WITH l0 AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, p, line, (row_number() OVER (PARTITION BY doc_id ORDER BY p))::INT AS i, least(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')), 8) AS w FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
runs AS (
  SELECT a.doc_id, a.i AS start, b.i - a.i + 1 AS n, sum(c.w) AS words, sum(CASE WHEN c.i < b.i THEN c.w ELSE 0 END) AS less_last, sum(CASE WHEN c.i > a.i THEN c.w ELSE 0 END) AS less_first,
    string_agg(c.line, chr(10) ORDER BY c.i) AS body
  FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 7 JOIN l c ON c.doc_id = a.doc_id AND c.i BETWEEN a.i AND b.i GROUP BY a.doc_id, a.i, b.i),
windows AS (SELECT doc_id, start, n, body FROM runs WHERE words >= 8 AND (less_last < 8 OR less_first < 8)),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n, body ORDER BY doc_id, start) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT l.doc_id, l.p FROM later JOIN l ON l.doc_id = later.doc_id AND l.i BETWEEN later.start AND later.start + later.n - 1),
kept AS (
  SELECT l0.doc_id, count(gone.p) AS n_removed, coalesce(string_agg(CASE WHEN gone.p IS NULL THEN l0.line END, chr(10) ORDER BY l0.p), '') AS body
  FROM l0 LEFT JOIN gone ON gone.doc_id = l0.doc_id AND gone.p = l0.p GROUP BY l0.doc_id)
SELECT d.doc_id, coalesce(n_removed, 0)::BIGINT AS n_removed, len(coalesce(body, ''))::BIGINT AS n_chars, md5(coalesce(body, '')) AS text_md5 FROM documents d LEFT JOIN kept USING (doc_id)
"""

OP8 = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)
    UNION ALL SELECT doc_id, len(w)::VARCHAR || '|' || array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.m AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = d.doc_id
"""



def _op12(rounds: int = 3) -> str:
    """Plain k-means, all distances taken, one round after another."""
    parts = ["""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
  "c0 AS (SELECT row_number() OVER (ORDER BY h NULLS LAST, q) - 1 AS c, q FROM (SELECT sha256('1:' || vec_id) AS h, q FROM v ORDER BY h NULLS LAST, q LIMIT 16))"]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS (SELECT r, min({{'d': d, 'c': c}}) AS m FROM (
  SELECT v.r, c{i}.c, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c{i}.q[i]) * (v.q[i] - c{i}.q[i])))::BIGINT AS d FROM v CROSS JOIN c{i}) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""m{i} AS (SELECT c, list(x ORDER BY i) AS q FROM (SELECT a{i}.m.c AS c, i, floor(sum(v.q[i])::DOUBLE / count(*))::BIGINT AS x FROM a{i} JOIN v USING (r), range(1, 65) t(i) GROUP BY 1, 2) GROUP BY c),
c{i + 1} AS (SELECT c, coalesce(m{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN m{i} USING (c))""")
    last = f"a{rounds}"
    return f"""WITH {", ".join(parts)}
SELECT v.vec_id, {last}.m.c::INT AS cluster, {last}.m.d AS distance, (sum({last}.m.d) OVER (PARTITION BY {last}.m.c))::BIGINT AS cluster_inertia, (sum({last}.m.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(k.q, ',')) AS centroid_sha256 FROM v JOIN {last} USING (r) JOIN c{rounds} k ON k.c = {last}.m.c"""


OP12 = _op12()

ORACLES = {"op12_centroid_clusters": OP12, "op2_quality_rules": OP2, "op3_source_mixing": OP3, "op6_line_dedup": OP6, "op8_jaccard_join": OP8}
