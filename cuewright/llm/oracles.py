"""DuckDB SQL for the operators that SQL can express."""

WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

NEAR_DEDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id
      GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, b AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT node, least(node, min(other)) AS root FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id,
       d.doc_id = coalesce(c.root, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""

SUBSTRINGS = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
dup AS (SELECT doc_id, i FROM win JOIN (SELECT h, min(doc_id) AS m FROM win GROUP BY h) USING (h) WHERE doc_id > m),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM dup),
one AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM one ANTI JOIN cov USING (doc_id, k)
         GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

MIXING = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 9) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
      FROM s),
r AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0))::DOUBLE
                / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
      FROM w WINDOW before AS (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce(min_by(level, 2.0 * source_size / weight) FILTER (level * weight <= 2 * source_size), 0) AS level FROM r),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * l.level) AS target FROM w, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t),
e AS (SELECT source, h, sum(size) AS s FROM d GROUP BY source, h),
u AS (SELECT source, h, s, sum(s) OVER (PARTITION BY source ORDER BY h) AS upto FROM e),
b AS (SELECT u.source, min_by(u.h, u.h) AS cut, min_by(u.s, u.h) AS s, min_by(u.upto, u.h) AS upto, any_value(rest) AS rest
      FROM u JOIN (SELECT source, target - passes * source_size AS rest FROM p) q ON u.source IS NOT DISTINCT FROM q.source
      WHERE upto > rest GROUP BY u.source)
SELECT d.doc_id, d.source, d.size, p.source_size, p.target,
       (d.size * (p.passes + CASE WHEN d.h < b.cut OR d.h = b.cut AND b.upto - b.rest < b.rest - (b.upto - b.s) THEN 1 ELSE 0 END))::BIGINT
         AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""

WARC = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (h)
"""

NEAREST = r"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda z: (z[2] - z[1]) * (z[2] - z[1])),
             lambda x, y: x + y)) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

NEGATIVES = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
      FROM v a JOIN v c ON c.vec_id <> a.vec_id AND len(c.e) = len(a.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
             s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score WHERE p.place <= 5)
SELECT * FROM n WHERE rank <= 5
"""

REPAIR = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
         lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
        FROM conversations),
crc AS (SELECT src.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT)),
                                      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM src, tab),
dam AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE kind <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS ini,
               rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS said FROM dam),
flt AS (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate'
                       WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
               lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM num),
ins(h, g2, c, a) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (1, 2, 3, 'I'), (3, 2, 3, 'I'), (2, 3, 3, 'I'), (0, 3, 6, 'II'), (1, 3, 6, 'II')),
edge(ini, g, h, c, a) AS (VALUES ('s', 0, 1, 0, 'K'), ('u', 0, 2, 0, 'K'), ('u', 1, 2, 0, 'K'), ('u', 3, 2, 0, 'K'), ('a', 2, 3, 0, 'K'),
                                 ('*', 0, 2, 3, 'R'), ('*', 1, 2, 3, 'R'), ('*', 3, 2, 3, 'R'), ('*', 2, 3, 3, 'R'),
                                 ('', 0, 0, 4, 'D'), ('', 1, 1, 4, 'D'), ('', 2, 2, 4, 'D'), ('', 3, 3, 4, 'D')),
ids AS (SELECT DISTINCT conv_id FROM conversations),
dp AS (SELECT conv_id, 0::BIGINT AS i, g2 AS g, {'c': c::BIGINT, 'a': a} AS best FROM ids, ins WHERE h = 0
       UNION ALL
       SELECT f.conv_id, f.i, ins.g2, min({'c': best.c + edge.c + ins.c + CASE WHEN fault = 'truncated' AND edge.a <> 'D' THEN 3 ELSE 0 END, 'a': best.a || edge.a || ins.a})
       FROM dp JOIN flt f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN edge ON edge.g = dp.g JOIN ins ON ins.h = edge.h
       WHERE edge.ini = '' OR f.fault NOT IN ('blank', 'duplicate') AND (edge.ini = '*' OR edge.ini = f.ini)
       GROUP BY f.conv_id, f.i, ins.g2),
top AS (SELECT d.conv_id, min(best) AS best FROM dp d JOIN (SELECT conv_id, max(i) AS i FROM dp GROUP BY conv_id) m
        ON d.conv_id IS NOT DISTINCT FROM m.conv_id AND d.i = m.i WHERE g IN (0, 3) GROUP BY d.conv_id),
ops AS (SELECT conv_id, generate_subscripts(string_split(best.a, ''), 1) AS p, unnest(string_split(best.a, '')) AS op FROM top WHERE best.a <> ''),
pos AS (SELECT *, sum(CASE WHEN op <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) AS i FROM ops),
line AS (SELECT a.conv_id, a.p, a.op, f.role, CASE WHEN op = 'I' THEN '' ELSE f.text END AS text, f.ini = 's' AND op = 'K' AS sys
         FROM pos a LEFT JOIN flt f ON f.conv_id IS NOT DISTINCT FROM a.conv_id AND f.i = a.i WHERE op <> 'D'),
seq AS (SELECT *, sum(CASE WHEN sys THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS q FROM line),
txt AS (SELECT conv_id, string_agg(CASE WHEN op = 'K' THEN role WHEN q % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS t FROM seq GROUP BY conv_id),
cnt AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
               count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
               count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY conv_id)
SELECT top.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c AS cost, best.a AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM top LEFT JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM top.conv_id LEFT JOIN txt ON txt.conv_id IS NOT DISTINCT FROM top.conv_id
"""
