"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
) SELECT * FROM r WHERE rank <= 5"""

#: Shingle sets, pairs that share one, links, and all that can be reached by links.
NGRAM_COMPONENTS = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a
) SELECT r.x AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.x GROUP BY r.x"""

#: Shortest runs of 50 words from each line on and up to each line; later copies of any of them are deleted.
LINE_DEDUP = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS o FROM documents WHERE text IS NOT NULL
), l AS (
  SELECT doc_id, o, t, length(t) - length(replace(t, ' ', '')) + 1 AS w, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS i
  FROM (SELECT doc_id, o, trim(regexp_replace(line, '\s+', ' ', 'g')) AS t FROM raw) WHERE t <> ''
), c AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l
), runs AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.w >= 50 GROUP BY 1, 2
  UNION
  SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.w >= 50 GROUP BY b.doc_id, b.i
), named AS (
  SELECT r.doc_id, s, e, min(l.o) AS os, max(l.o) AS oe, string_agg(l.t, chr(10) ORDER BY l.i) AS name
  FROM runs r JOIN l ON l.doc_id = r.doc_id AND l.i BETWEEN s AND e GROUP BY 1, 2, 3
), placed AS (
  SELECT *, first_value(doc_id) OVER f AS first_doc, first_value(s) OVER f AS first_s FROM named WINDOW f AS (PARTITION BY name ORDER BY doc_id, s)
), gone AS (
  SELECT doc_id, os, oe FROM placed WHERE doc_id <> first_doc OR s >= first_s + (e - s + 1)
), hit AS (
  SELECT DISTINCT raw.doc_id, raw.o FROM raw JOIN gone g ON g.doc_id = raw.doc_id AND raw.o BETWEEN g.os AND g.oe
), kept AS (
  SELECT raw.doc_id, string_agg(line, chr(10) ORDER BY raw.o) AS text FROM raw ANTI JOIN hit ON hit.doc_id = raw.doc_id AND hit.o = raw.o GROUP BY 1
), cleaned AS (
  SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, d.n_chars, d.doc_id IN (SELECT doc_id FROM hit) AS changed FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
) SELECT doc_id, text, CASE WHEN changed THEN length(text) ELSE n_chars END AS n_chars FROM cleaned"""
