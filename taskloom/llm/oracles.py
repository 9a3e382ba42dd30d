"""DuckDB SQL for the operators that SQL can express: plain statements of the results, for small inputs."""

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_REACH = """r(id, root) AS (SELECT id, id FROM nodes UNION SELECT e.b, r.root FROM r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON e.a = r.id)"""

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM w, unnest(range(1, len(w) - 18)) u(i)),
rep AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM rep, range(20) t(j)),
each AS (SELECT doc_id, p, w[p] AS x FROM w, unnest(range(1, len(w) + 1)) u(p)),
kept AS (SELECT doc_id, count(g.p) AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (g.p IS NULL) AS t FROM each e LEFT JOIN gone g USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS x FROM w, unnest(range(1, greatest(len(w), least(len(w) + 1, 2)))) u(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT id AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id, id = min(root) AS kept FROM r LEFT JOIN n ON n.doc_id = id GROUP BY id
"""

VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.93),
nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH},
d AS (SELECT id, count(*) AS k FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) z GROUP BY id)
SELECT r.id AS vec_id, CAST(coalesce(any_value(k), 0) AS BIGINT) AS n_links, min(root) AS component_id, r.id = min(root) AS kept FROM r LEFT JOIN d ON d.id = r.id GROUP BY r.id
"""
