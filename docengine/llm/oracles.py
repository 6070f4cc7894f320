"""DuckDB SQL with the rows of those queries that SQL can express."""

from __future__ import annotations

WORD = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MINHASH = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORD}) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM d),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(root) AS c FROM r GROUP BY node)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN m ON node = doc_id"""

EMBEDDING = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(root) AS c FROM r GROUP BY node), n AS (SELECT a, count(*) AS k FROM e GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN m ON node = vec_id LEFT JOIN n ON a = vec_id"""

_ORDER = "ORDER BY turn, role, text"
CHAT = f"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
w AS (SELECT *, lag(role) OVER (PARTITION BY conv_id {_ORDER}) AS prev, lead(role) OVER (PARTITION BY conv_id {_ORDER}) AS next, length(replace(replace(replace(text, '\\', '\\e'), '###', '\\h'), '</turn>', '\\t')) AS body FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256,
CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' {_ORDER})) AS loss_sha256,
CAST(sum(4 + length(role) + 2 + body + 8) AS BIGINT) AS formatted_chars,
bool_and(CASE WHEN prev IS NULL THEN role IN ('system', 'user') WHEN prev = 'user' THEN role = 'assistant' ELSE role = 'user' END AND (next IS NOT NULL OR role = 'assistant')) AS valid FROM w GROUP BY conv_id"""

REPEATS = f"""WITH l AS (SELECT doc_id, regexp_extract_all(text, {WORD}) AS w FROM documents),
x AS (SELECT doc_id, i - 1 AS i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM l WHERE len(w) >= 50)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM x),
h AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM c WHERE n > 1),
s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM h) GROUP BY doc_id, z),
h2 AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM c WHERE k > 1),
s2 AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM h2) GROUP BY doc_id, z),
t2 AS (SELECT doc_id, sum(b - a) AS later FROM s2 GROUP BY doc_id)
SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS repeated_words, CAST(coalesce(max(later), 0) AS BIGINT) AS later_words, string_agg(a || '-' || b, ' ' ORDER BY a) AS spans FROM s LEFT JOIN t2 USING (doc_id) GROUP BY doc_id"""
