"""SQL for DuckDB that gives the rows of those operator queries that SQL can express."""

CHAT = """
WITH RECURSIVE c AS (SELECT * FROM conversations),
u AS (SELECT conv_id, turn FROM c WHERE role = 'user'),
lv AS (
  SELECT conv_id, turn, 0 AS level FROM u WHERE NOT EXISTS (SELECT 1 FROM u AS p WHERE p.conv_id = u.conv_id AND p.turn = u.turn - 2)
  UNION ALL SELECT u.conv_id, u.turn, lv.level + 1 FROM u JOIN lv ON u.conv_id = lv.conv_id AND u.turn = lv.turn + 2
),
j AS (
  SELECT c.*, nx.turn AS result_turn, pv.turn AS call_turn, own.level AS own_level, prev.level AS prev_level
  FROM c
  LEFT JOIN c AS nx ON nx.conv_id = c.conv_id AND nx.turn = c.turn + 1 AND nx.role = 'assistant'
  LEFT JOIN u AS pv ON pv.conv_id = c.conv_id AND pv.turn = c.turn - 1
  LEFT JOIN lv AS own ON own.conv_id = c.conv_id AND own.turn = c.turn
  LEFT JOIN lv AS prev ON prev.conv_id = c.conv_id AND prev.turn = c.turn - 1
)
SELECT conv_id, turn, role,
  CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
  CASE role WHEN 'user' THEN conv_id || '-' || turn WHEN 'assistant' THEN conv_id || '-' || (turn - 1) END AS call_id,
  CASE role WHEN 'user' THEN result_turn WHEN 'assistant' THEN call_turn END AS linked_turn,
  coalesce(CASE role WHEN 'user' THEN own_level WHEN 'assistant' THEN prev_level END, 0) AS level,
  CASE role WHEN 'assistant' THEN 1 ELSE 0 END AS step,
  CASE role WHEN 'user' THEN CASE WHEN result_turn IS NULL THEN 'open' ELSE 'linked' END WHEN 'assistant' THEN CASE WHEN call_turn IS NULL THEN 'orphan' ELSE 'linked' END ELSE 'plain' END AS status,
  CASE role WHEN 'user' THEN CAST(length(text) >= 40 AND turn BETWEEN 0 AND 4 AS INTEGER) END AS valid,
  CASE role
    WHEN 'user' THEN '{"arguments":{' || CASE WHEN turn >= 2 THEN '"after":{"$result":"' || conv_id || '-' || (turn - 2) || '"},' ELSE '' END || '"page":' || turn || ',"query":' || to_json(text) || '},"id":"' || conv_id || '-' || turn || '","name":"search","role":"user","type":"call"}'
    WHEN 'assistant' THEN '{"call_id":"' || conv_id || '-' || (turn - 1) || '","content":' || to_json(text) || ',"role":"assistant","type":"result"}'
    ELSE '{"content":' || to_json(text) || ',"role":' || to_json(role) || ',"type":"message"}'
  END AS message
FROM j
"""

JACCARD = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, chr(1))] ELSE [] END) AS sh FROM d
  )
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n AS x ON x.doc_id = p.a JOIN n AS y ON y.doc_id = p.b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""

EMBEDDINGS = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e AS a JOIN e AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT c.a AS vec_id, coalesce(k.n, 0) AS n_links, c.component_id, c.component_id = c.a AS kept FROM c LEFT JOIN k ON k.a = c.a
"""

REPEATS = """
WITH n AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 49, 0))) AS p FROM n)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
hit AS (SELECT w.doc_id, w.p FROM w JOIN f ON w.s = f.s WHERE f.first < w.doc_id),
e AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM hit),
g AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM e),
r AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, k),
seg AS (
  SELECT r.doc_id, a AS o, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0))) AS x FROM r JOIN n ON n.doc_id = r.doc_id
  UNION ALL
  SELECT n.doc_id, n.n + 1, substr(h, 2 * coalesce(t.b, 0) + 1) FROM n LEFT JOIN (SELECT doc_id, max(b) AS b FROM r GROUP BY doc_id) AS t ON t.doc_id = n.doc_id
),
kept AS (SELECT doc_id, sha256(unhex(string_agg(x, '' ORDER BY o))) AS kept_sha256 FROM seg GROUP BY doc_id),
t AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_bytes, CAST(coalesce(t.removed, 0) AS BIGINT) AS n_removed, coalesce(t.spans, 0) AS n_spans, kept.kept_sha256
FROM n JOIN kept ON kept.doc_id = n.doc_id LEFT JOIN t ON t.doc_id = n.doc_id
"""

_TREE = """
  list_transform(list_filter(regexp_extract_all({0}, '(?:[^\\n]|\\n[^\\n])*\\n\\n+|(?:[^\\n]|\\n[^\\n])+\\n?|\\n'), lambda x: x <> ''),
    lambda s: list_transform(list_filter(regexp_extract_all(s, '[^\\n]*\\n+|[^\\n]+'), lambda x: x <> ''),
      lambda p: list_transform(regexp_extract_all(p, '(?s).{{1,31}}?[.!?][ \\t\\n\\x0B\\f\\r]|(?s).{{1,32}}'), lambda x: sha256('L' || x))))"""
_PARENT = "list_transform({0}, lambda s: sha256('{1}' || array_to_string(s, '')))"
_DIFFERS = "list_position(list_transform(range(1, greatest(len({0}), len({1})) + 1), lambda i: ({0})[i] IS DISTINCT FROM ({1})[i]), true)"

FINGERPRINTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS next_text FROM documents),
e AS (SELECT *, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM d),
t AS (SELECT *, {_TREE.format("text")} AS a, {_TREE.format("edited")} AS b, {_TREE.format("next_text")} AS c FROM e),
p AS (SELECT *, list_transform(a, lambda s: {_PARENT.format("s", "P")}) AS pa, list_transform(b, lambda s: {_PARENT.format("s", "P")}) AS pb FROM t),
s AS (SELECT *, {_PARENT.format("pa", "S")} AS sa, {_PARENT.format("pb", "S")} AS sb FROM p),
f AS (SELECT *, coalesce({_DIFFERS.format("sa", "sb")}, 0) AS section FROM s),
g AS (SELECT *, CASE WHEN section = 0 THEN 0 ELSE coalesce({_DIFFERS.format("coalesce(pa[section], [])", "coalesce(pb[section], [])")}, 0) END AS paragraph FROM f),
l AS (SELECT doc_id, 'a' AS side, unnest(flatten(flatten(a))) AS leaf FROM t UNION ALL SELECT doc_id, 'b', unnest(flatten(flatten(b))) FROM t UNION ALL SELECT doc_id, 'c', unnest(flatten(flatten(c))) FROM t),
m AS (SELECT doc_id, leaf, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b, count(*) FILTER (side = 'c') AS c FROM l GROUP BY ALL),
n AS (SELECT doc_id, sum(least(a, b)) AS ab, sum(a + b) AS all_ab, sum(least(a, c)) AS ac, sum(a + c) AS all_ac FROM m GROUP BY doc_id)
SELECT g.doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, sha256('R' || array_to_string(sa, '')) AS fingerprint, sha256('R' || array_to_string(sb, '')) AS edited_fingerprint,
  CASE WHEN coalesce(all_ab, 0) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * ab::DOUBLE / all_ab::DOUBLE END AS near_edited,
  CASE WHEN coalesce(all_ac, 0) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * ac::DOUBLE / all_ac::DOUBLE END AS near_next,
  len(sa) AS n_sections, section AS first_edited_section, paragraph AS first_edited_paragraph,
  CASE WHEN paragraph = 0 THEN 0 ELSE coalesce({_DIFFERS.format("coalesce(coalesce(a[section], [])[paragraph], [])", "coalesce(coalesce(b[section], [])[paragraph], [])")}, 0) END AS first_edited_piece
FROM g LEFT JOIN n ON n.doc_id = g.doc_id
"""

ORACLES = {"op2_chat_formatting": CHAT, "op3_ngram_jaccard_join": JACCARD, "op4_embedding_near_dedup": EMBEDDINGS, "op8_document_fingerprints": FINGERPRINTS, "op10_suffix_array_dedup": REPEATS}
