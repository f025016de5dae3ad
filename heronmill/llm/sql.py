"""DuckDB SQL for the rows of the queries that SQL can express."""

LINE_DEDUP = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM split
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), repeated AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.i, k.line, coalesce(k.doc_id > r.first_doc, false) AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

DECONTAMINATE = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (
  SELECT *, least(10, len(w)) AS n FROM items WHERE len(w) > 0
), wins AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)
), starts AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM docs, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)
), found AS (
  SELECT s.doc_id, s.i, s.n, w.item_id FROM starts s JOIN wins w ON s.n = w.n AND s.win = w.win
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), own AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(o.n_items, 0) AS n_items,
  sha256(coalesce(o.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN own o USING (doc_id)
"""

EMBEDDING_DEDUP = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT a AS id, a AS other FROM link UNION SELECT r.id, l.b FROM reach r JOIN link l ON r.other = l.a
), root AS (
  SELECT id, min(other) AS root FROM reach GROUP BY id
), n AS (
  SELECT a AS id, count(DISTINCT b) AS n FROM link GROUP BY a
)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(r.root, e.vec_id) AS component_id,
  e.vec_id = coalesce(r.root, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.id LEFT JOIN root r ON e.vec_id = r.id
"""

JACCARD_JOIN = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS shingle
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM (SELECT *, least(5, len(w)) AS n FROM d) WHERE n > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
  SELECT p.a, p.b, p.n = x.n AND p.n = y.n AS same
  FROM (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS n FROM s l JOIN s r USING (shingle)
        WHERE l.doc_id <> r.doc_id GROUP BY ALL) p
  JOIN size x ON x.doc_id = p.a JOIN size y ON y.doc_id = p.b
  WHERE p.n >= 0.8 * (x.n + y.n - p.n) - 1e-9
), reach AS (
  SELECT a AS id, a AS other FROM link UNION SELECT r.id, l.b FROM reach r JOIN link l ON r.other = l.a
), root AS (
  SELECT id, min(other) AS root FROM reach GROUP BY id
), n AS (
  SELECT a AS id, count(*) AS n, min(b) FILTER (same) AS twin FROM link GROUP BY a
)
SELECT e.doc_id, least(e.doc_id, coalesce(n.twin, e.doc_id)) AS class_id, coalesce(n.n, 0) AS n_links,
  coalesce(r.root, e.doc_id) AS component_id, e.doc_id = coalesce(r.root, e.doc_id) AS kept
FROM documents e LEFT JOIN n ON e.doc_id = n.id LEFT JOIN root r ON e.doc_id = r.id
"""

IMPORTANCE = r"""
WITH byte AS (
  SELECT b, list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) AS t
  FROM (SELECT unnest(range(0, 256)) AS b)
), crc AS (
  SELECT list(t ORDER BY b) AS t FROM byte
), words AS (
  SELECT doc_id, row, target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, text, row_number() OVER () AS row, false AS target FROM documents
        UNION ALL SELECT NULL, text, row_number() OVER (), true FROM benchmark)
), grams AS (
  SELECT row, target, w[i] AS g FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM words)
  UNION ALL SELECT row, target, w[i] || ' ' || w[i + 1] FROM (SELECT *, unnest(range(1, len(w))) AS i FROM words)
  UNION ALL SELECT row, target, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM words)
), counted AS (
  SELECT row, target, g, count(*) AS n FROM grams GROUP BY ALL
), hashed AS (
  SELECT g, xor(4294967295, list_reduce(
    list_transform(range(1, octet_length(encode(g)) + 1), lambda i: ('0x' || substr(hex(encode(g)), 2 * i - 1, 2))::BIGINT),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295)) % 10000 AS bucket
  FROM (SELECT DISTINCT g FROM counted), crc
), placed AS (
  SELECT row, target, bucket, n FROM counted JOIN hashed USING (g)
), own AS (
  SELECT bucket, coalesce(sum(n) FILTER (NOT target), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (target), 0)::DOUBLE AS t
  FROM placed GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM own) + 10000))
    / ((s + 1) * ((SELECT sum(t) FROM own) + 10000))))::BIGINT AS gain FROM own
), summed AS (
  SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM placed JOIN gain USING (bucket) WHERE NOT target GROUP BY row
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
      + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN summed USING (row) WHERE NOT words.target
), drawn AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20
    ORDER BY score DESC, doc_id NULLS LAST, weight DESC, n_features DESC) END AS place,
    5 * count(*) FILTER (n_words >= 20) OVER () // 100 AS most FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank FROM drawn
"""

FILL_MIDDLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), hashed AS (
  SELECT doc_id, text, u, len(u) AS n,
    list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS h FROM cut
), chosen AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100
      THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM hashed
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
    array_to_string(u[b + 1:n], '') AS s FROM chosen
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
