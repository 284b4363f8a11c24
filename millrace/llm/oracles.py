"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from millrace.llm.license_scan import BASE, COVER, SLACK, TEMPLATES

OP1 = r"""
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, g.i AS i, min(doc_id) OVER (PARTITION BY g.s) AS first_doc
  FROM (SELECT doc_id, unnest(list_transform(range(1, length(h) // 2 - 48), lambda i: {'i': i, 's': array_slice(encode(h), 2 * i - 1, 2 * i + 98)})) AS g FROM docs)
), marked AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new
  FROM windows WHERE first_doc < doc_id
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM marked) GROUP BY doc_id, nth
), gaps AS (
  SELECT doc_id, a, b, lag(b, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS since FROM spans
), cut AS (
  SELECT doc_id, string_agg(substr(h, 2 * since - 1, 2 * (a - since)), '' ORDER BY a) AS head, max(b) AS tail,
         sum(b - a) AS n_removed, count(*) AS n_spans
  FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 1) - 1))) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)
"""

PHRASES = ", ".join(f"({n}, '{label}', {n < len(BASE)}, '{text}')" for n, (label, text) in enumerate(BASE + TEMPLATES))

OP2 = rf"""
WITH phrases(template, label, base, phrase) AS (
  VALUES {PHRASES}
), pairs AS (
  SELECT template, label, base, len(t) AS words, unnest(range(1, len(t))) AS q, t
  FROM (SELECT *, string_split(phrase, ' ') AS t FROM phrases)
), words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), places AS (
  SELECT doc_id, p, w[p] AS one, w[p + 1] AS two FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS p FROM words)
), votes AS (
  SELECT DISTINCT doc_id, template, label, base, words, q, p - q AS diagonal
  FROM places JOIN pairs ON one = t[q] AND two = t[q + 1]
), covered AS (
  SELECT d.doc_id, d.template, d.diagonal, v.q + e AS word, v.diagonal - d.diagonal AS more
  FROM (SELECT DISTINCT doc_id, template, diagonal FROM votes) d
  JOIN votes v ON v.doc_id = d.doc_id AND v.template = d.template AND v.diagonal BETWEEN d.diagonal AND d.diagonal + {SLACK}
  CROSS JOIN (VALUES (0), (1)) ends(e)
), shares AS (
  SELECT doc_id, template, label, base, diagonal, count(DISTINCT word) / CAST(any_value(p.words) + max(more) AS DOUBLE) AS share
  FROM covered JOIN (SELECT DISTINCT template, label, base, words FROM pairs) p USING (template) GROUP BY doc_id, template, label, base, diagonal
), phrases_found AS (
  SELECT label, doc_id, i - 1 AS word
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words) JOIN phrases ON base AND list_slice(w, i, i + len(string_split(phrase, ' ')) - 1) = string_split(phrase, ' ')
), base_found AS (
  SELECT doc_id, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels
  FROM phrases_found GROUP BY doc_id
), found AS (
  SELECT doc_id, n_base, first_word, last_word, base_labels, score, labels FROM (
    SELECT doc_id, max(share) AS score,
           array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE CASE WHEN base THEN label IN (SELECT label FROM phrases_found f WHERE f.doc_id = s.doc_id) ELSE share >= {COVER} END)), ',') AS labels
    FROM shares s GROUP BY doc_id
  ) LEFT JOIN base_found USING (doc_id)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM words LEFT JOIN found USING (doc_id)
"""

OP3 = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), component AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), degree AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN component USING (vec_id) LEFT JOIN degree USING (vec_id)
"""

OP9 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words
), windows AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM starts
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM windows WHERE nth > 1
), each AS (
  SELECT doc_id, w[k] AS word, k FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM words)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

ORACLES = {"op1_suffix_dedup": OP1, "op2_license_scan": OP2, "op3_embedding_near_dedup": OP3, "op9_substring_dedup": OP9}
