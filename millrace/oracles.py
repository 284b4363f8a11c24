"""DuckDB SQL with the rows of each query of ``queries``."""

from __future__ import annotations

from millrace import code_queries

LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS position FROM documents)"
LINE_SPANS = LINES + """, line_spans AS (
  SELECT doc_id, position, coalesce(sum(length(line) + 1) OVER w, 0) AS o_start, coalesce(sum(length(line) + 1) OVER w, 0) + length(line) AS o_end
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""
WORD_SPANS = "word_spans AS (SELECT doc_id, i - 1 AS start, i + 5 AS stop FROM (SELECT doc_id, text, unnest(range(1, length(text) - 4)) AS i FROM documents WHERE contains(text, 'icense')) WHERE substr(text, i, 6) = 'icense')"
SHAPES = r"""shaped AS (
  SELECT *, list_filter(regexp_split_to_array(lower(text), '[ \n\t\r]+'), lambda w: w <> '') AS w FROM documents
), repeated AS (
  SELECT doc_id, lang, source, n_chars, copies FROM (
    SELECT *, count(*) OVER (PARTITION BY lang, array_to_string(w, ' ')) AS copies FROM shaped WHERE len(w) >= 12
  ) WHERE copies > 1
)"""
FINDINGS = SHAPES + ", " + LINE_SPANS + """, found AS (
  SELECT 'D1' AS rule_id, lang AS context_id, source || '/' || doc_id AS path, 0 AS start, n_chars AS length, 'This text repeats' AS message,
         'Violation' AS disposition, 'copies=' || copies AS evidence, 'Local' AS fix_complexity FROM repeated
  UNION ALL
  SELECT 'D2', lang, source || '/' || doc_id, 0, n_chars, 'This text has no label', 'Review', NULL, NULL
  FROM documents ANTI JOIN labels USING (doc_id)
  UNION ALL
  SELECT 'D3', lang, source || '/' || doc_id, o_start, o_end - o_start, 'This line is long', 'Violation', NULL, 'Trivial'
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o_start) AS nth FROM line_spans WHERE o_end - o_start > 400)
  JOIN documents USING (doc_id) WHERE nth = 1
)"""
EDITS = """edits AS (
  SELECT source AS file_identity, doc_id * 2 AS edit_id, n_chars // 3 AS start, n_chars // 50 AS length FROM documents
  UNION ALL
  SELECT source, doc_id * 2 + 1, (doc_id * 37) % 5000, doc_id % 3 FROM documents
), conflicts AS (
  SELECT x.file_identity, x.edit_id AS a, y.edit_id AS b FROM edits x JOIN edits y ON x.file_identity = y.file_identity AND x.edit_id < y.edit_id
  WHERE CASE WHEN x.length = 0 OR y.length = 0 THEN x.start <= y.start + y.length AND y.start <= x.start + x.length
             ELSE x.start < y.start + y.length AND y.start < x.start + x.length END
)"""
TREE = """tree AS (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders
), ring AS (
  SELECT * FROM tree UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
)"""
RANGES = """ranges AS (
  SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, CAST(hour(ts) * 4 AS INTEGER) AS first_line, CAST(hour(ts) * 4 + event_id % 7 AS INTEGER) AS last_line,
         CASE WHEN event_type IN ('click', 'purchase', 'view') THEN 'Covered' WHEN event_type = 'error' THEN 'Uncovered' ELSE 'Unknown' END AS state FROM events
)"""
MERGED = "CASE WHEN bool_and(state = 'Covered') THEN 'Covered' WHEN bool_and(state = 'Uncovered') THEN 'Uncovered' ELSE 'Unknown' END AS state"

ORACLES = {
    "q_select_where": "SELECT doc_id, source, n_chars FROM documents WHERE n_chars >= 1000 AND lang = 'en'",
    "q_select_many_lines": f"WITH {LINES} SELECT doc_id, CAST(position AS INTEGER) AS position, line FROM lines",
    "q_except_when": "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE NOT coalesce(coalesce(nullif(o_orderpriority, '5-LOW') < '3', false) OR coalesce(o_totalprice > 200000, false), false)",
    "q_concat": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'",
    "q_union_identity": """
      SELECT c_custkey, c_nationkey, why FROM (
        SELECT c_custkey, c_nationkey, 'balance' AS why, 0 AS side FROM customer WHERE c_acctbal > 0
        UNION ALL SELECT c_custkey, c_nationkey, 'segment', 1 FROM customer WHERE c_mktsegment = 'BUILDING'
      ) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY side) = 1""",
    "q_join_equi": "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'",
    "q_join_folded_key": "SELECT p_partkey, p_type, class FROM part JOIN (VALUES ('Economy', 'cheap'), ('PROMO', 'offer'), ('standard', 'plain'), (NULL, 'none')) k(kind, class) ON lower(p_type) = lower(kind)",
    "q_without_matching_key": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id IS NOT DISTINCT FROM d.doc_id)",
    "q_without_matching_theta": "SELECT o_orderkey, o_custkey FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND (b.o_orderdate > a.o_orderdate OR (b.o_orderdate = a.o_orderdate AND b.o_orderkey > a.o_orderkey)))",
    "q_set_missing": """
      WITH want AS (SELECT lower(c_mktsegment) AS word, c_custkey AS nth FROM customer UNION ALL SELECT upper(p_type[1]) || lower(p_type[2:]), p_partkey FROM part)
      SELECT arg_min(word, nth) AS word FROM want WHERE lower(word) NOT IN (SELECT lower(p_type) FROM part WHERE p_size > 10) GROUP BY lower(word)""",
    "q_set_unexpected": "SELECT s_nationkey AS nation FROM supplier EXCEPT SELECT r_regionkey FROM region",
    "q_place_filters": r"""
      WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)
      SELECT page_id, host FROM p WHERE list_contains(string_split(path, '/')[:-2], 'en') OR regexp_full_match(host, 'm\.[^/]*\.net')""",
    "q_constant_groups": "SELECT p_brand, p_type, p_partkey, CAST(count(*) OVER (PARTITION BY p_brand, p_type) AS BIGINT) AS n FROM part QUALIFY n >= 2",
    "q_template_groups": r"""
      WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+') AS scheme, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '') AS path FROM pages),
      t AS (SELECT page_id, scheme, regexp_replace(path, '[0-9]+', '{}') AS template FROM p WHERE len(regexp_extract_all(path, '[0-9]+')) = 1)
      SELECT *, count(*) OVER (PARTITION BY scheme, template) AS n FROM t QUALIFY n >= 2""",
    "q_duplicates": f"WITH {SHAPES} SELECT doc_id, lang, copies FROM repeated",
    "q_membership": """
      SELECT doc_id, string_agg(DISTINCT g, ';' ORDER BY g) AS groups, count(DISTINCT g) AS n FROM (
        SELECT doc_id, lang || '/' || source AS g FROM documents UNION ALL SELECT doc_id, 'quality=' || quality FROM labels
      ) WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY doc_id""",
    "q_exactly_one": """
      WITH links AS (SELECT u.conv_id, u.turn, count(a.turn) AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user') u
        LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' GROUP BY ALL)
      SELECT conv_id FROM links GROUP BY conv_id HAVING bool_and(n = 1)""",
    "q_sections": f"""
      WITH {LINES}, marked AS (SELECT *, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY position) AS before FROM lines),
      numbered AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY before) AS section FROM marked WHERE trim(line) <> '')
      SELECT doc_id, CAST(section AS INTEGER) AS section, count(*) AS n_lines, CAST(min(position) AS INTEGER) AS first_line FROM numbered GROUP BY doc_id, section""",
    "q_blank_lines": f"WITH {LINES} SELECT doc_id, count(*) FILTER (WHERE trim(line) = '') AS blank, count(*) AS n_lines FROM lines GROUP BY doc_id",
    "q_chain_before_after": """
      SELECT conv_id, turn, coalesce(string_agg(role, ',') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
             coalesce(string_agg(role, ',') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after,
             row_number() OVER w = 1 AS is_first, lead(1) OVER w IS NULL AS is_last
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "q_overlap_conflicts": f"WITH {EDITS} SELECT file_identity, a, b FROM conflicts",
    "q_containment": f"WITH {LINE_SPANS}, {WORD_SPANS} SELECT doc_id, start, CAST(position AS INTEGER) AS position FROM word_spans JOIN line_spans USING (doc_id) WHERE o_start <= start AND o_end >= stop",
    "q_nearest_ancestor": f"WITH {LINE_SPANS}, {WORD_SPANS} SELECT doc_id, start, CAST(o_start AS BIGINT) AS o_start, CAST(o_end AS BIGINT) AS o_end FROM word_spans JOIN line_spans USING (doc_id) JOIN documents USING (doc_id) WHERE o_start <= start AND o_end >= stop",
    "q_suppress_innermost": """
      WITH stamped AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), scopes AS (
        SELECT user_id, min(s) AS o_start, max(s) AS o_end FROM stamped GROUP BY user_id
        UNION ALL SELECT user_id, min(s), max(s) FROM stamped GROUP BY user_id, event_type
      )
      SELECT event_id, o_start, o_end FROM stamped JOIN scopes USING (user_id) WHERE event_type = 'error' AND o_start <= s AND o_end >= s
      QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY o_end - o_start, o_start DESC) = 1""",
    "q_findings": f"WITH {FINDINGS} SELECT rule_id, context_id, path, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, message, disposition, evidence, fix_complexity FROM found",
    "q_aggregate_findings": f"""
      WITH {FINDINGS}, everywhere AS (
        SELECT * FROM found UNION ALL SELECT * REPLACE ('second' AS context_id, 'Review' AS disposition, 'seen again' AS evidence, 'Architectural' AS fix_complexity) FROM found
      )
      SELECT rule_id, path, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, message, CASE WHEN bool_and(disposition = 'Review') THEN 'Review' ELSE 'Violation' END AS disposition,
             string_agg(DISTINCT evidence, '; ' ORDER BY evidence) AS evidence, arg_min_null(fix_complexity, context_id) AS fix_complexity, count(DISTINCT context_id) AS contexts
      FROM everywhere GROUP BY rule_id, path, start, length, message""",
    "q_status": f"""
      WITH {FINDINGS}, places AS (SELECT 'corpus/' || context_id AS project_path, rule_id, path, start, length, message, min(fix_complexity) AS fix_complexity FROM found WHERE disposition = 'Violation' GROUP BY ALL)
      SELECT project_path, fix_complexity, count(*) AS n FROM places GROUP BY project_path, fix_complexity""",
    "q_report_once": "SELECT CAST(user_id AS VARCHAR) AS user, event_id FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "q_baseline_diff": """
      WITH accepted AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'X' ELSE o_orderstatus END || '|' || o_orderpriority AS content FROM orders WHERE o_orderpriority <> '1-URGENT')
      SELECT o_orderkey, CASE WHEN content IS NULL THEN 'Added' WHEN content = o_orderstatus || '|' || o_orderpriority THEN 'Unchanged' ELSE 'Modified' END AS change
      FROM orders LEFT JOIN accepted USING (o_orderkey)""",
    "q_changed_symbols": """
      WITH parts AS (SELECT l_orderkey AS symbol, 'f' || l_linenumber AS path, l_partkey AS start, l_returnflag || ':' || l_linestatus AS text, l_shipdate AS shipped FROM lineitem),
      now AS (SELECT symbol, string_agg(text, chr(10) ORDER BY path, start, text) AS text FROM parts GROUP BY symbol),
      old AS (SELECT symbol, string_agg(text, chr(10) ORDER BY path, start, text) AS text FROM (SELECT * REPLACE (CASE WHEN start % 5 = 0 THEN 'N:F' ELSE text END AS text) FROM parts WHERE shipped < TIMESTAMP '2001-01-01') GROUP BY symbol)
      SELECT CAST(symbol AS VARCHAR) AS symbol, CASE WHEN old.text IS NULL THEN 'Added' WHEN old.text = now.text THEN 'Unchanged' ELSE 'Modified' END AS change FROM now LEFT JOIN old USING (symbol)""",
    "q_merge_points": f"WITH {RANGES} SELECT user_id, day, {MERGED} FROM ranges GROUP BY user_id, day",
    "q_merge_ranges": f"WITH {RANGES}, each AS (SELECT user_id, first_line, last_line, day, {MERGED} FROM ranges GROUP BY ALL) SELECT user_id, first_line, last_line, {MERGED} FROM each GROUP BY user_id, first_line, last_line",
    "q_line_measure": f"""
      WITH {RANGES}, lines AS (SELECT user_id, unnest(range(first_line, last_line + 1)) AS line, state FROM ranges),
      each AS (SELECT user_id, line, bool_and(state = 'Covered') AS yes, bool_or(state = 'Unknown') AS open FROM lines GROUP BY user_id, line),
      sums AS (SELECT user_id, count(*) FILTER (WHERE yes) AS covered, count(*) AS coverable, NOT bool_or(open) AS is_complete FROM each GROUP BY user_id)
      SELECT *, is_complete AND coverable > 0 AND covered * 100.0 / coverable >= 50 AS passed,
             CASE WHEN is_complete AND coverable > 0 THEN CASE WHEN covered = coverable THEN 'Covered' ELSE 'Uncovered' END ELSE 'Unknown' END AS state FROM sums""",
    "q_inspect_evidence": f"""
      WITH {LINE_SPANS}, {WORD_SPANS}, held AS (SELECT doc_id, o_start, o_end, CASE position % 3 WHEN 0 THEN 'Covered' WHEN 1 THEN 'Uncovered' ELSE 'Unknown' END AS state FROM line_spans),
      own AS (SELECT doc_id, start, bool_and(state = 'Uncovered') AS none, bool_or(state = 'Unknown') AS unsure, max(state) FILTER (WHERE o_start = start AND o_end = stop) AS exact
        FROM word_spans JOIN held USING (doc_id) WHERE o_start <= start AND o_end >= stop GROUP BY doc_id, start)
      SELECT doc_id, start, CASE WHEN none IS NULL THEN 'Unknown' WHEN none THEN 'Uncovered' WHEN unsure THEN 'Unknown' ELSE coalesce(exact, 'Unknown') END AS evidence_state,
             CASE WHEN none IS NULL THEN 'MissingRange' WHEN none THEN NULL WHEN unsure THEN 'PartialRange' WHEN exact IS NULL THEN 'UnsupportedExpressionMapping' END AS evidence_reason
      FROM word_spans LEFT JOIN own USING (doc_id, start)""",
    "q_planning_algebra": """
      WITH p AS (SELECT event_id, event_type = 'click' AS lt, event_type <> 'click' AS lf, true AS rt, value < 90 AS rf FROM events),
      q AS (SELECT event_id, lt AND rt AS bt, CASE WHEN NOT lt THEN true ELSE lf OR rf END AS bf, CASE WHEN NOT lf THEN true ELSE lt OR rt END AS et, lf AND rf AS ef FROM p)
      SELECT event_id, bt AS both_can_true, bf AS both_can_false, et AS either_can_true, ef AS either_can_false, ef AS neither_can_true, et AS neither_can_false, bt AND NOT bf AS both_certain FROM q""",
    "q_closure": f"""
      WITH RECURSIVE {TREE}, reach(start, node, depth) AS (
        SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION SELECT start, dst, depth + 1 FROM reach JOIN tree ON node = src
      ) SELECT start, node, CAST(min(depth) AS INTEGER) AS depth FROM reach GROUP BY start, node""",
    "q_reaches": "SELECT 'c' || c_custkey AS start, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS reaches FROM customer",
    "q_path_to": "SELECT 'r' || n_regionkey AS start, 'o' || o_orderkey AS target, concat('r', n_regionkey, '>n', n_nationkey, '>c', c_custkey, '>o', o_orderkey) AS path FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "q_callees_boundary": f"""
      WITH RECURSIVE {TREE}, open AS (SELECT * FROM ring WHERE src NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')), reach(start, node, depth) AS (
        SELECT 'r' || r_regionkey, dst, 1 FROM region JOIN open ON src = 'r' || r_regionkey UNION SELECT start, dst, depth + 1 FROM reach JOIN open ON node = src WHERE depth < 6
      ) SELECT start, node, CAST(min(depth) AS INTEGER) AS depth FROM reach GROUP BY start, node""",
    "q_traverse_bounded": """
      WITH flags AS (
        SELECT n_nationkey AS n, coalesce(max(CASE WHEN o_orderkey IS NOT NULL THEN 2 END), 0) + coalesce(max(CASE WHEN c_custkey IS NOT NULL AND o_orderkey IS NULL THEN 1 END), 0) AS status
        FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey)
      SELECT 'n' || n AS seed, 'n' || n AS node, 0 AS depth, CAST(status AS INTEGER) AS status FROM flags
      UNION ALL SELECT 'n' || n, 'c' || c_custkey, 1, CAST(status AS INTEGER) FROM flags JOIN customer ON c_nationkey = n""",
    "q_conflict_groups": "SELECT n_nationkey AS node, n_nationkey % 5 AS component FROM nation",
    "q_reaching_defs": """
      WITH RECURSIVE flow(src, dst) AS (
        SELECT n_nationkey, n_nationkey + 5 FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_nationkey, n_nationkey - 20 FROM nation WHERE n_nationkey >= 20 UNION ALL SELECT n_nationkey, n_nationkey + 1 FROM nation WHERE n_nationkey < 4
      ), made(block, variable, definition) AS (SELECT s_nationkey, 'v' || (s_suppkey % 4), max(s_suppkey) FROM supplier GROUP BY ALL), into_(block, variable, definition) AS (
        SELECT dst, variable, definition FROM made JOIN flow ON block = src
        UNION SELECT dst, i.variable, i.definition FROM into_ i JOIN flow ON i.block = src WHERE NOT EXISTS (SELECT 1 FROM made k WHERE k.block = i.block AND k.variable = i.variable)
      ) SELECT CAST(block AS INTEGER) AS block, variable, CAST(definition AS INTEGER) AS definition FROM into_""",
    "q_batch_ids": f"""
      WITH {EDITS}, parts AS (SELECT CAST(edit_id AS VARCHAR) AS proposal, [file_identity, CAST(start AS VARCHAR), CAST(length AS VARCHAR), 'x'] AS p FROM edits)
      SELECT proposal, upper(sha256(array_to_string(list_transform(p, lambda x: length(x) || ':' || x), ''))) AS batch_id FROM parts""",
    "q_without_conflicts": f"WITH {EDITS}, real AS (SELECT a, b FROM conflicts JOIN edits x ON x.edit_id = a JOIN edits y ON y.edit_id = b WHERE x.start <> y.start OR x.length <> y.length) SELECT CAST(edit_id AS VARCHAR) AS batch_id, file_identity, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length FROM edits WHERE edit_id NOT IN (SELECT a FROM real UNION SELECT b FROM real)",
    "q_safe_everywhere": "SELECT source || '!' AS batch_id FROM (SELECT source, lang, max(n_chars) < 20000 AS safe FROM documents GROUP BY source, lang) GROUP BY source HAVING bool_and(safe)",
    "q_glob": r"SELECT page_id FROM pages WHERE regexp_matches(regexp_replace(url, '^[a-z]+://', ''), '\A([^\n]*/)?[^/]*1[^/]*\z') OR regexp_matches(regexp_replace(url, '^[a-z]+://', ''), '\A[^/]*/[^/][^/]*/([^\n]*/)?[^/]*1\z')",
    "q_identifier_words": "SELECT c_custkey, concat_ws(' ', 'Customer', substr(c_name, 10), upper(c_mktsegment[1]) || lower(c_mktsegment[2:]), 'HTTP', 'Key', c_nationkey) AS words FROM customer",
    "q_namespace_match": "SELECT doc_id FROM documents WHERE lang = 'en' OR (lang = 'de' AND source = 'src1')",
    "q_line_and_column": f"""
      WITH {WORD_SPANS}
      SELECT doc_id, start, CAST(len(string_split(head, chr(10))) AS BIGINT) AS line, CAST(length(string_split(head, chr(10))[-1]) + 1 AS BIGINT) AS "column"
      FROM (SELECT doc_id, start, substr(text, 1, start) AS head FROM word_spans JOIN documents USING (doc_id))""",
    "q_fingerprints": "SELECT doc_id, upper(sha256(text)) AS fingerprint, CAST(length(text) AS BIGINT) AS units FROM documents",
    "q_allowance_parse": """
      SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand || '+' || p_type ELSE '' END AS rules, CASE WHEN p_size < 40 THEN p_name ELSE '' END AS reason,
             concat_ws('; ', CASE WHEN p_size <= 25 THEN 'no rule is named' END, CASE WHEN p_size >= 40 THEN 'no reason is given' END) AS problems FROM part""",
    "q_classified_calls": """
      WITH calls AS (SELECT event_id, CASE WHEN value > 5 THEN CASE WHEN user_id % 2 = 0 THEN 'web' ELSE 'app' END END AS owner, event_type AS operation, [0, 1, 2, 4][event_id % 4 + 1] AS bit FROM events),
      known(owner, operation, bits, capability) AS (VALUES ('web', 'click', 7, 'streams'), ('web', 'view', 1, 'streams'))
      SELECT event_id, CASE WHEN owner IS NULL THEN 'Unresolved' WHEN owner <> 'web' THEN 'NotStandardSymbol' WHEN bit = 0 THEN 'UnsupportedFramework' WHEN bits IS NULL OR bits & bit = 0 THEN 'UnsupportedOperation' ELSE 'Supported' END AS standing, capability
      FROM calls LEFT JOIN known USING (owner, operation)""",
    "q_distinct_definitions": "SELECT lang AS context_id, source AS symbol, 'f' || (n_chars % 7) AS path, doc_id AS start FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY 'f' || (n_chars % 7), doc_id) = 1",
    "q_derived_from": "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1",
    "q_where_argument": """
      SELECT o_orderkey AS call_id, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A' AND l_linestatus = 'O')
        OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')""",
    "q_references_to": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#2'",
    "q_routes": "SELECT s_suppkey AS route_id, CASE WHEN r_name <> 'ASIA' THEN concat('/', r_name, '/', n_name, '/', s_name) END AS route FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "q_sets_are_equal": """
      WITH x AS (SELECT count(*) AS n FROM (SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation)), y AS (SELECT count(*) AS m FROM (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer))
      SELECT n + m = 0 AS are_equal, n AS missing, m AS unexpected FROM x, y""",
    "q_previous_accessibility": """
      WITH old AS (SELECT l_orderkey, min(CASE WHEN l_tax > 0.04 THEN 'public' ELSE 'internal' END) AS previous FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-01-01' GROUP BY l_orderkey)
      SELECT CAST(l_orderkey AS VARCHAR) AS symbol, previous FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN old USING (l_orderkey)""",
    "q_changed_files": "SELECT doc_id, 'src/' || doc_id AS path, CASE WHEN n_chars % 3 = 0 THEN 'Added' ELSE 'Modified' END AS change FROM documents WHERE n_chars % 3 = 0 OR n_chars % 2 = 0",
    "q_compatible_views": """
      WITH sets AS (
        SELECT n_regionkey AS framework, list(n_nationkey ORDER BY n_nationkey) AS all_roots FROM nation GROUP BY n_regionkey
      ), subsets AS (
        SELECT framework, all_roots, list_filter(all_roots, lambda x, i: (m >> (i - 1)) & 1 = 1) AS roots FROM sets, range(1, 32) r(m)
      ), cliques AS (
        SELECT DISTINCT framework, all_roots, roots FROM subsets WHERE list_max(roots) - list_min(roots) <= 10
      )
      SELECT framework, array_to_string(list_sort(list_transform(roots, lambda x: x)), ',') AS roots FROM cliques c
      WHERE NOT EXISTS (SELECT 1 FROM cliques d WHERE d.framework = c.framework AND len(d.roots) > len(c.roots) AND list_has_all(d.roots, c.roots))""",
    "q_view_contexts": """
      WITH RECURSIVE reach(framework, context_id) AS (
        SELECT n_regionkey, n_nationkey FROM nation UNION SELECT framework, context_id // 2 FROM reach WHERE context_id > 0
      ) SELECT framework, CAST(context_id AS BIGINT) AS context_id FROM reach""",
}

ORACLES |= code_queries.ORACLES
