"""SQL twins of the registered queries."""

from __future__ import annotations

from ..functions.text import CAMEL, IDENTIFIER, WORD


def tokens(text: str) -> str:
    words = f"regexp_extract_all(lower({text}), '{WORD}')"
    snake = f"flatten(list_transform(list_filter({words}, lambda w: contains(w, '_')), lambda w: list_filter(string_split(w, '_'), lambda p: length(p) > 1)))"
    pieces = f"list_transform(regexp_extract_all({text}, '{IDENTIFIER}'), lambda w: regexp_extract_all(regexp_replace(w, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '{CAMEL}'))"
    camel = f"flatten(list_transform(list_filter({pieces}, lambda p: len(p) > 1), lambda p: list_filter(list_transform(p, lambda x: lower(x)), lambda x: length(x) > 1)))"
    return f"list_concat(list_concat({words}, {snake}), {camel})"


def bm25(k: int) -> str:
    return f"""
      dt AS MATERIALIZED (SELECT doc_id, {tokens("coalesce(text, '')")} AS t FROM documents),
      qt AS (SELECT DISTINCT item_id AS qid, unnest({tokens("coalesce(text, '')")}) AS term FROM benchmark),
      corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dt),
      post AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, greatest(len(t), 1) AS dl, unnest(t) AS term FROM dt) GROUP BY ALL),
      dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
      bm AS (SELECT qid, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
             FROM qt JOIN post USING (term) JOIN dfs USING (term), corpus GROUP BY qid, doc_id),
      bm_top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= {k})"""


def vector(queries: str, k: int, own: bool) -> str:
    other = "" if own else "WHERE q.qid <> e.vec_id"
    return f"""
      q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v, label AS q_label FROM embeddings WHERE {queries}),
      e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
      sim AS (SELECT qid, q_label, vec_id, label, round(list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 6) AS score FROM q, e {other}),
      hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM sim QUALIFY rank <= {k})"""


FUSED = f"""{bm25(20)}, {vector("vec_id IN (SELECT item_id FROM benchmark)", 20, True)},
      both_lists AS (SELECT qid, vec_id AS id, rank, score FROM hits UNION ALL SELECT qid, doc_id, rank, NULL FROM bm_top),
      fused AS (SELECT qid, id, round(sum(1 / (60 + rank)), 9) AS rrf, coalesce(max(score), 0.0) AS score FROM both_lists GROUP BY qid, id),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, id) AS rank FROM fused)"""

CAPPED = """
      keyed AS (SELECT r.*, d.source, d.lang, (d.lang = 'de')::INT AS demoted, (row_number() OVER (PARTITION BY qid, source ORDER BY rank) > 1)::INT AS over_cap FROM ranked r JOIN documents d ON d.doc_id = r.id),
      reranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY demoted, over_cap, rank) AS new_rank FROM keyed)"""

EVAL = f"""{vector("vec_id % 20 = 0", 20, False)},
      ranks AS (SELECT qid, any_value(q_label) AS q_label, min(CASE WHEN label = q_label THEN rank END) AS rank, max(score) AS top_score FROM hits GROUP BY qid),
      rows_ AS (SELECT qid, q_label < 8 AS answerable, ['third_' || q_label % 3, CASE WHEN q_label % 2 = 0 THEN 'even' ELSE 'odd' END] AS tags, rank, top_score,
                top_score >= 0.5 AS has_evidence, round(abs(ev.value), 3) AS ms FROM ranks LEFT JOIN events ev ON ev.event_id = qid)"""

_SHARES = """count(*) AS n, count_if(answerable) AS n_answerable,
      round(avg(CASE WHEN answerable THEN (coalesce(rank, 99) <= 1)::INT END), 6) AS hit_at_1, round(avg(CASE WHEN answerable THEN (coalesce(rank, 99) <= 3)::INT END), 6) AS hit_at_3,
      round(avg(CASE WHEN answerable THEN (coalesce(rank, 99) <= 5)::INT END), 6) AS hit_at_5, round(avg(CASE WHEN answerable THEN coalesce(1 / rank, 0) END), 6) AS mrr,
      round(avg(CASE WHEN answerable THEN has_evidence::INT END), 6) AS gate_recall, round(avg(CASE WHEN NOT answerable THEN (NOT has_evidence)::INT END), 6) AS no_evidence_recall,
      round(quantile_cont(ms, 0.5), 1) AS p50_ms, round(quantile_cont(ms, 0.95), 1) AS p95_ms"""

SWEEP = f"""{EVAL}, grid AS (SELECT * FROM rows_, (SELECT round(unnest(range(0, 20)) * 0.05::DOUBLE, 2) AS threshold)),
      counts AS (SELECT threshold, count_if(answerable AND coalesce(top_score >= threshold, false)) AS tp, count_if(answerable AND NOT coalesce(top_score >= threshold, false)) AS fn,
        count_if(NOT answerable AND coalesce(top_score >= threshold, false)) AS fp, count_if(NOT answerable AND NOT coalesce(top_score >= threshold, false)) AS tn,
        count_if(answerable AND coalesce(top_score >= threshold, false) AND rank <= 3) AS hits3 FROM grid GROUP BY threshold),
      swept AS (SELECT threshold, tp, fn, fp, tn, round(tp / nullif(tp + fn, 0), 6) AS gate_recall, round(tn / nullif(fp + tn, 0), 6) AS no_evidence_recall,
        round(hits3 / nullif(tp + fn, 0), 6) AS hit_at_3, round((tp / nullif(tp + fn, 0) + tn / nullif(fp + tn, 0)) / 2, 6) AS balanced_accuracy FROM counts)"""

HEADS = """
      seen AS (SELECT user_id AS branch, ts AS at_ts, event_id AS seq, CASE WHEN event_type = 'purchase' THEN NULL ELSE CAST(floor(abs(value)) AS BIGINT) END AS head FROM events),
      lagged AS (SELECT *, lag(head) OVER w AS previous_head, count(head) OVER (PARTITION BY branch ORDER BY at_ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS had_history FROM seen WINDOW w AS (PARTITION BY branch ORDER BY at_ts, seq)),
      changes AS (SELECT *, CASE WHEN head IS NULL THEN CASE WHEN previous_head IS NULL THEN 'already_deleted' ELSE 'deleted' END WHEN previous_head IS NULL THEN CASE WHEN had_history THEN 'recreated' ELSE 'created' END
        WHEN head = previous_head THEN 'unchanged' WHEN previous_head < head THEN 'fast_forward' ELSE 'rewind' END AS change_type FROM lagged)"""

#: Commits are parts; the first parent of n is n // 2, every third has (n - 3) as second parent.
EDGES = """edges AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey >= 2 UNION SELECT p_partkey, p_partkey - 3 FROM part WHERE p_partkey % 3 = 0 AND p_partkey > 3)"""
REACHED = f"""{EDGES}, starts AS (SELECT max(p_partkey) AS node FROM part UNION SELECT max(p_partkey) - 1 FROM part),
      reached AS (SELECT node AS start, node FROM starts UNION SELECT r.start, e.parent FROM reached r JOIN edges e ON e.child = r.node)"""

SQL: dict[str, str] = {
    "bm25_topk": f"WITH {bm25(10)} SELECT qid, doc_id, score, rank FROM bm_top",
    "token_df": f"WITH t AS (SELECT doc_id, unnest({tokens("coalesce(text, '')")}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term",
    "vector_topk": f"WITH {vector('vec_id % 20 = 0', 10, True)} SELECT qid, vec_id, score, rank FROM hits",
    "rrf_fusion": f"WITH {FUSED} SELECT qid, id, rrf, score, rank FROM ranked",
    "per_source_cap_rerank": f"WITH {FUSED}, {CAPPED} SELECT qid, id, rank, demoted, over_cap, new_rank FROM reranked",
    "grade_rerank": f"""WITH {FUSED}, graded AS (SELECT r.*, CASE WHEN quality = 1 THEN 0 WHEN quality = 0 THEN 1 END AS grade FROM ranked r LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = r.id)
      SELECT qid, id, rank, grade, row_number() OVER (PARTITION BY qid ORDER BY coalesce(grade, 9), rank) AS new_rank FROM graded""",
    "hybrid_gate": f"""WITH {FUSED} SELECT qid, max(score) AS top_score, max(score) >= 0.54 AS has_evidence, CASE WHEN max(score) >= 0.54 THEN 'ok' ELSE 'below_threshold' END AS reason,
      coalesce(list_slice(list(id ORDER BY rank) FILTER (score >= 0.54), 1, 4), []) AS contexts FROM ranked GROUP BY qid""",
    "hit_mrr": f"WITH {EVAL} SELECT {_SHARES} FROM rows_",
    "metrics_by_tag": f"WITH {EVAL} SELECT tag, {_SHARES} FROM (SELECT *, unnest(tags) AS tag FROM rows_) GROUP BY tag",
    "latency_percentiles": "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 1) AS p50, round(quantile_cont(value, 0.95), 1) AS p95, round(quantile_cont(value, 0.99), 1) AS p99 FROM events GROUP BY event_type",
    "threshold_sweep": f"WITH {SWEEP} SELECT * FROM swept",
    "best_threshold": f"WITH {SWEEP} SELECT threshold, balanced_accuracy FROM swept ORDER BY balanced_accuracy DESC, threshold DESC LIMIT 1",
    "nearest_threshold": f"WITH {SWEEP} SELECT threshold FROM swept ORDER BY abs(threshold - 0.54), threshold LIMIT 1",
    "gold_overlap": """SELECT count(*) AS n_hits, count_if(EXISTS (SELECT 1 FROM lineitem g WHERE g.l_orderkey = h.l_orderkey AND g.l_returnflag = 'R'
        AND NOT (h.l_linenumber * 10 + h.l_quantity < g.l_linenumber * 10 OR h.l_linenumber * 10 > g.l_linenumber * 10 + g.l_quantity / 2))) AS n_matched FROM lineitem h""",
    "suite_errors": """SELECT 'q' || item_id % 35 AS id, list_filter([CASE WHEN count(*) OVER (PARTITION BY item_id % 35) > 1 THEN 'duplicate id' END, CASE WHEN item_id % 3 = 0 AND item_id % 2 = 0 THEN 'gold but not answerable' END,
        CASE WHEN item_id % 3 <> 0 AND item_id % 2 <> 0 THEN 'answerable without gold' END, CASE WHEN item_id % 7 = 0 THEN 'unknown tag' END, CASE WHEN item_id % 5 = 0 THEN 'duplicate tag' END,
        CASE WHEN item_id % 4 = 0 THEN 'bad line range' END], lambda x: x IS NOT NULL) AS errors FROM benchmark QUALIFY len(errors) > 0""",
    "citations_rollup": """WITH a AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') AS w FROM conversations WHERE role = 'assistant'), c AS (SELECT conv_id, turn, length(array_to_string(w, '')) % 5 + 1 AS n1, len(w) % 7 + 1 AS n2 FROM a)
        SELECT conv_id, turn, CASE WHEN n1 > 5 THEN [] WHEN n2 > 5 OR n1 = n2 THEN [n1::INT] ELSE [n1::INT, n2::INT] END AS cited FROM c""",
    "file_rollup": f"""WITH {bm25(20)} SELECT source, count(*) AS n, list(rank ORDER BY qid, rank) AS ranks, list_sort(list(DISTINCT lang)) AS langs, max(score) AS best_score, bool_or(rank = 1) AS cited, min(doc_id) AS first_doc FROM bm_top JOIN documents USING (doc_id) GROUP BY source""",
    "counter_top": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, l_returnflag, l_linestatus LIMIT 3",
    "latest_per_group": "SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "retain_last_k": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS position FROM orders QUALIFY position > 3",
    "head_changes": f"WITH {HEADS} SELECT branch, seq, head, previous_head, change_type FROM changes",
    "head_change_counts": f"WITH {HEADS} SELECT change_type, count(*) AS n, count(DISTINCT branch) AS branches FROM changes GROUP BY change_type",
    "conversation_list": """SELECT c.conv_id, count(*) AS n_messages, count_if(role = 'assistant') AS n_responses, max(turn) AS last_turn, arg_max(role, turn) AS last_role FROM conversations c
        WHERE EXISTS (SELECT 1 FROM conversations r WHERE r.conv_id = c.conv_id AND r.role = 'system') GROUP BY c.conv_id""",
    "idle_conversations": "SELECT DISTINCT conv_id FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations r WHERE r.conv_id = c.conv_id AND r.role = 'assistant' AND r.turn >= 3)",
    "retention_preview": """WITH p AS (SELECT * FROM (VALUES ('click', 7), ('view', 14), ('purchase', 21)) AS t(mode, days)), e AS (SELECT *, max(ts) OVER () AS newest FROM events)
        SELECT event_type AS mode, count(*) AS n, min(event_id) AS first_id FROM e JOIN p ON p.mode = e.event_type WHERE ts < newest - to_days(days::INT) GROUP BY event_type""",
    "keyset_page": "SELECT o_orderdate, o_orderkey, o_custkey FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1997-01-01', 1000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51",
    "offset_page": "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 26 OFFSET 50",
    "manifest_diff": """WITH o AS (SELECT p_partkey AS k, sha256(p_name) AS h FROM part WHERE p_partkey % 10 <> 0), n AS (SELECT p_partkey AS k, sha256(CASE WHEN p_partkey % 7 = 0 THEN p_name || '!' ELSE p_name END) AS h FROM part WHERE p_partkey % 11 <> 0)
        SELECT coalesce(o.k, n.k) AS path, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS status FROM o FULL JOIN n ON o.k = n.k""",
    "tree_renames": """WITH o AS (SELECT 'a/' || p_partkey AS path, p_brand || p_size AS sha FROM part WHERE p_partkey % 4 <> 0), n AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN 'b/' ELSE 'a/' END || p_partkey AS path, CASE WHEN p_partkey % 13 = 0 THEN 'new' || p_partkey ELSE p_brand || p_size END AS sha FROM part WHERE p_partkey % 5 <> 0),
        j AS (SELECT coalesce(o.path, n.path) AS path, o.sha AS o, n.sha AS n FROM o FULL JOIN n ON o.path = n.path), g AS (SELECT path, o AS sha, row_number() OVER (PARTITION BY o ORDER BY path) AS k FROM j WHERE n IS NULL), c AS (SELECT path, n AS sha, row_number() OVER (PARTITION BY n ORDER BY path) AS k FROM j WHERE o IS NULL)
        SELECT coalesce(c.path, g.path) AS path, CASE WHEN c.path IS NOT NULL THEN g.path END AS old_path, CASE WHEN c.path IS NULL THEN 'deleted' WHEN g.path IS NULL THEN 'added' ELSE 'renamed' END AS status FROM c FULL JOIN g ON c.sha = g.sha AND c.k = g.k
        UNION ALL SELECT path, NULL, 'modified' FROM j WHERE o IS NOT NULL AND n IS NOT NULL AND o <> n""",
    "overlay_tree": """WITH base AS (SELECT 'f/' || s_suppkey AS path, s_name AS sha FROM supplier), files AS (SELECT 'f/' || s_suppkey AS path, 'new' AS sha FROM supplier WHERE s_suppkey % 6 = 0 UNION ALL SELECT 'g/' || s_suppkey, 'moved' FROM supplier WHERE s_suppkey % 7 = 0)
        SELECT path, sha FROM base WHERE path NOT IN (SELECT path FROM files) AND path NOT IN (SELECT 'f/' || s_suppkey FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 = 0) UNION ALL SELECT path, sha FROM files""",
    "children_collect": "SELECT n_name, coalesce(list(s_suppkey ORDER BY s_suppkey) FILTER (s_suppkey IS NOT NULL), []) AS children FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_name",
    "status_case": """SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus IS NULL THEN 'git_only' WHEN o_orderstatus = 'F' AND l.k IS NOT NULL THEN 'vss_indexed' WHEN o_orderstatus = 'P' THEN 'materialized' WHEN o_orderstatus = 'O' THEN 'unavailable' ELSE 'git_only' END AS status
        FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'F') l ON l.k = o_orderkey) GROUP BY status""",
    "roots_union": "SELECT s_nationkey AS root FROM supplier UNION SELECT c_nationkey FROM customer UNION SELECT n_nationkey FROM nation",
    "unresolved_diff": f"WITH {EDGES} SELECT DISTINCT parent AS node FROM edges EXCEPT SELECT p_partkey FROM part WHERE p_partkey % 4 <> 0",
    "unindexed_union": "SELECT doc_id, quality, true AS indexed FROM labels UNION ALL SELECT doc_id, NULL, false FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "ancestors": f"WITH RECURSIVE {REACHED} SELECT start, node FROM reached",
    "ancestors_by_level": "WITH RECURSIVE r AS (SELECT s_suppkey AS start, s_suppkey AS node FROM supplier WHERE s_suppkey % 10 = 0 UNION SELECT start, node // 2 FROM r WHERE node >= 2) SELECT start, node FROM r",
    "ahead_behind": f"""WITH RECURSIVE {REACHED}, s AS (SELECT max(node) AS t, min(node) AS b FROM starts) SELECT (SELECT count(*) FROM reached WHERE start = t AND node NOT IN (SELECT node FROM reached WHERE start = b)) AS ahead,
        (SELECT count(*) FROM reached WHERE start = b AND node NOT IN (SELECT node FROM reached WHERE start = t)) AS behind FROM s""",
    "merge_bases": f"""WITH RECURSIVE {REACHED}, common AS (SELECT node FROM reached GROUP BY node HAVING count(DISTINCT start) = 2),
        below AS (SELECT e.parent AS node FROM common c JOIN edges e ON e.child = c.node UNION SELECT e.parent FROM below b JOIN edges e ON e.child = b.node) SELECT node FROM common WHERE node NOT IN (SELECT node FROM below)""",
    "line_sections": """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
        m AS (SELECT *, nullif(regexp_extract(line, '^\\s*(```|~~~)', 1), '') AS mark FROM l), f AS (SELECT *, count(mark) OVER w AS fences FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        t AS (SELECT *, CASE WHEN fences % 2 = 0 AND mark IS NULL THEN nullif(regexp_extract(line, '^(#{1,6})\\s+(.+?)\\s*$', 2), '') END AS title FROM f), s AS (SELECT *, count(title) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM t)
        SELECT doc_id, section, coalesce(max(title), '(intro)') AS title, min(i) AS line_start, max(i) AS line_end, sum(length(line) + 1) AS n_chars FROM s GROUP BY doc_id, section HAVING max((trim(line) <> '')::INT) = 1""",
    "glob_filter": "SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages WHERE regexp_matches(regexp_replace(url, '^[a-z]+://', ''), '^(.*\\.example\\.com/.*|[^/]*/en/[^/]*\\.html|blog\\.[^/]*/de/[^/]*)$')",
    "redact": """SELECT doc_id, substring(regexp_replace(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '(?i)\\b(token|password|secret|authorization|api[_-]?key)[ \\t\\n\\x0B\\f\\r]*[:=][ \\t\\n\\x0B\\f\\r]*([^ \\t\\n\\x0B\\f\\r,;]+)', '\\1=<redacted>', 'g'), 1, 512) AS redacted FROM documents WHERE trim(text) <> ''""",
    "token_estimates": "SELECT doc_id, (floor(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / 2.8 + (length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))) * 0.6) + 1)::BIGINT AS estimate FROM documents",
    "lifecycle_fold": """WITH e AS (SELECT user_id AS trace, event_id AS seq, CASE event_type WHEN 'click' THEN 'delta' WHEN 'view' THEN 'delta' WHEN 'purchase' THEN CASE WHEN user_id % 2 = 0 THEN 'completed' ELSE 'notice' END ELSE event_type END AS kind, abs(value) AS size, CASE WHEN event_id % 3 = 0 THEN 'm' || event_id % 5 END AS model FROM events)
        SELECT trace, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_events, min(seq) FILTER (kind = 'delta') AS first_delta, round(sum(CASE WHEN kind = 'delta' THEN size ELSE 0 END), 4) AS delta_size, arg_max(model, seq) FILTER (model IS NOT NULL) AS model,
        CASE WHEN count_if(kind = 'completed') > 0 THEN 'completed' ELSE 'running' END AS status FROM e GROUP BY trace""",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "purge_preview": """WITH k AS (SELECT c_custkey FROM customer WHERE c_nationkey = 7), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM k)) SELECT 'orders' AS table_name, count(*) AS n FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)""",
    "illegal_transitions": """WITH s AS (SELECT o_custkey AS subject, o_orderkey AS seq, o_orderstatus AS state FROM orders), m AS (SELECT subject, seq, lag(state) OVER (PARTITION BY subject ORDER BY seq) AS from_state, state AS to_state FROM s)
        SELECT from_state, to_state, subject, seq FROM m WHERE from_state IS NOT NULL AND from_state <> to_state AND (from_state, to_state) NOT IN (('O', 'P'), ('P', 'F'))""",
    "corpus_scan": "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS n_bytes FROM documents WHERE octet_length(encode(text)) <= 20000 AND lang <> 'es'",
    "revision_prune": "SELECT c_nationkey AS project, c_custkey AS revision FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey DESC) > 3",
    "safe_paths": """WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://(.*)$', 1), '[?#].*$', '') || CASE WHEN page_id % 5 = 0 THEN '/../x' ELSE '' END AS path FROM pages),
        s AS (SELECT *, string_split(path, '/') AS parts, lower(string_split(path, '/')[-1]) AS name FROM p)
        SELECT page_id, len(list_filter(parts, lambda x: x IN ('', '.', '..') OR lower(x) = '.git')) = 0 AND length(path) BETWEEN 1 AND 4096 AS safe,
        CASE WHEN name LIKE 'readme%' THEN 0 WHEN regexp_matches(path, '^docs?/') THEN 1 WHEN len(parts) = 1 THEN 2 WHEN name IN ('changelog.md', 'release-notes.md', 'license.md', 'license') THEN 9 ELSE 3 END AS priority,
        regexp_matches(lower(path), '(^|/)tests?/') OR regexp_matches(name, '^(test_|conftest\\.)|(_test|\\.test|\\.spec)\\.[^.]*$') AS is_test FROM s""",
    "captured_content": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN NULL ELSE text END AS content, sha256(text) AS sha256, octet_length(encode(text)) AS n_bytes FROM conversations",
    "budget_pack": """WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
        r AS (SELECT conv_id, 0::BIGINT AS n, 0::BIGINT AS held, NULL::BIGINT AS turn FROM t WHERE n = 1 UNION ALL
              SELECT r.conv_id, t.n, CASE WHEN held + size <= 800 THEN held + size ELSE held END, CASE WHEN held + size <= 800 THEN t.turn END FROM r JOIN t ON t.conv_id = r.conv_id AND t.n = r.n + 1)
        SELECT conv_id, turn FROM r WHERE turn IS NOT NULL""",
    "path_resolution": """WITH f AS (SELECT DISTINCT 'd' || s_suppkey % 3 || '/s/f' || s_suppkey % 70 AS path FROM supplier), a AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN './' ELSE '' END || 's/f' || s_suppkey % 90 AS asked FROM supplier)
        SELECT asked, CASE WHEN count(path) = 1 THEN max(path) END AS path FROM a LEFT JOIN f ON suffix(path, '/' || replace(asked, './', '')) GROUP BY asked""",
    "next_sequence": """SELECT o_custkey, o_orderkey, coalesce(n, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM orders LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) USING (o_custkey) WHERE o_orderstatus <> 'F'""",
    "first_match": """SELECT n_nationkey, coalesce((SELECT min(s_name) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000), (SELECT min(c_name) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900), (SELECT min(c_name) FROM customer WHERE c_nationkey = n_nationkey)) AS value FROM nation""",
    "reference_files": f"""WITH {bm25(4)}, c AS (SELECT qid, rank AS n, source AS path, lang AS section, doc_id % 50 AS line_start, score FROM bm_top JOIN documents USING (doc_id) WHERE qid % 2 = 1 OR rank IN (1, 3)),
        f AS (SELECT qid, path, list(n ORDER BY n) AS citations, list(section ORDER BY n) AS s, max(score) AS best_score, qid % 2 = 0 AS cited, min(line_start) AS line, count(*) AS chunk_count, min(n) AS first FROM c GROUP BY qid, path)
        SELECT qid, path, citations, list_filter(s, lambda x, i: list_position(s, x) = i) AS sections, best_score, cited, line, chunk_count, row_number() OVER (PARTITION BY qid ORDER BY first) AS place FROM f""",
    "sse_frames": "SELECT user_id::VARCHAR AS trace, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_type AS event, props AS data FROM events",
    "user_sessions": """WITH g AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE)::INT, 1) AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""",
    "point_lookup": "SELECT doc_id, source, 0.0::DOUBLE AS score FROM documents WHERE doc_id IN (SELECT item_id * 30 FROM benchmark)",
    "index_names": """WITH c AS (SELECT c_custkey, c_name, regexp_replace(regexp_replace(regexp_replace(c_name, '[^A-Za-z0-9._-]', '-', 'g'), '-{2,}', '-', 'g'), '^[._-]+|[._-]+$', '', 'g') AS safe, c_mktsegment FROM customer)
        SELECT c_custkey, CASE WHEN safe = c_name AND length(safe) <= 16 THEN safe ELSE regexp_replace(substring(CASE WHEN length(safe) > 16 THEN regexp_replace(substring(safe, 1, 7), '[._-]+$', '') ELSE safe END, 1, 7), '[._-]+$', '') || '-' || substring(sha256(c_name), 1, 8) END AS component,
        replace(lower(trim(c_mktsegment)), '_', '-') AS segment FROM c""",
}
