"""Registered queries of column expressions, decisions and roll-ups, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import text as T
from ..operators import assemble, catalog, facts, history, observe
from ..streaming import sse
from .queries import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


@query("""SELECT o_orderkey, (o_orderkey % 7 = 0) OR o_orderstatus IN ('O', 'P') AS materialized, o_orderstatus = 'F' AND o_orderkey % 2 = 0 AS ready,
  CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 500 <= 300 THEN 'already_running' WHEN o_orderkey % 3 = 0 THEN 'take_over' WHEN o_orderstatus = 'O' THEN 'already_indexed' ELSE 'start' END AS decision,
  CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 500 > 300 THEN 'aborted' WHEN o_orderkey % 3 = 0 THEN 'running' ELSE 'done' END AS run_state, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 4 = o_orderkey % 4 END AS drift_free FROM orders""")
def decisions(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey", "CASE o_orderstatus WHEN 'F' THEN 'already_indexed' WHEN 'O' THEN 'completed' ELSE 'materialized' END AS state", "o_orderkey % 2 = 0 AND o_orderstatus = 'F' AS done", "IF(o_orderkey % 7 = 0, 'x', NULL) AS locator", "o_orderkey % 3 = 0 AS running", "o_orderkey % 500 AS age")
    state, running = F.col("state"), F.col("running")
    made, _ = observe.readiness(F.when(state == "already_indexed", "failed").otherwise(state), F.col("done"), F.col("locator"))
    _, ready = observe.readiness(state, F.col("done"), F.col("locator"))
    return rows.select("o_orderkey", made.alias("materialized"), ready.alias("ready"), observe.start_decision(state, running, F.col("age")).alias("decision"), observe.run_state(F.when(running, "running").otherwise("done"), F.col("age")).alias("run_state"), observe.matches(F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey") % 4), F.col("o_orderkey") % 4).alias("drift_free"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '<redacted>' ELSE event_type END AS a, left(repeat(event_type, 200), 512) AS b FROM events""")
def redacted_params(spark, d):
    rows = table(spark, d, "events").withColumn("m", F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("My_API_Key"), F.col("event_type"), F.lit("q"), F.repeat("event_type", F.lit(200)))).otherwise(F.create_map(F.lit("page"), F.col("event_type"), F.lit("q"), F.repeat("event_type", F.lit(200)))))
    rows = rows.withColumn("m", R.redacted_params(F.col("m")))
    return rows.select("event_id", F.coalesce(F.col("m")["My_API_Key"], F.col("m")["page"]).alias("a"), F.col("m")["q"].alias("b"))


@query("""SELECT conv_id, turn, '[' || turn || '] src/' || role || CASE WHEN turn % 3 = 0 THEN ' #' || role WHEN turn % 3 = 1 THEN ' lines ' || turn || '-' || turn + 9 ELSE '' END AS heading, CASE WHEN length(text) > 400 THEN left(text, 400) || '…' ELSE text END AS excerpt,
  'vscode://file/root/src/' || role || CASE WHEN turn % 3 = 1 THEN ':' || turn ELSE '' END AS uri FROM conversations""")
def context_headings(spark, d):
    rows = table(spark, d, "conversations").withColumns({"path": F.concat(F.lit("src/"), "role"), "line": F.when(F.col("turn") % 3 == 1, F.col("turn"))})
    head = R.heading(F.col("turn"), F.col("path"), F.when(F.col("turn") % 3 == 0, F.col("role")), F.col("line"), F.col("line") + 9, F.when(F.col("turn") % 3 == 0, "doc").otherwise("code"))
    return rows.select("conv_id", "turn", head.alias("heading"), R.excerpt(F.col("text")).alias("excerpt"), R.editor_uri("vscode", F.lit("/root/"), F.col("path"), F.col("line")).alias("uri"))


@query("""WITH c AS (SELECT conv_id, list('[' || turn || '] ' || role || chr(10) || text ORDER BY turn) FILTER (role = 'user') AS parts, max(text) FILTER (role = 'system') AS code FROM conversations GROUP BY conv_id)
  SELECT conv_id, array_to_string(list_concat(list_concat(CASE WHEN len(parts) > 0 THEN list_concat(['Search results:'], parts) ELSE ['Search results:' || chr(10) || 'nothing was found.'] END,
    CASE WHEN trim(coalesce(code, '')) <> '' THEN ['Selected code:' || chr(10) || '```' || chr(10) || trim(code) || chr(10) || '```'] ELSE [] END), ['Question:' || chr(10) || 'why ' || conv_id || '?']), chr(10) || chr(10)) AS prompt FROM c""")
def prompts(spark, d):
    rows = table(spark, d, "conversations")
    found = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), "role").alias("heading"), "text")))).alias("c"), F.max(F.when(F.col("role") == "system", F.col("text"))).alias("code"))
    return found.select("conv_id", R.prompt(F.col("c"), F.concat(F.lit("why "), F.col("conv_id").cast("string"), F.lit("?")), F.col("code")).alias("prompt"))


@query("""SELECT event_id, CASE WHEN event_id % 7 > 0 THEN round((event_id % 900) / ((event_id % 7) * 250000000 / 1e9::DOUBLE), 1) END AS tokens_per_second, CASE event_id % 5 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE event_id END AS id FROM events""")
def speeds_and_ids(spark, d):
    e = F.col("event_id")
    written = F.when(e % 5 == 0, F.concat(F.lit(" "), e.cast("string"))).when(e % 5 == 1, F.concat(e.cast("string"), F.lit(".0"))).when(e % 5 == 2, F.concat(e.cast("string"), F.lit(".5"))).when(e % 5 == 3, F.lit("true")).otherwise(e.cast("string"))
    return table(spark, d, "events").select("event_id", R.tokens_per_second(e % 900, (e % 7) * 250000000).alias("tokens_per_second"), R.strict_id(written).alias("id"))


@query("""SELECT c_custkey, 'Repo' || c_custkey AS repository, CASE WHEN c_custkey % 2 = 0 THEN 'f/' || c_nationkey END AS branch, CASE WHEN c_custkey % 2 = 0 THEN 'f-' || c_nationkey || '-' || left(sha256('f/' || c_nationkey), 8) ELSE 'main' END AS component,
  'Repo' || c_custkey || '@' || CASE WHEN c_custkey % 2 = 0 THEN 'f-' || c_nationkey || '-' || left(sha256('f/' || c_nationkey), 8) ELSE 'main' END || '--v3' AS index_id, 'a/b' || c_nationkey || '/c' AS normal FROM customer""")
def repository_names(spark, d):
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    even = F.col("c_custkey") % 2 == 0
    remote = F.concat(F.lit("git@host:org/Repo"), k, F.when(even, ".git").otherwise("/"))
    branch = R.branch_name(F.concat(F.when(even, "refs/heads/f/").otherwise("refs/tags/"), n))
    short = F.coalesce(branch, F.lit("main"))
    path = T.normalized_path(F.concat(F.lit(".././/a\\b"), n, F.lit("/c")))
    return table(spark, d, "customer").select("c_custkey", R.repository_name(remote).alias("repository"), branch.alias("branch"), R.safe_component(short, "branch").alias("component"), R.index_id(R.repository_name(remote), short, "v3").alias("index_id"), path.alias("normal"))


@query("""WITH p AS (SELECT c_custkey AS k, CASE WHEN NOT (c_nationkey % 2 = 0 AND (c_custkey % 4 > 0 OR c_nationkey = 4)) THEN 'other-' || c_custkey WHEN c_custkey % 4 = 0 THEN 'n-' || c_nationkey ELSE 'n-' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN '--v' ELSE '@b--v' END || c_custkey END AS project, c_custkey % 3 AS rank, c_custkey AS age, CASE WHEN c_nationkey % 2 = 0 AND (c_custkey % 4 > 0 OR c_nationkey = 4) THEN 'n-' || c_nationkey ELSE 'other-' || c_custkey END AS base FROM customer),
  a AS (SELECT 'N_' || n_nationkey AS name, 'n-' || n_nationkey AS base FROM nation), j AS (SELECT name, project, row_number() OVER (PARTITION BY name ORDER BY (project <> a.base), rank DESC, age DESC, project) AS n FROM a JOIN p USING (base)) SELECT name, project FROM j WHERE n = 1""")
def resolved_indexes(spark, d):
    named = "concat('n-', c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN concat('--v', c_custkey) ELSE concat('@b--v', c_custkey) END)"
    projects = table(spark, d, "customer").selectExpr(f"IF(c_nationkey % 2 = 0 AND (c_custkey % 4 > 0 OR c_nationkey = 4), {named}, concat('other-', c_custkey)) AS project", "c_custkey % 3 AS chunker_rank", "c_custkey AS indexed_at")
    return catalog.resolve(projects, table(spark, d, "nation").selectExpr("concat('N_', n_nationkey) AS name"))


@query("""SELECT p_brand AS path, list_sort(list(DISTINCT [p_size, p_size + 5])) AS lines, list_sort(list(DISTINCT p_type)) AS symbols, list_sort(list(DISTINCT p_partkey % 3)) AS queries FROM part GROUP BY p_brand""")
def evidence_rollup(spark, d):
    found = assemble.evidence_rollup(table(spark, d, "part").selectExpr("p_brand AS path", "p_size AS line_start", "p_size + 5 AS line_end", "p_type AS symbol", "p_partkey % 3 AS query"))
    return found.withColumn("lines", F.transform("lines", lambda x: F.array(x["line_start"], x["line_end"])))


@query("""WITH h AS (SELECT p_partkey % 20 AS qid, row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY p_partkey) AS rank, p_brand AS path, CASE WHEN p_size % 2 = 0 THEN p_type END AS symbol FROM part),
  w AS (SELECT qid, rank, 0 AS k, symbol AS q FROM h WHERE symbol IS NOT NULL UNION ALL SELECT qid, rank, 1, path FROM h), f AS (SELECT qid, q, min(rank * 10 + k) AS lead_at FROM w WHERE (qid, q) NOT IN (SELECT (p_partkey % 20, p_brand) FROM part WHERE p_partkey < 100) GROUP BY ALL)
  SELECT qid, q AS query, row_number() OVER (PARTITION BY qid ORDER BY lead_at, q) AS n FROM f QUALIFY n <= 6""")
def second_round_queries(spark, d):
    from pyspark.sql import Window

    part = table(spark, d, "part").withColumn("qid", F.col("p_partkey") % 20)
    hits = part.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("p_partkey")).alias("rank"), F.col("p_brand").alias("path"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("symbol"))
    return assemble.expand_queries(hits, part.where("p_partkey < 100").select("qid", F.col("p_brand").alias("query")))


@query("""WITH o AS (SELECT o_custkey AS run_id, o_orderstatus <> 'P' AS ok, CASE WHEN o_orderkey % 3 = 0 THEN 'unchanged' ELSE 'moved' END AS change_type, o_orderpriority AS reason FROM orders)
  SELECT run_id, count(*) AS n, count_if(ok) AS n_ok, count_if(change_type = 'unchanged') AS n_unchanged, CASE WHEN count_if(ok) = count(*) THEN 'ok' WHEN count_if(ok) > 0 THEN 'partial_failure' ELSE 'failed' END AS state, list_sort(coalesce(list(DISTINCT reason) FILTER (NOT ok), [])) AS reasons FROM o GROUP BY run_id""")
def sync_outcomes(spark, d):
    return observe.sync_rollup(table(spark, d, "orders").selectExpr("o_custkey AS run_id", "o_orderstatus != 'P' AS ok", "IF(o_orderkey % 3 = 0, 'unchanged', 'moved') AS change_type", "o_orderpriority AS reason"))


@query("""WITH c AS (SELECT p_partkey AS label, 'profile' || p_size % 5 AS sp, 'index' || p_size % 7 AS pid, CASE WHEN p_size % 3 = 0 THEN 'other' ELSE 'retrieval' END AS m FROM part)
  SELECT label, 'unknown profile ' || sp AS error FROM c WHERE sp > 'profile2' UNION ALL SELECT label, 'unknown index ' || pid FROM c WHERE pid > 'index3' UNION ALL SELECT label, 'unknown mode ' || m FROM c WHERE m = 'other'""")
def matrix_errors(spark, d):
    cells = table(spark, d, "part").selectExpr("p_partkey AS label", "concat('profile', p_size % 5) AS search_profile", "concat('index', p_size % 7) AS project_id", "array(IF(p_size % 3 = 0, 'other', 'retrieval')) AS modes")
    return observe.matrix_errors(cells, spark.range(3).selectExpr("concat('profile', id) AS search_profile"), spark.range(4).selectExpr("concat('index', id) AS project_id"))


@query("""SELECT c_custkey AS project_id, CASE WHEN c_custkey % 3 = 0 THEN 'none of ' || c_nationkey WHEN c_custkey % 5 = 0 THEN c_nationkey + 1 || ' of ' || c_nationkey END AS lexical, CASE WHEN c_custkey % 4 = 0 THEN ['size'] ELSE [] END AS settings FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0 OR c_custkey % 4 = 0""")
def index_drift(spark, d):
    rows = table(spark, d, "customer")
    vectors = rows.selectExpr("c_custkey AS project_id", "c_nationkey AS chunks", "map('size', IF(c_custkey % 4 = 0, '800', '1200')) AS settings")
    lexical = rows.where("c_custkey % 3 != 0").selectExpr("c_custkey AS project_id", "c_nationkey + IF(c_custkey % 5 = 0, 1, 0) AS lexical_count")
    return observe.drift(lexical, vectors, {"size": 1200})


@query("""WITH l AS (SELECT conv_id, list({'turn': turn, 'role': role} ORDER BY turn) AS m FROM conversations GROUP BY conv_id) SELECT c_custkey AS conv_id, list_transform(m, lambda x: x.role) AS roles FROM customer LEFT JOIN l ON conv_id = c_custkey""")
def conversation_details(spark, d):
    found = observe.conversation_detail(table(spark, d, "customer").select(F.col("c_custkey").alias("conv_id")), table(spark, d, "conversations"))
    return found.select("conv_id", F.transform("messages", lambda m: m["role"]).alias("roles"))


@query("""SELECT event_id AS trace, event_type AS stage, r AS role, CASE r WHEN 'generator' THEN 'loaded' ELSE 'absent' END AS state FROM events, (VALUES ('generator'), ('embedder')) v(r) WHERE r = 'generator' AND event_id % 2 = 0 OR r = 'embedder' AND event_id % 3 = 0""")
def residency(spark, d):
    return observe.residency(table(spark, d, "events").selectExpr("event_id AS trace", "event_type AS stage", "IF(event_id % 2 = 0, 'loaded', NULL) AS generator", "IF(event_id % 3 = 0, 'absent', NULL) AS embedder"))


@query("""WITH m AS (SELECT p_size AS position, 'm' || p_size % 40 || CASE WHEN p_size % 2 = 0 THEN ':7b' ELSE '' END AS model FROM part), n AS (SELECT position, CASE WHEN contains(model, ':') THEN model ELSE model || ':latest' END AS model FROM m)
  SELECT arg_min(model, (CASE model WHEN 'm99:latest' THEN 0 WHEN 'm12:7b' THEN 1 WHEN 'm3:latest' THEN 2 ELSE 4 END, position)) AS model FROM n""")
def picked_model(spark, d):
    return assemble.pick_model(table(spark, d, "part").selectExpr("p_size AS position", "concat('m', p_size % 40, IF(p_size % 2 = 0, ':7b', '')) AS model"), ["m99", "m12:7b", "m3"])


@query("""WITH f AS (SELECT 'a' || p_size % 20 || '/' || CASE WHEN p_partkey % 9 = 0 THEN 'b/' ELSE '' END || p_partkey || CASE WHEN p_partkey % 6 = 0 THEN '' ELSE '.' || substr(p_type, 1, 2) END AS path FROM part), s AS (SELECT lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS name, count(*) AS n FROM f GROUP BY 1 ORDER BY n DESC, name LIMIT 8),
  g AS (SELECT regexp_extract(path, '^(.*)/', 1) AS name, count(*) AS n FROM f GROUP BY 1 ORDER BY n DESC, name LIMIT 15) SELECT 'suffix' AS kind, name, n FROM s UNION ALL SELECT 'folder', name, n FROM g""")
def repository_summary(spark, d):
    path = "concat('a', p_size % 20, '/', IF(p_partkey % 9 = 0, 'b/', ''), p_partkey, IF(p_partkey % 6 = 0, '', concat('.', substr(p_type, 1, 2)))) AS path"
    return facts.repository_summary(table(spark, d, "part").selectExpr(path))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'same' WHEN c_nationkey % 3 = 1 AND c_nationkey % 2 = 0 THEN 'unknown' WHEN c_nationkey % 3 = 1 THEN 'fast_forward' ELSE 'diverged' END AS relation FROM customer""")
def relationships(spark, d):
    n = F.col("c_nationkey")
    base, target = F.lit("b"), F.when(n % 3 == 0, "b").otherwise("t")
    merge = F.when((n % 3 == 1) & (n % 2 == 0), None).when(n % 3 == 1, "b").otherwise("other")
    return table(spark, d, "customer").select("c_custkey", history.relationship(base, target, merge).alias("relation"))


@query("""SELECT doc_id, CASE WHEN starts_with(text, '# p' || doc_id) THEN text ELSE '# p' || doc_id || ' > ' || source || CASE WHEN doc_id % 2 = 0 THEN ' > class A' ELSE '' END || chr(10) || text END AS chunk, doc_id % 2 = 0 AS none FROM documents""")
def context_headers(spark, d):
    scopes = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("class A")))
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("so\n  NO_EVIDENCE \n"), "source")).otherwise(F.concat(F.lit("NO_EVIDENCE of "), "source"))
    return table(spark, d, "documents").select("doc_id", T.context_header(F.concat(F.lit("p"), F.col("doc_id").cast("string")), F.col("source"), scopes, F.col("text")).alias("chunk"), T.no_evidence(said).alias("none"))


@query("""WITH e AS (SELECT user_id AS trace, event_id AS seq, event_type <> 'purchase' AS is_delta, event_type AS text, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM events)
  SELECT trace, string_agg(text, '' ORDER BY seq) AS text FROM e WHERE is_delta GROUP BY trace, grp""")
def delta_batches(spark, d):
    """Deltas joined up to the next other event; the limit is beyond every batch."""
    rows = table(spark, d, "events").selectExpr("user_id AS trace", "event_id AS seq", "IF(event_type = 'purchase', 'tool', 'delta') AS kind", "event_type AS text")
    return sse.batch_deltas(rows, 1 << 30).select("trace", "text")


@query("""SELECT user_id AS run, event_type AS stage, count(*) AS calls, count_if(event_id % 4 = 0) AS cached, round(sum(CASE WHEN event_id % 4 > 0 THEN (event_id % 50)::DOUBLE ELSE 0 END), 3) AS seconds, count_if(event_id % 9 = 0) AS problems,
  CASE WHEN count_if(event_id % 9 = 0) = 0 THEN 'complete' WHEN count_if(event_id % 9 = 0) < count(*) THEN 'partial' ELSE 'failed' END AS status FROM events GROUP BY ALL""")
def stage_rollup(spark, d):
    return observe.stage_rollup(table(spark, d, "events").selectExpr("user_id AS run", "event_type AS stage", "event_id % 4 = 0 AS cached", "double(event_id % 50) AS seconds", "IF(event_id % 9 = 0, 'x', NULL) AS problem"))


@query("SELECT o_custkey AS run, count_if(o_orderstatus = 'F') AS processed, count(*) AS total, round(count_if(o_orderstatus = 'F') / count(*), 4) AS share FROM orders GROUP BY 1")
def progress(spark, d):
    return observe.progress(table(spark, d, "orders").selectExpr("o_custkey AS run", "o_orderstatus = 'F' AS done"))


@query("""WITH b AS (SELECT CASE WHEN s_nationkey = 3 THEN 103 ELSE s_nationkey END AS r, count(*) AS branches, count_if(s_acctbal > 3000) AS tracked FROM supplier GROUP BY 1), l AS (SELECT CASE WHEN c_nationkey % 4 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS r, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
  SELECT n_nationkey AS repository_id, coalesce(branches, 0) AS branches, coalesce(tracked, 0) AS tracked, coalesce(s, 'never') AS last_state FROM nation LEFT JOIN b ON b.r = n_nationkey LEFT JOIN l ON l.r = n_nationkey""")
def repository_list(spark, d):
    branches = table(spark, d, "supplier").selectExpr("IF(s_nationkey = 3, 103, s_nationkey) AS repository_id", "s_acctbal > 3000 AS tracked")
    runs = table(spark, d, "orders").join(table(spark, d, "customer").selectExpr("c_custkey AS o_custkey", "IF(c_nationkey % 4 = 0, c_nationkey + 100, c_nationkey) AS repository_id"), "o_custkey").selectExpr("repository_id", "o_orderstatus AS state", "o_orderdate AS started_at", "o_orderkey AS run_id")
    return observe.repository_list(table(spark, d, "nation").selectExpr("n_nationkey AS repository_id"), branches, runs)
