"""Registered queries of the snapshot store and its views, each with its SQL twin; orders stand in for snapshots and runs, customers for projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store, views
from .queries import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


STATE = "CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'indexing' WHEN o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderkey % 3 = 1 THEN 'accepted' ELSE 'validated' END AS state"
SNAPSHOTS = ["o_orderkey AS snapshot_id", "o_custkey AS project_id", "o_orderkey % 4 AS revision", "o_orderdate AS updated_at", STATE]
SNAP = f"snap AS (SELECT {', '.join(SNAPSHOTS)} FROM orders)"
RUNS = ["o_orderkey AS run_id", "o_custkey AS repository_id", "CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'running' END AS state", "o_orderkey % 97 AS generation", "o_orderdate AS lease_until"]
NOW = "TIMESTAMP '1996-01-01'"


def snapshots(spark, d):
    return table(spark, d, "orders").selectExpr(*SNAPSHOTS)


def runs(spark, d):
    return table(spark, d, "orders").selectExpr(*RUNS)


def now():
    return F.expr("TIMESTAMP_NTZ '1996-01-01'")


@query("""WITH o AS (SELECT p_partkey AS request, ['f' || p_partkey % 3, 'f' || p_partkey % 5] AS files, ['f' || p_partkey % 4, 'g' || p_size % 2] AS deleted, ['f' || p_partkey % 6, 'h' || p_size % 2] AS old, ['f' || p_partkey % 3, 'f' || p_size % 7] AS new FROM part),
  e AS (SELECT request, list_filter([
    CASE WHEN len(list_distinct(files)) < len(files) THEN 'duplicate files' END, CASE WHEN len(list_distinct(deleted)) < len(deleted) THEN 'duplicate deleted paths' END,
    CASE WHEN len(list_distinct(old)) < len(old) THEN 'duplicate rename sources' END, CASE WHEN len(list_distinct(new)) < len(new) THEN 'duplicate rename targets' END,
    CASE WHEN list_has_any(files, deleted) THEN 'changed and deleted' END, CASE WHEN list_has_any(files, old) THEN 'rename source changed' END,
    CASE WHEN list_has_any(deleted, old) THEN 'rename source deleted' END, CASE WHEN NOT list_has_all(files, new) THEN 'rename target without content' END], lambda x: x IS NOT NULL) AS errors FROM o)
  SELECT request, errors FROM e WHERE len(errors) > 0""")
def overlay_errors(spark, d):
    name = lambda a, k, n: f"concat('{a}', {k} % {n})"
    rows = table(spark, d, "part").selectExpr(
        "p_partkey AS request", f"array({name('f', 'p_partkey', 3)}, {name('f', 'p_partkey', 5)}) AS files", f"array({name('f', 'p_partkey', 4)}, {name('g', 'p_size', 2)}) AS deleted",
        f"array(named_struct('old_path', {name('f', 'p_partkey', 6)}, 'new_path', {name('f', 'p_partkey', 3)}), named_struct('old_path', {name('h', 'p_size', 2)}, 'new_path', {name('f', 'p_size', 7)})) AS renames",
    )
    return store.overlay_errors(rows)


@query("""SELECT s_nationkey AS request, 'p' || s_suppkey AS path, CASE WHEN s_suppkey % 3 = 0 THEN 'renamed' WHEN s_suppkey % 2 = 0 THEN 'added' ELSE 'modified' END AS status, CASE WHEN s_suppkey % 3 = 0 THEN 'old' || s_suppkey END AS old_path FROM supplier WHERE s_suppkey % 5 <> 0
  UNION ALL SELECT s_nationkey, 'p' || s_suppkey, 'deleted', NULL FROM supplier WHERE s_suppkey % 5 = 0""")
def overlay_deltas(spark, d):
    rows = table(spark, d, "supplier").selectExpr("s_nationkey AS request", "s_suppkey AS k", "concat('p', s_suppkey) AS path", "CASE WHEN s_suppkey % 2 = 0 THEN 'added' ELSE 'modified' END AS status", "concat('old', s_suppkey) AS old_path")
    renames = rows.where("k % 3 = 0").select("request", "old_path", F.col("path").alias("new_path"))
    return store.overlay_deltas(rows.where("k % 5 != 0").select("request", "path", "status"), rows.where("k % 5 = 0").select("request", "path"), renames)


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'added' WHEN p_size % 4 = 1 THEN 'renamed' ELSE 'modified' END AS status, CASE WHEN p_size % 4 = 1 THEN p_brand END AS old_path FROM part""")
def delta_projection(spark, d):
    rows = table(spark, d, "part")
    status = F.when(F.col("p_size") % 4 == 0, "copied").when(F.col("p_size") % 4 == 1, "renamed").otherwise("modified")
    kind, old = store.delta_projection(status, F.col("p_brand"))
    return rows.select("p_partkey", kind.alias("status"), old.alias("old_path"))


@query(f"""WITH {SNAP}, r AS (SELECT c_custkey AS request, c_custkey * 11 AS snapshot_id, CASE WHEN c_nationkey % 2 = 0 THEN 'indexing' ELSE 'completed' END AS new_state FROM customer),
  j AS (SELECT request, r.snapshot_id, new_state, state, CASE WHEN state IS NULL THEN 'not_found' WHEN state NOT IN ('accepted', 'indexing', 'failed') THEN 'unexpected_state'
    WHEN (state, new_state) IN (('accepted', 'indexing'), ('indexing', 'completed')) THEN 'ok' ELSE 'illegal' END AS outcome FROM r LEFT JOIN snap USING (snapshot_id))
  SELECT request, snapshot_id, outcome, CASE WHEN outcome = 'ok' THEN new_state ELSE state END AS state FROM j""")
def expected_transitions(spark, d):
    requests = table(spark, d, "customer").selectExpr("c_custkey AS request", "c_custkey * 11 AS snapshot_id", "array('accepted', 'indexing', 'failed') AS expected", "CASE WHEN c_nationkey % 2 = 0 THEN 'indexing' ELSE 'completed' END AS new_state")
    allowed = spark.createDataFrame([("accepted", "indexing"), ("indexing", "completed")], "from_state string, to_state string")
    return store.transitions(requests, snapshots(spark, d), allowed)


@query(f"""WITH {SNAP}, known AS (SELECT project_id, revision, min(snapshot_id) AS snapshot_id, arg_min(state, snapshot_id) AS state FROM snap GROUP BY ALL)
  SELECT c_custkey AS request, CASE WHEN state IS NULL THEN 'new' WHEN state = 'completed' THEN 'already_indexed' ELSE 'already_exists' END AS outcome,
    CASE WHEN state IS NULL THEN 202 WHEN state = 'completed' THEN 200 ELSE 409 END AS code, coalesce(state = 'failed', false) AS retryable, snapshot_id
  FROM customer LEFT JOIN known ON project_id = c_custkey AND revision = c_nationkey % 4""")
def target_lookup(spark, d):
    return store.target_lookup(table(spark, d, "customer").selectExpr("c_custkey AS request", "c_custkey AS project_id", "c_nationkey % 4 AS revision"), snapshots(spark, d))


@query(f"WITH {SNAP} SELECT a.snapshot_id, a.project_id FROM snap a WHERE EXISTS (SELECT 1 FROM snap b WHERE b.project_id = a.project_id AND b.snapshot_id <> a.snapshot_id AND b.state IN ('submitting', 'accepted', 'indexing'))")
def active_conflicts(spark, d):
    return store.active_conflicts(snapshots(spark, d))


@query(f"WITH {SNAP} SELECT snapshot_id, state FROM snap WHERE state IN ('submitting', 'accepted', 'indexing') ORDER BY updated_at, snapshot_id LIMIT 100")
def recovery_candidates(spark, d):
    return store.recovery_candidates(snapshots(spark, d)).select("snapshot_id", "state")


@query(f"""WITH runs AS (SELECT {", ".join(RUNS)} FROM orders), h AS (SELECT repository_id, max(generation) AS last, bool_or(state = 'running' AND lease_until > {NOW}) AS live, max(CASE WHEN state = 'running' AND lease_until <= {NOW} THEN run_id END) AS expired FROM runs GROUP BY 1),
  a AS (SELECT k AS repository_id, c_acctbal > 0 AS active, last, coalesce(live, false) AS live, expired FROM (SELECT unnest(range(1, 3001)) AS k) LEFT JOIN customer ON c_custkey = k LEFT JOIN h ON h.repository_id = k),
  o AS (SELECT *, CASE WHEN active IS NULL THEN 'not_found' WHEN NOT active THEN 'inactive' WHEN live THEN 'already_running' ELSE 'claimed' END AS outcome FROM a)
  SELECT repository_id, outcome, CASE WHEN outcome = 'claimed' THEN coalesce(last, 0) + 1 END AS generation, CASE WHEN outcome = 'claimed' THEN expired END AS ended_run FROM o""")
def lease_claims(spark, d):
    repositories = table(spark, d, "customer").selectExpr("c_custkey AS repository_id", "c_acctbal > 0 AS active")
    return store.lease_claims(spark.range(1, 3001).withColumnRenamed("id", "repository_id"), repositories, runs(spark, d), now())


@query(f"""WITH runs AS (SELECT {", ".join(RUNS)} FROM orders), j AS (SELECT c_custkey * 7 AS run_id, coalesce(state = 'running' AND generation = c_custkey * 7 % 97 AND lease_until > {NOW} AND c_nationkey <> 3, false) AS owns, generation
    FROM customer LEFT JOIN runs ON run_id = c_custkey * 7) SELECT run_id, owns, CASE WHEN owns THEN generation + 1 END AS generation FROM j""")
def lease_refreshes(spark, d):
    asked = table(spark, d, "customer").selectExpr("c_custkey * 7 AS run_id", "CASE WHEN c_nationkey = 3 THEN -1 ELSE c_custkey * 7 % 97 END AS expected")
    return store.lease_refreshes(asked, runs(spark, d), now())


def purge(spark, d):
    customers = table(spark, d, "customer").where("c_nationkey < 12").select("c_custkey")
    orders = table(spark, d, "orders").selectExpr("o_custkey AS c_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    guards = {"sync": orders.where("o_orderstatus = 'P' AND o_totalprice > 100000"), "snapshot": orders.where("o_orderstatus = 'O' AND o_totalprice > 300000")}
    items = table(spark, d, "lineitem").select("l_orderkey").join(orders.selectExpr("c_custkey", "o_orderkey AS l_orderkey"), "l_orderkey")
    return store.purge_plan(customers, guards, {"lineitem": (items, "c_custkey"), "orders": (orders, "c_custkey"), "customer": (table(spark, d, "customer"), "c_custkey")}, "c_custkey")


REFUSED = """judged AS (SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 100000) THEN 'sync'
    WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_totalprice > 300000) THEN 'snapshot' END AS refused FROM customer WHERE c_nationkey < 12)"""


@query(f"WITH {REFUSED} SELECT c_custkey, refused FROM judged")
def purge_guards(spark, d):
    return purge(spark, d)[0]


@query(f"""WITH {REFUSED}, free AS (SELECT c_custkey FROM judged WHERE refused IS NULL)
  SELECT 0 AS step, 'lineitem' AS table_name, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN free ON c_custkey = o_custkey
  UNION ALL SELECT 1, 'orders', count(*) FROM orders JOIN free ON c_custkey = o_custkey UNION ALL SELECT 2, 'customer', count(*) FROM free""")
def guarded_purge(spark, d):
    return purge(spark, d)[1]


@query("""WITH c AS (SELECT o_custkey AS conv_id, min(o_orderdate) AS created_at, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS last_at, bool_or(o_orderstatus = 'P') AS busy FROM orders GROUP BY 1)
  SELECT conv_id FROM c WHERE coalesce(last_at, created_at) < TIMESTAMP '1998-01-01' - INTERVAL 100 DAY AND NOT busy ORDER BY coalesce(last_at, created_at), conv_id LIMIT 40""")
def expired_conversations(spark, d):
    orders = table(spark, d, "orders")
    chats = orders.groupBy(F.col("o_custkey").alias("conv_id")).agg(F.min("o_orderdate").alias("created_at"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("last_at"))
    responses = orders.selectExpr("o_custkey AS conv_id", "CASE WHEN o_orderstatus = 'P' THEN 'running' ELSE 'completed' END AS status")
    return store.expired_conversations(chats, responses, F.lit(100), F.expr("TIMESTAMP_NTZ '1998-01-01'"), 40).select("conv_id")


@query("""WITH b AS (SELECT s_suppkey AS binding_id, 'n' || s_nationkey % 40 || s_suppkey % 3 AS a, 'n' || s_nationkey % 30 || s_suppkey % 2 AS w FROM supplier WHERE s_acctbal > 4000),
  n AS (SELECT DISTINCT binding_id, name FROM (SELECT binding_id, unnest([a, w]) AS name FROM b)), q AS (SELECT DISTINCT ' n' || n_nationkey || r || ' ' AS asked, 'n' || n_nationkey || r AS name FROM nation, (SELECT unnest([0, 1, 2]) AS r)),
  f AS (SELECT asked, count(binding_id) AS n, min(binding_id) AS one FROM q LEFT JOIN n USING (name) GROUP BY asked)
  SELECT asked, CASE WHEN n = 0 THEN 'required' WHEN n = 1 THEN 'ok' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN one END AS binding_id FROM f""")
def resolve_bindings(spark, d):
    bindings = table(spark, d, "supplier").selectExpr("s_suppkey AS binding_id", "concat('n', s_nationkey % 40, s_suppkey % 3) AS project_id", "concat('n', s_nationkey % 30, s_suppkey % 2) AS workspace", "s_acctbal > 4000 AS active")
    asked = table(spark, d, "nation").select(F.explode(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda r: F.concat(F.lit(" n"), F.col("n_nationkey").cast("string"), r.cast("string"), F.lit(" ")))).alias("asked"))
    return store.resolve_bindings(asked, bindings)


@query("""WITH b AS (SELECT s_nationkey AS repository_id, s_suppkey AS position, 'b' || s_suppkey % 6 AS branch, 'head' || s_suppkey AS head, 'p' || s_suppkey AS project_id FROM supplier WHERE s_acctbal > 2000),
  q AS (SELECT DISTINCT c_nationkey AS repository_id, 'head' || c_custkey % 120 AS "commit", 'b' || c_custkey % 9 AS branch FROM customer)
  SELECT q.repository_id, q."commit", q.branch, coalesce(arg_min(project_id, (NOT (b.branch = q.branch OR b.head = q."commit"))::INT * 1000000 + position), 'repo' || q.repository_id || '-' || left(q."commit", 8)) AS project_id
  FROM q LEFT JOIN b ON b.repository_id = q.repository_id GROUP BY q.repository_id, q."commit", q.branch""")
def choose_branch(spark, d):
    branches = table(spark, d, "supplier").selectExpr("s_nationkey AS repository_id", "s_suppkey AS position", "concat('b', s_suppkey % 6) AS branch", "concat('head', s_suppkey) AS head", "concat('p', s_suppkey) AS project_id", "s_acctbal > 2000 AS tracked")
    asked = table(spark, d, "customer").selectExpr("c_nationkey AS repository_id", "concat('head', c_custkey % 120) AS `commit`", "concat('b', c_custkey % 9) AS branch", "concat('repo', c_nationkey) AS name").distinct()
    return store.choose_branch(asked, branches)


def commit_rows(spark, d):
    return table(spark, d, "part").where("p_partkey % 17 != 0").selectExpr("p_partkey AS child", "p_name AS subject", "filter(array(p_partkey div 2, IF(p_partkey % 3 = 0, p_partkey - 3, NULL)), x -> x > 0) AS parents")


def edge_rows(spark, d):
    rows = commit_rows(spark, d)
    return store.parent_edges(rows, F.col("parent") < 50, F.col("parent") % 2 == 0)


COMMITS = "commits AS (SELECT p_partkey AS child, p_name AS subject, list_filter([p_partkey // 2, CASE WHEN p_partkey % 3 = 0 THEN p_partkey - 3 END], lambda x: x > 0) AS parents FROM part WHERE p_partkey % 17 <> 0)"
PARENTS = f"""{COMMITS}, flat AS (SELECT child, unnest(parents) AS parent, unnest(range(0, len(parents))) AS ordinal FROM commits),
  edges AS (SELECT child, parent, ordinal::INT AS ordinal, CASE WHEN parent NOT IN (SELECT child FROM commits) THEN CASE WHEN parent < 50 THEN 'truncated' WHEN parent % 2 = 0 THEN 'shallow' ELSE 'unavailable' END END AS unresolved FROM flat)"""


@query(f"WITH {PARENTS} SELECT child, parent, ordinal, unresolved FROM edges")
def parent_edges(spark, d):
    return edge_rows(spark, d)


@query(f"""WITH {PARENTS}, m AS (SELECT count(*) AS n FROM part WHERE p_partkey % 34 = 0)
  SELECT coalesce(bool_or(unresolved = 'truncated'), false) AS truncated, coalesce(bool_or(unresolved = 'shallow'), false) AS shallow, any_value(m.n) AS n_unavailable_roots,
    NOT coalesce(bool_or(unresolved = 'truncated'), false) AND NOT coalesce(bool_or(unresolved = 'shallow'), false) AND any_value(m.n) = 0 AS history_complete FROM edges, m""")
def history_flags(spark, d):
    roots = table(spark, d, "part").where("p_partkey % 34 = 0").select(F.col("p_partkey").alias("root"))
    return store.history_flags(edge_rows(spark, d), roots, commit_rows(spark, d))


@query(f"""WITH {COMMITS}, s AS (SELECT o_custkey AS child, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS snapshot_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS snapshot_state FROM orders GROUP BY 1)
  SELECT child, subject, parents, snapshot_id, snapshot_state FROM commits LEFT JOIN s USING (child)""")
def commit_details(spark, d):
    snaps = table(spark, d, "orders").selectExpr("o_custkey AS revision", "o_orderkey AS snapshot_id", "o_orderstatus AS state", "o_orderdate AS created_at")
    return store.commit_details(commit_rows(spark, d).select("child", "subject"), edge_rows(spark, d), snaps)


@query("""WITH p AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END, TIMESTAMP '1995-01-01') DESC, o_orderkey DESC LIMIT 25 OFFSET 25)
  SELECT o_orderkey, o_custkey, CASE WHEN (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') > 50 THEN to_base64(encode('v1:50')) END AS next_cursor FROM p""")
def filtered_page(spark, d):
    """The second page of a filtered list, newest first by the first time that is known; an absent filter does nothing."""
    rows = table(spark, d, "orders").withColumn("seen_at", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate"))).withColumn("made_at", F.expr("TIMESTAMP_NTZ '1995-01-01'"))
    rows = views.where_equal(rows, o_orderstatus="F", o_orderpriority="1-URGENT", o_custkey=None)
    return views.page(rows, views.newest_first(rows, "seen_at", "made_at", key="o_orderkey"), 25, "djE6MjU=").select("o_orderkey", "o_custkey", "next_cursor")


@query("""WITH s AS (SELECT l_orderkey AS path, l_partkey * 10000 + l_suppkey AS i, l_returnflag || ', (' || l_linestatus || '),' || l_linestatus AS symbol, l_quantity::INT AS line_end FROM lineitem),
  n AS (SELECT path, i, symbol, trim(unnest(string_split(symbol, ','))) AS name, unnest(range(0, 3)) AS place FROM s), k AS (SELECT path, name, min(ROW(i, symbol, place)) AS lead_at FROM n WHERE name <> '' AND NOT starts_with(name, '(') GROUP BY path, name)
  SELECT s.path, 'code' AS type, count(*) AS chunks, max(line_end) AS line_max, any_value(l.symbols) AS symbols FROM s JOIN (SELECT path, list(name ORDER BY lead_at) AS symbols FROM k GROUP BY path) l USING (path) GROUP BY s.path""")
def index_files(spark, d):
    return views.index_files(table(spark, d, "lineitem").selectExpr("l_orderkey AS path", "CAST(NULL AS string) AS type", "l_partkey * 10000 + l_suppkey AS chunk_index", "int(l_quantity) AS line_end", "concat(l_returnflag, ', (', l_linestatus, '),', l_linestatus) AS symbol"))


@query("SELECT p_partkey AS id, p_brand AS path, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'code' END AS type, nullif(p_size % 3, 0) AS line_start, nullif(p_size, 0) AS line_end, nullif(CASE WHEN p_size % 4 = 0 THEN '' ELSE p_name END, '') AS section, p_name AS symbol, p_retailprice AS score FROM part")
def hit_projection(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey AS id", "p_brand AS path", "IF(p_size % 2 = 0, p_type, NULL) AS type", "p_size % 3 AS line_start", "p_size AS line_end", "IF(p_size % 4 = 0, '', p_name) AS section", "p_name AS symbol", "p_retailprice")
    return views.hits(rows, F.col("p_retailprice"))


@query("""WITH w AS (SELECT c_nationkey, max(c_custkey) AS winner FROM customer WHERE c_acctbal > 0 GROUP BY 1)
  SELECT c_custkey AS project_id, 'n' || c.c_nationkey AS name, coalesce(winner = c_custkey, false) AS current, CASE WHEN c_acctbal > 1000 AND c_custkey % 4 > 0 THEN c_custkey % 5 <> c_custkey % 3 END AS stale FROM customer c LEFT JOIN w USING (c_nationkey)""")
def project_listing(spark, d):
    rows = table(spark, d, "customer")
    winners = rows.where("c_acctbal > 0").groupBy(F.concat(F.lit("n"), F.col("c_nationkey")).alias("name")).agg(F.max("c_custkey").alias("project_id"))
    return views.project_listing(rows.selectExpr("c_custkey AS project_id", "concat('n', c_nationkey) AS name", "IF(c_acctbal > 1000, c_custkey % 5, NULL) AS head", "IF(c_custkey % 4 > 0, c_custkey % 3, NULL) AS indexed"), winners)


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2 END AS source_count, CASE WHEN event_id % 3 = 0 THEN NULL ELSE [event_type] END AS paths, 1 AS reference_count, event_id % 2 AS cited_count, event_type AS model, 1 AS n_profile FROM events""")
def trace_metadata(spark, d):
    rows = table(spark, d, "events").selectExpr(
        "event_id", "map('embed_model', event_type, 'password', 'x') AS profile", "IF(event_id % 3 = 0, NULL, array(map('path', event_type, 'text', 'secret'), map('body', 'b'))) AS sources",
        "array(map('path', 'p')) AS refs", "IF(event_id % 2 = 0, CAST(NULL AS array<int>), array(1)) AS cited",
    )
    kept = rows.select("event_id", *views.trace_metadata(F.col("profile"), F.col("sources"), F.col("refs"), F.col("cited")))
    return kept.select("event_id", "source_count", F.transform("sources", lambda s: s["path"]).alias("paths"), "reference_count", "cited_count", F.col("profile")["embed_model"].alias("model"), F.size("profile").alias("n_profile"))


@query("""WITH e AS (SELECT user_id AS request, event_id AS seq, CASE WHEN event_id % 40 >= user_id % 40 THEN 'delta' WHEN event_type = 'click' THEN 'meta' WHEN event_type <> 'purchase' THEN 'delta' WHEN event_id % 2 = 0 THEN 'error' ELSE 'done' END AS event, ['bad_request', 'llm_failed', 'other'][event_id % 3 + 1] AS code, props AS data FROM events),
  f AS (SELECT *, min(CASE WHEN event IN ('error', 'done') THEN seq END) OVER (PARTITION BY request) AS fin FROM e)
  SELECT request, CASE WHEN max(fin) IS NULL THEN 500 WHEN any_value(event) FILTER (seq = fin) = 'done' THEN 200 ELSE CASE any_value(code) FILTER (seq = fin) WHEN 'bad_request' THEN 400 WHEN 'llm_failed' THEN 502 ELSE 500 END END AS status,
    arg_max(data, seq) FILTER (event = 'meta' AND (fin IS NULL OR seq < fin)) AS meta, any_value(data) FILTER (seq = fin) AS data FROM f GROUP BY request""")
def collapsed_events(spark, d):
    rows = table(spark, d, "events").selectExpr(
        "user_id AS request", "event_id AS seq", "CASE WHEN event_id % 40 >= user_id % 40 THEN 'delta' WHEN event_type = 'click' THEN 'meta' WHEN event_type <> 'purchase' THEN 'delta' WHEN event_id % 2 = 0 THEN 'error' ELSE 'done' END AS event", "array('bad_request', 'llm_failed', 'other')[int(event_id % 3)] AS code", "props AS data"
    )
    return views.collapsed(rows)


@query("SELECT event_id AS request, event_type AS target, CASE WHEN event_id % 5 IN (1, 3) THEN 'denied' ELSE 'failed' END AS outcome, 'HTTP_' || [200, 401, 500, 403, 202][event_id % 5 + 1] AS reason, round(value, 1) AS elapsed_ms FROM events WHERE event_id % 5 NOT IN (0, 4)")
def audit_rows(spark, d):
    return views.audit_rows(table(spark, d, "events").selectExpr("event_id AS request", "event_type AS path", "array(200, 401, 500, 403, 202)[int(event_id % 5)] AS status_code", "value AS elapsed_ms"))


@query(f"""WITH {SNAP}, ex AS (SELECT project_id, revision AS head, max(snapshot_id) AS own, arg_max(state, snapshot_id) AS own_state FROM snap GROUP BY ALL),
  dn AS (SELECT project_id, arg_max(snapshot_id, (updated_at, snapshot_id)) AS newest FROM snap WHERE state = 'completed' GROUP BY 1)
  SELECT c_name AS branch, c_custkey AS project_id, CASE WHEN own_state = 'completed' THEN 'current' WHEN newest IS NOT NULL THEN 'behind' WHEN own IS NOT NULL THEN own_state ELSE 'none' END AS relation,
    CASE WHEN own_state = 'completed' THEN own ELSE coalesce(newest, own) END AS snapshot_id FROM customer LEFT JOIN ex ON ex.project_id = c_custkey AND ex.head = c_nationkey % 4 LEFT JOIN dn ON dn.project_id = c_custkey""")
def refs_view(spark, d):
    return views.refs_view(table(spark, d, "customer").selectExpr("c_name AS branch", "c_custkey AS project_id", "c_nationkey % 4 AS head"), snapshots(spark, d))
