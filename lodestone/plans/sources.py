"""Registered queries of readers, chunkers and source facts, each with its SQL twin; every part makes one Python module and one Markdown page."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..lineage import dealt
from ..operators import assemble, chunks, evaluate, facts, history
from ..sources import corpus
from .queries import edges, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


MODULE = '''"""Module {k}."""
from fastapi import APIRouter
LIMIT = {k}
router = APIRouter(prefix="/m{k}")


class Box{k}:
    """Holds things."""

    size = {k}

    def open_{k}(self, a):
        def inner():
            return a
        return inner


@router.get("/run")
def run(x):
    return Box{k}().open_{k}(x)
'''
PAGE = """Words before any heading, enough of them to be kept.
# Part {k}
```
# no heading
~~~
```
some text that is long enough to be kept as a chunk.
## Use
short
### How
this takes the short section above into its own name.
"""


#: Modules that one task parses.
MODULES = 10_000


def modules(spark, d):
    text = F.replace(F.lit(MODULE), F.lit("{k}"), F.col("p_partkey").cast("string"))
    return dealt(table(spark, d, "part").select("p_partkey"), MODULES).select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("src/m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), text.alias("text"))


def chunk_rows(spark, d, generation):
    return chunks.chunk(modules(spark, d), least=1, generation=generation).select("doc_id", "chunk_index", "line_start", "line_end", "symbol", "kind")


def expected(rows: list[tuple]) -> str:
    values = ", ".join(f"({i}, {a}, {b}, {s}, '{k}')" for i, (a, b, s, k) in enumerate(rows))
    return f"SELECT p_partkey AS doc_id, i AS chunk_index, a AS line_start, b AS line_end, replace(s, '%', p_partkey::VARCHAR) AS symbol, kind FROM part, (VALUES {values}) v(i, a, b, s, kind)"


#: What the module has, by hand: the first generation knows no nested definitions and leaves decorators out of classes only.
FIRST = [(1, 1, "'(module docstring)'", "module_doc"), (3, 3, "'LIMIT'", "assign"), (4, 4, "'router'", "assign"), (8, 8, "'Box%.__doc__'", "docstring"), (10, 10, "'Box%.size'", "class_assign"), (12, 15, "'Box%.open_%'", "method"), (18, 20, "'run'", "function")]
THIRD = [*FIRST[:3], (7, 7, "'Box%'", "class"), *FIRST[3:6], (13, 14, "'Box%.open_%.inner'", "function"), FIRST[6]]


@query(expected(FIRST))
def python_chunks_v1(spark, d):
    return chunk_rows(spark, d, 1)


@query(expected(THIRD))
def python_chunks_v2(spark, d):
    return chunk_rows(spark, d, 2)


@query(expected(THIRD))
def python_chunks_v3(spark, d):
    return chunk_rows(spark, d, 3)


@query("""SELECT p_partkey AS doc_id, i AS chunk_index, a AS line_start, b AS line_end, replace(s, '%', p_partkey::VARCHAR) AS section FROM part, (VALUES (0, 1, 1, '(intro)'), (1, 2, 7, 'Part %'), (2, 10, 11, 'Use > How')) v(i, a, b, s)""")
def markdown_chunks(spark, d):
    text = F.replace(F.lit(PAGE), F.lit("{k}"), F.col("p_partkey").cast("string"))
    pages = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("docs/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"), text.alias("text"))
    return chunks.chunk(pages, least=40).select("doc_id", "chunk_index", "line_start", "line_end", F.col("enclosing")[0].alias("section"))


@query("""SELECT 'src/m' || p_partkey || '.py' AS path, replace(caller, '%', p_partkey::VARCHAR) AS caller, replace(called, '%', p_partkey::VARCHAR) AS called, line AS line_start, CASE WHEN t IS NOT NULL THEN 'src/m' || p_partkey || '.py' END AS target_path, replace(t, '%', p_partkey::VARCHAR) AS target_symbol
  FROM part, (VALUES ('(module)', 'APIRouter', 4, NULL), ('run', 'router.get', 18, NULL), ('run', 'Box%().open_%', 20, 'Box%.open_%'), ('run', 'Box%', 20, 'Box%')) v(caller, called, line, t)""")
def call_edges(spark, d):
    """Calls of all modules joined with the only definition of the called name; a decorator belongs to its function."""
    return facts.call_edges(facts.python_facts(modules(spark, d)))


@query("SELECT 'src/m' || p_partkey || '.py' AS path, 'GET' AS method, '/m' || p_partkey || '/run' AS url, 19 AS line FROM part")
def routes(spark, d):
    rows = facts.python_facts(modules(spark, d)).where("fact = 'route'")
    return rows.select("path", F.col("name").alias("method"), F.col("target").alias("url"), F.col("line_start").alias("line"))


@query("""WITH f AS (SELECT DISTINCT CASE WHEN p_partkey % 50 = 0 THEN 'app.py' WHEN p_partkey % 40 = 0 THEN 'tests/main.py' WHEN p_partkey % 30 = 0 THEN 'a/b/main.py' WHEN p_partkey % 20 = 0 THEN 'a/server' || p_partkey || '.py' ELSE 'a/m' || p_partkey || '.py' END AS path, p_partkey % 20 = 0 AS marked FROM part),
  s AS (SELECT path, (CASE WHEN path IN ('app.py', 'tests/main.py', 'a/b/main.py') THEN 10 ELSE 0 END) + (CASE WHEN path LIKE 'a/b/%' THEN 0 ELSE 3 END) - (CASE WHEN path LIKE 'tests/%' THEN 8 ELSE 0 END) + max(CASE WHEN marked THEN 8 ELSE 0 END) AS score FROM f GROUP BY path)
  SELECT path, score FROM s WHERE score >= 8 ORDER BY score DESC, path LIMIT 6""")
def entry_points(spark, d):
    path = "CASE WHEN p_partkey % 50 = 0 THEN 'app.py' WHEN p_partkey % 40 = 0 THEN 'tests/main.py' WHEN p_partkey % 30 = 0 THEN 'a/b/main.py' WHEN p_partkey % 20 = 0 THEN concat('a/server', p_partkey, '.py') ELSE concat('a/m', p_partkey, '.py') END"
    files = table(spark, d, "part").selectExpr(f"{path} AS path", "IF(p_partkey % 20 = 0, 'app = FastAPI()', 'x = \"FastAPI(\"') AS text").distinct()
    return facts.entry_points(files, facts.python_facts(files))


@query("""SELECT c_nationkey AS repo, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS position, md5(c_custkey::VARCHAR) AS sha, CASE WHEN c_custkey % 2 = 0 THEN [md5('a'), md5('b')] ELSE [] END AS parents, c_name || ' and more' AS subject, count(*) OVER (PARTITION BY c_nationkey) > 20 AS truncated
  FROM customer QUALIFY position <= 20""")
def commit_records(spark, d):
    """Logs of NUL-separated fields, one a nation, cut after 20 commits."""
    fields = F.concat_ws("\0", F.concat(F.lit("\n"), F.md5(F.col("c_custkey").cast("string"))), F.lit("tree"), F.when(F.col("c_custkey") % 2 == 0, F.concat_ws(" ", F.md5(F.lit("a")), F.md5(F.lit("b")))).otherwise(""), "c_name", F.lit("2024-01-01T00:00:00Z"), F.lit("never"), F.concat("c_name", F.lit("\x01\x02 and \t more")), F.lit(""))
    logs = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("repo")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", fields.alias("t")))).alias("x"))
    rows = corpus.commit_records(logs.select("repo", F.array_join(F.transform("x", lambda r: r["t"]), "").alias("text")), 20)
    return rows.select("repo", F.col("position").cast("long").alias("position"), "sha", "parents", "subject", "truncated")


@query("""WITH RECURSIVE edges AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey >= 2 UNION SELECT p_partkey, p_partkey - 3 FROM part WHERE p_partkey % 3 = 0 AND p_partkey > 3),
  pairs AS (SELECT s_suppkey AS old, CASE WHEN s_suppkey % 9 > 0 THEN s_suppkey * 3 % 199 + 1 END AS new FROM supplier), r AS (SELECT DISTINCT new AS s, new AS node FROM pairs WHERE new IS NOT NULL UNION SELECT r.s, e.parent FROM r JOIN edges e ON e.child = r.node)
  SELECT old, new, CASE WHEN new IS NOT NULL THEN (new, old) IN (SELECT (s, node) FROM r) END AS is_ancestor FROM pairs""")
def is_ancestor(spark, d):
    return history.is_ancestor(table(spark, d, "supplier").selectExpr("s_suppkey AS old", "IF(s_suppkey % 9 > 0, s_suppkey * 3 % 199 + 1, NULL) AS new"), edges(spark, d))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000 AS elapsed_ms FROM events")
def sequenced_events(spark, d):
    return history.sequenced(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", ("ts", "event_id"), "ts").drop("ts")


@query("""WITH a AS (SELECT c_custkey AS qid, CASE WHEN c_custkey % 4 = 0 THEN ' NO_EVIDENCE' WHEN c_custkey % 4 = 1 THEN 'no marks' ELSE 'see [2, 9] and [1]' END AS answer FROM customer),
  g AS (SELECT o_custkey AS qid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS n, o_orderkey AS path FROM orders QUALIFY n <= 3), c AS (SELECT qid, list({'n': n, 'path': path} ORDER BY n) AS given FROM g GROUP BY qid),
  j AS (SELECT a.qid, answer, coalesce(given, []) AS given FROM a LEFT JOIN c ON c.qid = a.qid), k AS (SELECT *, CASE WHEN a.answer LIKE 'see%' THEN list_filter([2, 9, 1], lambda x: x <= len(given)) ELSE [] END AS cited FROM j a)
  SELECT qid, CASE WHEN answer = ' NO_EVIDENCE' THEN 'NO_EVIDENCE' ELSE answer END AS answer, answer = ' NO_EVIDENCE' AS no_evidence, cited, CASE WHEN answer = ' NO_EVIDENCE' THEN [] WHEN len(cited) = 0 THEN list_transform(given, lambda g: g.path) ELSE list_transform(list_filter(given, lambda g: list_contains(cited, g.n)), lambda g: g.path) END AS paths FROM k""")
def final_answers(spark, d):
    from pyspark.sql import Window

    contexts = table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("n"), F.col("o_orderkey").alias("path")).where("n <= 3")
    answers = table(spark, d, "customer").selectExpr("c_custkey AS qid", "CASE WHEN c_custkey % 4 = 0 THEN ' NO_EVIDENCE' WHEN c_custkey % 4 = 1 THEN 'no marks' ELSE 'see [2, 9] and [1]' END AS answer")
    return assemble.final_answers(answers, contexts).select("qid", "answer", "no_evidence", "cited", F.transform("references", lambda r: r["path"]).alias("paths"))


@query("""SELECT n_nationkey AS line, CASE n_nationkey % 4 WHEN 1 THEN ['missing gold', 'missing tags'] WHEN 2 THEN ['not an object'] ELSE ['unknown extra'] END AS errors FROM nation WHERE n_nationkey % 4 > 0""")
def suite_fields(spark, d):
    whole = '{"id": "a", "question": "q", "answerable": true, "gold": [], "tags": ["t"]}'
    kinds = F.array(F.lit(whole), F.lit('{"id": "a", "question": "q", "answerable": true}'), F.lit("[1]"), F.lit(whole[:-1] + ', "extra": 1}'))
    return evaluate.field_errors(table(spark, d, "nation").select(F.col("n_nationkey").alias("line"), F.get(kinds, F.col("n_nationkey") % 4).alias("text")))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'special--v3' ELSE 'n-' || s_nationkey END AS index_name, s_suppkey % 6 < 2 AS is_ref FROM supplier""")
def names_and_refs(spark, d):
    name = F.when(F.col("s_suppkey") % 5 == 0, F.lit("My_Repo ")).otherwise(F.concat(F.lit("N_"), F.col("s_nationkey").cast("string")))
    refs = F.array(*[F.lit(r) for r in ("refs/heads/main", "refs/heads/a/b-c", "main", "refs/heads/a..b", "refs/heads/x.lock", "refs/heads/a b")])
    return table(spark, d, "supplier").select("s_suppkey", R.resolved_alias(name, "my_repo=special--v3, other = x").alias("index_name"), R.is_git_ref(F.get(refs, (F.col("s_suppkey") % 6).cast("int"))).alias("is_ref"))


@query("""SELECT 'src/m' || p_partkey || '.py' AS path, 'GET' AS method, CASE WHEN p_partkey % 3 = 0 THEN '/v' || p_partkey ELSE '' END || '/m' || p_partkey || '/run' AS url, 19 AS line FROM part""")
def mounted_routes(spark, d):
    """Every third module's router is mounted by another module under a prefix of its own."""
    key = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("from src import m"), key, F.lit("\nfrom src.m"), key, F.lit(" import router as r\napp.include_router("), F.when(F.col("p_partkey") % 2 == 0, "r").otherwise(F.concat(F.lit("m"), key, F.lit(".router"))), F.lit(", prefix='/v"), key, F.lit("')\n"))
    mains = dealt(table(spark, d, "part").select("p_partkey").where("p_partkey % 3 = 0"), MODULES).select(F.concat(F.lit("src/main"), key, F.lit(".py")).alias("path"), text.alias("text"))
    return facts.mounted_routes(facts.python_facts(modules(spark, d).select("path", "text").unionByName(mains)))
