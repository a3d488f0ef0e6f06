"""Identifier, prompt, assembly and fact operators on small tables."""

import ast
import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.functions import records as R
from lodestone.lineage import dealt
from lodestone.operators import assemble, facts


def each(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_validators(spark):
    assert each(spark, ["a/b.py", "", "/a", "a//b", "a/../b", ".git/x", "a\\b", "C:x", None, "a/.GIT"], R.is_safe_path) == [True] + [False] * 9
    assert each(spark, ["a" * 40, "g" * 40, None], R.is_git_sha) == [True, False, False]
    assert each(spark, ["git@h:o/Repo.git", "https://h/o/r/", " ", "x\\y.git"], R.repository_name) == ["Repo", "r", None, "y"]
    assert each(spark, ["refs/heads/a/b", "refs/tags/x", "refs/heads/"], R.branch_name) == ["a/b", None, None]
    safe = each(spark, ["plain", "feature/x y", "///", "z" * 300], lambda c: R.safe_component(c, "branch"))
    assert safe[0] == "plain" and safe[1].startswith("feature-x-y-") and safe[2].startswith("branch-") and len(safe[3]) <= 120
    assert each(spark, ["3", " 4 ", "5.0", "5.5", "true", None], R.strict_id) == [3, 4, 5, None, None, None]
    assert each(spark, ["src/tests/a.py", "a/test_x.py", "a/x.spec.ts", "a/latest.py"], R.is_test_path) == [True, True, True, False]
    assert each(spark, ["README.md", "docs/a.md", "a.md", "x/license.md", "x/y.md"], R.document_priority) == [0, 1, 2, 9, 3]
    assert each(spark, [0, 25], lambda c: R.page_offset(R.page_cursor(c)), "long") == [0, 25]
    assert each(spark, ["djE6MDE=", "???", None], R.page_offset) == [None, None, None]


def test_model_output(spark):
    assert each(spark, ['<think>{"a":0}</think>```json\n{"a": 1}\n```', "none", '{"a": ', 'so {x} {"b": {"c": 2}} and {"d": 3}'], R.json_in_text) == ['{"a": 1}', None, None, '{"b": {"c": 2}}']
    assert each(spark, ['{"b":1, "a":[1.0,"é"]}', ' {"a":[1.0,"é"],"b":1}', "x"], R.canonical_hash) == [hashlib.sha256('{"a":[1.0,"é"],"b":1}'.encode()).hexdigest()[:16]] * 2 + [None]
    claims = spark.createDataFrame([([("ok [1]", [1, 1]), ("bad", [1, 9]), ("", [1]), ("[2]", [2]), ("none", [])],)], "c array<struct<text:string,evidence_ids:array<int>>>")
    (row,) = claims.select(R.valid_claims(F.col("c"), F.array(F.lit(1), F.lit(2))).alias("x")).collect()
    assert [(c.text, c.evidence_ids) for c in row.x] == [("ok", [1])]
    params = spark.createDataFrame([({"q": "x" * 600, "API_KEY": "1"},)], "m map<string,string>").select(R.redacted_params(F.col("m")).alias("m")).first().m
    assert params == {"q": "x" * 512, "API_KEY": "<redacted>"}


def test_prompt(spark):
    ctx = spark.createDataFrame([(1, "a.md", "S", None, None, "doc"), (2, "b.py", None, 3, 9, "code"), (3, "c", None, None, None, "code")], "n int, path string, section string, a int, b int, t string")
    head = R.heading(F.col("n"), F.col("path"), F.col("section"), F.col("a"), F.col("b"), F.col("t"))
    assert [r.h for r in ctx.select("n", head.alias("h")).orderBy("n").collect()] == ["[1] a.md #S", "[2] b.py lines 3-9", "[3] c"]
    one = spark.createDataFrame([([("[1] a", "text")],)], "c array<struct<heading:string,text:string>>")
    assert one.select(R.prompt(F.col("c"), F.lit("why?"), F.lit(" code ")).alias("p")).first().p == "Search results:\n\n[1] a\ntext\n\nSelected code:\n```\ncode\n```\n\nQuestion:\nwhy?"
    assert each(spark, ["x" * 401, "y"], R.excerpt) == ["x" * 400 + "…", "y"]


def test_references_keep_their_numbers(spark):
    ctx = spark.createDataFrame([(1, 1, "a", "s", 5, 9, 0.5), (1, 2, "b", None, None, None, 0.9), (1, 3, "a", "s", 1, 2, 0.7), (2, 1, "c", None, 1, 1, 0.1)], "qid int, n int, path string, section string, line_start int, line_end int, score double")
    cited = spark.createDataFrame([(1, [3, 1]), (2, [])], "qid int, cited array<int>")
    got = assemble.references(ctx, cited, True)
    assert {(r.qid, r.n, r.is_cited) for r in got.collect()} == {(1, 1, True), (1, 3, True), (2, 1, None)}
    (f,) = assemble.reference_files(got.where("qid = 1")).collect()
    assert (f.citations, f.lines, f.sections, f.best_score, f.cited, f.line, f.chunk_count) == ([1, 3], [[5, 9], [1, 2]], ["s"], 0.7, True, 1, 2)


def test_budget_quota_paths(spark):
    rows = spark.createDataFrame([("g", i, s) for i, s in enumerate([5, 9, 4, 2, 1])], "g string, i long, size int")
    assert sorted(r.i for r in assemble.pack(rows, "g", "i", "size", 10).collect()) == [0, 2, 4]
    asked = spark.createDataFrame([("./main.py",), ("app/main.py",), ("util.py",), ("nope",)], "asked string")
    files = spark.createDataFrame([("app/main.py",), ("a/util.py",), ("b/util.py",)], "path string")
    assert {(r.asked, r.path) for r in assemble.resolve_paths(asked, files).collect()} == {("./main.py", "app/main.py"), ("app/main.py", "app/main.py"), ("util.py", None), ("nope", None)}
    q = assemble.quota(spark.createDataFrame([(1, p, s) for p, s in (("a", 9), ("a", 8), ("a", 7), ("b", 1))], "q int, p string, s int"), ("q",), "p", [F.desc("s")], 2, 12)
    assert [r.s for r in q.orderBy("place").collect()] == [9, 8, 1]
    loaded = spark.createDataFrame([(0, "x"), (1, "y:7b")], "position int, model string")
    assert assemble.pick_model(loaded, ["z", "y:7b"]).first().model == "y:7b" and assemble.pick_model(loaded, ["z"]).first().model == "x:latest"
    fresh = assemble.next_sequence(spark.createDataFrame([(1, 4)], "c int, seq int"), "c", "seq", spark.createDataFrame([(1, 10), (1, 11), (2, 5)], "c int, at int"), "at")
    assert {(r.c, r.at, r.seq) for r in fresh.collect()} == {(1, 10, 5), (1, 11, 6), (2, 5, 1)}


SOURCE = '''import os
from fastapi import FastAPI
app = FastAPI()
text = "Flask("

@app.get("/pay")
def pay():
    helper(1)

def helper(x):
    return os.getcwd()
'''


def test_facts(spark):
    files = spark.createDataFrame([("app/main.py", SOURCE), ("tests/test_a.py", "import x"), ("bad.py", "def ("), ("n.txt", SOURCE)], "path string, text string")
    found = facts.python_facts(files)
    rows = {(r.path, r.fact, r.name, r.target) for r in found.collect()}
    assert ("app/main.py", "route", "GET", "/pay") in rows and ("app/main.py", "call", "pay", "helper") in rows and ("app/main.py", "marker", "FastAPI(", None) in rows
    assert not any(r[1] == "marker" and r[2] == "Flask(" for r in rows) and not any(r[0] in ("bad.py", "n.txt") for r in rows)
    assert [(r.path, r.score) for r in facts.entry_points(files, found).collect()] == [("app/main.py", 21)]
    assert ("helper", "app/main.py", "helper") in {(r.called, r.target_path, r.target_symbol) for r in facts.call_edges(found).collect()}
    assert {(r.kind, r.name, r.n) for r in facts.repository_summary(files).collect()} >= {("suffix", ".py", 3), ("folder", ".", 2)}


@pytest.mark.parametrize(("head", "indexed", "stale"), [("a", "a", False), ("a", "b", True), (None, "b", None)])
def test_staleness(spark, head, indexed, stale):
    assert spark.createDataFrame([(head, indexed)], "h string, i string").select(R.stale(F.col("h"), F.col("i")).alias("x")).first().x is stale


def test_a_module_is_parsed_once(monkeypatch):
    """One parse a module, and blanked literals only where a marker stands in the text at all."""
    parsed, blanked = [], []
    parse, bare = ast.parse, facts.without_literals
    monkeypatch.setattr(ast, "parse", lambda *a, **k: parsed.append(1) or parse(*a, **k))
    monkeypatch.setattr(facts, "without_literals", lambda s: blanked.append(1) or bare(s))
    source = 'from fastapi import APIRouter\nr = APIRouter(prefix="/p")\napp.include_router(r, prefix="/v")\n\n\n@r.get("/x")\ndef f():\n    return g()\n'
    found = facts.module_facts(source)
    assert ("route", "GET", "/v/p/x", 7, 7) in found and ("mount", "r", "/v", 3, 3) in found and ("call", "f", "g", 8, 8) in found
    assert len(parsed) == 1 and not blanked
    assert [f[1] for f in facts.module_facts('app = FastAPI()\nx = "Flask("\n') if f[0] == "marker"] == ["FastAPI("] and len(blanked) == 1


def test_a_narrow_table_is_dealt_by_rows(spark):
    assert dealt(spark.range(100_000, numPartitions=1), 5_000).rdd.getNumPartitions() == 20
    assert dealt(spark.range(10, numPartitions=1), 5_000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_edges_and_mounts_do_not_parse_again(spark):
    """Facts are stored before they are used more than once."""
    found = facts.python_facts(spark.createDataFrame([("a.py", "def f():\n    return g()\n")], "path string, text string"))
    for made in (facts.call_edges(found), facts.mounted_routes(found)):
        assert "MapInPandas" not in made._jdf.queryExecution().optimizedPlan().toString()
