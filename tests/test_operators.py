"""Small golden tables for retrieval, evaluation, history, chunking and streams."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import catalog, chunks, evaluate, history, retrieval, store, survey
from lodestone.sources import corpus
from lodestone.streaming import sse


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokenize(spark):
    got = one(spark, T.tokenize(F.lit("validate_token HTTPServer 42 한글")))
    assert got == ["validate_token", "httpserver", "42", "한글", "validate", "token", "validate", "token", "http", "server"]
    assert one(spark, T.tokenize(F.lit(None).cast("string"))) == []


def test_names_and_citations(spark):
    assert one(spark, T.symbol_candidates(F.lit("How does `Service.run` call process() with MAX_SIZE or fooBar, snake_case, HttpError?"))) == ["Service.run", "HttpError", "snake_case", "MAX_SIZE", "process"]
    assert one(spark, T.symbol_candidates(F.lit("그냥 한국어 문장입니다"))) == []
    assert one(spark, T.citations(F.lit("A [1]. B [3][1] items[9]"), F.lit(3))) == [1, 3]


@pytest.mark.parametrize(
    ("spec", "path", "hit"),
    [("tests", "tests/a.py", True), ("tests", "src/tests.py", False), ("docs/*.md", "docs/a.md", True), ("docs/*.md", "docs/b/a.md", False), ("docs/**", "docs/b/a.md", True), ("a?.py", "ab.py", True), ("github/x", ".github/x", True), ("**/test_*.*", "src/latest_a.b", True), ("**/test_*.*", "src/best_a.b", False), ("", "a", False)],
)
def test_globs(spark, spec, path, hit):
    assert one(spark, T.excluded(F.lit(path), spec)) is hit


def test_text_helpers(spark):
    assert one(spark, T.demoted(F.lit("src/tests/a.py"), "tests,docs/**")) is True
    assert one(spark, T.demoted(F.lit("docs/x/y.md"), "tests,docs/**")) is True
    assert one(spark, T.demoted(F.lit("src/a.py"), "tests,docs/**")) is False
    assert one(spark, T.redacted(F.lit(" my  api-key: abc,  Token=xyz; "))) == "my api-key=<redacted>, Token=<redacted>;"
    assert one(spark, T.redacted(F.lit("  "))) is None
    header = T.context_header(F.lit("a.py"), F.lit(None).cast("string"), F.array(F.lit("C"), F.lit("f")), F.lit("body"))
    assert one(spark, header) == "# a.py > C > f\nbody"
    assert one(spark, T.no_evidence(F.lit("well\n NO_EVIDENCE \n"))) is True and one(spark, T.no_evidence(F.lit("x"))) is False
    assert one(spark, T.token_estimate(F.lit("abcd가"))) == math.floor(4 / 2.8 + 0.6) + 1


def test_bm25_on_three_documents(spark):
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, "dog bird"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "cat dog dog"), (8, "")], "qid long, text string")
    got = {(r.qid, r.doc_id): r.score for r in retrieval.bm25(asked, docs).collect()}
    avg = 5 / 3

    def term(tf, df, dl):
        return math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))

    assert got == pytest.approx({(7, 1): round(term(2, 1, 3) + term(1, 2, 3), 6), (7, 2): round(term(1, 2, 2), 6)})


def test_fusion_rerank_gate(spark):
    vector = spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 2, 0.4)], "qid long, id string, rank int, score double")
    lexical = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "qid long, id string, rank int")
    fused = retrieval.rrf(vector, lexical)
    assert [(r.id, r.score) for r in fused.orderBy("rank").collect()] == [("b", 0.4), ("a", 0.9), ("c", 0.0)]
    g = retrieval.gate(fused, 0.5, 4).first()
    assert (g.top_score, g.has_evidence, g.contexts) == (0.9, True, ["a"])
    assert retrieval.gate(fused, 0.95, 4).first().reason == "below_threshold"
    hits = spark.createDataFrame([(1, i, p) for i, p in enumerate(["a", "a", "a", "b", "a"], 1)], "qid long, rank int, path string")
    assert [r.path for r in retrieval.cap_rerank(hits, 2).orderBy("new_rank").collect()] == ["a", "a", "b", "a", "a"]
    hits = spark.createDataFrame([(1, i, p) for i, p in enumerate(["tests/test_cli", "src/cli", "tests/test_utils", "src/discover"], 1)], "qid long, rank int, path string")
    assert [r.path for r in retrieval.cap_rerank(hits, 0, "tests").orderBy("new_rank").collect()] == ["src/cli", "src/discover", "tests/test_cli", "tests/test_utils"]
    symbols = spark.createDataFrame([("k1", "Service.run, other"), ("k2", "(module docstring)"), ("k3", "run")], "id string, symbol string")
    asked = spark.createDataFrame([(1, ["RUN"]), (2, ["service.run"])], "qid long, names array<string>")
    assert {(r.qid, r.id, r.grade) for r in retrieval.symbol_grades(asked, symbols).collect()} == {(1, "k1", 1), (1, "k3", 0), (2, "k1", 0)}


def test_search_puts_named_symbols_first(spark):
    docs = spark.createDataFrame([(i, "word", f"p{i}") for i in range(3)], "doc_id long, text string, path string")
    vectors = spark.createDataFrame([(i, [1.0, 0.1 * i]) for i in range(3)], "vec_id long, vector array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "qid long, vector array<float>")
    questions = spark.createDataFrame([(1, "word"), (2, "word")], "qid long, text string")
    names = spark.createDataFrame([(1, ["RUN"])], "qid long, names array<string>")
    symbols = spark.createDataFrame([(2, "Service.run")], "id long, symbol string")
    found = retrieval.search(questions, docs, asked, vectors, names=names, symbols=symbols)
    assert {r.qid: r.contexts for r in found.collect()} == {1: [2, 0, 1], 2: [0, 1, 2]}
    assert {r.qid: r.contexts for r in retrieval.search(questions, docs, asked, vectors, k=1, use_bm25=False, names=names, symbols=symbols).collect()} == {1: [2], 2: [0]}
    none = [r for lexical in (True, False) for r in retrieval.search(questions, docs, asked, vectors.limit(0), use_bm25=lexical).collect()]
    assert len(none) == 4 and {(r.qid, r.top_score, r.has_evidence, r.reason, tuple(r.contexts)) for r in none} == {(q, None, False, "empty_index", ()) for q in (1, 2)}


def test_vector_search_in_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)] + [(9, None)], "vec_id long, vector array<float>")
    asked = rows.where("vec_id in (0, 3, 7)").withColumnRenamed("vec_id", "qid")
    one_block = {tuple(r) for r in retrieval.vector_top_k(asked, rows, 3).collect()}
    assert one_block == {tuple(r) for r in retrieval.vector_top_k(asked, rows, 3, block=1).collect()}
    assert {(q, v) for q, v, _, rank in one_block if rank == 1} == {(0, 0), (3, 3), (7, 7)}
    assert retrieval.vector_top_k(asked.limit(0), rows, 3).count() == 0


def test_sweep_matches_hand_count(spark):
    rows = [(True, 0.70, 1), (True, 0.55, 5), (True, 0.45, 2), (False, 0.60, None), (False, 0.30, None)]
    frame = spark.createDataFrame(rows, "answerable boolean, top_score double, rank int")
    r = evaluate.sweep(frame, [0.54]).first()
    assert (r.tp, r.fn, r.fp, r.tn) == (2, 1, 1, 1)
    assert (r.gate_recall, r.no_evidence_recall, r.hit_at_3, r.balanced_accuracy) == pytest.approx((0.666667, 0.5, 0.333333, 0.583333))
    r = evaluate.sweep(frame.where("answerable"), [0.54]).first()
    assert r.no_evidence_recall is None and r.balanced_accuracy is None
    tied = spark.createDataFrame([(0.1, 0.5), (0.3, 0.5), (0.2, 0.4)], "threshold double, balanced_accuracy double")
    assert evaluate.best_threshold(tied).first().threshold == 0.3


def test_metrics_and_gold(spark):
    rows = spark.createDataFrame([(True, 1, True, float(i), ["x"]) for i in range(5)] + [(True, None, False, 5.0 + i, ["x", "y"]) for i in range(5)], "answerable boolean, rank int, has_evidence boolean, ms double, tags array<string>")
    m = evaluate.metrics(rows).first()
    assert (m.hit_at_1, m.mrr, m.gate_recall, m.no_evidence_recall, m.p50_ms) == (0.5, 0.5, 0.5, None, 4.5)
    assert {(r.tag, r.n) for r in evaluate.metrics_by_tag(rows).collect()} == {("x", 10), ("y", 5)}
    hit = spark.createDataFrame([(1, "p", "f", 10, 20)], "qid int, path string, symbol string, line_start int, line_end int")
    for a, b, n in ((20, 30, 1), (21, 30, 0), (None, None, 1)):
        gold = spark.createDataFrame([(1, "p", None, a, b)], "qid int, path string, symbol string, gold_start int, gold_end int")
        assert evaluate.gold_matches(hit, gold).count() == n


def test_history(spark):
    edges = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (6, 3), (7, None)], "child long, parent long")
    starts = spark.createDataFrame([(5,), (6,)], "node long")
    for limit in (8 << 20, 0):
        found = history.ancestors(edges, starts, limit)
        assert {(r.start, r.node) for r in found.collect()} == {(5, n) for n in (5, 4, 3, 2, 1)} | {(6, n) for n in (6, 3, 1)}
    assert tuple(history.ahead_behind(found, 6, 5).first()) == (3, 1)
    assert [r.node for r in history.merge_bases(edges, found, 5, 6).collect()] == [3]
    kind = history.relationship(F.col("b"), F.col("t"), F.col("m"))
    rows = spark.createDataFrame([("a", "a", "a"), ("a", "b", "a"), ("a", "b", None), ("a", "b", "c")], "b string, t string, m string")
    assert [r.k for r in rows.select(kind.alias("k")).collect()] == ["same", "fast_forward", "unknown", "diverged"]
    seen = spark.createDataFrame([("m", i, i, h) for i, h in enumerate([1, 1, 2, 1, None, None, 3])], "branch string, at int, seq int, head int")
    assert [r.change_type for r in history.head_changes(seen, F.col("previous_head") < F.col("head")).orderBy("at").collect()] == ["created", "unchanged", "fast_forward", "rewind", "deleted", "already_deleted", "recreated"]


def test_overlay_and_renames(spark):
    tree = lambda *rows: spark.createDataFrame(list(rows), "path string, sha string")
    got = {tuple(r) for r in history.renames(tree(("a", "1"), ("b", "2"), ("c", "3")), tree(("a", "9"), ("d", "2"), ("e", "5"))).collect()}
    assert got == {("a", None, "modified"), ("d", "b", "renamed"), ("c", None, "deleted"), ("e", None, "added")}
    moved = spark.createDataFrame([("b",)], "old_path string")
    after = history.overlay(tree(("a", "1"), ("b", "2"), ("c", "3")), tree(("a", "9"), ("d", "2")), spark.createDataFrame([("c",)], "path string"), moved)
    assert {tuple(r) for r in after.collect()} == {("a", "9"), ("d", "2")}


SOURCE = '''"""Doc."""
import os
LIMIT, other = 1, 2


@app.get("/pay")
def pay():
    def inner():
        return 1
    return inner


class Service:
    name: str = "x"

    async def run(self):
        try:
            def deep(): pass
        finally:
            x = 1
'''


def test_chunks(spark):
    found = [(s["symbol"], s["kind"], s["line_start"], s["line_end"]) for s in chunks.python_scopes(SOURCE)]
    assert found[:4] == [("(module docstring)", "module_doc", 1, 1), ("LIMIT, other", "assign", 3, 3), ("pay", "function", 6, 10), ("pay.inner", "method", 8, 9)]
    assert ("Service.run.deep", "method", 18, 18) in found and ("Service.run.x", "assign", 20, 20) in found
    assert chunks.route_lines(SOURCE) == [("GET", "/pay", 7)]
    text = "\n".join(f"line {i}" for i in range(100))
    windows = list(chunks.line_windows(text, 100, 30, 1))
    assert windows[0][:2] == (1, 14) and windows[-1][1] == 100 and all(b[0] <= a[1] + 1 and b[0] > a[0] for a, b in zip(windows, windows[1:], strict=False))
    assert chunks.pieces("abc", 10, 2) == [(0, 3)]
    long = "".join(f"row {i}\n" for i in range(40))
    spans = chunks.pieces(long, 50, 10)
    assert spans[0][0] == 0 and spans[-1][1] == len(long) and all(long[b - 1] == "\n" and c <= b for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    docs = spark.createDataFrame([(1, "a.py", SOURCE), (2, "bad.py", "def (\n" * 30), (3, "n.txt", None), (4, "r.md", "# A\n\n## B\n" + "long enough words " * 9)], "doc_id long, path string, text string")
    rows = chunks.chunk(docs, least=30).collect()
    assert {(r.doc_id, r.kind) for r in rows} == {(1, k) for k in ("function", "class", "method", "assign")} - {(1, "assign")} | {(2, None), (4, "section")}
    assert [r.enclosing for r in rows if r.doc_id == 4] == [["A > B"]] and [r.chunk_index for r in rows if r.doc_id == 1] == list(range(sum(r.doc_id == 1 for r in rows)))
    md = "intro\n# One\nbody\n```\n# no heading\n```\n## Two\n\n~~~\n# no\n~~~"
    got = [(r.title, r.line_start, r.line_end) for r in chunks.sections(spark.createDataFrame([(1, md)], "doc_id long, text string")).orderBy("section").collect()]
    assert got == [("(intro)", 1, 1), ("One", 2, 6), ("Two", 7, 11)]
    assert chunks.decode_bytes("é".encode("latin-1")) is not None and chunks.decode_bytes(b"a\0b") is None


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, body in {"README.md": b"# T", "src/app.py": b"x = 1", "node_modules/a.js": b"no", "src/data.bin": b"\0", "src/n.txt": b"a\0", "yarn.lock": b"x"}.items():
        (tmp_path / name).write_bytes(body)
    got = {r.path: (r.type, r.text) for r in corpus.scan(spark, str(tmp_path)).collect()}
    assert got == {"README.md": ("doc", "# T"), "src/app.py": ("code", "x = 1")}
    (tmp_path / "s.jsonl").write_text('{"id":"q1","question":"?","answerable":true,"gold":[{"path":"a"}],"tags":["t"]}\nbroken\n')
    rows = corpus.suite(spark, str(tmp_path / "s.jsonl")).collect()
    assert [r.id for r in rows if r._bad is None] == ["q1"] and sum(r._bad is not None for r in rows) == 1
    md = spark.createDataFrame([("# G\n## Q1 what is it?\n- `a/b.py:3-9`\n- `c.md:4`\n## Q2 why\nnothing",)], "text string")
    got = corpus.gold_markdown(md).orderBy("id").collect()
    assert [(r.id, r.question, [tuple(g) for g in r.gold]) for r in got] == [("Q1", "what is it?", [("a/b.py", 3, 9), ("c.md", 4, 4)]), ("Q2", "why", [])]


def test_catalog(spark, tmp_path):
    shelf = catalog.Catalog(spark, str(tmp_path / "index"))
    rows = lambda *r: spark.createDataFrame(list(r), "chunk_id string, path string, text string, seq int")
    first = shelf.build("p", rows(("p:a:0", "a", "old", 1), ("p:a:0", "a", "new", 2), ("p:b:0", "b", "b", 1)), expected=2)
    assert shelf.active("p") == first and {r.text for r in shelf.chunks("p").collect()} == {"new", "b"}
    with pytest.raises(ValueError):
        shelf.build("p", rows(("p:a:0", "a", "x", 1)), expected=5)
    assert shelf.active("p") == first
    manifest = lambda *r: spark.createDataFrame(list(r), "path string, sha256 string")
    plan = catalog.incremental_plan(manifest(("a", "1"), ("b", "2")), manifest(("a", "9"), ("c", "3")), True)
    assert {tuple(r) for r in plan.collect()} == {("a", "changed"), ("b", "deleted"), ("c", "added")}
    second = shelf.rebuild("p", plan, rows(("p:a:0", "a", "newer", 1), ("p:c:0", "c", "c", 1)))
    assert {r.text for r in shelf.chunks("p").collect()} == {"newer", "c"} and shelf.active("p") == second
    assert {r.status for r in shelf.revisions().collect()} == {"active", "retired", "failed"}
    assert [r.revision for r in shelf.prunable(0).collect()] == [first]
    assert catalog.fingerprint({"chunk_size": "900", "zzz": 1}, {"embed_dim": 64})["chunk_size"] == 900


def test_streams(spark, tmp_path):
    text = 'event: delta\ndata: {"a": 1}\n\nevent: bad\ndata: nope\n\ndata: {"b": 2}\r\n\r\ndata: {"rest"'
    got = [(r.seq, r.event, r.data) for r in sse.frames(spark.createDataFrame([("t", text)], "trace string, text string")).orderBy("seq").collect()]
    assert got == [(0, "delta", '{"a": 1}'), (2, "message", '{"b": 2}')]
    events = spark.createDataFrame([("t", 1, "delta", "ab"), ("t", 2, "delta", "cd"), ("t", 3, "delta", "e"), ("t", 4, "done", ""), ("t", 5, "delta", "f")], "trace string, seq int, kind string, text string")
    assert [r.text for r in sse.batch_deltas(events, 4).orderBy("batch").collect()] == ["abcd", "e", "f"]
    folder = tmp_path / "events"
    rows = spark.createDataFrame([(f"2024-01-01 0{h}:{m:02d}:00", "a", 1.0) for h in (1, 2) for m in (0, 30)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(folder))
    stream = sse.event_windows(spark.readStream.schema(rows.schema).parquet(str(folder)))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("select hour(window_start), n from windows").collect()} == {(1, 2), (2, 2)}
    assert {tuple(r) for r in sse.event_windows(rows).selectExpr("hour(window_start)", "n").collect()} == {(1, 2), (2, 2)}


def test_frame_stream_keeps_the_rest(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tmp_path / "chunks"
    folder.mkdir()
    text = 'event: x\ndata: {"n": 1}\n\ndata: {"n": 2}\n\n'
    for i, part in enumerate((text[:17], text[17:30], text[30:])):
        (folder / f"{i}.json").write_text(json.dumps({"trace": "t", "chunk": part}))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = sse.frame_stream(spark.readStream.schema("trace string, chunk string").option("maxFilesPerTrigger", 1).json(str(folder)))
    try:
        q = stream.writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    except Exception as error:  # the runtime's client library may be absent
        if "protobuf" in str(error) or "google" in str(error):
            pytest.skip("stateful Python processors need protobuf")
        raise
    assert {(r.event, r.data) for r in spark.table("frames").collect()} == {("x", '{"n": 1}'), ("message", '{"n": 2}')}


def test_budgets_pass_over_what_does_not_fit(spark):
    import random

    from lodestone.operators.ordered import fitting

    rng = random.Random(4)
    rows = [(g, i, rng.randint(0, 30)) for g in "abc" for i in range(200)] + [("d", 0, None)]
    got = {(r.g, r.i): r.fits for r in fitting(spark.createDataFrame(rows, "g string, i int, size int").repartition(5), ("g",), ["i"], "size", 500, 40).collect()}
    for g in "abcd":
        held = n = 0
        for _, i, size in sorted(r for r in rows if r[0] == g):
            fits = held + (size or 0) <= 500 and n < 40
            assert got[g, i] == fits
            held, n = held + (size or 0) * fits, n + fits


def test_survey_sizes_add_up_in_walk_order(spark):
    from lodestone.operators import survey

    rows = [("r", p, n, False) for p, n in (("b/x.py", 60), ("a.md", 30), ("z.py", 50), ("b/c/y.py", 20), ("b/a.py", 10), (".env", 1), ("b/.git/k.py", 1), ("docs/readme", 5))]
    got = {r.path: (r.reason, r.kind, r.unit) for r in survey.survey_files(spark.createDataFrame(rows, "repo string, path string, length long, is_link boolean"), total_bytes=100).collect()}
    kept = [p for p in got if got[p][0] is None]
    # Files of a folder come before its folders: a.md, z.py, then b/a.py; b/x.py is too much, b/c/y.py and docs/readme are not.
    assert sorted(kept) == ["a.md", "b/a.py", "docs/readme", "z.py"] and got["b/x.py"][0] == got["b/c/y.py"][0] == "survey_size_limit"
    assert got[".env"][0] == "excluded_file" and got["b/.git/k.py"] == ("excluded_directory", "code", "b/.git") and got["docs/readme"][1] == "doc"


def test_survey_sections_know_their_fences(spark):
    from lodestone.operators import survey

    text = "lead\n# Usage\n```\n# no heading\n~~~\n# nor this\n```\n## Other\nx"
    long = "# Title\n" + "\n".join(f"line {i}" for i in range(60)) + "\n# Limits\nnone"
    files = spark.createDataFrame([("r", "docs/a.md", text), ("r", "README.md", long), ("r", "changelog.md", "# Usage\nx")], "repo string, path string, text string")
    got = sorted((r.priority, r.path, r.line_start, r.line_end, r.heading) for r in survey.doc_sections(files).collect())
    assert got == [(0, "README.md", 1, 40, "Title"), (0, "README.md", 62, 63, "Limits"), (1, "docs/a.md", 2, 7, "Usage"), (2, "README.md", 41, 61, "Title (continued)"), (3, "docs/a.md", 1, 1, "intro"), (3, "docs/a.md", 8, 9, "Other"), (4, "changelog.md", 1, 2, "Usage")]


def test_pages_and_cursors(spark):
    from lodestone.operators import views

    rows = spark.range(7).withColumnRenamed("id", "k")
    first = views.page(rows, [F.asc("k")], 3).collect()
    second = views.page(rows, [F.asc("k")], 3, first[0].next_cursor).collect()
    third = views.page(rows, [F.asc("k")], 3, second[0].next_cursor).collect()
    assert [[r.k for r in p] for p in (first, second, third)] == [[0, 1, 2], [3, 4, 5], [6]] and third[0].next_cursor is None
    for bad in ("", "xx", "djE6LTE="):
        with pytest.raises(ValueError):
            views.page(rows, [F.asc("k")], 3, bad)
    with pytest.raises(ValueError):
        views.page(rows, [F.asc("k")], 0)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from lodestone import lineage

    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))

    assert lineage.shared_dir(session("spark://x", "hdfs:/a/")) == "hdfs:/a"
    assert lineage.shared_dir(session("local[4]", None))
    for master in ("spark://x", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            lineage.shared_dir(session(master, None))


def test_deltas_come_in_order_however_they_are_dealt(spark):
    from lodestone.streaming import sse

    rows = [("t", i, "delta" if i % 7 else "tool", f"<{i}>") for i in range(200)]
    got = sse.batch_deltas(spark.createDataFrame(rows, "trace string, seq int, kind string, text string").repartition(4), 12).orderBy("batch").collect()
    assert "".join(r.text for r in got) == "".join(r[3] for r in rows if r[2] == "delta") and len(got) > 30


def test_one_claim_takes_a_lease(spark):
    from lodestone.operators import store

    asked = spark.createDataFrame([(1, 2), (1, 1), (2, 1), (3, 1)], "repository_id long, seq int")
    known = spark.createDataFrame([(1, True), (2, True)], "repository_id long, active boolean")
    runs = spark.createDataFrame([(9, 2, "running", 4, 100)], "run_id long, repository_id long, state string, generation long, lease_until int")
    got = sorted(tuple(r) for r in store.lease_claims(asked, known, runs, F.lit(50)).select("repository_id", "outcome").collect())
    assert got == [(1, "already_running"), (1, "claimed"), (2, "already_running"), (3, "not_found")]


def test_choose_branch_meets_no_pairs_of_branches(spark):
    """Equal to the rule on awkward rows, and one row each side of every join."""
    branches = spark.createDataFrame([(1, 2, "b1", "h1", "p2", True), (1, 1, "b0", "h0", "p1", True), (1, 5, "b1", "h5", "p5", True), (1, 0, "b9", "h5", "p0", False), (2, 3, None, "h1", "p3", True), (None, 1, "b1", "h1", "pn", True), (4, 1, "b", "h", None, True)], "repository_id int, position int, branch string, head string, project_id string, tracked boolean")
    asked = spark.createDataFrame([(1, "h5", "b1", "r"), (1, "h5", "b7", "r"), (1, "x", "b7", "r"), (1, None, "b1", "r"), (2, "h1", None, "r"), (3, "abcdefghij", "b", "r"), (None, "h1", "b1", "n"), (4, "h", "b", "r"), (1, "x", "b7", "r")], "repository_id int, commit string, branch string, name string")
    got = store.choose_branch(asked, branches)
    want = {(1, "h5", "b1"): "p2", (1, "h5", "b7"): "p5", (1, "x", "b7"): "p1", (1, None, "b1"): "p2", (2, "h1", None): "p3", (3, "abcdefghij", "b"): "r-abcdefgh", (None, "h1", "b1"): "n-h1", (4, "h", "b"): "r-h"}
    assert {(r.repository_id, r.commit, r.branch): r.project_id for r in got.collect()} == want and got.count() == len(want)
    # one repository of 3,000 asked and 3,000 branches: nine million pairs before
    many = spark.range(3_000).selectExpr("1 AS repository_id", "id AS position", "concat('b', id) AS branch", "concat('h', id) AS head", "concat('p', id) AS project_id", "true AS tracked")
    joined = store.choose_branch(spark.range(3_000).selectExpr("1 AS repository_id", "concat('h', id) AS commit", "'none' AS branch", "'r' AS name"), many)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count() == 3_000 and all("position" not in line for line in plan.splitlines() if "Join" in line)


def test_a_survey_without_a_budget_leaves_no_file_out(spark):
    rows = spark.range(5_000).selectExpr("'r' AS repo", "concat('src/f', id, '.py') AS path", "20000L AS length", "false AS is_link")
    assert survey.survey_files(rows).where("reason is null").count() == 2_000  # 40 MB
    assert survey.survey_files(rows, total_bytes=None).where("reason is null").count() == 4_000
    assert survey.survey_files(rows, total_bytes=None, most=None).where("reason is null").count() == 5_000
    assert survey.survey_files(rows, most=None).where("reason is null").count() == 2_000


def test_the_registered_survey_has_no_budget(spark, tmp_path):
    """Larger than the default budget of a repository: every third of 13,500 pages."""
    from lodestone.plans import surveys

    spark.range(13_500).selectExpr("id AS page_id", "'http://x' AS url", "repeat('x', 10) AS html").write.parquet(f"{tmp_path}/pages.parquet")
    assert surveys.QUERIES["survey_files"](spark, str(tmp_path)).where("reason = 'survey_size_limit'").count() == 0


def test_ancestors_block_by_block(spark):
    """Chains of hundreds of levels take as many rounds as the blocks that they enter, and equal plain code."""
    pairs = [(n, n // 2) for n in range(2, 1_200)] + [(n, n - 3) for n in range(6, 1_200, 3)] + [(5_000, 4), (7, 6_000), (6_000, None)]
    up = {}
    for child, parent in pairs:
        up.setdefault(child, []).append(parent)
    edges = spark.createDataFrame(pairs, "child long, parent long")
    starts = [1_199, 1_197, 1_100, 5_000, 9_999, 7]
    want = set()
    for start in starts:
        todo, seen = [start], {start}
        while todo:
            for p in up.get(todo.pop(), ()):
                if p is not None and p not in seen:
                    seen.add(p)
                    todo.append(p)
        want |= {(start, node) for node in seen}
    frame = spark.createDataFrame([(s,) for s in [*starts, 7, None]], "node long")
    for block_edges in (1 << 19, 400):
        rows = history.ancestors(edges, frame, 0, block_edges).collect()
        assert len(rows) == len(want) and {(r.start, r.node) for r in rows} == want
