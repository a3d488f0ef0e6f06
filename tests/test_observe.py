"""Decision columns, roll-ups, checks and the query log."""

import datetime

from pyspark.sql import functions as F

from lodestone.operators import observe


def test_decisions(spark):
    rows = spark.createDataFrame([("completed", True, None, False, 0), ("completed", False, None, True, 10), ("failed", None, "x", True, 999), (None, None, None, False, 0)], "state string, done boolean, locator string, running boolean, age int")
    made, ready = observe.readiness(F.col("state"), F.col("done"), F.col("locator"))
    got = rows.select(made.alias("m"), ready.alias("r"), observe.start_decision(F.col("state"), F.col("running"), F.col("age")).alias("d"), observe.run_state(F.lit("running"), F.col("age")).alias("s")).collect()
    assert [(r.m, r.r) for r in got] == [(True, True), (True, False), (True, False), (None, False)]
    assert [r.d for r in got] == ["already_indexed", "already_running", "take_over", "start"]
    assert [r.s for r in got] == ["running", "running", "aborted", "running"]
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "b")], "x string, y string")
    assert [r.m for r in pairs.select(observe.matches(F.col("x"), F.col("y")).alias("m")).collect()] == [True, False, None]


def test_rollups_and_checks(spark):
    outcomes = spark.createDataFrame([(1, True, "unchanged", None), (1, False, None, "gone"), (2, True, "created", None), (3, False, None, "net")], "run_id int, ok boolean, change_type string, reason string")
    assert {(r.run_id, r.state, tuple(r.reasons)) for r in observe.sync_rollup(outcomes).collect()} == {(1, "partial_failure", ("gone",)), (2, "ok", ()), (3, "failed", ("net",))}
    cells = spark.createDataFrame([("a", "p1", "i1", ["retrieval"]), ("b", "p2", "i9", ["other"])], "label string, search_profile string, project_id string, modes array<string>")
    found = observe.matrix_errors(cells, spark.createDataFrame([("p1",)], "search_profile string"), spark.createDataFrame([("i1",)], "project_id string"))
    assert {(r.label, r.error) for r in found.collect()} == {("b", "unknown profile p2"), ("b", "unknown index i9"), ("b", "unknown mode other")}
    vectors = spark.createDataFrame([("i", 5, {"size": "1"}), ("j", 5, {"size": "2"})], "project_id string, chunks int, settings map<string,string>")
    got = observe.drift(spark.createDataFrame([("i", 5)], "project_id string, lexical_count int"), vectors, {"size": 1}).collect()
    assert [(r.project_id, r.lexical, r.settings) for r in got] == [("j", "none of 5", ["size"])]
    seen = observe.residency(spark.createDataFrame([("t", "s", "loaded", None)], "trace string, stage string, generator string, embedder string"))
    assert [(r.role, r.state) for r in seen.collect()] == [("generator", "loaded")]


def test_log_and_report(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 12)
    rows = spark.createDataFrame([(at, i, "p", "q", "answered", None, True, 0.9, 0.5, 1, "m", None, {"ms": 1.0}) for i in ("a", "b", None)], observe.QUERY_LOG)
    observe.log_queries(rows, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 3 and observe.forget_index(log, "a").count() == 2
    text = observe.report(spark.createDataFrame([("x", 0.5, None)], "label string, hit_at_1 double, mrr double"), "Run")
    assert "| x | 50.0 % | — |" in text
    detail = observe.conversation_detail(spark.createDataFrame([(1,), (2,)], "conv_id int"), spark.createDataFrame([(1, 1, "b", "y"), (1, 0, "a", "x")], "conv_id int, turn int, role string, text string"))
    assert {r.conv_id: r.messages and [m.role for m in r.messages] for r in detail.collect()} == {1: ["a", "b"], 2: None}


def test_revisions_are_upserted_abandoned_repaired_and_dropped(spark, tmp_path):
    from lodestone.operators.catalog import Catalog

    store = Catalog(spark, str(tmp_path / "index"))
    rows = lambda *r: spark.createDataFrame(list(r), "chunk_id string, path string, seq int, text string")
    first = store.build("p", rows(("a", "x", 1, "old"), ("b", "x", 1, "b")))
    store.upsert("p", rows(("a", "x", 1, "newer"), ("a", "x", 2, "newest"), ("c", "y", 1, "c")))
    assert {(r.chunk_id, r.text) for r in store.chunks("p").collect()} == {("a", "newest"), ("b", "b"), ("c", "c")}
    assert not store.abandon("p", first, "retired ones stay") and store._any()
    store._record("p", "lost", "building")
    rows(("z", "z", 1, "z")).write.parquet(store.path("p", "lost"))
    assert store.repair() == 1 and not (tmp_path / "index/chunks/project=p/revision=lost").exists()
    assert {r.revision: r.status for r in store.revisions().collect()}["lost"] == "failed"
    store.build("q", rows(("q", "q", 1, "q")))
    (tmp_path / "index/lexical/project=p").mkdir(parents=True)
    assert store.drop("p") == 3 and store.drop("p") == 0
    assert {r.project for r in store.revisions().collect()} == {"q"} and store.chunks("p") is None and store.chunks("q").count() == 1
    assert not (tmp_path / "index/lexical/project=p").exists() and not (tmp_path / "index/chunks/project=p").exists()


def test_runs_are_saved_and_read_again(spark, tmp_path):
    from lodestone.operators import observe
    from lodestone.sources import corpus

    rows = spark.createDataFrame([("cell", "retrieval", "q1", True, 1), ("cell", "retrieval", "q2", False, None)], "label string, mode string, id string, answerable boolean, rank int")
    observe.save_run(rows, str(tmp_path / "runs"), "r1")
    saved = spark.read.json(str(tmp_path / "runs/r1"))
    assert saved.select("run_id", "label", "mode").collect()[0] == ("r1", "cell", "retrieval") and [x.id for x in saved.first().rows] == ["q1", "q2"]
    observe.save_status(rows, str(tmp_path / "status"))
    observe.save_status(rows.limit(1), str(tmp_path / "status"))
    assert spark.read.option("header", True).csv(str(tmp_path / "status")).count() == 1
    (tmp_path / "old").mkdir()
    (tmp_path / "old/a.json").write_text('{"run_id": "a", "cells": []}')
    (tmp_path / "old/b.json").write_text("{broken")
    assert [r.file.rsplit("/", 1)[1] for r in corpus.unreadable_runs(spark, str(tmp_path / "old")).collect()] == ["b.json"]
