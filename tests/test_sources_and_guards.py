"""Source trees pruned at the listing, saved runs, README lookup, build guards, and search over stored indexes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.operators import ann, facts, lexical_index, retrieval
from lodestone.sources import corpus


def opened(df):
    """Files that the scan of a collected plan reads."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    if "AdaptiveSparkPlan" in leaf.nodeName():
        leaf = leaf.executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numFiles").value()


def test_scan_opens_only_what_belongs(spark, tmp_path):
    root = tmp_path / "my repo+x"
    texts = {"a.py": "x = 1\n", "docs/guide.md": "# T\n", "sub dir/b+c.md": "é\n", "node_modules/x.js": "no", "yarn.lock": "no", "gen/out.py": "no", "big.txt": "y" * 500, "image.png": "no", ".git/config.md": "no", "bin.py": "a\0b"}
    for path, text in texts.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    found = corpus.scan(spark, str(root), "gen/**", 400)
    rows = {r.path: (r.type, r.text, r.sha256) for r in found.collect()}
    assert set(rows) == {"a.py", "docs/guide.md", "sub dir/b+c.md"}
    assert rows["sub dir/b+c.md"] == ("doc", "é\n", hashlib.sha256("é\n".encode()).hexdigest())
    assert opened(corpus.scan(spark, str(root), "gen/**", 400)) == 4  # these and bin.py, whose content tells that it is binary


def test_newest_run_by_prefix(spark, tmp_path):
    for name in ("20240101-a.json", "20240102-b.json", "20240103-c.txt", "2023-z.json"):
        (tmp_path / name).write_text("{}")
    assert corpus.newest_run(spark, str(tmp_path), "2024").endswith("/20240102-b.json")
    assert corpus.newest_run(spark, str(tmp_path), "20240101").endswith("/20240101-a.json")
    assert corpus.newest_run(spark, str(tmp_path), "2025") is None


def test_readmes(spark):
    files = spark.createDataFrame([("a", "README"), ("a", "readme.md"), ("a", "x/README.md"), ("b", "x/README.md"), ("c", "README.rst"), ("c", "README.md")], "repo string, path string")
    assert {tuple(r) for r in facts.readmes(files).collect()} == {("a", "readme.md"), ("b", None), ("c", "README.md")}


def test_build_guards(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (1, "c"), (2, "d"), (None, "e")], "doc_id long, text string")
    path = str(tmp_path / "lex")
    lexical_index.build(docs, path)
    assert {tuple(r) for r in lexical_index.build_errors(docs, path).collect()} == {("missing_id", None), ("duplicate_id", "1"), ("count_mismatch", "3 of 4")}
    assert lexical_index.build_errors(docs.where("doc_id = 2")).count() == 0


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stored")
    rows = [(i, f"common word{i % 7} unique{i}", [float(i % 5 + 1), float(i % 3), 1.0 + i / 100]) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    vectors = spark.createDataFrame([(r[0], r[2]) for r in rows], "vec_id long, vector array<double>")
    ann.build(vectors, f"{folder}/v", cells=6)
    lexical_index.build(docs, f"{folder}/l")
    lexical_index.build(docs.where("doc_id < 50"), f"{folder}/short")
    return folder, docs, vectors


def test_search_over_stored_indexes(spark, stored):
    folder, docs, vectors = stored
    questions = spark.createDataFrame([(3, "word3 unique10"), (8, "common"), (9, "nothing here")], "qid long, text string")
    asked = vectors.where("vec_id in (3, 8, 9)").withColumnRenamed("vec_id", "qid")
    every = questions.select("qid").unionByName(spark.createDataFrame([(77,)], "qid long"))
    plain = lambda df: sorted((tuple(r) for r in df.select("qid", "top_score", "has_evidence", "reason", "contexts").collect()), key=str)
    got = retrieval.search_indexed(questions, asked, f"{folder}/l", f"{folder}/v", every=every)
    assert plain(got) == plain(retrieval.search(questions, docs, asked, vectors, every=every)) and got.where("not hybrid").count() == 0
    # an index that has drifted takes no part
    got = retrieval.search_indexed(questions, asked, f"{folder}/short", f"{folder}/v", every=every)
    assert plain(got) == plain(retrieval.search(questions, docs, asked, vectors, use_bm25=False, every=every)) and got.where("hybrid").count() == 0
    assert [r.reason for r in got.where(F.col("qid") == 77).collect()] == ["empty_index"]
