"""Every query with a SQL twin gives the same rows in both engines."""

import math

import duckdb
import pytest

from lodestone.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, int | str | bool) else str(v)


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    df, twin = QUERIES[name](spark, sf_dir), duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(twin.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    other = sorted((tuple(plain(r[twin.columns.index(c)]) for c in columns) for r in twin.fetchall()), key=str)
    assert mine == other


@pytest.fixture(scope="module")
def mixed_sources(spark, tmp_path_factory):
    """Tables in which each source has texts in several languages and every vector passes the gate."""
    folder = str(tmp_path_factory.mktemp("mixed"))
    docs = [(i, f"w{i % 4} w{i % 3} x{i}", ("en", "de", "fr")[i % 3], f"s{i % 2}") for i in range(24)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, f"w{i % 4} x{i}") for i in range(1, 9)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, [1.0, 0.01 * i], i % 2) for i in range(24)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def equals_its_sql(spark, folder, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df, twin = QUERIES[name](spark, folder), c.sql(SQL[name])
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[x]) for x in columns) for r in df.collect()), key=str)
    return mine == sorted((tuple(plain(r[twin.columns.index(x)]) for x in columns) for r in twin.fetchall()), key=str)


def test_search_caps_a_source_in_all_its_languages(spark, mixed_sources):
    assert equals_its_sql(spark, mixed_sources, "search_batch")


def test_evaluation_caps_a_source_in_all_its_languages(spark, mixed_sources):
    assert equals_its_sql(spark, mixed_sources, "eval_pipeline")
