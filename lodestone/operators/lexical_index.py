"""A stored lexical index: postings by term and stretch of documents, with what bounds their impact, and searches that skip.

An index is three Parquet tables in a folder of the caller. ``postings`` has, for each term
and stretch of documents, the documents, how often each has the term, their lengths, and the
frontier of (frequency, length) pairs, of which no other has both a greater frequency and a
smaller length. The greatest BM25 impact in a block is that of a frontier pair, whatever the
average length, so documents can be added without rewriting. ``terms`` has document and
collection frequencies, ``stretches`` the size and total length of each stretch.

A search reads the frontiers of its terms first, without documents: their impacts add up to
a bound of any score in a stretch. The ``SEEDS`` most promising stretches of each question
are scored, and after them only stretches whose bound reaches the k-th score. Hits equal
those of scoring every document. No text is read.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..lineage import cut, small
from .retrieval import B, K1, _best, _merge, blocks_of, top_k

STRETCH, SHELVES, SEEDS = 1024, 32, 2
ROOM = 2e-6
#: Bytes of tokens after which a stretch ends early: documents of any length are whole in one.
STRETCH_BYTES = 16 << 20
BLOCKS = "stretch string, term string, shelf int, docs array<long>, tf array<int>, dl array<int>, edge_tf array<int>, edge_dl array<int>"


def _blocks(run: str, stretch: int):
    """Posting blocks of a task's documents; stretches are numbered by task."""
    import pyarrow as pa
    from pyspark import TaskContext

    def emit(name: str, ids: np.ndarray, tokens: pa.Array, dl: np.ndarray):
        coded = tokens.dictionary_encode()
        terms, size = coded.dictionary, max(len(coded.dictionary), 1)
        row = np.repeat(np.arange(len(ids)), dl)
        key, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(ids) + row, return_counts=True)
        term, doc = key // len(ids), key % len(ids)
        ends = np.searchsorted(term, np.arange(size + 1)).astype(np.int32)
        # frontier: within a term by falling frequency, those shorter than all before
        order = np.lexsort((dl[doc], -tf, term))
        length = dl[doc][order].astype(np.int64) - term[order] * (1 << 40)
        least = np.minimum.accumulate(length)
        new = np.concatenate([[True], (length[1:] < least[:-1])]) if len(length) else np.zeros(0, bool)
        edge = order[new]
        edge_ends = np.searchsorted(term[edge], np.arange(size + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (ids[doc], tf.astype(np.int32), dl[doc].astype(np.int32))]
        edges = [pa.ListArray.from_arrays(pa.array(edge_ends), pa.array(x[edge].astype(np.int32))) for x in (tf, dl[doc])]
        if len(terms):
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(terms)), terms, pa.nulls(len(terms), pa.int32()), *lists, *edges], names=["stretch", "term", "shelf", "docs", "tf", "dl", "edge_tf", "edge_dl"])
        # the stretch itself, as a block without a term
        own = [pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([[]], pa.list_(pa.int32())), pa.array([dl.tolist()], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([None], pa.string()), pa.array([None], pa.int32()), *own, pa.array([[]], pa.list_(pa.int32())), pa.array([[]], pa.list_(pa.int32()))], names=["stretch", "term", "shelf", "docs", "tf", "dl", "edge_tf", "edge_dl"])

    def deal(batches):
        task, n, held, size, step = TaskContext.get().partitionId(), 0, [], 0, min(64, stretch)

        def out():
            ids = np.concatenate([h[0] for h in held])
            yield from emit(f"{run}-{task}-{n}", ids, pa.concat_arrays([h[1] for h in held]), np.concatenate([h[2] for h in held]))

        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                dl = part.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                held.append((part.column(0).to_numpy(zero_copy_only=False), part.column(1).flatten(), dl))
                size += held[-1][1].nbytes
                if sum(len(h[0]) for h in held) >= stretch or size > STRETCH_BYTES:
                    yield from out()
                    n, held, size = n + 1, [], 0
        if held:
            yield from out()

    return deal


def build(docs: DataFrame, path: str, stretch: int = STRETCH) -> None:
    """Index documents (doc_id, text) under ``path``; a null text has no terms, rows without an id stay out."""
    add(docs, path, stretch)


def add(docs: DataFrame, path: str, stretch: int = STRETCH) -> None:
    """Add documents to an index, or begin one. Adding a doc_id again makes it two documents."""
    run = uuid.uuid4().hex[:12]
    tokens = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), tokenize(F.coalesce("text", F.lit(""))).alias("tokens"))
    rows = cut(tokens.mapInArrow(_blocks(run, stretch), BLOCKS))
    whole = rows.where("term is null")
    whole.select("stretch", F.size("docs").cast("long").alias("n"), F.aggregate("dl", F.lit(0).cast("long"), lambda a, x: a + x).alias("total")).coalesce(1).write.mode("append").parquet(f"{path}/stretches")
    shelf = F.pmod(F.xxhash64("term"), F.lit(SHELVES)).cast("int")
    rows = rows.where("term is not null").withColumn("shelf", shelf)
    # salted by stretch, so that the blocks of a stop word are no single task's
    salted = rows.repartition("shelf", F.pmod(F.xxhash64("stretch"), F.lit(8)))
    salted.sortWithinPartitions("shelf", "term", "stretch").write.mode("append").partitionBy("shelf").option("compression", "zstd").parquet(f"{path}/postings")
    counts = rows.groupBy("shelf", "term").agg(F.sum(F.size("docs")).cast("long").alias("df"), F.sum(F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x)).alias("cf"))
    counts.repartition("shelf").write.mode("append").partitionBy("shelf").parquet(f"{path}/terms")


def build_errors(docs: DataFrame, path: str | None = None) -> DataFrame:
    """error and id: rows without an id (or an empty one), ids that several rows have, and, of an index, a count that is not the rows'."""
    name = F.col("doc_id").cast("string")
    missing = docs.where(F.coalesce(name, F.lit("")) == "").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("missing_id").alias("error"), F.lit(None).cast("string").alias("id"))
    twice = docs.where(F.coalesce(name, F.lit("")) != "").groupBy(name.alias("id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("error"), "id")
    out = missing.unionByName(twice)
    if path is not None:
        held = indexed(docs.sparkSession, path)
        wrong = docs.agg(F.count("*").alias("n")).where(F.col("n") != held).select(F.lit("count_mismatch").alias("error"), F.format_string("%d of %d", F.lit(held), "n").alias("id"))
        out = out.unionByName(wrong)
    return out


def indexed(spark: SparkSession, path: str) -> int:
    """How many documents an index holds."""
    return spark.read.parquet(f"{path}/stretches").agg(F.sum("n")).first()[0] or 0


def _asked(spark: SparkSession, path: str, name: str, terms: DataFrame, shelves: list[int]) -> DataFrame:
    """Rows of a table of the index that are about some terms; other shelves are not opened."""
    return spark.read.parquet(f"{path}/{name}").where(F.col("shelf").isin(shelves)).drop("shelf").join(terms, "term", "left_semi")


def search(questions: DataFrame, path: str, k: int = 10, block: int = 1024, seeds: int = SEEDS) -> DataFrame:
    """qid, doc_id, score, rank; BM25 of all documents of the index. ``questions`` has qid and text."""
    spark = questions.sparkSession
    total = spark.read.parquet(f"{path}/stretches").agg(F.sum("n").alias("n"), F.sum("total").alias("t")).first()
    n, average = total.n or 0, (total.t or 0) / total.n if total.n and total.t else 1.0
    out = None
    for part in blocks_of(questions, block):
        # a block of questions is a stated query set: its terms are few
        asked = cut(part.where("qid is not null").select(F.col("qid").cast("long").alias("qid"), F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")))
        terms = small(asked.select("term").distinct(), 64)
        shelves = [r[0] for r in asked.select(F.pmod(F.xxhash64("term"), F.lit(SHELVES)).cast("int")).distinct().collect()]
        known = _asked(spark, path, "terms", terms, shelves).groupBy("term").agg(F.sum("df").alias("df"))
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
        weights = small(cut(asked.join(known, "term").select("qid", "term", idf)), 72)
        impact = F.expr(f"array_max(zip_with(edge_tf, edge_dl, (f, l) -> f * {K1 + 1}D / (f + {K1}D * ({1 - B}D + {B}D * greatest(l, 1) / {average!r}D))))")
        fronts = _asked(spark, path, "postings", terms, shelves).select("term", "stretch", impact.alias("most"))
        bounds = cut(fronts.join(weights, "term").groupBy("qid", "stretch").agg(F.sum(F.col("idf") * F.col("most")).alias("bound")))
        ranked = top_k(bounds, seeds, ("qid",), [F.desc("bound"), F.asc("stretch")]).select("qid", "stretch")
        first = cut(_scored(spark, path, ranked, weights, terms, shelves, average, k))
        floor = top_k(first, k, ("qid",), [F.desc("score"), F.asc("doc_id")]).where(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
        rest = bounds.join(small(floor, 24), "qid", "left").where((F.col("bound") + ROOM >= F.coalesce("floor", F.lit(0.0)))).select("qid", "stretch").join(small(ranked, 64), ["qid", "stretch"], "left_anti")
        found = first.unionByName(_scored(spark, path, cut(rest), weights, terms, shelves, average, k))
        out = found if out is None else out.unionByName(found)
    return top_k(out, k, ("qid",), [F.desc("score"), F.asc("doc_id")])


def _scored(spark: SparkSession, path: str, pairs: DataFrame, weights: DataFrame, terms: DataFrame, shelves: list[int], average: float, k: int) -> DataFrame:
    """The best ``k`` documents of every (qid, stretch), from the stretch's blocks of asked terms."""
    import pyarrow as pa

    wanted = pairs.join(weights, "qid").groupBy("stretch", "term").agg(F.sort_array(F.collect_list(F.struct("qid", "idf"))).alias("asking"))  # one entry a question of the block
    rows = _asked(spark, path, "postings", terms, shelves).join(small(wanted, 256), ["stretch", "term"]).select("stretch", "term", "docs", "tf", "dl", F.transform("asking", lambda x: x["qid"]).alias("q"), F.transform("asking", lambda x: x["idf"]).alias("w"))

    def one(parts: list) -> tuple:
        """Sums of one stretch: questions by documents."""
        docs, doc = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        q_ids, q = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True)
        sums, at, qat = np.zeros((len(q_ids), len(docs))), 0, 0
        for ids, tf, dl, asking, idf in parts:
            weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.maximum(dl, 1) / average))
            # a doc_id may be in a stretch twice: added, one by one
            np.add.at(sums, np.ix_(q[qat : qat + len(asking)], doc[at : at + len(ids)]), idf[:, None] * weight[None, :])
            at, qat = at + len(ids), qat + len(asking)
        return _best(q_ids, docs, np.round(sums, 6), k, sums > 0)

    def score(batches):
        stretch, parts, best = None, [], []
        for batch in batches:
            names = batch.column(0).to_pylist()
            lists = [batch.column(j) for j in range(2, 7)]
            for i, name in enumerate(names):
                if name != stretch and parts:
                    best.append(one(parts))
                    parts = []
                    if len(best) > 64:
                        best = [_merge(best, k)]
                stretch = name
                parts.append(tuple(c[i].values.to_numpy(zero_copy_only=False) for c in lists))
        if parts:
            best.append(one(parts))
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merge(best, k)], names=["qid", "doc_id", "score"])

    return rows.repartition("stretch").sortWithinPartitions("stretch", "term").mapInArrow(score, "qid long, doc_id long, score double")
