"""Lexical and vector search, fusion, reranking and the evidence gate, for all questions in one plan."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import demoted, let, tokenize
from ..lineage import cut, small

K1, B, RRF_K = 1.5, 0.75, 60
SYMBOL_POOL = 100
#: Documents whose tokens are looked up at a time.
POSTING_ROWS = 256


def top_k(scored: DataFrame, k: int, by: tuple[str, ...], order: list[Column]) -> DataFrame:
    """The first ``k`` rows of each group with their rank; Spark plans a group limit before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def document_tokens(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), tokenize(F.col(text)).alias("tokens"))


def term_frequencies(tokens: DataFrame) -> DataFrame:
    """doc_id, term, tf."""
    return tokens.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def document_frequencies(tokens: DataFrame) -> DataFrame:
    """term, df (documents, not occurrences) and cf (occurrences).

    Each document marks the first of its equal tokens, so one sum by term does, which tasks
    combine before they send it.
    """

    def marked(s: Column) -> Column:
        return F.transform(s, lambda t, i: F.struct(t.alias("term"), ((i == 0) | (F.get(s, i - 1) != t)).alias("first")))

    rows = tokens.select(F.explode(let(F.sort_array("tokens"), marked)).alias("t"))
    return rows.groupBy("t.term").agg(F.count_if("t.first").alias("df"), F.count("*").alias("cf"))


def blocks_of(queries: DataFrame, size: int) -> list[DataFrame]:
    """The queries in parts of about ``size`` rows, dealt by a hash of their id."""
    n = -(-queries.count() // size)
    return [queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for i in range(n)] if n > 1 else [queries]


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, dl and, for those of the sorted terms that a document has, their places and how often it has them; documents are tokenised once."""
    import pyarrow as pa
    import pyarrow.compute as pc

    handle = docs.sparkSession.sparkContext.broadcast(pa.array(terms, pa.string()))  # the terms of one block of questions

    def find(batches):
        for batch in (b.slice(at, POSTING_ROWS) for b in batches for at in range(0, b.num_rows, POSTING_ROWS)):
            lists = batch.column(1)
            dl = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            place = pc.index_in(lists.flatten(), value_set=handle.value)
            hit = pc.is_valid(place).to_numpy(zero_copy_only=False)
            key, tf = np.unique(np.repeat(np.arange(len(dl)), dl)[hit] * len(terms) + place.drop_null().to_numpy(), return_counts=True)
            ends = np.searchsorted(key, np.arange(len(dl) + 1) * max(len(terms), 1)).astype(np.int32)
            held = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % max(len(terms), 1), tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dl, pa.int64()), *held], names=["doc_id", "dl", "terms", "tf"])

    return document_tokens(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "tokens").mapInArrow(find, "doc_id long, dl long, terms array<int>, tf array<int>")


def bm25(questions: DataFrame, docs: DataFrame, k: int = 10, block: int = 1024) -> DataFrame:
    """qid, doc_id, score, rank. ``questions`` has qid and text, ``docs`` doc_id and text.

    Questions are taken in blocks. For each, one pass over the documents keeps the postings
    of the block's terms (document by document, so nothing is shuffled), from which totals
    and document frequencies come. A second pass over these postings scores documents
    against all questions of the block, and a task sends on its own best ``k`` rows of each
    question only, however frequent a term is.
    """
    import pyarrow as pa

    out = None
    for part in blocks_of(questions, block):
        asked = part.select(F.col("qid").cast("long"), F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")).toArrow()
        terms, place = np.unique(asked.column("term").to_numpy(), return_inverse=True)
        q_ids, q_row = np.unique(asked.column("qid").to_numpy(), return_inverse=True)
        held = cut(postings(docs.select("doc_id", "text"), terms.tolist()))
        n, total = held.agg(F.count("*"), F.sum("dl")).first()
        df = np.zeros(len(terms))
        for r in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[r.t] = r["count"]
        order = np.argsort(place, kind="stable")
        by_term = np.split(q_row[order], np.searchsorted(place[order], np.arange(1, len(terms)))) if len(terms) else []
        handle = questions.sparkSession.sparkContext.broadcast((q_ids, by_term, np.log(1 + (n - df + 0.5) / (df + 0.5)), (total or 0) / n if n and total else 1.0))

        def score(batches, handle=handle):
            q_ids, by_term, idf, average = handle.value
            best: list = []
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    rows = batch.slice(at, 2048)
                    ids, dl = rows.column(0).to_numpy(zero_copy_only=False), np.maximum(rows.column(1).to_numpy(), 1)
                    lists = rows.column(2)
                    row = np.repeat(np.arange(len(dl)), lists.value_lengths().to_numpy(zero_copy_only=False))
                    term, tf = lists.flatten().to_numpy(), rows.column(3).flatten().to_numpy()
                    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / average))
                    sums = np.zeros((len(q_ids), len(dl)))
                    order = np.argsort(term, kind="stable")
                    for x in np.split(order, np.flatnonzero(np.diff(term[order])) + 1) if len(order) else ():
                        sums[np.ix_(by_term[term[x[0]]], row[x])] += weight[x]
                    best.append(_best(q_ids, ids, np.round(sums, 6), k, sums > 0))
                if len(best) > 64:
                    best = [_merge(best, k)]
            if best:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merge(best, k)], names=["qid", "doc_id", "score"])

        found = held.where(F.size("terms") > 0).select("doc_id", "dl", "terms", "tf").mapInArrow(score, "qid long, doc_id long, score double")
        out = found if out is None else out.unionByName(found)
    return top_k(out, k, ("qid",), [F.desc("score"), F.asc("doc_id")])


def _best(q_ids: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """qid, id and score of each query's best ``k`` columns, of equal scores the least ids."""
    keep = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
    row, column = np.repeat(np.arange(len(q_ids)), keep.shape[1]), keep.ravel()
    if use is not None:
        taken = use[row, column]
        row, column = row[taken], column[taken]
    return q_ids[row], ids[column], score[row, column]


def _merge(parts: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` of each query over several results."""
    q, ids, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], ids[keep], score[keep]


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = 4096) -> DataFrame:
    """qid, vec_id, score (cosine, six decimals), rank; exact. Both frames have an id and a vector.

    The query set is taken in blocks of bounded size. A block goes to every task as one
    matrix, each Arrow batch of vectors is one matrix product, and a task sends on its own
    best ``k`` rows for each query only.
    """
    import pyarrow as pa

    out = None
    for part in blocks_of(queries, block):
        rows = part.select("qid", "vector").where("vector is not null").toArrow().combine_chunks()
        q_ids = rows.column("qid").to_numpy().astype(np.int64)
        q = rows.column("vector").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(q_ids), -1) if len(q_ids) else np.zeros((0, 0))
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        handle = queries.sparkSession.sparkContext.broadcast((q_ids, q))

        def search(batches, handle=handle):
            q_ids, q = handle.value
            best: list = []
            for batch in batches:
                if not batch.num_rows or not len(q_ids):
                    continue
                v = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                for at in range(0, len(q_ids), 256):
                    best.append(_best(q_ids[at : at + 256], batch.column(0).to_numpy(), np.round(q[at : at + 256] @ v.T, 6), k))
                best = [_merge(best, k)]
            if best:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in best[0]], names=["qid", "vec_id", "score"])

        found = vectors.select(F.col("vec_id").cast("long"), "vector").where("vector is not null").mapInArrow(search, "qid long, vec_id long, score double")
        out = found if out is None else out.unionByName(found)
    return top_k(out, k, ("qid",), [F.desc("score"), F.asc("vec_id")])


def rrf(vector_hits: DataFrame, lexical_hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """qid, id, rrf, score, rank from ranked lists (qid, id, rank[, score]); a hit that only the lexical list has scores 0."""
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    both = vector_hits.select("qid", "id", F.col("rank").alias("v"), "score").join(lexical_hits.select("qid", "id", F.col("rank").alias("l")), ["qid", "id"], "full_outer")
    fused = both.select("qid", "id", F.round(part("v") + part("l"), 9).alias("rrf"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rrf"), "id")))


def cap_rerank(hits: DataFrame, cap: int, demote: str = "", path: str = "path", cap_by: str | None = None) -> DataFrame:
    """A new rank by (demoted, over the cap of its file, old rank); nothing is dropped, cap 0 is off."""
    nth = F.row_number().over(Window.partitionBy("qid", cap_by or path).orderBy("rank"))
    over = (nth > cap) if cap > 0 else F.lit(False)
    late = demoted(F.col(path), demote) if demote else F.lit(False)
    keyed = hits.withColumns({"demoted": late.cast("int"), "over_cap": over.cast("int")})
    return keyed.withColumn("new_rank", F.row_number().over(Window.partitionBy("qid").orderBy("demoted", "over_cap", "rank")))


def grade_rerank(hits: DataFrame, grades: DataFrame) -> DataFrame:
    """Hits whose id has a grade come first (0 before 1), others keep their order."""
    best = grades.groupBy("qid", "id").agg(F.min("grade").alias("grade"))
    joined = hits.join(best, ["qid", "id"], "left")
    return joined.withColumn("new_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.coalesce("grade", F.lit(9)), "rank")))


def symbol_grades(candidates: DataFrame, symbols: DataFrame) -> DataFrame:
    """qid, id, grade: 0 where a candidate name equals a symbol, 1 where it equals its last dotted part, any case."""
    name = F.explode(F.split("symbol", r"\s*,\s*")).alias("name")
    names = symbols.select("id", name).where("name != '' and not startswith(name, '(')")
    last = F.element_at(F.split("name", r"\."), -1)
    keys = names.select("id", F.explode(F.array(F.struct(F.col("name").alias("key"), F.lit(0).alias("grade")), F.struct(last.alias("key"), F.when(last != F.col("name"), 1).alias("grade")))).alias("k")).where("k.grade is not null")
    keys = keys.select("id", F.lower("k.key").alias("key"), "k.grade")
    asked = candidates.select("qid", F.explode(F.transform("names", F.lower)).alias("key"))
    return asked.join(keys, "key").groupBy("qid", "id").agg(F.min("grade").alias("grade"))


def gate(hits: DataFrame, threshold: float, k: int, questions: DataFrame | None = None) -> DataFrame:
    """qid, top_score (greatest vector score of the pool), has_evidence, reason and the contexts that pass, in rank order.

    Of ``questions`` (qid), those without hits have no score, no contexts and the reason ``empty_index``.
    """
    passed = F.filter(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))), lambda h: h["score"] >= threshold)
    out = hits.groupBy("qid").agg(F.max("score").alias("top_score"), F.slice(passed, 1, k).alias("passed"))
    if questions is not None:
        out = questions.select("qid").distinct().join(out, "qid", "left").withColumn("passed", F.coalesce("passed", F.array().cast(out.schema["passed"].dataType)))
    evidence = F.coalesce(F.col("top_score") >= threshold, F.lit(False))
    return out.select("qid", "top_score", evidence.alias("has_evidence"), F.when(evidence, "ok").when(F.col("top_score").isNull(), "empty_index").otherwise("below_threshold").alias("reason"), F.transform("passed", lambda h: h["id"]).alias("contexts"))


def reranked(questions: DataFrame, docs: DataFrame, query_vectors: DataFrame, vectors: DataFrame, *, pool: int = 20, k: int = 4, use_bm25: bool = True, cap: int = 0, demote: str = "", cap_by: str = "path", names: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """qid, id, rank, score of all questions' hits: vector pool, lexical pool, fusion, rerank, symbol matches first.

    ``cap_by`` is the column of ``docs`` of which ``cap`` hits come first. ``names`` has qid and names (symbols that the
    question names), ``symbols`` id and symbol; both are needed for the last rerank.
    """
    own = max(pool if use_bm25 or cap or demote else k, k)
    widest = own
    if names is not None and symbols is not None:
        widest = max(own, SYMBOL_POOL)
        naming = names.where(F.size("names") > 0).select("qid", F.lit(True).alias("naming")).distinct()

    def pooled(found: DataFrame) -> DataFrame:
        """Questions that name symbols keep the wider pool, others their own."""
        if widest == own:
            return found
        return found.join(naming, "qid", "left").where((F.col("rank") <= own) | F.col("naming")).drop("naming")

    semantic = pooled(vector_top_k(query_vectors, vectors, widest)).withColumnRenamed("vec_id", "id")
    hits = rrf(semantic, pooled(bm25(questions, docs, widest)).withColumnRenamed("doc_id", "id")) if use_bm25 else semantic
    if cap or demote:
        hits = cap_rerank(hits.join(docs.select(F.col("doc_id").alias("id"), "path", F.col(cap_by).alias("_of")), "id"), cap, demote, cap_by="_of").drop("rank").withColumnRenamed("new_rank", "rank")
    if names is not None and symbols is not None:
        hits = grade_rerank(hits, symbol_grades(names, symbols)).drop("rank", "grade").withColumnRenamed("new_rank", "rank")
    if use_bm25:  # a question without vector hits has no evidence to order, whatever the lexical list says
        hits = hits.join(semantic.select("qid").distinct(), "qid", "left_semi")
    return hits.select("qid", "id", "rank", "score")


def search_indexed(questions: DataFrame, query_vectors: DataFrame, lexical: str | None, vectors: str, *, pool: int = 20, k: int = 4, threshold: float = 0.54, probes: int = 8, exact: bool = True, every: DataFrame | None = None) -> DataFrame:
    """Hybrid search over stored indexes: the gate's rows with ``hybrid``, whether the lexical list took part.

    A lexical index whose documents are not as many as the vectors has drifted: it is left
    out, and the hits are those of the vectors alone.
    """
    from . import ann, lexical_index

    spark = questions.sparkSession
    chunks = ann.cells_table(spark, vectors).agg(F.sum("n")).first()[0] or 0
    hybrid = lexical is not None and lexical_index.indexed(spark, lexical) == chunks
    semantic = ann.search(query_vectors, vectors, max(pool, k) if hybrid else k, probes, exact).withColumnRenamed("vec_id", "id")
    hits = semantic.select("qid", "id", "rank", "score")
    if hybrid:
        hits = rrf(semantic, lexical_index.search(questions, lexical, max(pool, k)).withColumnRenamed("doc_id", "id"))
        hits = hits.join(semantic.select("qid").distinct(), "qid", "left_semi")
    return gate(hits, threshold, k, query_vectors if every is None else every).withColumn("hybrid", F.lit(hybrid))


def search(questions: DataFrame, docs: DataFrame, query_vectors: DataFrame, vectors: DataFrame, *, k: int = 4, threshold: float = 0.54, every: DataFrame | None = None, **options) -> DataFrame:
    """Hybrid search for all questions: ``reranked`` hits, and the gate. ``every`` (qid) names questions that may have no vector."""
    hits = reranked(questions, docs, query_vectors, vectors, k=k, **options)
    return gate(hits, threshold, k, query_vectors if every is None else every)
