"""Registered queries: each applies an operator to whole driver tables, which stand in for the engine's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import text as T
from ..lineage import small, spread
from ..operators import assemble, chunks, evaluate, history, retrieval, views
from ..sources import corpus
from ..streaming import sse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def lexical(spark, d, k):
    return retrieval.bm25(questions(spark, d), documents(spark, d), k)


def semantic(spark, d, k, where=None):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = rows.where("vec_id % 20 = 0") if where is None else rows.join(where, "vec_id", "left_semi")
    return retrieval.vector_top_k(asked.withColumnRenamed("vec_id", "qid"), rows, k)


def fused(spark, d):
    """Benchmark questions against documents; the vector of a question or document is the one of its number."""
    ids = small(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), 16)
    return retrieval.rrf(semantic(spark, d, 20, ids).withColumnRenamed("vec_id", "id"), lexical(spark, d, 20).withColumnRenamed("doc_id", "id"))


def eval_rows(spark, d):
    """Every vector whose id is divisible by 20 as a question; vectors of its label are relevant."""
    label = table(spark, d, "embeddings").select("vec_id", "label")
    hits = semantic(spark, d, 21).where("vec_id != qid")
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where("rank <= 20")
    hits = hits.join(label, "vec_id").join(label.select(F.col("vec_id").alias("qid"), F.col("label").alias("q_label")), "qid")
    ranks = evaluate.first_relevant_rank(hits, F.col("label") == F.col("q_label")).join(label.select(F.col("vec_id").alias("qid"), F.col("label").alias("q_label")), "qid")
    ms = table(spark, d, "events").select(F.col("event_id").alias("qid"), F.round(F.abs("value"), 3).alias("ms"))
    tags = F.array(F.concat(F.lit("third_"), (F.col("q_label") % 3).cast("string")), F.when(F.col("q_label") % 2 == 0, "even").otherwise("odd"))
    return ranks.select("qid", (F.col("q_label") < 8).alias("answerable"), tags.alias("tags"), "rank", "top_score", (F.col("top_score") >= 0.5).alias("has_evidence")).join(ms, "qid", "left")


def swept(spark, d):
    return evaluate.sweep(eval_rows(spark, d), [round(0.05 * i, 2) for i in range(20)])


@query
def bm25_topk(spark, d):
    return lexical(spark, d, 10).select("qid", "doc_id", "score", "rank")


@query
def token_df(spark, d):
    return retrieval.document_frequencies(retrieval.document_tokens(documents(spark, d), "doc_id", "text"))


@query
def vector_topk(spark, d):
    return semantic(spark, d, 10)


@query
def rrf_fusion(spark, d):
    return fused(spark, d)


@query
def per_source_cap_rerank(spark, d):
    """At most one hit of a source before the others; German documents go last."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "lang", "source").alias("path"), "source")
    hits = fused(spark, d).join(docs, "id")
    return retrieval.cap_rerank(hits, 1, "de", cap_by="source").select("qid", "id", "rank", "demoted", "over_cap", "new_rank")


@query
def grade_rerank(spark, d):
    hits = fused(spark, d)
    grade = F.when(F.col("quality") == 1, 0).otherwise(1)
    graded = table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality")).select("id", grade.alias("grade"))
    return retrieval.grade_rerank(hits, hits.select("qid", "id").join(graded, "id")).select("qid", "id", "rank", "grade", "new_rank")


@query
def hybrid_gate(spark, d):
    return retrieval.gate(fused(spark, d), 0.54, 4)


@query
def hit_mrr(spark, d):
    return evaluate.metrics(eval_rows(spark, d))


@query
def metrics_by_tag(spark, d):
    return evaluate.metrics_by_tag(eval_rows(spark, d))


@query
def latency_percentiles(spark, d):
    return evaluate.percentiles(table(spark, d, "events"), "event_type", "value")


@query
def threshold_sweep(spark, d):
    return swept(spark, d)


@query
def best_threshold(spark, d):
    return evaluate.best_threshold(swept(spark, d))


@query
def nearest_threshold(spark, d):
    return evaluate.nearest_threshold(swept(spark, d), 0.54)


@query
def gold_overlap(spark, d):
    """Line items as hits and returned ones as gold: an order is a path, an item a range of lines."""
    items = table(spark, d, "lineitem")
    hits = items.select(F.col("l_orderkey").alias("qid"), F.lit("p").alias("path"), F.lit("s").alias("symbol"), (F.col("l_linenumber") * 10).alias("line_start"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).alias("line_end"))
    gold = items.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("qid"), F.lit("p").alias("path"), F.lit(None).cast("string").alias("symbol"), (F.col("l_linenumber") * 10).alias("gold_start"), (F.col("l_linenumber") * 10 + F.col("l_quantity") / 2).alias("gold_end"))
    found = evaluate.gold_matches(hits, gold).select(F.lit(1).alias("one"))
    both = hits.select(F.lit(0).alias("one")).unionAll(found)
    return both.agg(F.count_if(F.col("one") == 0).alias("n_hits"), F.count_if(F.col("one") == 1).alias("n_matched"))


@query
def suite_errors(spark, d):
    i = F.col("item_id")
    line = F.struct(F.lit("p").alias("path"), F.lit(9).alias("line_start"), F.when(i % 4 == 0, 3).otherwise(12).alias("line_end"))
    empty = F.array().cast("array<struct<path:string,line_start:int,line_end:int>>")
    suite = table(spark, d, "benchmark").select(
        F.concat(F.lit("q"), (i % 35).cast("string")).alias("id"), F.col("text").alias("question"), (i % 3 != 0).alias("answerable"),
        F.when((i % 2 == 0) | (i % 4 == 0), F.array(line)).otherwise(empty).alias("gold"),
        F.concat(F.array(F.lit("a")), F.when(i % 7 == 0, F.array(F.lit("zz"))).otherwise(F.array().cast("array<string>")), F.when(i % 5 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))).alias("tags"),
    )
    found = evaluate.suite_errors(suite, ["a", "b"])
    order = ["duplicate id", "gold but not answerable", "answerable without gold", "unknown tag", "duplicate tag", "bad line range"]
    return found.select("id", F.filter(F.array(*map(F.lit, order)), lambda m: F.array_contains("errors", m)).alias("errors"))


@query
def citations_rollup(spark, d):
    """Answers that cite [a, b]; numbers over the five contexts are dropped."""
    said = table(spark, d, "conversations").where("role = 'assistant'")
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    said = said.withColumn("n1", F.length(F.concat_ws("", words)) % 5 + 1).withColumn("n2", F.size(words) % 7 + 1)
    answer = F.format_string("so it is [%d, %d] and again [%d]", "n1", "n2", "n1")
    return said.select("conv_id", "turn", T.citations(answer, F.lit(5)).alias("cited"))


@query
def file_rollup(spark, d):
    hits = lexical(spark, d, 20).join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    return hits.groupBy("source").agg(
        F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("qid", "rank"))), lambda x: x["rank"]).alias("ranks"),
        F.array_sort(F.collect_set("lang")).alias("langs"), F.max("score").alias("best_score"), F.bool_or(F.col("rank") == 1).alias("cited"), F.min("doc_id").alias("first_doc"),
    )


@query
def counter_top(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_returnflag", "l_linestatus").limit(3)


@query
def latest_per_group(spark, d):
    return history.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"), ("o_custkey",), (F.desc("o_orderdate"), F.desc("o_orderkey")))


@query
def retain_last_k(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return history.beyond_last_k(rows, ("o_custkey",), (F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")), 3).select("o_custkey", "o_orderkey", "position")


def heads(spark, d):
    """Users as branches; a purchase takes the branch away, other values are heads, and a lesser head is an ancestor."""
    head = F.when(F.col("event_type") != "purchase", F.floor(F.abs("value")).cast("long"))
    seen = table(spark, d, "events").select(F.col("user_id").alias("branch"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), head.alias("head"))
    return history.head_changes(seen, F.col("previous_head") < F.col("head"))


@query
def head_changes(spark, d):
    return heads(spark, d).select("branch", "seq", "head", "previous_head", "change_type")


@query
def head_change_counts(spark, d):
    return heads(spark, d).groupBy("change_type").agg(F.count("*").alias("n"), F.count_distinct("branch").alias("branches"))


@query
def conversation_list(spark, d):
    return views.conversation_list(table(spark, d, "conversations"), F.col("role") == "system")


@query
def idle_conversations(spark, d):
    rows = table(spark, d, "conversations")
    return views.without(rows, rows, F.expr("role = 'assistant' and turn >= 3"), "conv_id")


@query
def retention_preview(spark, d):
    policy = spark.createDataFrame([("click", 7), ("view", 14), ("purchase", 21)], "mode string, days int")
    return views.retention_preview(table(spark, d, "events"), policy, "event_type", "ts", "event_id")


@query
def keyset_page(spark, d):
    import datetime

    return history.keyset_page(table(spark, d, "orders").select("o_orderdate", "o_orderkey", "o_custkey"), ("o_orderdate", "o_orderkey"), (datetime.datetime(1997, 1, 1), 1000), 50)


@query
def offset_page(spark, d):
    return table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").select("c_custkey", "c_name", "c_acctbal").offset(50).limit(26).drop("c_acctbal")


@query
def manifest_diff(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("path"), "p_name")
    name = F.when(F.col("path") % 7 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))
    return history.diff(rows.where("path % 10 != 0").select("path", F.sha2("p_name", 256).alias("h")), rows.where("path % 11 != 0").select("path", F.sha2(name, 256).alias("h")), "path", "h")


@query
def tree_renames(spark, d):
    rows, key = table(spark, d, "part"), F.col("p_partkey")
    sha = F.concat("p_brand", F.col("p_size").cast("string"))
    old = rows.where("p_partkey % 4 != 0").select(F.concat(F.lit("a/"), key.cast("string")).alias("path"), sha.alias("sha"))
    place = F.when(key % 9 == 0, "b/").otherwise("a/")
    new = rows.where("p_partkey % 5 != 0").select(F.concat(place, key.cast("string")).alias("path"), F.when(key % 13 == 0, F.concat(F.lit("new"), key.cast("string"))).otherwise(sha).alias("sha"))
    return history.renames(old, new)


@query
def overlay_tree(spark, d):
    rows, key = table(spark, d, "supplier"), F.col("s_suppkey")
    path = F.concat(F.lit("f/"), key.cast("string"))
    files = rows.where("s_suppkey % 6 = 0").select(path.alias("path"), F.lit("new").alias("sha")).unionByName(rows.where("s_suppkey % 7 = 0").select(F.concat(F.lit("g/"), key.cast("string")).alias("path"), F.lit("moved").alias("sha")))
    moved = rows.where("s_suppkey % 7 = 0").select(path.alias("old_path"))
    return history.overlay(rows.select(path.alias("path"), F.col("s_name").alias("sha")), files, rows.where("s_suppkey % 5 = 0").select(path.alias("path")), moved)


@query
def children_collect(spark, d):
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    rows = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return history.children(nations, rows, "n_nationkey", "s_suppkey", "s_suppkey").select("n_name", "children")


@query
def status_case(spark, d):
    done = table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("done")).distinct()
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "materialized").when(F.col("o_orderstatus") == "O", "failed")
    rows = table(spark, d, "orders").select("o_orderkey", state.alias("state")).join(done, "o_orderkey", "left")
    return rows.select(history.commit_status(F.col("state"), F.col("done"), F.lit(None)).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query
def roots_union(spark, d):
    parts = [("supplier", "s_nationkey"), ("customer", "c_nationkey"), ("nation", "n_nationkey")]
    return views.distinct_of(*((table(spark, d, t), k) for t, k in parts))


def edges(spark, d):
    """Parts as commits: the first parent of n is n // 2, every third has n - 3 as its second."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("child"))
    return rows.where("child >= 2").select("child", F.expr("child div 2").alias("parent")).unionByName(rows.where("child % 3 = 0 and child > 3").select("child", (F.col("child") - 3).alias("parent"))).distinct()


def newest(spark, d) -> list[int]:
    top = table(spark, d, "part").agg(F.max("p_partkey")).first()[0]
    return [top, top - 1]


def reached(spark, d):
    return history.ancestors(edges(spark, d), spark.createDataFrame([(x,) for x in newest(spark, d)], "node long"))


@query
def unresolved_diff(spark, d):
    known = table(spark, d, "part").where("p_partkey % 4 != 0").select(F.col("p_partkey").alias("node"))
    return history.unresolved(edges(spark, d), known)


@query
def unindexed_union(spark, d):
    return views.with_unindexed(table(spark, d, "labels").select("doc_id", "quality"), table(spark, d, "documents"), "doc_id")


@query
def ancestors(spark, d):
    return reached(spark, d)


@query
def ancestors_by_level(spark, d):
    """Walked block by block, as graphs are that do not fit a task: suppliers' lines of n // 2."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("child"))
    return history.ancestors(rows.where("child >= 2").select("child", F.expr("child div 2").alias("parent")), rows.where("child % 10 = 0").select(F.col("child").alias("node")), local_bytes=0)


@query
def ahead_behind(spark, d):
    a, b = newest(spark, d)
    return history.ahead_behind(reached(spark, d), b, a)


@query
def merge_bases(spark, d):
    a, b = newest(spark, d)
    return history.merge_bases(edges(spark, d), reached(spark, d), a, b)


@query
def line_sections(spark, d):
    return chunks.sections(table(spark, d, "documents"))


@query
def line_window_chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("path"), "text")
    return chunks.chunk(docs).drop("text", "enclosing", "symbol")


@query
def glob_filter(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return rows.where(T.excluded(F.col("path"), "**.example.com/**,*/en/*.html,blog.*/de/*"))


@query
def redact(spark, d):
    return documents(spark, d).select("doc_id", T.redacted(F.col("text")).alias("redacted")).where("redacted is not null")


@query
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("estimate"))


@query
def lifecycle_fold(spark, d):
    kind = F.when(F.col("event_type").isin("click", "view"), "delta").when(F.col("event_type") == "purchase", F.expr("IF(user_id % 2 = 0, 'completed', 'notice')")).otherwise(F.col("event_type"))
    rows = table(spark, d, "events").select(F.col("user_id").alias("trace"), F.col("event_id").alias("seq"), kind.alias("kind"), F.abs("value").alias("size"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("m"), (F.col("event_id") % 5).cast("string"))).alias("model"))
    return history.lifecycle(rows, "trace", "seq").withColumn("delta_size", F.round("delta_size", 4))


@query
def event_windows(spark, d):
    return sse.event_windows(table(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query
def purge_preview(spark, d):
    keys = table(spark, d, "customer").where("c_nationkey = 7").select("c_custkey")
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    items = table(spark, d, "lineitem").select("l_orderkey").join(orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    return history.purge_preview({"orders": (orders, "o_custkey"), "lineitem": (items, "o_custkey")}, keys, "c_custkey")


@query
def illegal_transitions(spark, d):
    states = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("state"))
    return history.illegal_transitions(states, spark.createDataFrame([("O", "P"), ("P", "F")], "from_state string, to_state string"), "subject", "seq")


@query
def corpus_scan(spark, d):
    return corpus.manifest(table(spark, d, "documents").where("lang != 'es'"), "doc_id", max_bytes=20_000)


@query
def revision_prune(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("project"), F.col("c_custkey").alias("revision"), "c_acctbal")
    return history.beyond_last_k(rows, ("project",), (F.desc_nulls_last("c_acctbal"), F.desc("revision")), 3).select("project", "revision")


@query
def safe_paths(spark, d):
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://(.*)$", 1), r"[?#].*$", "")
    rows = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, F.concat(path, F.lit("/../x"))).otherwise(path).alias("path"))
    return rows.select("page_id", R.is_safe_path(F.col("path")).alias("safe"), R.document_priority(F.col("path")).alias("priority"), R.is_test_path(F.col("path")).alias("is_test"))


@query
def captured_content(spark, d):
    mode = F.when(F.col("turn") % 2 == 0, "metadata").otherwise("full")
    return table(spark, d, "conversations").select("conv_id", "turn", R.captured(F.col("text"), mode).alias("c")).select("conv_id", "turn", "c.content", "c.sha256", F.col("c.n_bytes").cast("long").alias("n_bytes"))


@query
def budget_pack(spark, d):
    """Turns of each conversation that fit 800 characters when taken in order."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return assemble.pack(rows, "conv_id", "turn", "size", 800)


@query
def path_resolution(spark, d):
    key, rows = F.col("s_suppkey"), table(spark, d, "supplier")
    files = rows.select(F.concat(F.lit("d"), (key % 3).cast("string"), F.lit("/s/f"), (key % 70).cast("string")).alias("path")).distinct()
    asked = rows.select(F.concat(F.when(key % 2 == 0, "./").otherwise(""), F.lit("s/f"), (key % 90).cast("string")).alias("asked"))
    return assemble.resolve_paths(asked, files)


@query
def next_sequence(spark, d):
    """Open orders numbered after the finished ones of their customer."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    done = rows.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("seq"))
    return assemble.next_sequence(done, "o_custkey", "seq", rows.where("o_orderstatus != 'F'").select("o_custkey", "o_orderkey"), "o_orderkey").select("o_custkey", "o_orderkey", F.col("seq").cast("long").alias("seq"))


@query
def first_match(spark, d):
    """A nation's contact: a rich supplier, else a rich customer, else any customer."""
    keys = table(spark, d, "nation").select("n_nationkey")
    supplier = table(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"), "s_name")
    customers = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_name", "c_acctbal")
    return assemble.first_match(keys, "n_nationkey", (supplier, "s_name"), (customers.where("c_acctbal > 9900"), "c_name"), (customers, "c_name"))


@query
def reference_files(spark, d):
    """File roll-up of the four best documents of each question; even questions cite the first and third."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("path"), F.col("lang").alias("section"))
    contexts = lexical(spark, d, 4).join(docs, "doc_id").select("qid", F.col("rank").alias("n"), "path", "section", (F.col("doc_id") % 50).alias("line_start"), (F.col("doc_id") % 50 + 9).alias("line_end"), "score")
    cited = questions(spark, d).select("qid", F.when(F.col("qid") % 2 == 0, F.array(F.lit(1), F.lit(3))).otherwise(F.array().cast("array<int>")).alias("cited"))
    return assemble.reference_files(assemble.references(contexts, cited, True)).select("qid", "path", "citations", "sections", "best_score", "cited", "line", F.col("chunk_count").cast("long").alias("chunk_count"), "place")


@query
def sse_frames(spark, d):
    """Events written as one stream of frames for each user, and read back."""
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("trace"), "event_id", sse.serialise(F.col("event_type"), F.col("props")).alias("frame"))
    text = rows.groupBy("trace").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("event_id", "frame"))), lambda x: x["frame"])).alias("text"))
    return sse.frames(text)


@query
def user_sessions(spark, d):
    return sse.sessions(table(spark, d, "events")).withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query
def point_lookup(spark, d):
    asked = table(spark, d, "benchmark").select((F.col("item_id") * 30).alias("doc_id"))
    return views.lookup(table(spark, d, "documents"), asked, "doc_id").select("doc_id", "source", "score")


@query
def index_names(spark, d):
    name = R.safe_component(F.col("c_name"), "repository", 16)
    return table(spark, d, "customer").select("c_custkey", name.alias("component"), R.normalized_name(F.col("c_mktsegment")).alias("segment"))
