"""Lists and projections that a user interface asks for: filters, pages, summaries of indexes and event streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import kept_keys, page_cursor, page_offset
from ..lineage import small

# Keys of traces that may be kept, and status codes of errors.
PROFILE_KEYS = ("embed_model", "embed_dim", "chunker_version", "use_bm25", "pool", "rrf_k", "top_k")
SOURCE_KEYS = ("path", "file", "source", "start_line", "end_line", "line_start", "line_end", "score", "chunk_id", "symbol")
ERROR_CODES = {"bad_request": 400, "project_not_found": 404, "retrieval_failed": 503, "model_not_loaded": 503, "llm_failed": 502}


def where_equal(df: DataFrame, **values) -> DataFrame:
    """The rows that have all given values; a value of None does not filter."""
    for column, value in values.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def page(df: DataFrame, order: list[Column], limit: int, cursor: str | None = None) -> DataFrame:
    """A page with ``next_cursor`` on every row (null on the last page), from an opaque cursor or the start.

    One row more than the limit is read to see whether more follow.
    """
    if not 1 <= limit <= 501:
        raise ValueError("limit must be between 1 and 501")
    offset = 0 if cursor is None else df.sparkSession.range(1).select(page_offset(F.lit(cursor))).first()[0]
    if offset is None:
        raise ValueError("invalid cursor")
    rows = df.orderBy(*order).offset(offset).limit(limit + 1)
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # limit + 1 rows
    rows = rows.withColumn("more", F.max("place").over(Window.partitionBy()) > limit)
    return rows.where(F.col("place") <= limit).withColumn("next_cursor", F.when(F.col("more"), page_cursor(F.lit(offset + limit)))).drop("more")


def newest_first(df: DataFrame, *times: str, key: str) -> list[Column]:
    """The order of lists: the first time that is known, the latest first, then the key."""
    return [F.coalesce(*times).desc(), F.col(key).desc()]


def index_files(chunks: DataFrame) -> DataFrame:
    """path, type, chunks, line_max and distinct symbols in order of their first chunk; names in brackets are no symbols."""
    rows = chunks.groupBy("path").agg(
        F.min_by(F.coalesce("type", F.lit("code")), "chunk_index").alias("type"), F.count("*").alias("chunks"), F.max(F.coalesce("line_end", F.lit(0))).alias("line_max"),
        F.array_sort(F.collect_list(F.struct("chunk_index", "symbol"))).alias("s"),
    )
    names = F.transform(F.flatten(F.transform("s", lambda x: F.split(F.coalesce(x["symbol"], F.lit("")), ","))), lambda n: F.trim(n))
    return rows.select("path", "type", "chunks", "line_max", F.array_distinct(F.filter(names, lambda n: (n != "") & ~F.startswith(n, F.lit("(")))).alias("symbols"))


def hits(chunks: DataFrame, score: Column) -> DataFrame:
    """Chunks as hits: zeros and empty texts are unknown, a missing type is code."""
    number = lambda c: F.nullif(F.col(c), F.lit(0)).alias(c)
    name = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return chunks.select("id", "path", F.coalesce("type", F.lit("code")).alias("type"), number("line_start"), number("line_end"), name("section"), name("symbol"), score.alias("score"))


def project_listing(revisions: DataFrame, current: DataFrame, only_current: bool = False) -> DataFrame:
    """Indexes (project_id, name, head, indexed) with whether their name resolves to them and whether they are behind; ``current`` has name and project_id."""
    winners = current.select(F.col("name"), F.col("project_id").alias("winner"))
    out = revisions.join(winners, "name", "left")
    out = out.select("project_id", "name", F.coalesce(F.col("winner") == F.col("project_id"), F.lit(False)).alias("current"), F.when(F.col("head").isNotNull() & F.col("indexed").isNotNull(), F.col("head") != F.col("indexed")).alias("stale"))
    return out.where("current") if only_current else out


def trace_metadata(profile: Column, sources: Column, references: Column, cited: Column) -> list[Column]:
    """What a trace may keep: known keys of its profile and of 100 sources, and how many there were."""
    safe = F.filter(F.transform(F.slice(sources, 1, 100), lambda s: kept_keys(s, SOURCE_KEYS)), lambda s: F.size(s) > 0)
    count = lambda c: F.when(c.isNull(), 0).otherwise(F.size(c))
    return [kept_keys(profile, PROFILE_KEYS).alias("profile"), safe.alias("sources"), count(sources).alias("source_count"), count(references).alias("reference_count"), count(cited).alias("cited_count")]


def collapsed(events: DataFrame) -> DataFrame:
    """One answer for each request of events (request, seq, event, code, data): its first error or done event, with the meta before it.

    A request with neither has no result and the code 500.
    """
    ends = F.col("event").isin("error", "done")
    first = events.withColumn("end", F.min(F.when(ends, F.col("seq"))).over(Window.partitionBy("request")))
    meta = F.max_by("data", F.when((F.col("event") == "meta") & (F.col("end").isNull() | (F.col("seq") < F.col("end"))), F.col("seq")))
    last = F.max(F.when(F.col("seq") == F.col("end"), F.struct("event", "code", "data")))
    rows = first.groupBy("request").agg(meta.alias("meta"), last.alias("x"))
    known = F.create_map(*[F.lit(v) for pair in ERROR_CODES.items() for v in pair])
    status = F.when(F.col("x").isNull(), 500).when(F.col("x.event") == "done", 200).otherwise(F.coalesce(F.try_element_at(known, F.col("x.code")), F.lit(500)))
    return rows.select("request", status.alias("status"), "meta", F.col("x.data").alias("data"))


def audit_rows(calls: DataFrame) -> DataFrame:
    """Audit rows of calls (request, path, status_code, elapsed_ms) that were neither answered nor accepted."""
    failed = calls.where(~F.col("status_code").isin(200, 202))
    return failed.select("request", F.col("path").alias("target"), F.when(F.col("status_code").isin(401, 403), "denied").otherwise("failed").alias("outcome"), F.format_string("HTTP_%d", F.col("status_code").cast("int")).alias("reason"), F.round("elapsed_ms", 1).alias("elapsed_ms"))


def refs_view(branches: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Branches with the snapshot of their head, else the newest finished one of their project, and how they relate to it."""
    exact = snapshots.groupBy(F.col("project_id"), F.col("revision").alias("head")).agg(F.max_by(F.struct("snapshot_id", "state"), "snapshot_id").alias("own"))
    done = snapshots.where(F.col("state").isin("completed", "already_indexed")).groupBy("project_id").agg(F.max_by("snapshot_id", F.struct("updated_at", "snapshot_id")).alias("newest"))
    joined = branches.join(exact, ["project_id", "head"], "left").join(done, "project_id", "left")
    ready = F.coalesce(F.col("own.state").isin("completed", "already_indexed"), F.lit(False))
    relation = F.when(ready, "current").when(F.col("newest").isNotNull(), "behind").when(F.col("own").isNotNull(), F.col("own.state")).otherwise("none")
    return joined.select("branch", "project_id", relation.alias("relation"), F.when(ready, F.col("own.snapshot_id")).otherwise(F.coalesce("newest", "own.snapshot_id")).alias("snapshot_id"))


def lookup(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of some ids, with score 0: nothing was searched. A short list of ids goes to the rows."""
    return rows.join(small(ids.select(key).distinct(), 16), key, "left_semi").withColumn("score", F.lit(0.0))


def conversation_list(messages: DataFrame, having: Column) -> DataFrame:
    """conv_id, n_messages, n_responses, last_turn and last_role of conversations with a message for which ``having`` holds."""
    asked = messages.where(having).select("conv_id").distinct()
    return messages.join(asked, "conv_id", "left_semi").groupBy("conv_id").agg(
        F.count("*").alias("n_messages"), F.count_if(F.col("role") == "assistant").alias("n_responses"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role")
    )


def without(keys: DataFrame, rows: DataFrame, condition: Column, key: str) -> DataFrame:
    """Distinct keys of which no row meets a condition."""
    return keys.select(key).distinct().join(rows.where(condition).select(key), key, "left_anti")


def retention_preview(rows: DataFrame, policy: DataFrame, mode: str, at: str, key: str) -> DataFrame:
    """mode, n and first_id of rows that are older than their mode's days (policy: mode, days), counted back from the newest row."""
    newest = rows.agg(F.max(at)).scalar()
    old = rows.join(small(policy, 64), F.col(mode) == F.col("mode")).where(F.col(at) < newest - F.make_dt_interval("days"))
    return old.groupBy("mode").agg(F.count("*").alias("n"), F.min(key).alias("first_id"))


def distinct_of(*keys: tuple[DataFrame, str], name: str = "root") -> DataFrame:
    """The distinct values of one column each of several tables."""
    return reduce(DataFrame.unionByName, [df.select(F.col(c).alias(name)) for df, c in keys]).distinct()


def with_unindexed(indexed: DataFrame, every: DataFrame, key: str) -> DataFrame:
    """Indexed rows, and all other keys with nulls for what only an index has."""
    rest = every.select(key).join(indexed, key, "left_anti").withColumn("indexed", F.lit(False))
    return indexed.withColumn("indexed", F.lit(True)).unionByName(rest, allowMissingColumns=True)
