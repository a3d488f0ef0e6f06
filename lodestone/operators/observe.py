"""Views over runs, snapshots, chats and logs: decisions as columns, roll-ups, reports and the query log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_LOG = "at timestamp, index_id string, project_id string, question string, outcome string, reason string, has_evidence boolean, top_score double, threshold double, n_contexts int, model string, error string, timing map<string,double>"


def readiness(state: Column, done: Column, locator: Column) -> tuple[Column, Column]:
    """(materialized, index ready): an index counts as ready once it completed or had been there already, and is done."""
    return locator.isNotNull() | state.isin("materialized", "accepted", "indexing", "completed", "already_indexed"), F.coalesce(state.isin("completed", "already_indexed") & done, F.lit(False))


def start_decision(state: Column, running: Column, heartbeat_age: Column, limit: int = 300) -> Column:
    """What a request to index does: refused while a live run holds the index, taken over once its heartbeat is old."""
    return F.when(running & (heartbeat_age <= limit), "already_running").when(running, "take_over").when(state == "completed", "already_indexed").otherwise("start")


def run_state(state: Column, heartbeat_age: Column, limit: int = 300) -> Column:
    return F.when(state.isin("running", "indexing_lexical", "promoting") & (heartbeat_age > limit), "aborted").otherwise(state)


def matches(expected: Column, seen: Column) -> Column:
    """Equality that is null where either side is unknown."""
    return F.when(expected.isNotNull() & seen.isNotNull(), expected == seen)


def sync_rollup(outcomes: DataFrame) -> DataFrame:
    """Each run's branches by outcome, and its state: nothing, ok, partial failure or failure."""
    ok = F.count_if(F.col("ok"))
    state = F.when(F.count("*") == 0, "nothing").when(ok == F.count("*"), "ok").when(ok > 0, "partial_failure").otherwise("failed")
    return outcomes.groupBy("run_id").agg(F.count("*").alias("n"), ok.alias("n_ok"), F.count_if(F.col("change_type") == "unchanged").alias("n_unchanged"), state.alias("state"), F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("reason")))).alias("reasons"))


def matrix_errors(cells: DataFrame, profiles: DataFrame, indexes: DataFrame, modes: tuple[str, ...] = ("retrieval", "pipeline")) -> DataFrame:
    """label and message of cells that name an unknown profile, index or mode."""
    profile = cells.join(profiles.select("search_profile").distinct(), "search_profile", "left_anti").select("label", F.concat(F.lit("unknown profile "), "search_profile").alias("error"))
    index = cells.join(indexes.select("project_id").distinct(), "project_id", "left_anti").select("label", F.concat(F.lit("unknown index "), "project_id").alias("error"))
    mode = cells.select("label", F.explode("modes").alias("m")).where(~F.col("m").isin(*modes)).select("label", F.concat(F.lit("unknown mode "), "m").alias("error"))
    return profile.unionByName(index).unionByName(mode)


def drift(lexical: DataFrame, vectors: DataFrame, current: dict) -> DataFrame:
    """Indexes whose lexical count differs from their chunks, or whose stored settings differ from the current ones."""
    joined = vectors.join(lexical, "project_id", "left")
    changed = [F.when(~F.col("settings")[k].eqNullSafe(F.lit(str(v))), F.lit(k)) for k, v in current.items()]
    out = joined.select("project_id", F.when(~F.col("lexical_count").eqNullSafe(F.col("chunks")), F.concat_ws(" of ", F.coalesce(F.col("lexical_count").cast("string"), F.lit("none")), "chunks")).alias("lexical"), F.array_compact(F.array(*changed)).alias("settings"))
    return out.where("lexical is not null or size(settings) > 0")


def conversation_detail(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    rows = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    return conversations.join(rows, "conv_id", "left")


def residency(events: DataFrame) -> DataFrame:
    """One observation for each role of a sampled stage: the generator and the embedder."""
    seen = F.explode(F.array(F.struct(F.lit("generator").alias("role"), F.col("generator").alias("state")), F.struct(F.lit("embedder").alias("role"), F.col("embedder").alias("state")))).alias("o")
    return events.select("trace", "stage", seen).select("trace", "stage", "o.role", "o.state").where("state is not null")


def log_queries(rows: DataFrame, folder: str) -> None:
    """Append to the log, one folder a day."""
    rows.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(folder)


def forget_index(log: DataFrame, index_id: str) -> DataFrame:
    """The log without the rows of one index; a project's other indexes keep theirs."""
    return log.where(~F.col("index_id").eqNullSafe(F.lit(index_id)))


def save_run(rows: DataFrame, folder: str, run_id: str) -> None:
    """Evaluation rows (label, mode and what a question yielded) as one JSON line a cell and mode, under the run's id."""
    cells = rows.groupBy("label", "mode").agg(F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c not in ("label", "mode")]))).alias("rows"))
    cells.withColumn("run_id", F.lit(run_id)).coalesce(1).write.mode("errorifexists").json(f"{folder.rstrip('/')}/{run_id}")


def save_status(status: DataFrame, folder: str) -> None:
    """A status table as one CSV file with a header, the last one replaced."""
    status.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def report(metrics: DataFrame, title: str) -> str:
    """A markdown table of a few metric rows, rates as percentages."""
    columns = metrics.columns
    rates = [c for c in columns if c.startswith("hit_at") or c.endswith("recall")]
    show = lambda r, c: "—" if r[c] is None else f"{100 * r[c]:.1f} %" if c in rates else str(r[c])
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(r, c) for c in columns) + " |" for r in metrics.orderBy(*columns[:2]).collect())]) + "\n"


def stage_rollup(calls: DataFrame) -> DataFrame:
    """Each run's stages: calls, cache hits, seconds and whether all went well; ``calls`` has run, stage, cached, seconds and problem."""
    return calls.groupBy("run", "stage").agg(
        F.count("*").alias("calls"), F.count_if("cached").alias("cached"), F.round(F.sum(F.when(~F.col("cached"), F.col("seconds")).otherwise(0.0)), 3).alias("seconds"),
        F.count("problem").alias("problems"), F.when(F.count("problem") == 0, "complete").when(F.count("problem") < F.count("*"), "partial").otherwise("failed").alias("status"),
    )


def progress(steps: DataFrame) -> DataFrame:
    """Each run's processed and total items and its share; a share of nothing is null."""
    out = steps.groupBy("run").agg(F.count_if("done").alias("processed"), F.count("*").alias("total"))
    return out.withColumn("share", F.when(F.col("total") > 0, F.round(F.col("processed") / F.col("total"), 4)))


def repository_list(repositories: DataFrame, branches: DataFrame, runs: DataFrame) -> DataFrame:
    """Repositories (repository_id, created_at) with their branches, how many are tracked, and their last run's state."""
    tracked = branches.groupBy("repository_id").agg(F.count("*").alias("branches"), F.count_if("tracked").alias("tracked"))
    last = runs.groupBy("repository_id").agg(F.max_by("state", F.struct("started_at", "run_id")).alias("last_state"))
    none = F.lit(0)
    joined = repositories.join(tracked, "repository_id", "left").join(last, "repository_id", "left")
    return joined.select("repository_id", F.coalesce("branches", none).alias("branches"), F.coalesce("tracked", none).alias("tracked"), F.coalesce("last_state", F.lit("never")).alias("last_state"))
