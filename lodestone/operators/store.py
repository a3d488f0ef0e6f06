"""Rules of a snapshot and repository store as set operations: what each request would meet, and what rows would follow.

Nothing is locked or changed here. Each function takes the tables as they stand and says for
every request, in one plan, what a store that handles it alone would answer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of snapshots and runs.
ACTIVE = ("submitting", "accepted", "indexing")
DONE = ("completed", "already_indexed")
RETRYABLE = ("failed", "rejected", "aborted")


def _repeated(values: Column) -> Column:
    return F.size(F.array_distinct(values)) < F.size(values)


def overlay_errors(overlays: DataFrame) -> DataFrame:
    """request and errors of overlays (request, files, deleted, renames (old_path, new_path)) that contradict themselves."""
    old, new = F.transform("renames", lambda r: r["old_path"]), F.transform("renames", lambda r: r["new_path"])
    files, deleted = F.col("files"), F.col("deleted")
    rules = [
        (_repeated(files), "duplicate files"), (_repeated(deleted), "duplicate deleted paths"), (_repeated(old), "duplicate rename sources"), (_repeated(new), "duplicate rename targets"),
        (F.arrays_overlap(files, deleted), "changed and deleted"), (F.arrays_overlap(files, old), "rename source changed"), (F.arrays_overlap(deleted, old), "rename source deleted"),
        (F.size(F.array_except(new, files)) > 0, "rename target without content"),
    ]
    found = overlays.select("request", F.array_compact(F.array(*[F.when(broken, message) for broken, message in rules])).alias("errors"))
    return found.where(F.size("errors") > 0)


def overlay_deltas(files: DataFrame, deleted: DataFrame, renames: DataFrame) -> DataFrame:
    """request, path, status, old_path: rows that an overlay leaves; a file at a rename's target is a rename, whatever its own status."""
    moved = renames.select("request", F.col("new_path").alias("path"), "old_path")
    changed = files.join(moved, ["request", "path"], "left").select("request", "path", F.when(F.col("old_path").isNotNull(), "renamed").otherwise(F.col("status")).alias("status"), "old_path")
    return changed.unionByName(deleted.select("request", "path", F.lit("deleted").alias("status"), F.lit(None).cast("string").alias("old_path")))


def delta_projection(status: Column, old_path: Column) -> tuple[Column, Column]:
    """Status and old path as an indexer takes them: a copy is an addition, only renames have an old path."""
    return F.when(status == "copied", "added").otherwise(status), F.when(status == "renamed", old_path)


def transitions(requests: DataFrame, snapshots: DataFrame, allowed: DataFrame) -> DataFrame:
    """request, snapshot_id, outcome and the state that follows, for requests (request, snapshot_id, expected, new_state).

    A snapshot that is not in one of the expected states keeps its own; so does one whose
    state machine does not lead to the new one.
    """
    joined = requests.join(snapshots.select("snapshot_id", "state"), "snapshot_id", "left")
    steps = F.broadcast(allowed.select(F.col("from_state").alias("state"), F.col("to_state").alias("new_state"), F.lit(True).alias("legal")))  # a state machine's table
    joined = joined.join(steps, ["state", "new_state"], "left")
    outcome = F.when(F.col("state").isNull(), "not_found").when(~F.array_contains("expected", F.col("state")), "unexpected_state").when(F.col("legal").isNull(), "illegal").otherwise("ok")
    return joined.select("request", "snapshot_id", outcome.alias("outcome"), F.when(outcome == "ok", F.col("new_state")).otherwise(F.col("state")).alias("state"))


def target_lookup(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """request, outcome, status code, whether a retry may help and the snapshot found, for requests (request, project_id, revision)."""
    known = snapshots.groupBy("project_id", "revision").agg(F.min_by(F.struct("snapshot_id", "state"), "snapshot_id").alias("s"))
    joined = requests.join(known, ["project_id", "revision"], "left")
    state = F.col("s.state")
    done = state.isin(*DONE)
    return joined.select(
        "request", F.when(state.isNull(), "new").when(done, "already_indexed").otherwise("already_exists").alias("outcome"),
        F.when(state.isNull(), 202).when(done, 200).otherwise(409).alias("code"), F.coalesce(state.isin(*RETRYABLE), F.lit(False)).alias("retryable"), F.col("s.snapshot_id").alias("snapshot_id"),
    )


def active_conflicts(snapshots: DataFrame) -> DataFrame:
    """snapshot_id of snapshots whose project has another one on its way; one count a project, no pairs."""
    active = F.col("state").isin(*ACTIVE)
    counted = snapshots.withColumn("n", F.count_if(active).over(Window.partitionBy("project_id")))
    return counted.where(F.col("n") > F.when(active, 1).otherwise(0)).select("snapshot_id", "project_id")


def recovery_candidates(snapshots: DataFrame, limit: int = 100) -> DataFrame:
    """Snapshots on their way, the longest untouched first."""
    return snapshots.where(F.col("state").isin(*ACTIVE)).orderBy("updated_at", "snapshot_id").limit(limit)


def lease_claims(requests: DataFrame, repositories: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """repository_id, outcome, generation and the expired run that a claim ends.

    ``repositories`` has repository_id and active, ``runs`` run_id, repository_id, state,
    generation and lease_until. A live lease refuses a claim, an expired one is ended by it,
    and generations only grow. Of several claims on a repository the first (by ``seq``, if
    requests have it) takes the lease, which refuses the others.
    """
    running = F.col("state") == "running"
    held = runs.groupBy("repository_id").agg(
        F.max("generation").alias("last"), F.max(F.when(running & (F.col("lease_until") > now), F.lit(1))).alias("live"), F.max(F.when(running & (F.col("lease_until") <= now), F.col("run_id"))).alias("expired")
    )
    turn = F.row_number().over(Window.partitionBy("repository_id").orderBy("seq" if "seq" in requests.columns else "repository_id")).alias("turn")
    joined = requests.select("repository_id", turn).join(repositories.select("repository_id", "active"), "repository_id", "left").join(held, "repository_id", "left")
    outcome = F.when(F.col("active").isNull(), "not_found").when(~F.col("active"), "inactive").when(F.col("live").isNotNull() | (F.col("turn") > 1), "already_running").otherwise("claimed")
    claimed = outcome == "claimed"
    return joined.select("repository_id", outcome.alias("outcome"), F.when(claimed, F.coalesce("last", F.lit(0)) + 1).cast("long").alias("generation"), F.when(claimed, F.col("expired")).alias("ended_run"))


def lease_refreshes(requests: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """run_id, whether the caller (run_id, expected) still owns the lease, and its next generation."""
    joined = requests.join(runs, "run_id", "left")
    owns = F.coalesce((F.col("state") == "running") & (F.col("generation") == F.col("expected")) & (F.col("lease_until") > now), F.lit(False))
    return joined.select("run_id", owns.alias("owns"), F.when(owns, F.col("generation") + 1).cast("long").alias("generation"))


def purge_plan(repositories: DataFrame, guards: dict[str, DataFrame], dependents: dict[str, tuple[DataFrame, str]], key: str) -> tuple[DataFrame, DataFrame]:
    """Repositories with what forbids their purge (null if nothing), and table_name and n of rows that go with those that may.

    ``guards`` names frames of keys in use, in the order in which they are asked; ``dependents``
    come in the order in which rows must go.
    """
    asked = repositories.select(key)
    for name, used in guards.items():
        asked = asked.join(used.select(key).distinct().withColumn(name, F.lit(name)), key, "left")
    judged = asked.select(key, (F.coalesce(*guards) if guards else F.lit(None).cast("string")).alias("refused"))
    free = judged.where("refused is null").select(key)
    counts = []
    for i, (name, (rows, column)) in enumerate(dependents.items()):
        n = rows.join(free.withColumnRenamed(key, column), column, "left_semi").agg(F.count("*").alias("n"))
        counts.append(n.select(F.lit(i).alias("step"), F.lit(name).alias("table_name"), "n"))
    return judged, reduce(DataFrame.unionByName, counts)


def expired_conversations(conversations: DataFrame, responses: DataFrame, policy_days: Column, now: Column, batch: int) -> DataFrame:
    """The oldest ``batch`` conversations over their age of which no response is on its way; (conv_id, created_at, last_at)."""
    at = F.coalesce("last_at", "created_at")
    busy = responses.where(F.col("status").isin("created", "running")).select("conv_id")
    old = conversations.where(at < now - F.make_dt_interval(policy_days)).join(busy, "conv_id", "left_anti")
    return old.orderBy(at, "conv_id").limit(batch)


def resolve_bindings(asked: DataFrame, bindings: DataFrame) -> DataFrame:
    """asked, outcome (ok, required, ambiguous) and the one active binding that has the name as project or as workspace."""
    names = bindings.where("active").select("binding_id", F.explode(F.array_distinct(F.array_compact(F.array("project_id", "workspace")))).alias("name"))
    found = asked.select("asked", F.trim("asked").alias("name")).join(names, "name", "left").groupBy("asked").agg(F.count("binding_id").alias("n"), F.min("binding_id").alias("only"))
    return found.select("asked", F.when(F.col("n") == 0, "required").when(F.col("n") == 1, "ok").otherwise("ambiguous").alias("outcome"), F.when(F.col("n") == 1, F.col("only")).alias("binding_id"))


def choose_branch(asked: DataFrame, branches: DataFrame) -> DataFrame:
    """For (repository_id, commit, branch, name) the project that takes the commit.

    The named tracked branch or one whose head is the commit, whichever comes first, else
    the first tracked branch, else a name made of repository and commit.
    """
    place = F.min(F.struct("position", "project_id"))
    tracked = branches.where("tracked")
    # the first branch of each name, of each head and of all: an answer meets three rows and not all branches of its repository
    named = tracked.groupBy("repository_id", "branch").agg(place.alias("_named"))
    headed = tracked.groupBy("repository_id", F.col("head").alias("commit")).agg(place.alias("_headed"))
    first = tracked.groupBy("repository_id").agg(place.alias("_first"))
    joined = asked.select("repository_id", "commit", "branch", "name").distinct().join(named, ["repository_id", "branch"], "left").join(headed, ["repository_id", "commit"], "left").join(first, "repository_id", "left")
    best = joined.withColumn("project_id", F.coalesce(F.least("_named", "_headed"), "_first")["project_id"])
    return best.select("repository_id", "commit", "branch", F.coalesce("project_id", F.concat("name", F.lit("-"), F.left("commit", F.lit(8)))).alias("project_id"))


def parent_edges(commits: DataFrame, truncated: Column, shallow: Column) -> DataFrame:
    """child, parent, ordinal and why a parent is not among the commits (child, parents); null for known ones."""
    edges = commits.select("child", F.posexplode("parents").alias("ordinal", "parent"))
    known = commits.select(F.col("child").alias("parent"), F.lit(True).alias("known")).distinct()
    reason = F.when(F.col("known").isNull(), F.when(truncated, "truncated").when(shallow, "shallow").otherwise("unavailable"))
    return edges.join(known, "parent", "left").select("child", "parent", "ordinal", reason.alias("unresolved"))


def history_flags(edges: DataFrame, roots: DataFrame, commits: DataFrame) -> DataFrame:
    """truncated, shallow, n_unavailable_roots and history_complete of a scan, as one row."""
    missing = roots.join(commits.select(F.col("child").alias("root")), "root", "left_anti").agg(F.count("*").alias("n_unavailable_roots"))
    flags = edges.agg(F.coalesce(F.bool_or(F.col("unresolved") == "truncated"), F.lit(False)).alias("truncated"), F.coalesce(F.bool_or(F.col("unresolved") == "shallow"), F.lit(False)).alias("shallow"))
    whole = flags.select("truncated", "shallow", missing.select("n_unavailable_roots").scalar().alias("n_unavailable_roots"))
    return whole.withColumn("history_complete", ~F.col("truncated") & ~F.col("shallow") & (F.col("n_unavailable_roots") == 0))


def commit_details(commits: DataFrame, edges: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Commits with the ordered list of their parents and the latest snapshot of each."""
    parents = edges.groupBy("child").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "parent"))), lambda x: x["parent"]).alias("parents"))
    newest = snapshots.groupBy(F.col("revision").alias("child")).agg(F.max_by(F.struct("snapshot_id", "state"), F.struct("created_at", "snapshot_id")).alias("s"))
    joined = commits.join(parents, "child", "left").join(newest, "child", "left")
    return joined.select(*commits.columns, F.coalesce("parents", F.array().cast(parents.schema["parents"].dataType)).alias("parents"), F.col("s.snapshot_id").alias("snapshot_id"), F.col("s.state").alias("snapshot_state"))
