"""Index revisions: built beside the active one, checked, promoted by swapping a pointer, pruned."""

from __future__ import annotations

import itertools
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import history

# What an old fingerprint without a key means.
LEGACY = {"chunker": "line-window", "context_header": False, "chunk_size": 1200, "chunk_overlap": 150, "min_chunk_chars": 80, "embed_dim": 1024, "generation": "v1"}


def fingerprint(stored: dict | None, overrides: dict | None = None) -> dict:
    """Typed settings: legacy values, then what was stored, then overrides; unknown keys are ignored."""
    out = dict(LEGACY)
    for source in (stored or {}, overrides or {}):
        out |= {k: type(LEGACY[k])(v) for k, v in source.items() if k in LEGACY and v is not None}
    return out


def incremental_plan(old: DataFrame, new: DataFrame, same_settings: bool) -> DataFrame:
    """path and status against the last manifest (path, sha256); with other settings every new file has changed."""
    return history.diff(old, new, "path", "sha256") if same_settings else new.select("path", F.lit("changed").alias("status"))


def last_write(chunks: DataFrame, key: str = "chunk_id", order: str = "seq") -> DataFrame:
    return history.latest(chunks, (key,), (F.desc(order),))


class Catalog:
    """Revisions of projects in one folder that Spark can reach.

    Chunks of a revision are Parquet under ``project=/revision=``; states are appended rows
    of ``revisions`` and the last one counts. A revision is readable once its row says
    active, so a reader sees the old or the new one and a failed build changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._numbers = itertools.count(time.time_ns())

    def _record(self, project: str, revision: str, status: str, **meta) -> None:
        # Records of one writer are told apart by their number where the clock does not.
        row = [(project, revision, status, json.dumps(meta, sort_keys=True), next(self._numbers))]
        self.spark.createDataFrame(row, "project string, revision string, status string, meta string, number long").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.folder}/revisions")

    def revisions(self) -> DataFrame:
        """The last record of each revision; those that were dropped are gone."""
        rows = self.spark.read.schema("project string, revision string, status string, meta string, number long, at timestamp").parquet(f"{self.folder}/revisions")
        return history.latest(rows, ("project", "revision"), (F.desc("at"), F.desc("number"))).where("status != 'dropped'")

    def active(self, project: str) -> str | None:
        found = self.revisions().where((F.col("project") == project) & (F.col("status") == "active")).orderBy(F.desc("at"), F.desc("number")).limit(1).collect()
        return found[0].revision if found else None

    def path(self, project: str, revision: str) -> str:
        return f"{self.folder}/chunks/project={project}/revision={revision}"

    def build(self, project: str, chunks: DataFrame, settings: dict | None = None, expected: int | None = None) -> str:
        """Write, verify, promote; the old revision is retired only after the new one has been checked."""
        revision = uuid.uuid4().hex[:12]
        self._record(project, revision, "building", fingerprint=fingerprint(settings))
        try:
            last_write(chunks).write.parquet(self.path(project, revision))
            written = self.spark.read.parquet(self.path(project, revision))
            n, distinct = written.agg(F.count("*"), F.count_distinct("chunk_id")).first()
            if n != distinct or expected is not None and n != expected:
                raise ValueError(f"{n} chunks, {distinct} ids, {expected} expected")
        except Exception as error:
            self._record(project, revision, "failed", reason=str(error)[:500])
            raise
        old = self.active(project) if self._any() else None
        self._record(project, revision, "active", chunks=n)
        if old is not None:
            self._record(project, old, "retired")
        return revision

    def _any(self) -> bool:
        return bool(self.spark.read.parquet(f"{self.folder}/revisions").limit(1).count())

    def chunks(self, project: str) -> DataFrame | None:
        revision = self.active(project)
        return self.spark.read.parquet(self.path(project, revision)) if revision else None

    def rebuild(self, project: str, plan: DataFrame, fresh: DataFrame, settings: dict | None = None) -> str:
        """A revision of the unchanged files' chunks and freshly built ones."""
        touched = plan.where("status != 'unchanged'").select("path")
        old = self.chunks(project)
        kept = old.join(touched, "path", "left_anti") if old is not None else fresh.limit(0)
        return self.build(project, kept.unionByName(fresh), settings)

    def upsert(self, project: str, fresh: DataFrame, order: str = "seq") -> str:
        """A revision of the active chunks in which fresh ones of the same id take the place of old ones."""
        old = self.chunks(project)
        kept = old.join(fresh.select("chunk_id"), "chunk_id", "left_anti") if old is not None else fresh.limit(0)
        return self.build(project, kept.unionByName(last_write(fresh, order=order)))

    def _delete(self, path: str) -> None:
        """Take away one exact path of this folder; nothing happens where there is none."""
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)

    def abandon(self, project: str, revision: str, reason: str) -> bool:
        """Mark a revision that is not readable as failed and take its chunks away; active and retired ones stay."""
        found = self.revisions().where((F.col("project") == project) & (F.col("revision") == revision)).collect()
        if not found or found[0].status not in ("building", "failed"):
            return False
        self._record(project, revision, "failed", reason=reason)
        self._delete(self.path(project, revision))
        return True

    def repair(self, reason: str = "builder is gone") -> int:
        """Abandon all builds that never ended; returns how many."""
        left = self.revisions().where("status = 'building'").collect()
        return sum(self.abandon(r.project, r.revision, reason) for r in left)

    def drop(self, project: str, side_cars: tuple[str, ...] = ("lexical", "queries")) -> int:
        """Delete an index by its exact name: records first, so that no reader finds it, then chunks, then what lies beside them.

        Side-cars are folders ``name/project=...``. Doing it twice does no harm; returns how many revisions went.
        """
        gone = self.revisions().where(F.col("project") == project).collect()
        for r in gone:
            self._record(project, r.revision, "dropped")
        self._delete(f"{self.folder}/chunks/project={project}")
        for name in side_cars:
            self._delete(f"{self.folder}/{name}/project={project}")
        return len(gone)

    def prunable(self, keep: int = 2) -> DataFrame:
        retired = self.revisions().where("status = 'retired'")
        return history.beyond_last_k(retired, ("project",), (F.desc("at"), F.desc("revision")), keep).select("project", "revision")


def resolve(projects: DataFrame, asked: DataFrame) -> DataFrame:
    """The index each asked name stands for: its exact name, else the best of ``name--*`` and ``name@*`` by chunker rank, then age."""
    name = F.regexp_replace(F.lower(F.trim("name")), "_", "-")
    known = projects.withColumn("base", F.regexp_extract(F.lower("project"), r"^(.*?)(?:--|@|$)", 1))
    pairs = asked.withColumn("base", name).join(known, "base")
    best = F.row_number().over(Window.partitionBy("name").orderBy((F.lower("project") != F.col("base")), F.desc("chunker_rank"), F.desc("indexed_at"), "project"))
    return pairs.withColumn("n", best).where("n = 1").select("name", "project")
