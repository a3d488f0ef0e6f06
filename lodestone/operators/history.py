"""Repository history and observability as relational and graph operators."""

from __future__ import annotations

import uuid
from bisect import bisect_right
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut, shared_dir, small

#: Edges of a graph that one task walks at a time.
BLOCK_EDGES = 1 << 19


def latest(df: DataFrame, by: tuple[str, ...], order: tuple[Column, ...]) -> DataFrame:
    """The first row of each group in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def beyond_last_k(df: DataFrame, by: tuple[str, ...], order: tuple[Column, ...], k: int) -> DataFrame:
    """Rows that a keep-the-last-k policy would prune."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("position") > k)


def keyset_page(df: DataFrame, keys: tuple[str, str], after: tuple | None, limit: int, has_more: bool = True) -> DataFrame:
    """The page after a cursor (both keys descending), one row more as a probe if asked for."""
    a, b = keys
    if after is not None:
        df = df.where((F.col(a) < F.lit(after[0])) | ((F.col(a) == F.lit(after[0])) & (F.col(b) < F.lit(after[1]))))
    return df.orderBy(F.desc(a), F.desc(b)).limit(limit + has_more)


def cursor(*values: Column) -> Column:
    return F.base64(F.concat_ws("|", *[v.cast("string") for v in values]).cast("binary"))


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key and status (added, changed, deleted, unchanged) of two keyed tables."""
    o, n = old.select(key, F.col(value).alias("_old"), F.lit(1).alias("_o")), new.select(key, F.col(value).alias("_new"), F.lit(1).alias("_n"))
    status = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return o.join(n, key, "full_outer").select(key, status.alias("status"))


def renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, old_path, status of two trees (path, sha): a deleted and an added path of one sha are a rename, paired in path order."""
    both = old.select("path", F.col("sha").alias("o")).join(new.select("path", F.col("sha").alias("n")), "path", "full_outer")
    nth = lambda sha: F.row_number().over(Window.partitionBy(sha).orderBy("path"))
    gone = both.where("n is null").select("path", F.col("o").alias("sha"), nth("o").alias("k"))
    came = both.where("o is null").select("path", F.col("n").alias("sha"), nth("n").alias("k"))
    moved = came.alias("c").join(gone.alias("g"), ["sha", "k"], "full_outer").select(
        F.coalesce("c.path", "g.path").alias("path"), F.when(F.col("c.path").isNotNull(), F.col("g.path")).alias("old_path"),
        F.when(F.col("c.path").isNull(), "deleted").when(F.col("g.path").isNull(), "added").otherwise("renamed").alias("status"),
    )
    edited = both.where("o is not null and n is not null and o != n").select("path", F.lit(None).cast("string").alias("old_path"), F.lit("modified").alias("status"))
    return moved.unionByName(edited)


def head_changes(observed: DataFrame, is_ancestor: Column) -> DataFrame:
    """change_type of each observed head of a branch against the one before it.

    ``observed`` has branch, at, seq and head (null where the branch is gone); ``is_ancestor``
    is over head and previous_head.
    """
    w = Window.partitionBy("branch").orderBy("at", "seq")
    rows = observed.withColumn("previous_head", F.lag("head").over(w)).withColumn("had_history", F.count("head").over(w.rowsBetween(Window.unboundedPreceding, -1)) > 0)
    kind = (
        F.when(F.col("head").isNull(), F.when(F.col("previous_head").isNull(), "already_deleted").otherwise("deleted"))
        .when(F.col("previous_head").isNull(), F.when(F.col("had_history"), "recreated").otherwise("created"))
        .when(F.col("head") == F.col("previous_head"), "unchanged").when(is_ancestor, "fast_forward").otherwise("rewind")
    )
    return rows.withColumn("change_type", kind)


def children(parents: DataFrame, rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Parents with the ordered list of their children's values; an empty list where there are none."""
    lists = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias("children"))
    return parents.join(lists, key, "left").withColumn("children", F.coalesce("children", F.array().cast(lists.schema["children"].dataType)))


def commit_status(state: Column, done: Column, locator: Column) -> Column:
    """git_only, vss_indexed, materialized or unavailable."""
    return (
        F.when(state.isNull(), "git_only").when((state == "completed") & F.coalesce(done, F.lit(False)), "vss_indexed")
        .when(state.isin("materialized", "accepted", "indexing") | locator.isNotNull(), "materialized").when(state == "failed", "unavailable").otherwise("git_only")
    )


def ancestors(edges: DataFrame, starts: DataFrame, local_bytes: int = 8 << 20, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """start and every node that is reached over (child, parent) edges, the start included.

    A graph whose counted edges fit ``local_bytes`` goes to every task as adjacency arrays
    and each start is walked there. A larger one is walked block by block, see ``_by_blocks``.
    """
    edges = edges.where("parent is not null")
    if edges.limit(local_bytes // 16 + 1).count() * 16 <= local_bytes:
        return _walked(edges, starts)
    return _by_blocks(edges, starts, block_edges)


def _by_blocks(edges: DataFrame, starts: DataFrame, block_edges: int) -> DataFrame:
    """Ancestors in a graph that no task holds.

    Children are dealt to ranges of ids of about ``block_edges`` edges. A round walks each
    block that was entered as deep as its edges lead, with what earlier rounds saw there, and
    hands on the parents that lie in other blocks. So each node is expanded once for each
    start, and rounds are as many as the blocks that a path enters, never more than levels.
    """
    spark = edges.sparkSession
    edges = cut(edges.select(F.col("child").cast("long").alias("a"), F.col("parent").cast("long").alias("b")).where("a is not null"))
    starts = cut(starts.where("node is not null").select(F.col("node").cast("long").alias("node")).distinct())
    blocks = -(-edges.count() // block_edges) or 1
    ends = sorted(set(edges.agg(F.percentile_approx("a", [i / blocks for i in range(1, blocks)], 100 * blocks)).first()[0] or [])) if blocks > 1 else []
    lanes = max(1, min(starts.count(), spark.sparkContext.defaultParallelism))
    block = lambda node: F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= node)) if ends else F.lit(0)
    lane = F.pmod(F.xxhash64("a"), F.lit(lanes)).cast("int")
    root = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
    edges.withColumn("block", block(F.col("a")).cast("int")).write.partitionBy("block").parquet(f"{root}/edges")
    at = lambda name: spark.read.schema("a long, b long, block int").parquet(f"{root}/{name}")
    entered, found, rounds = starts.select(F.col("node").alias("a"), F.col("node").alias("b"), block(F.col("node")).cast("int").alias("block")), [], []
    walk = _block_walk(ends)
    while True:
        active = [r[0] for r in entered.select("block").distinct().collect()]  # numbers of blocks
        if not active:
            break
        rows = at("edges").where(F.col("block").isin(active)).select("block", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(None).cast("long").alias("start"), F.lit(0).alias("kind"), "a", "b")
        seen = [at(f"seen{i}").where(F.col("block").isin(active)) for i, held in enumerate(rounds) if held & set(active)]
        for kind, part in [*((1, s) for s in seen), (2, entered)]:
            rows = rows.unionByName(part.select("block", lane.alias("lane"), F.col("a").alias("start"), F.lit(kind).alias("kind"), "a", "b"))
        dealt = rows.repartition(min(len(active) * lanes, 4 * spark.sparkContext.defaultParallelism), "block", "lane").sortWithinPartitions("block", "lane", "start", "kind")
        step = cut(dealt.mapInArrow(walk, "start long, node long, inside boolean"))
        new = step.where("inside").select(F.col("start").alias("a"), F.col("node").alias("b"), block(F.col("node")).cast("int").alias("block"))
        new.write.partitionBy("block").parquet(f"{root}/seen{len(rounds)}")
        entered = step.where("not inside").select(F.col("start").alias("a"), F.col("node").alias("b"), block(F.col("node")).cast("int").alias("block"))
        found.append(step.where("inside").select("start", "node"))
        rounds.append(set(active))
    return reduce(DataFrame.unionByName, found) if found else starts.select(F.col("node").alias("start"), "node")


def _block_walk(ends: list[int]):
    import pyarrow as pa

    def pack(start, inside, across):
        nodes = inside + across
        return pa.RecordBatch.from_arrays([pa.array([start] * len(nodes), pa.int64()), pa.array(nodes, pa.int64()), pa.array([True] * len(inside) + [False] * len(across))], names=["start", "node", "inside"])

    def explore(block, parents, seen, entries):
        """Nodes that are new in the block, and parents of them that lie elsewhere."""
        inside, across = [], set()
        for e in entries:
            if e in seen:
                continue
            seen.add(e)
            open_ = [e]
            while open_:
                node = open_.pop()
                inside.append(node)
                for p in parents.get(node, ()):
                    if bisect_right(ends, p) != block:
                        across.add(p)
                    elif p not in seen:
                        seen.add(p)
                        open_.append(p)
        return inside, list(across)

    def walk(batches):
        place, start, parents, seen, entries = None, None, {}, set(), []
        for batch in batches:
            for b, l, s, kind, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (b, l) != place or s != start:
                    if entries:
                        yield pack(start, *explore(place[0], parents, seen, entries))
                    if (b, l) != place:
                        parents = {}
                    place, start, seen, entries = (b, l), s, set(), []
                if kind == 0:
                    parents.setdefault(x, []).append(y)
                elif kind == 1:
                    seen.add(y)
                else:
                    entries.append(y)
        if entries:
            yield pack(start, *explore(place[0], parents, seen, entries))

    return walk


def _walked(edges: DataFrame, starts: DataFrame) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    rows = edges.select(F.col("child").cast("long"), F.col("parent").cast("long")).toArrow()
    nodes, place = np.unique(np.concatenate([rows.column(0).to_numpy(), rows.column(1).to_numpy()]), return_inverse=True)
    child, parent = np.split(place.astype(np.int32), 2)
    order = np.argsort(child, kind="stable")
    handle = edges.sparkSession.sparkContext.broadcast((nodes, np.searchsorted(child[order], np.arange(len(nodes) + 1)), parent[order]))

    def walk(batches):
        nodes, begins, parent = handle.value
        for batch in batches:
            for start in batch.column(0).to_pylist():
                at = int(np.searchsorted(nodes, start))
                if at == len(nodes) or nodes[at] != start:
                    yield pa.RecordBatch.from_arrays([pa.array([start]), pa.array([start])], names=["start", "node"])
                    continue
                seen = np.zeros(len(nodes), bool)
                seen[at] = True
                frontier = np.array([at])
                while len(frontier):
                    size = begins[frontier + 1] - begins[frontier]
                    to = parent[np.repeat(begins[frontier] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                    frontier = np.unique(to[~seen[to]])
                    seen[frontier] = True
                found = nodes[seen]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), start, np.int64)), pa.array(found)], names=["start", "node"])

    return starts.where("node is not null").select(F.col("node").cast("long").alias("node")).distinct().mapInArrow(walk, "start long, node long")


def unresolved(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Parents (node) that edges name and no known node (node) is."""
    return edges.select(F.col("parent").alias("node")).distinct().join(known, "node", "left_anti")


def is_ancestor(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (old, new) with whether old is new or one of its ancestors; null where either is missing."""
    reached = ancestors(edges, pairs.select(F.col("new").alias("node")).distinct()).select(F.col("start").alias("new"), F.col("node").alias("old"), F.lit(True).alias("hit"))
    joined = pairs.join(reached, ["new", "old"], "left")
    return joined.select("old", "new", F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), F.coalesce("hit", F.lit(False))).alias("is_ancestor"))


def sequenced(events: DataFrame, by: str, order: tuple[str, ...], at: str) -> DataFrame:
    """Events with their number in a trace from 1, and milliseconds since its first."""
    w = Window.partitionBy(by).orderBy(*order)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    return events.withColumn("sequence", F.row_number().over(w)).withColumn("elapsed_ms", (micros - F.min(micros).over(Window.partitionBy(by))) / 1000)


def ahead_behind(reached: DataFrame, base, target) -> DataFrame:
    """How many ancestors each of two starts has alone."""
    sides = reached.where(F.col("start").isin(base, target)).groupBy("node").agg(F.max((F.col("start") == F.lit(target)).cast("int")).alias("t"), F.max((F.col("start") == F.lit(base)).cast("int")).alias("b"))
    return sides.agg(F.count_if((F.col("t") == 1) & (F.col("b") == 0)).alias("ahead"), F.count_if((F.col("b") == 1) & (F.col("t") == 0)).alias("behind"))


def merge_bases(edges: DataFrame, reached: DataFrame, a, b) -> DataFrame:
    """Common ancestors of two starts that no other common ancestor descends from.

    All ancestors of a common ancestor are common, so these are the common ones that are
    not the parent of a common one.
    """
    common = reached.where(F.col("start").isin(a, b)).groupBy("node").agg(F.count_distinct("start").alias("n")).where(F.col("n") == (1 if a == b else 2)).select("node")
    parents = edges.join(common.withColumnRenamed("node", "child"), "child", "left_semi").select(F.col("parent").alias("node"))
    return common.join(parents, "node", "left_anti")


def relationship(base: Column, target: Column, merge_base: Column) -> Column:
    return F.when(base == target, "same").when(merge_base.isNull(), "unknown").when(merge_base == base, "fast_forward").otherwise("diverged")


def illegal_transitions(states: DataFrame, allowed: DataFrame, by: str, order: str) -> DataFrame:
    """State changes that the table of allowed (from_state, to_state) pairs does not hold."""
    w = Window.partitionBy(by).orderBy(order)
    moves = states.withColumn("from_state", F.lag("state").over(w)).withColumnRenamed("state", "to_state").where("from_state is not null and from_state != to_state")
    return moves.join(F.broadcast(allowed), ["from_state", "to_state"], "left_anti")  # a state machine's table


def lifecycle(events: DataFrame, by: str, order: str) -> DataFrame:
    """One row of each trace: first and last position, first delta, text length and final status.

    Completed is never overwritten by cancelled, and nulls never overwrite values.
    """
    ordered = F.struct(order, "kind")
    return events.groupBy(by).agg(
        F.min(order).alias("first_seq"), F.max(order).alias("last_seq"), F.count("*").alias("n_events"),
        F.min(F.when(F.col("kind") == "delta", F.col(order))).alias("first_delta"),
        F.sum(F.when(F.col("kind") == "delta", F.col("size")).otherwise(0)).alias("delta_size"),
        F.max_by("model", F.when(F.col("model").isNotNull(), ordered)).alias("model"),
        F.when(F.count_if(F.col("kind") == "completed") > 0, "completed").otherwise(F.coalesce(F.max_by("kind", F.when(F.col("kind").isin("failed", "cancelled"), ordered)), F.lit("running"))).alias("status"),
    )


def purge_preview(dependents: dict[str, tuple[DataFrame, str]], keys: DataFrame, key: str) -> DataFrame:
    """table_name and n, the rows that removing the keys would take from each dependent table."""
    counts = [df.join(keys.select(F.col(key).alias(column)).distinct(), column, "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, (df, column) in dependents.items()]
    return reduce(DataFrame.unionByName, counts)


def overlay(base: DataFrame, files: DataFrame, deleted: DataFrame, moved: DataFrame) -> DataFrame:
    """A tree (path, sha) after deletions, renames (old_path) and upserts."""
    kept = base.join(deleted.select("path"), "path", "left_anti").join(moved.select(F.col("old_path").alias("path")), "path", "left_anti").join(files.select("path"), "path", "left_anti")
    return kept.unionByName(files.select("path", "sha"))
