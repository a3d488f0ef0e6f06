"""Vector search through an inverted file: vectors dealt by nearest centroid, probes by cell, exact scores.

An index is two Parquet tables in a folder of the caller. ``vectors`` has shelf, cell,
vec_id and vector, in folders by shelf (a run of cells) and sorted by cell, so a search
opens only the shelves and row groups that it probes. ``cells`` has each cell's centroid,
its rows and the least cosine of a member to the centroid.

That cosine bounds every score of the cell: by the triangle inequality of angles no member
is nearer to a question than the question's angle to the centroid less the cell's own. With
``exact`` a second round probes just the cells whose bound reaches the k-th score of the
first, so the hits equal a full scan's; without it they are those of the nearest cells.

Cells are fitted on at most ``SAMPLE`` vectors (least hashes of the id); all are indexed.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import BROADCAST_BYTES, cut, small
from .retrieval import _best, _merge, blocks_of, top_k

SAMPLE, ROUNDS, SHELVES = 1 << 16, 8, 256
#: Bounds and scores are compared with this much room for rounding to six decimals.
ROOM = 2e-6


def _matrix(column) -> np.ndarray:
    """Unit rows of an Arrow column of vectors; a zero vector stays zero."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def cells_for(rows: int, dimensions: int) -> int:
    """About the square root of the rows, as many as fit a broadcast."""
    return max(1, min(round(math.sqrt(rows)), BROADCAST_BYTES // (8 * max(dimensions, 1))))


def fit_cells(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids by spherical k-means over the sample, whose sums the tasks make; cells of like direction get near numbers."""
    import pyarrow as pa

    picked = cut(vectors.where("vector is not null and vec_id is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec_id", "vector"))
    first = picked.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(cells).select("vector").toArrow().combine_chunks()
    centroids = _matrix(first.column("vector").combine_chunks()) if first.num_rows else np.zeros((0, 0))
    spark = vectors.sparkSession
    for _ in range(rounds if len(centroids) > 1 else 0):
        handle = spark.sparkContext.broadcast(centroids)

        def sums(batches, handle=handle):
            total = np.zeros_like(handle.value)
            for batch in batches:
                v = _matrix(batch.column(0))
                np.add.at(total, (v @ handle.value.T).argmax(1), v)
            used = np.flatnonzero(np.abs(total).sum(1))
            yield pa.RecordBatch.from_pydict({"cell": pa.array(used, pa.int64()), "total": pa.array(list(total[used]), pa.list_(pa.float64()))})

        added = np.zeros_like(centroids)
        # a task sends one row a cell, and the sample is bounded
        for r in picked.select("vector").mapInArrow(sums, "cell long, total array<double>").collect():
            added[r.cell] += r.total
        held = np.abs(added).sum(1) > 0
        centroids = np.where(held[:, None], added / np.maximum(np.linalg.norm(added, axis=1, keepdims=True), 1e-300), centroids)
    if len(centroids) > 2:  # along the direction in which centroids differ most
        centred = centroids - centroids.mean(0)
        centroids = centroids[np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")]
    return centroids


def _dealt(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """shelf, cell, vec_id, vector and near (the cosine to the centroid)."""
    import pyarrow as pa

    handle = vectors.sparkSession.sparkContext.broadcast(centroids)
    width = -(-max(len(centroids), 1) // SHELVES)

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                near = _matrix(batch.column(1)) @ handle.value.T
                cell = near.argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array((cell // width).astype(np.int32)), pa.array(cell.astype(np.int32)), batch.column(0), batch.column(1), pa.array(near[np.arange(len(cell)), cell])], names=["shelf", "cell", "vec_id", "vector", "near"])

    kind = vectors.schema["vector"].dataType.simpleString()
    rows = vectors.where("vector is not null and vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "vector")
    return rows.mapInArrow(deal, f"shelf int, cell int, vec_id long, vector {kind}, near double")


def _stored(rows: DataFrame, path: str, mode: str) -> None:
    # a range of (cell, id) splits a hot cell over several files
    rows.drop("near").repartitionByRange("shelf", "cell", "vec_id").sortWithinPartitions("shelf", "cell", "vec_id").write.mode(mode).partitionBy("shelf").option("compression", "zstd").parquet(f"{path}/vectors")


def _cells(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    known = rows.sparkSession.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "cell int, centroid array<double>")
    return known.join(rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("least")), "cell", "left").select("cell", "centroid", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "least")


def build(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> None:
    """Index all vectors (vec_id, vector) under ``path``; rows without an id or a vector stay out."""
    if cells is None:
        size = vectors.where("vector is not null").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
        cells = cells_for(size.n, size.d or 1)
    centroids = fit_cells(vectors, cells, sample)
    rows = cut(_dealt(vectors, centroids))
    _stored(rows, path, "error")
    _cells(rows, centroids).coalesce(1).write.parquet(f"{path}/cells-0")


def append(vectors: DataFrame, path: str) -> None:
    """Add vectors to an index; centroids stay, counts and bounds of cells are written anew."""
    spark = vectors.sparkSession
    old = cells_table(spark, path)
    rows = cut(_dealt(vectors, _centroids(old)))
    _stored(rows, path, "append")
    more = rows.groupBy("cell").agg(F.count("*").alias("more"), F.min("near").alias("nearer"))
    new = old.join(more, "cell", "left").select("cell", "centroid", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.least("least", "nearer").alias("least"))
    new.coalesce(1).write.parquet(f"{path}/cells-{_version(spark, path) + 1}")


def _version(spark: SparkSession, path: str) -> int:
    """The last complete table of cells; one that was not finished has no ``_SUCCESS``."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/cells-*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(pattern)
    return max(int(f.getPath().getParent().getName().rsplit("-", 1)[1]) for f in found)


def cells_table(spark: SparkSession, path: str) -> DataFrame:
    """cell, centroid, n, least of an index."""
    return spark.read.parquet(f"{path}/cells-{_version(spark, path)}")


def _centroids(cells: DataFrame) -> np.ndarray:
    rows = cells.select("cell", "centroid").toArrow().combine_chunks()  # no more than a broadcast holds
    order = np.argsort(rows.column("cell").to_numpy())
    return _matrix(rows.column("centroid").combine_chunks())[order] if len(order) else np.zeros((0, 0))


def probed(spark: SparkSession, path: str, cells: np.ndarray, n_cells: int) -> DataFrame:
    """cell, vec_id and vector of some cells; other shelves are not opened, other row groups not read."""
    if not len(cells):
        return spark.createDataFrame([], "cell int, vec_id long, vector array<double>")
    width = -(-max(n_cells, 1) // SHELVES)
    rows = spark.read.parquet(f"{path}/vectors")
    rows = rows.where(F.col("shelf").isin(np.unique(cells // width).tolist()))
    if len(cells) < n_cells:
        runs = np.split(np.sort(cells), np.flatnonzero(np.diff(np.sort(cells)) > 1) + 1)
        if len(runs) <= 64:  # stretches of neighbouring cells reach the row groups as ranges
            near = F.lit(False)
            for run in runs:
                near = near | F.col("cell").between(int(run[0]), int(run[-1]))
            rows = rows.where(near)
    return rows.select("cell", "vec_id", "vector")


def _scored(rows: DataFrame, q_ids: np.ndarray, q: np.ndarray, pairs: dict[int, np.ndarray], k: int) -> DataFrame:
    """Each task's best ``k`` rows of each question among the cells that it probes."""
    import pyarrow as pa

    handle = rows.sparkSession.sparkContext.broadcast((q_ids, q, pairs))

    def search(batches):
        q_ids, q, pairs = handle.value
        best: list = []
        for batch in batches:
            cell = batch.column(0).to_numpy()
            ids, v = batch.column(1).to_numpy(), _matrix(batch.column(2))
            # rows come sorted by cell: a run of rows meets the questions that probe its cell
            edges = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                asking = pairs.get(int(cell[a])) if b > a else None
                if asking is not None:
                    best.append(_best(q_ids[asking], ids[a:b], np.round(q[asking] @ v[a:b].T, 6), k))
            if len(best) > 64:
                best = [_merge(best, k)]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merge(best, k)], names=["qid", "vec_id", "score"])

    return rows.mapInArrow(search, "qid long, vec_id long, score double")


def search(queries: DataFrame, path: str, k: int = 10, probes: int = 8, exact: bool = False, block: int = 4096) -> DataFrame:
    """qid, vec_id, score (cosine, six decimals), rank. ``queries`` has qid and vector; blocks of them are stated query sets."""
    spark = queries.sparkSession
    cells = cells_table(spark, path)
    centroids = _centroids(cells)
    facts = cells.select("cell", "n", "least").orderBy("cell").toArrow()
    n, least = facts.column("n").to_numpy(), facts.column("least").to_numpy(zero_copy_only=False).astype(float)
    out = None
    for part in blocks_of(queries, block):
        rows = part.select(F.col("qid").cast("long").alias("qid"), "vector").where("vector is not null and qid is not null").toArrow().combine_chunks()
        q_ids, q = rows.column("qid").to_numpy(), _matrix(rows.column("vector").combine_chunks())
        near = q @ centroids.T if len(q_ids) and len(centroids) else np.zeros((len(q_ids), len(centroids)))
        near[:, n == 0] = -2
        first = np.argsort(-near, axis=1, kind="stable")[:, : max(probes, 1)]
        asked = np.zeros(near.shape, bool)
        np.put_along_axis(asked, first, True, axis=1)
        asked &= n > 0
        found = _round(spark, path, q_ids, q, asked, k)
        if exact:
            found = cut(found)
            floor = dict(top_k(found, k, ("qid",), [F.desc("score"), F.asc("vec_id")]).where(F.col("rank") == k).select("qid", "score").collect())  # one row for each question of the block
            kth = np.array([floor.get(int(i), -2.0) for i in q_ids])
            angle = np.arccos(np.clip(near, -1, 1)) - np.arccos(np.clip(np.nan_to_num(least, nan=-1), -1, 1))
            bound = np.cos(np.clip(angle, 0, np.pi))
            bound[~np.any(q, axis=1)] = 2  # zero vectors have no angle
            rest = (bound + ROOM >= kth[:, None]) & ~asked & (n > 0)
            if rest.any():
                found = found.unionByName(_round(spark, path, q_ids, q, rest, k))
        out = found if out is None else out.unionByName(found)
    return top_k(out, k, ("qid",), [F.desc("score"), F.asc("vec_id")])


def _round(spark: SparkSession, path: str, q_ids: np.ndarray, q: np.ndarray, asked: np.ndarray, k: int) -> DataFrame:
    cell = np.flatnonzero(asked.any(0))
    return _scored(probed(spark, path, cell, asked.shape[1]), q_ids, q, {int(c): np.flatnonzero(asked[:, c]) for c in cell}, k)


def probes_for(spark: SparkSession, path: str, target: float = 0.95, k: int = 10, sample: int = 256) -> int:
    """The least number of probes that finds a share ``target`` of the true hits of sampled vectors of the index (least hashes of the id)."""
    if not cells_table(spark, path).agg(F.sum("n")).first()[0]:
        return 1
    stored = spark.read.parquet(f"{path}/vectors")
    picked = cut(stored.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(sample).select(F.col("vec_id").alias("qid"), "vector"))
    hits = cut(search(picked, path, k, probes=4, exact=True).select("qid", "vec_id"))
    homes = hits.join(stored.select("vec_id", "cell"), "vec_id").groupBy("qid", "cell").agg(F.count("*").alias("n")).toArrow()  # k rows a sampled vector
    rows = picked.toArrow().combine_chunks()
    centroids = _centroids(cells_table(spark, path))
    order = np.argsort(-(_matrix(rows.column("vector").combine_chunks()) @ centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    row = {q: i for i, q in enumerate(rows.column("qid").to_pylist())}
    found = np.zeros(len(centroids))
    for q, cell, n in zip(*(homes.column(c).to_pylist() for c in ("qid", "cell", "n")), strict=True):
        found[place[row[q], cell]] += n
    return int(np.searchsorted(np.cumsum(found) / found.sum(), target - 1e-9)) + 1


def recall(found: DataFrame, truth: DataFrame, k: int = 10) -> float:
    """Share of the true first ``k`` (qid, vec_id) that were found."""
    truth = truth.where(F.col("rank") <= k).select("qid", "vec_id")
    both = truth.join(small(found.where(F.col("rank") <= k).select("qid", "vec_id", F.lit(1).alias("hit")), 24), ["qid", "vec_id"], "left")
    return both.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]
