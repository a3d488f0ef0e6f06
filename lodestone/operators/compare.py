"""Many pairs of commits compared in one plan: ancestry, merge bases, how far each side is ahead.

Commits have two labels. The generation is one more than the greatest of a commit's parents,
so no commit reaches one of its own or a greater generation. The interval of a commit covers
the commits of the tree of first children below which it stands, so what lies inside was
reached along that tree. Generations and intervals answer most questions of ancestry without
a step; a walk goes on only where they leave it open, and never below the generation asked for.

Merge bases and counts come from one walk down from both commits in order of generation, which
ends where everything that is left is common. It touches the part of the history in which the
two differ, and not all their ancestors.

Graphs whose counted edges fit ``local_bytes`` go to every task as arrays with their labels,
if pairs are few. But two commits may differ in most of the history, so many pairs, and pairs
in larger graphs, are not walked one by one: a task takes a block of pairs and passes the graph once, children before parents, with
an integer for each commit whose bits say which pairs' ends reach it. A pass costs what one
walk does. Integers that are held at once fit ``MASK_BYTES``, or the block is halved.
Graphs beyond ``array_bytes``, and large ones with a cycle, are compared by joins on ancestors that are
walked block by block.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .history import ancestors

LOCAL_BYTES = 8 << 20
#: Pairs that are walked one by one.
WALKED = 128
#: Edges of a graph that every task holds, 16 bytes each.
ARRAY_BYTES = 256 << 20
#: Integers that a pass over the graph holds at once.
MASK_BYTES = 384 << 20
#: Commits whose integers are counted at a time.
COUNTED = 1 << 13
COMPARED = "base long, target long, base_is_ancestor boolean, merge_bases array<long>, ahead long, behind long"


class Labelled:
    """A commit graph as arrays: sorted ids, parents by commit, generations and intervals."""

    def __init__(self, child: np.ndarray, parent: np.ndarray):
        self.nodes, place = np.unique(np.concatenate([child, parent]), return_inverse=True)
        n = len(self.nodes)
        c, p = np.split(place.astype(np.int64), 2)
        order = np.lexsort((p, c))
        self.parents, self.begins = p[order], np.searchsorted(c[order], np.arange(n + 1))
        down = np.lexsort((c, p))
        children, starts = c[down], np.searchsorted(p[down], np.arange(n + 1))
        # generations by layers: a commit is due when its last parent is done
        waits, self.generation = np.diff(self.begins), np.zeros(n, np.int64)
        layer, level, done = np.flatnonzero(waits == 0), 1, 0
        waits = waits.copy()
        while len(layer):
            self.generation[layer] = level
            done += len(layer)
            size = starts[layer + 1] - starts[layer]
            below = children[np.repeat(starts[layer] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            np.subtract.at(waits, below, 1)
            below = np.unique(below)
            layer, level = below[waits[below] == 0], level + 1
        if done < n:
            raise ValueError("the commit graph has a cycle")
        # each commit hangs below the parent of greatest generation; numbers in order of a walk of that tree
        tree = np.full(n, -1, np.int64)
        rank = np.lexsort((self.parents, self.generation[self.parents], c[order]))
        last = self.begins[1:] - 1
        held = np.diff(self.begins) > 0
        tree[held] = self.parents[rank][last[held]]
        size = np.ones(n, np.int64)
        late = np.argsort(-self.generation, kind="stable")
        for v in late:
            if tree[v] >= 0:
                size[tree[v]] += size[v]
        self.enter, free = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = 0
        for v in late[::-1]:
            if tree[v] < 0:
                self.enter[v], at = at, at + size[v]
            else:
                self.enter[v] = free[tree[v]]
                free[tree[v]] += size[v]
            free[v] = self.enter[v] + 1
        self.leave = self.enter + size

    def find(self, node: int) -> int:
        at = int(np.searchsorted(self.nodes, node))
        return at if at < len(self.nodes) and self.nodes[at] == node else -1

    def up(self, v: int) -> np.ndarray:
        return self.parents[self.begins[v] : self.begins[v + 1]]

    def reaches(self, new: int, old: int) -> bool:
        """Whether ``old`` is ``new`` or an ancestor of it."""
        if new == old or self.enter[old] <= self.enter[new] < self.leave[old]:
            return True
        least, seen, open_ = self.generation[old], {new}, [new]
        while open_:
            for p in self.up(open_.pop()):
                if self.enter[old] <= self.enter[p] < self.leave[old]:
                    return True
                if self.generation[p] > least and p not in seen:
                    seen.add(p)
                    open_.append(p)
        return False

    def compare(self, base: int, target: int) -> tuple[list[int], int, int]:
        """Merge bases, and how many commits only the target and only the base has."""
        BASE, TARGET, STALE = 1, 2, 4
        flags = {base: BASE}
        flags[target] = flags.get(target, 0) | TARGET
        queue = [(-self.generation[v], v) for v in flags]
        heapq.heapify(queue)
        fresh, bases, ahead, behind = len(queue), [], 0, 0
        while fresh:  # commits in the queue that are not below a merge base
            _, v = heapq.heappop(queue)
            own = flags[v]
            if not own & STALE:
                fresh -= 1
            if own & (BASE | TARGET) == BASE | TARGET:
                if not own & STALE:
                    bases.append(v)
                own |= STALE
            ahead, behind = ahead + (own == TARGET), behind + (own == BASE)
            for p in self.up(v).tolist():
                before = flags.get(p)
                flags[p] = (before or 0) | own
                if before is None:
                    heapq.heappush(queue, (-self.generation[p], p))
                    fresh += not own & STALE
                elif not before & STALE and own & STALE:
                    fresh -= 1
        return sorted(self.nodes[bases].tolist()), ahead, behind


def compared(pairs: DataFrame, edges: DataFrame, local_bytes: int = LOCAL_BYTES, array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """base, target, base_is_ancestor, merge_bases (ascending), ahead, behind of every distinct pair; a commit without edges stands alone.

    ``edges`` has child and parent. Pairs with a null have null results.
    """
    edges = edges.where("parent is not null and child is not null").select(F.col("child").cast("long").alias("child"), F.col("parent").cast("long").alias("parent")).distinct()
    pairs = pairs.select(F.col("base").cast("long").alias("base"), F.col("target").cast("long").alias("target")).distinct()
    size = edges.limit(max(local_bytes, array_bytes) // 16 + 1).count() * 16
    if size > max(local_bytes, array_bytes):
        return _joined(pairs, edges)
    if size > local_bytes or pairs.limit(WALKED + 1).count() > WALKED:
        try:
            return _in_blocks(pairs, edges)
        except ValueError:  # a cycle
            if size <= local_bytes:
                raise
            return _joined(pairs, edges)
    import pyarrow as pa

    rows = edges.toArrow()
    handle = edges.sparkSession.sparkContext.broadcast(Labelled(rows.column(0).to_numpy(), rows.column(1).to_numpy()))

    def judge(base, target):
        graph = handle.value
        if base is None or target is None:
            return None, None, None, None
        a, b = graph.find(base), graph.find(target)
        if base == target:
            return True, [base], 0, 0
        if a >= 0 and b >= 0:
            return (graph.reaches(b, a), *graph.compare(a, b))
        return False, [], 1 if b < 0 else _closure(graph, b), 1 if a < 0 else _closure(graph, a)

    def run(batches):
        for batch in batches:
            found = [judge(x, y) for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            lists = [list(c) for c in zip(*found, strict=True)] or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists[0], pa.bool_()), pa.array(lists[1], pa.list_(pa.int64())), pa.array(lists[2], pa.int64()), pa.array(lists[3], pa.int64())], names=["base", "target", "base_is_ancestor", "merge_bases", "ahead", "behind"])

    return pairs.mapInArrow(run, COMPARED)


def _closure(graph: Labelled, v: int) -> int:
    """How many commits a commit reaches, itself included."""
    seen, open_ = {v}, [v]
    while open_:
        for p in graph.up(open_.pop()).tolist():
            if p not in seen:
                seen.add(p)
                open_.append(p)
    return len(seen)


class Ordered:
    """A commit graph as arrays: sorted ids, each one's number (children before parents), the order of numbers, edges by number of the child."""

    def __init__(self, child: np.ndarray, parent: np.ndarray):
        self.nodes, ends = np.unique(np.concatenate([child, parent]), return_inverse=True)
        n = len(self.nodes)
        c, p = np.split(ends.astype(np.int32), 2)
        if (c > p).all():
            self.order = np.arange(n, dtype=np.int32)[::-1]
        elif (c < p).all():
            self.order = np.arange(n, dtype=np.int32)
        else:
            self.order = self._sorted(c, p, n)
        self.number = np.empty(n, np.int32)
        self.number[self.order] = np.arange(n, dtype=np.int32)
        by = np.argsort(self.number[c], kind="stable")
        self.child, self.parent = self.number[c[by]], self.number[p[by]]

    @staticmethod
    def _sorted(c: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
        up, begins = memoryview(p[np.argsort(c, kind="stable")]), memoryview(np.concatenate([[0], np.cumsum(np.bincount(c, minlength=n))]))
        waits = np.bincount(p, minlength=n)
        open_, order, at = np.flatnonzero(waits == 0).tolist(), np.empty(n, np.int32), 0
        waits, out = memoryview(waits), memoryview(order)
        while open_:
            v = open_.pop()
            out[at], at = v, at + 1
            for x in up[begins[v] : begins[v + 1]]:
                waits[x] -= 1
                if not waits[x]:
                    open_.append(x)
        if at < n:
            raise ValueError("the commit graph has a cycle")
        return order

    def find(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of commits, -1 where one is unknown."""
        if not len(self.nodes):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.nodes, ids), len(self.nodes) - 1)
        return np.where(self.nodes[at] == ids, self.number[at], -1)

    def compare(self, base: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """Ahead, behind and merge bases of pairs of numbers; an unknown end (-1) reaches nothing."""
        found = self._passed(base, target)
        if found is None:
            half = len(base) // 2
            (a, z, tops), (a2, z2, tops2) = self.compare(base[:half], target[:half]), self.compare(base[half:], target[half:])
            found = np.concatenate([a, a2]), np.concatenate([z, z2]), tops + tops2
        return found

    def _passed(self, base: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]]] | None:
        """The same by one pass, nothing if more than 64 pairs need more than ``MASK_BYTES``.

        Of a commit's integer, the bits of three fields of ``n`` stand for the pairs whose
        base reaches it, whose target does, and of which a child of it is common to both.
        """
        n = -(-len(base) // 64) * 64
        most = MASK_BYTES // _mask_bytes(n) if len(base) > 64 else len(self.nodes)
        first = int(min((x[x >= 0].min() for x in (base, target) if (x >= 0).any()), default=len(self.nodes)))
        masks, low = [0] * (len(self.nodes) - first), (1 << n) - 1
        for shift, side in ((0, base), (n, target)):
            for i, v in enumerate(side.tolist()):
                if v >= 0:
                    masks[v - first] |= 1 << (shift + i)
        counts, bases = np.zeros(2 * n, np.int64), [[] for _ in base]
        live = len(masks) - masks.count(0)
        for at in range(0, len(masks), COUNTED):
            begin, end = np.searchsorted(self.child, [first + at, first + at + COUNTED])
            last = -1
            for c, p in zip((self.child[begin:end] - first).tolist(), (self.parent[begin:end] - first).tolist(), strict=True):
                if c != last:
                    last, x = c, masks[c]
                    x |= (x & x >> n & low) << 2 * n
                if x:
                    held = masks[p]
                    masks[p] = held | x if held else x
                    live += not held
            if live > most:
                return None
            part = masks[at : at + COUNTED]
            masks[at : at + COUNTED] = [0] * len(part)
            reached = np.array([i for i, x in enumerate(part) if x], np.int64)
            live -= len(reached)
            b, t, below = np.hsplit(np.frombuffer(b"".join(x.to_bytes(3 * n // 8, "little") for x in part if x), "<u8").reshape(len(reached), 3 * n // 64), 3)
            counts += _column_counts(np.hstack([t & ~b, b & ~t]))
            tops = b & t & ~below
            row, word = np.nonzero(tops)
            which, bit = np.nonzero(np.unpackbits(tops[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            for i, node in zip((word[which] * 64 + bit).tolist(), self.nodes[self.order[first + at + reached[row[which]]]].tolist(), strict=True):
                bases[i].append(node)
        return counts[: len(base)], counts[n : n + len(base)], [sorted(x) for x in bases]


def _mask_bytes(pairs: int) -> int:
    """Bytes of an integer of three bits a pair, and of its place in a list."""
    return 36 + 2 * pairs // 5


def _column_counts(rows: np.ndarray) -> np.ndarray:
    """How many rows of words have each bit; three rows are added to a sum and a carry of twice the weight."""
    if len(rows) < 24:
        return np.unpackbits(np.ascontiguousarray(rows).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    third = len(rows) // 3
    a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
    odd = a ^ b
    return 2 * _column_counts((a & b) | (odd & c)) + _column_counts(np.concatenate([odd ^ c, rows[3 * third :]]))


def _in_blocks(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs compared in blocks by passes over the whole graph, which must have no cycle."""
    import pyarrow as pa

    rows, spark = edges.toArrow(), edges.sparkSession
    graph = Ordered(rows.column(0).to_numpy(), rows.column(1).to_numpy())
    handle, cores, n = spark.sparkContext.broadcast(graph), spark.sparkContext.defaultParallelism, pairs.count()
    # a third of the commits is rarely held at once
    width = next((w for w in (2048, 1024, 512, 256, 128) if len(graph.nodes) // 3 * _mask_bytes(w) <= MASK_BYTES), 64)
    width = max(64, min(width, -(-n // cores) // 64 * 64))

    def locate(batches):
        for batch in batches:
            ends = [handle.value.find(c.fill_null(0).to_numpy()) for c in batch.columns]
            known = [np.where(c.is_valid().to_numpy(zero_copy_only=False), x, -1).astype(np.int32) for c, x in zip(batch.columns, ends, strict=True)]
            first = np.minimum(*[np.where(x < 0, len(handle.value.nodes), x) for x in known]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (*known, first))], names=["base", "target", "b", "t", "first"])

    def run(batches):
        for batch in batches:
            parts = -(-batch.num_rows // width)
            cuts = [i * batch.num_rows // parts for i in range(parts + 1)] if parts else []
            for rows in (batch.slice(x, y - x) for x, y in zip(cuts, cuts[1:], strict=False)):
                b, t = rows.column(2).to_numpy(), rows.column(3).to_numpy()
                ahead, behind, bases = handle.value.compare(b, t)
                out = []
                for x, y, known, a, z, tops in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), zip(b.tolist(), t.tolist(), strict=True), ahead.tolist(), behind.tolist(), bases, strict=True):
                    if x is None or y is None:
                        out.append((None, None, None, None))
                    elif x == y:
                        out.append((True, [x], 0, 0))
                    else:  # a commit without edges stands alone; a base that has nothing of its own is an ancestor
                        a, z = a + (known[1] < 0), z + (known[0] < 0)
                        out.append((z == 0, tops, a, z))
                lists = [list(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(lists[0], pa.bool_()), pa.array(lists[1], pa.list_(pa.int64())), pa.array(lists[2], pa.int64()), pa.array(lists[3], pa.int64())], names=["base", "target", "base_is_ancestor", "merge_bases", "ahead", "behind"])

    # ends of a block lie near each other, so a pass begins late in the graph for most of them
    located = pairs.mapInArrow(locate, "base long, target long, b int, t int, first int")
    return located.repartitionByRange(max(1, -(-4 * n // (3 * width))), "first", "base", "target").mapInArrow(run, COMPARED)


def _joined(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    known = pairs.where("base is not null and target is not null")
    starts = known.select(F.explode(F.array("base", "target")).alias("node")).distinct()
    reached = cut(ancestors(edges, starts, local_bytes=0))
    side = lambda end: known.join(reached.withColumnRenamed("start", end), end).select("base", "target", "node", F.lit(end).alias("end"))
    met = side("base").unionByName(side("target")).groupBy("base", "target", "node").agg(F.max((F.col("end") == "base").cast("int")).alias("b"), F.max((F.col("end") == "target").cast("int")).alias("t"))
    met = cut(met)
    common = met.where("b = 1 and t = 1").select("base", "target", "node")
    # parents of common commits are common, so bases are those that no common commit has as a parent
    below = common.join(edges, common["node"] == edges["child"]).select("base", "target", F.col("parent").alias("node"))
    bases = common.join(below, ["base", "target", "node"], "left_anti").groupBy("base", "target").agg(F.sort_array(F.collect_list("node")).alias("merge_bases"))
    counts = met.groupBy("base", "target").agg(F.count_if(F.expr("t = 1 and b = 0")).alias("ahead"), F.count_if(F.expr("b = 1 and t = 0")).alias("behind"), F.bool_or((F.col("node") == F.col("base")) & (F.col("t") == 1)).alias("base_is_ancestor"))
    out = pairs.join(counts, ["base", "target"], "left").join(bases, ["base", "target"], "left")
    both = F.col("base").isNotNull() & F.col("target").isNotNull()
    return out.select("base", "target", "base_is_ancestor", F.when(both, F.coalesce("merge_bases", F.array().cast("array<bigint>"))).alias("merge_bases"), "ahead", "behind")
