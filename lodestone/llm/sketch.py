"""Merged count-min sketches of 64-bit hashes, reduced to the question "could it reach the threshold?".

``possible(df, mapper, threshold, cells)`` makes one pass: tasks count hashes in sorted runs
of cells and send them by blocks of cells, executors add the blocks of all tasks, saturated
at the threshold, and what stays is one bit a cell. A cell never holds less than the count
of any hash that falls into it, so a hash whose cells are not all set is below the threshold
for certain; a hash whose cells are set may be anything and is left to an exact count.

Memory: a task counts in an array of up to ``DENSE`` cells; of larger sketches it holds at
most ``HELD`` distinct cells and sends them when there are more. An executor adds blocks of ``BLOCK`` bytes; the bits are ``cells / 8`` bytes, at most
``MAX_CELLS / 8`` in each worker and on the driver. ``sized`` picks the cells for a number
of counted things, so that a cell's mean load is a quarter of the threshold; beyond
``MAX_CELLS`` the sketch lets more through to the exact count, and results stay the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from .bytes_ import mix

DEPTH = 2
BLOCK = 1 << 20
HELD, DENSE = 3 << 20, 1 << 26
MIN_CELLS, MAX_CELLS = 1 << 21, 1 << 30

Counted = Iterator[tuple[np.ndarray, np.ndarray]]


def sized(counted: int, threshold: int) -> int:
    """Cells (a power of two) for so many counted things."""
    cells = MIN_CELLS
    while cells < MAX_CELLS and cells * threshold < 4 * counted * DEPTH:
        cells *= 2
    return cells


def cells_of(hashes: np.ndarray, cells: int) -> np.ndarray:
    """A row of cells for each level of the sketch; levels share no cell."""
    width = np.uint64(cells // DEPTH - 1)
    out, h = np.empty((DEPTH, len(hashes)), np.uint32), hashes
    for level in range(DEPTH):
        h = mix(h + np.uint64(0x9E3779B97F4A7C15))
        out[level] = (h & width).astype(np.uint32) + np.uint32(level * (cells // DEPTH))
    return out


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the counts of each."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


class Possible:
    """The bits of a merged sketch."""

    def __init__(self, bits: np.ndarray, cells: int):
        self.bits, self.cells = bits, cells

    def test(self, hashes: np.ndarray) -> np.ndarray:
        """False where a hash is below the threshold for certain."""
        at = cells_of(hashes, self.cells)
        out = np.ones(len(hashes), bool)
        for row in at:
            out &= (self.bits[row >> 3] >> (np.uint32(7) - (row & np.uint32(7))).astype(np.uint8)) & 1 == 1
        return out


def possible(df: DataFrame, mapper: Callable[[Iterator], Counted], threshold: int, cells: int) -> Possible:
    """The bits of all (hashes, counts) that ``mapper(batches)`` yields in all tasks."""
    block = min(BLOCK, cells)
    kind = np.uint8 if threshold < 256 else np.uint16 if threshold < 65536 else np.int64

    def partial(batches):
        import pyarrow as pa

        codec = pa.Codec("zstd", compression_level=3)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n, most = 0, 1 << 20

        def merged():
            keys, counts = add_up(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            return keys, np.minimum(counts, threshold).astype(np.int32)

        def sent(keys, counts):
            """One row for each touched block: gaps between its cells and their counts, byte by byte, compressed."""
            edges = np.searchsorted(keys, np.arange(0, cells + block, block, dtype=np.int64))
            for k in np.flatnonzero(np.diff(edges)):
                a, b = edges[k], edges[k + 1]
                place = (keys[a:b] - np.uint32(k * block)).astype("<u4")
                gaps = np.diff(place, prepend=np.zeros(1, "<u4"))
                planes = np.concatenate([gaps.view(np.uint8).reshape(-1, 4).T.ravel(), counts[a:b].astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel()])
                yield pa.RecordBatch.from_pydict({"k": pa.array([int(k)], pa.int32()), "n": pa.array([int(b - a)], pa.int32()), "v": pa.array([codec.compress(planes.tobytes(), asbytes=True)], pa.binary())})

        if cells <= DENSE:
            table = np.zeros(cells, kind)
            for hashes, counts in mapper(batches):
                for row in cells_of(hashes, cells):
                    at, more = add_up(row, np.minimum(counts, threshold))
                    table[at] = np.minimum(table[at] + more, threshold)
            used = np.flatnonzero(table)
            yield from sent(used.astype(np.uint32), table[used])
            return
        for hashes, counts in mapper(batches):
            for row in cells_of(hashes, cells):
                held.append((row, np.minimum(counts, threshold).astype(np.int32)))
                n += len(row)
            if n > most:
                held[:] = [merged()]
                n = len(held[0][0])
                most = max(1 << 20, min(2 * n, n + (1 << 20)))
                if n > HELD:
                    yield from sent(*held.pop())
                    n, most = 0, 1 << 20
        if held:
            yield from sent(*merged())

    def merge(batches):
        import pyarrow as pa

        codec = pa.Codec("zstd")
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                gaps, counts = np.frombuffer(codec.decompress(v.as_buffer(), 8 * n), np.uint8).reshape(2, 4, n)
                gaps, counts = (np.ascontiguousarray(x.T).view("<u4").ravel() for x in (gaps, counts))
                row = sums.setdefault(k, np.zeros(block, kind))
                at = np.cumsum(gaps)
                # saturated at the threshold, so that no sum overflows
                row[at] = np.minimum(row[at].astype(np.int64) + counts, threshold)
        for k, row in sums.items():
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "v": pa.array([np.packbits(row >= threshold).tobytes()], pa.binary())})

    n = cells // block
    summed = df.mapInArrow(partial, "k int, n int, v binary").repartition(min(n, 256), "k").mapInArrow(merge, "k int, v binary")
    bits = np.zeros(cells // 8, np.uint8)
    for k, v in summed.collect():
        bits[k * block // 8 : (k + 1) * block // 8] = np.frombuffer(bytes(v), np.uint8)
    return Possible(bits, cells)
