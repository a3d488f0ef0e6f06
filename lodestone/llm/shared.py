"""Small helpers used by several operators: values computed once, and sums of vectors."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, small

__all__ = ["cut", "free_name", "let", "small", "sum_vectors"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once for each row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of the frame has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def sum_vectors(df: DataFrame, mapper, size: int, dtype=np.float64, slice_size: int = 1 << 14) -> np.ndarray:
    """Sum over all rows of fixed-size vectors that ``mapper(batches)`` yields once per task.

    ``size`` is a parameter of the caller's method and never a property of the data. Each
    task sends its vector in slices, slices are summed by executors, and the driver gets
    one vector. Used for piece expectations, hashed document frequencies and the like.
    """
    item = np.dtype(dtype)

    def partial(batches):
        import pyarrow as pa

        total = None
        for vector in mapper(batches):
            total = vector if total is None else total + vector
        if total is not None:
            total = total.astype(item)
            at = [k for k in range(math.ceil(size / slice_size)) if total[k * slice_size : (k + 1) * slice_size].any()]
            if at:
                yield pa.RecordBatch.from_pydict({"k": pa.array(at, pa.int32()), "v": pa.array([total[k * slice_size : (k + 1) * slice_size].tobytes() for k in at], pa.binary())})

    def merge(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = np.frombuffer(v, item)
                sums[k] = sums[k] + row if k in sums else row
        if sums:
            yield pa.RecordBatch.from_pydict({"k": pa.array(list(sums), pa.int32()), "v": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    n = math.ceil(size / slice_size)
    summed = df.mapInArrow(partial, "k int, v binary").repartition(min(n, 64), "k").mapInArrow(merge, "k int, v binary")
    out = np.zeros(n * slice_size, item)
    for k, v in summed.collect():
        row = np.frombuffer(bytes(v), item)
        out[k * slice_size : k * slice_size + len(row)] += row
    return out[:size]
