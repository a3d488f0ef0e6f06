"""Folds over groups in an order, for rules in which one row decides what the next may do.

Rows are dealt by group and sorted in their partition, and a task carries a few numbers from
row to row: no group is gathered into one row, and memory does not grow with a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def folded(rows: DataFrame, by: tuple[str, ...], order: list, inputs: tuple[str, ...], start: Callable[[], object], out: str) -> DataFrame:
    """The rows with one more column ``name type``: what ``start()``, made anew for each group, says of its rows in order.

    ``start`` returns a function of the ``inputs`` of a row.
    """
    import pyarrow as pa

    name, kind = out.split()
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{name}` {kind}"])
    arrow = {"boolean": pa.bool_(), "long": pa.int64()}[kind]

    def run(batches):
        group, step = None, None
        for batch in batches:
            columns = {f: i for i, f in enumerate(batch.schema.names)}
            keys = list(zip(*(batch.column(columns[c]).to_pylist() for c in by), strict=True))
            values = zip(*(batch.column(columns[c]).to_pylist() for c in inputs), strict=True)
            said = []
            for key, value in zip(keys, values, strict=True):
                if step is None or key != group:
                    group, step = key, start()
                said.append(step(*value))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, arrow)], names=[*batch.schema.names, name])

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def fitting(rows: DataFrame, by: tuple[str, ...], order: list, size: str, limit: int | None, most: int | None = None) -> DataFrame:
    """Rows with ``fits``: whether one still fits the group's budget (and count; null is none) when its turn comes; one that does not is passed over."""

    def start():
        held, n = 0, 0

        def step(x):
            nonlocal held, n
            ok = (limit is None or held + (x or 0) <= limit) and (most is None or n < most)
            if ok:
                held, n = held + (x or 0), n + 1
            return ok

        return step

    return folded(rows, by, order, (size,), start, "fits boolean")
