"""Counts by (group, string), combined inside a task before they are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

HELD_ROWS, HELD_STRINGS, HELD_BYTES = 3 << 20, 1 << 19, 24 << 20


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values in order."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.append(first, len(values)))


class Combiner:
    """Sums of count columns by group (a tuple of strings) and string.

    ``add`` takes distinct pairs of codes of a slice. What is held is bounded by rows, by
    strings and by their bytes; beyond that everything is sent and counting begins anew.
    """

    def __init__(self, group_names: list[str], name: str, count_names: list[str]):
        self.names, self.width, self.group_names = [*group_names, name, *count_names], len(count_names), group_names
        self.clear()

    def clear(self) -> None:
        self.strings: dict[str, int] = {}
        self.groups: dict[tuple[str, ...], int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows, self.limit, self.bytes = 0, 1 << 20, 0

    def add(self, groups: list[tuple[str, ...]], group: np.ndarray, strings: pa.Array, code: np.ndarray, *counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``group`` and ``code`` are places in ``groups`` and ``strings``; yields what has to go."""
        if not len(code):
            return
        known = self.strings
        before = len(known)
        own = np.fromiter((known.setdefault(x, len(known)) for x in strings.to_pylist()), np.int64, len(strings))
        self.bytes += strings.nbytes if len(known) > before else 0
        named = np.fromiter((self.groups.setdefault(g, len(self.groups)) for g in groups), np.int64, len(groups))
        self.parts.append((named[group] << 32 | own[code], *(c.astype(np.int64) for c in counts)))
        self.rows += len(code)
        if self.rows > self.limit:
            self._merge()
            self.limit = max(1 << 20, 2 * self.rows)
        if self.rows > HELD_ROWS or len(known) > HELD_STRINGS or self.bytes > HELD_BYTES and sum(map(len, known)) > HELD_BYTES:
            yield from self.flush()

    def _merge(self) -> None:
        keys = np.concatenate([p[0] for p in self.parts])
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.parts = [(keys[first], *(np.add.reduceat(np.concatenate([p[j + 1] for p in self.parts])[order], first) for j in range(self.width)))]
        self.rows = len(first)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._merge()
            keys, *counts = self.parts[0]
            strings, groups = pa.array(self.strings, pa.string()), list(self.groups)
            labels = [pa.array([g[j] for g in groups], pa.string()) for j in range(len(self.group_names))]
            for at in range(0, len(keys), 1 << 16):
                part = keys[at : at + (1 << 16)]
                group, string = pa.array(part >> 32), pa.array(part & 0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays([*(x.take(group) for x in labels), strings.take(string), *(pa.array(c[at : at + (1 << 16)]) for c in counts)], names=self.names)
        self.clear()
