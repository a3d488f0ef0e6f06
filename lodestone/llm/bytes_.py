"""Vectorised primitives over Arrow text buffers, shared by the corpus operators.

Python string objects are never built on these paths: a column's UTF-8 buffer is
viewed as ``uint8`` and words, lines and hashes come from array operations. Work is
done in slices of bounded size, so memory does not grow with the batch; one text
longer than a slice is taken alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
BLOCK_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables = {"power": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}

WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Texts(NamedTuple):
    """UTF-8 bytes of some rows, and where each row starts (one offset more than rows)."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are in the mask."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The column's buffer; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return Texts(raw, offsets - offsets[0])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``limit`` bytes of text (one row at least)."""
    offsets = texts_of(batch.column(batch.schema.get_field_index(column))).offsets
    at, n = 0, len(offsets) - 1
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def runs(texts: Texts, inside: np.ndarray) -> Words:
    """Maximal runs of masked bytes that do not cross from one text to the next."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    first, last = texts.offsets[:-1], texts.offsets[1:] - 1
    before[first[first < n]] = False
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    held = np.diff(np.searchsorted(starts, texts.offsets))
    return Words(starts, ends, np.repeat(np.arange(len(texts)), held))


def words_of(texts: Texts) -> Words:
    r"""Words ``[^\x20\x09-\x0D]+`` of every text."""
    return runs(texts, ~WHITE[texts.data])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables["power"]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        for name, base in (("power", _P), ("inverse", _P_INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _tables[name] = np.cumprod(row, dtype=np.uint64)
    return _tables["power"], _tables["inverse"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; spans come in order of their starts and ends."""
    out, at, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while at < n:
        base = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, side="right")))
        block = data[base : ends[at:upto].max()]
        power, inverse = _powers(len(block) + 1)
        total = np.zeros(len(block) + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * power[: len(block)], out=total[1:])
        a, b = starts[at:upto] - base, ends[at:upto] - base
        out[at:upto] = (total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64)
        at = upto
    return mix(out)


def windows(values: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` neighbouring values of one text, and where each window begins."""
    if len(values) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(values) - width + 1
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + values[j : j + n]
    return mix(total[at]), at


def keyed(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Values told apart by text, to count within each text in one sort."""
    return mix(values + mix(doc.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))


def crc_remainder(column, m: int):
    """crc32 of the id as text, mod ``m`` (null ids count as the text ``null``)."""
    from pyspark.sql import functions as F

    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("null")).cast("binary")), F.lit(m))
