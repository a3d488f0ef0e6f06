"""Operator 4, BPE encoding and decoding with contiguous rank arrays; the text side of operator 2.

A short word is an array of parts (one byte each at first) beside an array with the rank
of every adjacent pair. The least rank is looked up, its boundary is deleted, and the
ranks of the two new neighbours are refreshed, until no pair has a rank. The arrays of
many different words form one matrix, so each step is a few array operations for all of
them; a word that is done leaves the matrix. Words over ``SHORT_BYTES`` go through a heap
over the same ranks, as scanning a long array for each merge takes quadratic time.

Words are encoded once for each worker's cache (two generations of about ``CACHE_BYTES``, the
older of which is dropped in turn)
and texts are looked up word by word. Decoding goes back from ids to bytes by a table and
reads them as UTF-8, with U+FFFD for what is not.

Edge cases: a null or empty text has no tokens (0, digests of the empty string); a special
token's string in a text becomes that token, as in the library; texts of any length are
handled whole; every row gives one result, repeated rows too; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_ import slices

SHORT_BYTES = 32
#: Bytes of words in one generation of the cache; longer words than ``CACHED_BYTES`` stay for one slice only.
CACHE_BYTES, CACHED_BYTES = 4 << 20, 64
SLICE_BYTES = 1 << 20
_NONE = np.int64(1) << 40


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 as is, others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Pairs:
    """Rank and result of adjacent parts, by open addressing over arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, result: np.ndarray):
        self.bits = max(10, int(len(left) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, _NONE, np.int64)
        self.longest = 1
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        # The rank is the place in the list; with it comes the part that the merge makes.
        for key, value in zip(keys.tolist(), (np.arange(len(left), dtype=np.int64) << 20 | result).tolist(), strict=True):
            at, probes = self._home(key), 1
            while self.keys[at] != -1 and self.keys[at] != key:
                at, probes = (at + 1) & (size - 1), probes + 1
            self.keys[at], self.values[at] = key, value
            self.longest = max(self.longest, probes)
        self.plain = {int(k): int(v) for k, v in zip(self.keys, self.values, strict=True) if k != -1}

    def _home(self, key: int) -> int:
        return ((key * 0x9E3779B97F4A7C15) & (1 << 64) - 1) >> (64 - self.bits)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 20 | result of each pair, or ``_NONE``."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[at] == key, self.values[at], _NONE)
        open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] != -1))
        for _ in range(self.longest):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class Codec:
    """Encoder and decoder of a byte-level BPE file (parts are named by their ids)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, alphabet = spec["model"], _byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pairs = _Pairs(*(np.array([vocab[f(m)] for m in merges]) for f in (lambda m: m[0], lambda m: m[1], "".join)))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = [b""] * (max(max(vocab.values()), *self.special.values(), 0) + 1)
        for piece, i in vocab.items():
            self.pieces[i] = bytes(alphabet[c] for c in piece)
        for content, i in self.special.items():
            self.pieces[i] = content.encode()
        self.of_byte = np.array([vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int64)
        # The word pattern of byte-level BPE is a fixed value.
        self.word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.texts: dict[str, str] = {}
        self.ids: dict[str, bytes] = {}
        self.older: tuple[dict[str, str], dict[str, bytes]] = ({}, {})
        self.long: list[str] = []
        self.held = 0
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.begins = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.all_bytes = np.frombuffer(b"".join(self.pieces), np.uint8)

    def _short(self, words: list[bytes]) -> list[list[int]]:
        """All words of one batch at once, one row of parts and ranks each."""
        size = np.array([len(w) for w in words])
        width = int(size.max())
        parts = np.zeros((len(words), width), np.int64)
        inside = np.arange(width) < size[:, None]
        parts[inside] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((len(words), max(width, 1)), _NONE, np.int64)
        if width > 1:
            pair = inside[:, 1:]
            ranks[:, :-1][pair] = self.pairs.find(parts[:, :-1][pair], parts[:, 1:][pair])
        done_parts: list = [None] * len(words)
        row = np.arange(len(words))
        while len(row):
            least = ranks.argmin(axis=1)
            every = np.arange(len(row))
            value = ranks[every, least]
            over = value == _NONE
            if over.any():
                for k in np.flatnonzero(over):
                    done_parts[row[k]] = parts[k, : size[k]].tolist()
                keep = ~over
                parts, ranks, size, row, least, value = parts[keep], ranks[keep], size[keep], row[keep], least[keep], value[keep]
                if not len(row):
                    break
                every = np.arange(len(row))
            # Delete the boundary after ``least``: later parts and ranks move up by one.
            shift = np.arange(parts.shape[1])[None, :] + (np.arange(parts.shape[1])[None, :] > least[:, None])
            shift = np.minimum(shift, parts.shape[1] - 1)
            parts = np.take_along_axis(parts, shift, axis=1)
            ranks = np.take_along_axis(ranks, shift, axis=1)
            parts[every, least] = value & 0xFFFFF
            size = size - 1
            ranks[every, size - 1] = _NONE
            right = np.flatnonzero(least < size - 1)
            ranks[right, least[right]] = self.pairs.find(parts[right, least[right]], parts[right, least[right] + 1])
            left = np.flatnonzero(least > 0)
            ranks[left, least[left] - 1] = self.pairs.find(parts[left, least[left] - 1], parts[left, least[left]])
            if (width := int(size.max())) < parts.shape[1]:
                parts, ranks = parts[:, :width], ranks[:, :width]
        return done_parts

    def _long(self, word: bytes) -> list[int]:
        """The same merges in n log n steps, for a word that is too long to scan again and again."""
        parts = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        find = self.pairs.plain.get
        heap = [(v, i) for i in range(n - 1) if (v := find(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            value, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or find(parts[i] << 32 | parts[j]) != value:
                continue
            parts[i], parts[j] = value & 0xFFFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (v := find(parts[i] << 32 | parts[k])) is not None:
                    heapq.heappush(heap, (v, i))
            if (h := before[i]) >= 0 and (v := find(parts[h] << 32 | parts[i])) is not None:
                heapq.heappush(heap, (v, h))
        return [p for p in parts if p >= 0]

    def learn(self, words: set[str]) -> None:
        """Have all the words in the cache: from its older half, or else encoded."""
        for w in self.long:
            del self.texts[w], self.ids[w]
        self.long = []
        if self.held > CACHE_BYTES:
            self.older, self.texts, self.ids, self.held = (self.texts, self.ids), {}, {}, 0
        new = words.difference(self.texts)
        for w in new.intersection(self.older[0]):
            self.texts[w], self.ids[w] = self.older[0][w], self.older[1][w]
            self.held += len(w)
        raw = sorted([(len(b := w.encode()), w, b) for w in new.difference(self.texts)], key=itemgetter(0))
        n_short = sum(x[0] <= SHORT_BYTES for x in raw)
        for at in range(0, len(raw), 8192):
            part = raw[at : at + 8192]
            few = max(0, min(len(part), n_short - at))
            found = (self._short([b for _, _, b in part[:few]]) if few else []) + [self._long(b) for _, _, b in part[few:]]
            ends = np.cumsum([len(ids) for ids in found]) * 4
            flat = np.array([i for ids in found for i in ids], np.int32).tobytes()
            begin = 0
            for (_, w, _), ids, end in zip(part, found, ends.tolist(), strict=True):
                self.texts[w], self.ids[w] = ",".join(map(str, ids)), flat[begin:end]
                begin = end
        self.held += sum(n for n, _, _ in raw if n <= CACHED_BYTES)
        self.long = [w for n, w, _ in raw if n > CACHED_BYTES]
        for content, i in self.special.items():
            self.texts[content], self.ids[content] = str(i), np.array([i], np.int32).tobytes()

    def words(self, text: str) -> list[str]:
        """The words of a text; a special token's string is a word of its own."""
        if self.at_special is None or not any(s in text for s in self.special):
            return self.word.findall(text)
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += self.word.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.word.findall(text[at:])

    def encode_batch(self, texts: list[str], decimals: bool = True) -> list[tuple[str, bytes]]:
        """For each text its ids as decimals joined by commas (if asked for) and as 32-bit integers."""
        split = [self.words(t) for t in texts]
        self.learn(set().union(*split))
        text, ids = self.texts.__getitem__, self.ids.__getitem__
        return [(",".join(map(text, words)) if decimals else "", b"".join(map(ids, words))) for words in split]

    def decode(self, ids: bytes) -> str:
        """The text of 32-bit ids."""
        part = np.frombuffer(ids, np.int32)
        size = self.lengths[part]
        total = int(size.sum())
        if not total:
            return ""
        ends = np.cumsum(size)
        at = np.arange(total) + np.repeat(self.begins[part] - (ends - size), size)
        return self.all_bytes[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _batches(batches, path, decimals=True):
    coder = codec(path)
    for batch in batches:
        for part in slices(batch, batch.schema.names[0], SLICE_BYTES):
            yield part, coder, coder.encode_batch(part.column(0).to_pylist(), decimals)


def _source(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text"), *more)


def encoded(docs: DataFrame, path: str | None = None, column: str = "ids", decoded: str = "decoded_sha256") -> DataFrame:
    """The documents with two more columns: their ids (an array of int) and the digest of the text decoded from these.

    Columns of these names that the documents have already are replaced.
    """
    path = path or vocabulary_path()
    kept = [c for c in docs.columns if c not in (column, decoded)]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"`{column}` array<int>", f"`{decoded}` string"])

    def run(batches):
        coder = codec(path)
        for batch in batches:
            where = batch.schema.get_field_index("text")
            for part in slices(batch, "text", SLICE_BYTES):
                raw = [x[1] for x in coder.encode_batch([t if t is not None else "" for t in part.column(where).to_pylist()], False)]
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in raw]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), np.int32)))
                back = pa.array([hashlib.sha256(coder.decode(x).encode()).hexdigest() for x in raw], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, ids, back], names=[*kept, column, decoded])

    return docs.select(*kept).mapInArrow(run, schema)


def lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every row."""
    path = path or vocabulary_path()

    def run(batches):
        for part, _, found in _batches(batches, path, False):
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(1), "n_tokens": pa.array([len(x[1]) // 4 for x in found], pa.int64())})

    return _source(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, n_tokens long")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode every whole text, decode it again, and give count and digests of both."""
    path = path or vocabulary_path()

    def hex_of(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def run(batches):
        for part, coder, found in _batches(batches, path):
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column(1),
                "n_tokens": pa.array([len(x[1]) // 4 for x in found], pa.int64()),
                "ids_sha256": pa.array([hex_of(x[0].encode()) for x in found]),
                "decoded_sha256": pa.array([hex_of(coder.decode(x[1]).encode()) for x in found]),
            })

    return _source(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
