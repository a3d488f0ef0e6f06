"""Operator 9, LM scoring: marginal probability over all subword segmentations.

The vocabulary is an existing subword vocabulary and its scores weigh the pieces: the file
scores pieces by order (0, -1, -2, ...), which are read as ranks of a Zipf-Mandelbrot law.
A word is its lower-cased bytes after a space; the log-space forward recursion over its
lattice sums the weight of every segmentation into pieces, single bytes being the
fallback. A text's probability is the product over its words and one end symbol, and is
reported as log10. ``rounds`` of expectation maximisation on the training words can refine
the weights; the registered query takes two rounds and gives scores by the vocabulary's own
weights beside.

Beside it stands the additive word-unigram base score. Counts of the training words are
one table (word, count), and its mass point is a head of at most ``HEAD_WORDS`` words,
looked up where the texts are; the few tokens outside it join the table by word. No word
outside the head is frequent, so that join has no hot key.

Edge cases: a null or empty text is one end symbol; repeated rows are trained on and
scored once each; a null doc_id is hashed as the text ``null``; with no training rows
every token is unknown; any text length works, texts being taken in windows of bounded
size, and words over ``LONG_WORD`` bytes in stretches that hand on the last forward values;
other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_ import LOWER, crc_remainder, mix, slices, span_hashes, texts_of, words_of
from .shared import cut, sum_vectors

HEAD_WORDS = 1 << 18
WINDOW_BYTES = 8 << 20
#: Words of more bytes go through the lattice in stretches of this many.
LONG_WORD = 1 << 14
_FILTER_BITS = 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Vocabulary pieces by hash, and a log probability for each; the last 257 are bytes and the end."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        self.pieces, self.log_p = pieces, log_p
        self.longest = max(map(len, pieces), default=1)
        hashes = np.array([_hash_of(p) for p in pieces], np.uint64)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where there is none."""
        out = np.full(hashes.shape, -1, np.int64)
        maybe = np.flatnonzero(self.filter[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)].ravel())
        if len(maybe) and len(self.sorted):
            asked = hashes.ravel()[maybe]
            at = np.minimum(np.searchsorted(self.sorted, asked), len(self.sorted) - 1)
            out.ravel()[maybe] = np.where(self.sorted[at] == asked, self.order[at], -1)
        return out


def _hash_of(piece: bytes) -> np.uint64:
    h = 0
    for b in piece:
        h = (h * int(_MULTIPLIER) + b + 1) & (1 << 64) - 1
    return mix(np.array([h], np.uint64))[0]


@lru_cache(maxsize=4)
def _prior(path: str) -> tuple[tuple[bytes, ...], np.ndarray]:
    """Pieces that can occur in lower-cased words, weighed by the vocabulary's own scores.

    The scores of the file are an order (0, -1, -2, ...), read as Zipf-Mandelbrot ranks.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        raw = model.id_to_piece(i).replace("▁", " ").encode()
        if raw and b" " not in raw[1:] and not any(65 <= b <= 90 for b in raw):
            found[raw] = 1 / (100 + max(0.0, -model.get_score(i)) if model.get_score(i) > -1e8 else 1e6)
    weights = np.array([*found.values(), *[1e-7] * 256, 1e-2])
    return tuple(found), np.log(weights / weights.sum())


class Lattice:
    """All spans of words of one length that are pieces: ids and weights by span length and start."""

    def __init__(self, pieces: Pieces, matrix: np.ndarray):
        n, self.size = matrix.shape
        self.ids, self.weights = [], []
        h = np.zeros((n, self.size + 1), np.uint64)
        for width in range(1, min(pieces.longest, self.size) + 1):
            h = h[:, : self.size - width + 1] * _MULTIPLIER + matrix[:, width - 1 :].astype(np.uint64) + np.uint64(1)
            ids = pieces.ids(mix(h))
            if width == 1:
                ids = np.where(ids < 0, len(pieces.pieces) + matrix.astype(np.int64), ids)
            self.ids.append(ids)
            self.weights.append(np.where(ids < 0, -np.inf, pieces.log_p[ids]))

    def forward(self, before: np.ndarray | None = None) -> np.ndarray:
        """Log weights of all ways to each position; ``before`` has those of the first positions, else the first is the start."""
        alpha = np.full((len(self.ids[0]), self.size + 1), -np.inf)
        known = 1 if before is None else before.shape[1]
        alpha[:, :known] = 0 if before is None else before
        for j in range(known, self.size + 1):
            alpha[:, j] = _log_sum(np.stack([alpha[:, j - w] + self.weights[w - 1][:, j - w] for w in range(1, min(j, len(self.ids)) + 1)]))
        return alpha

    def backward(self) -> np.ndarray:
        beta = np.full((len(self.ids[0]), self.size + 1), -np.inf)
        beta[:, self.size] = 0
        for i in range(self.size - 1, -1, -1):
            beta[:, i] = _log_sum(np.stack([beta[:, i + w] + self.weights[w - 1][:, i] for w in range(1, min(self.size - i, len(self.ids)) + 1)]))
        return beta


def _log_sum(rows: np.ndarray) -> np.ndarray:
    top = rows.max(axis=0)
    return top + np.log(np.exp(rows - top).sum(axis=0))


def _by_length(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Words of equal length as byte matrices, each after a space, in blocks of bounded size."""
    size = ends - starts
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        width = int(size[order[at]])
        same = int(np.searchsorted(size[order], width, side="right")) if at == 0 or size[order[at - 1]] != width else same
        block = order[at : min(same, at + max(1, (1 << 18) // (width + 1)))]
        matrix = np.full((len(block), width + 1), 32, np.uint8)
        matrix[:, 1:] = data[starts[block][:, None] + np.arange(width)]
        yield block, matrix
        at += len(block)


def word_log_p(pieces: Pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Natural log of each word's marginal probability."""
    out = np.zeros(len(starts))
    long = np.flatnonzero(ends - starts > LONG_WORD)
    short = np.flatnonzero(ends - starts <= LONG_WORD)
    for block, matrix in _by_length(data, starts[short], ends[short]):
        out[short[block]] = Lattice(pieces, matrix).forward()[:, -1]
    for i in long:
        out[i] = _long_log_p(pieces, np.concatenate(([np.uint8(32)], data[starts[i] : ends[i]])))
    return out


def _long_log_p(pieces: Pieces, word: np.ndarray) -> float:
    """The same for one long word: each stretch begins with as many bytes as the longest piece may reach back."""
    back = pieces.longest
    at = min(len(word), max(LONG_WORD, back))
    alpha = Lattice(pieces, word[None, :at]).forward()
    while at < len(word):
        upto = min(len(word), at + max(LONG_WORD, back))
        alpha = Lattice(pieces, word[None, at - back : upto]).forward(alpha[:, -back - 1 :])
        at = upto
    return float(alpha[0, -1])


def _expected(pieces: Pieces, data, starts, ends, counts) -> np.ndarray:
    """Expected uses of each piece over all segmentations of counted words."""
    total = np.zeros(len(pieces.log_p))
    for block, matrix in _by_length(data, starts, ends):
        lattice = Lattice(pieces, matrix)
        alpha, beta = lattice.forward(), lattice.backward()
        share = counts[block] / 1.0
        for w, (ids, weights) in enumerate(zip(lattice.ids, lattice.weights, strict=True), 1):
            posterior = np.exp(alpha[:, : lattice.size - w + 1] + weights + beta[:, w:] - alpha[:, -1:]) * share[:, None]
            seen = ids >= 0
            total += np.bincount(ids[seen], posterior[seen], minlength=len(total))
    return total


def _unique_words(batches):
    """Windows of rows with their lower-cased bytes, words, and distinct words."""
    for batch in batches:
        for part in slices(batch, "text", WINDOW_BYTES):
            texts = texts_of(part.column(0))
            data = LOWER[texts.data]
            words = words_of(texts)
            hashes = span_hashes(data, words.starts, words.ends)
            distinct, first, inverse, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            yield part, texts, data, words, distinct, first, inverse, count


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    offsets = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at])])


def word_counts(texts: DataFrame) -> DataFrame:
    """word (lower-cased bytes) and c over all rows of a one-column frame ``text``."""

    def run(batches):
        for _, _, data, words, _, first, _, count in _unique_words(batches):
            if len(first):
                yield pa.RecordBatch.from_arrays([_gather(data, words.starts[first], words.ends[first]), pa.array(count)], names=["word", "c"])

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Model:
    """Pieces with trained weights, those with the vocabulary's own, and the word counts with their totals."""

    def __init__(self, pieces: Pieces, own: Pieces, counts: DataFrame, n_texts: int, train_tokens: int, distinct: int):
        self.own = own
        self.pieces, self.counts, self.n_texts = pieces, counts, n_texts
        self.train_tokens, self.distinct = train_tokens, distinct


def fit(texts: DataFrame, path: str | None = None, rounds: int = 0) -> Model:
    """Count words of all rows of a frame with a column ``text``, and refine piece weights on them in ``rounds`` if asked to."""
    names, log_p = _prior(path or vocabulary_path())
    own = Pieces(list(names), log_p)
    texts = texts.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = cut(word_counts(texts))
    n_texts = texts.count()
    r = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    for _ in range(rounds if r.n else 0):
        pieces = Pieces(list(names), log_p)

        def expect(batches, pieces=pieces):
            for batch in batches:
                raw = texts_of(batch.column(0))
                yield _expected(pieces, raw.data, raw.offsets[:-1], raw.offsets[1:], batch.column(1).to_numpy())

        uses = sum_vectors(counts, expect, len(log_p))
        uses[-1] = n_texts
        log_p = np.log((uses + 0.1) / (uses.sum() + 0.1 * len(uses)))
    return Model(Pieces(list(names), log_p) if rounds else own, own, counts, n_texts, r.n + n_texts, r.v + (n_texts > 0))


def _head(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and counts of at most ``limit`` of the most frequent words, and the least count among them."""
    level = F.floor(F.log2("c") * 8)
    held, least = 0, None
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("level")).collect():
        held += r.n
        if held > limit:
            break
        least = r.least
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def hashed(batches):
        for batch in batches:
            raw = texts_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(span_hashes(raw.data, raw.offsets[:-1], raw.offsets[1:]).astype(np.int64)), batch.column(1)], names=["h", "c"])

    rows = counts.where(F.col("c") >= least).mapInArrow(hashed, "h long, c long").toArrow()
    h, c = rows.column(0).to_numpy().astype(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(h)
    return h[order], c[order], least


_SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, vocabulary_score double, word binary, tf long"


def score(docs: DataFrame, model: Model, held_out) -> DataFrame:
    """Scores of all rows, by the model's weights and by the vocabulary's own; ``held_out`` is a boolean column."""
    hashes, counts, _ = _head(model.counts, HEAD_WORDS)
    handle = docs.sparkSession.sparkContext.broadcast((model.pieces, None if model.own is model.pieces else model.own, hashes, counts))  # bounded by HEAD_WORDS and the vocabulary
    n_texts = model.n_texts

    def run(batches):
        pieces, own, head, head_counts = handle.value
        for part, texts, data, words, distinct, first, inverse, _ in _unique_words(batches):
            n = len(texts)
            spans = (data, words.starts[first], words.ends[first])
            at = np.minimum(np.searchsorted(head, distinct), max(len(head) - 1, 0))
            in_head = head[at] == distinct if len(head) else np.zeros(len(distinct), bool)
            log_c = np.where(in_head, np.log10(np.where(in_head, head_counts[at], 1) + 0.1), 0) if len(head) else np.zeros(len(distinct))
            tokens = np.bincount(words.doc, minlength=n)
            known = np.bincount(words.doc, in_head[inverse], minlength=n).astype(np.int64) + (n_texts > 0)
            base = np.bincount(words.doc, log_c[inverse], minlength=n) + np.log10(n_texts + 0.1)
            total = [(np.bincount(words.doc, word_log_p(p, *spans)[inverse], minlength=n) + p.log_p[-1]) / np.log(10) for p in (pieces, own) if p is not None]
            rare = ~in_head[inverse]
            pair, tf = np.unique(words.doc[rare] * max(len(distinct), 1) + inverse[rare], return_counts=True)
            row, word = pair // max(len(distinct), 1), pair % max(len(distinct), 1)
            rid = part.column(1).to_numpy()
            m = len(pair)

            def pad(values, kind):
                return pa.concat_arrays([values, pa.nulls(m, kind)])

            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((rid, rid[row]))), pad(part.column(2), pa.int64()), pad(part.column(3), pa.bool_()), pad(pa.array(tokens + 1), pa.int64()),
                    pad(pa.array(known), pa.int64()), pad(pa.array(base), pa.float64()), pad(pa.array(total[0]), pa.float64()), pad(pa.array(total[-1]), pa.float64()),
                    pa.concat_arrays([pa.nulls(n, pa.binary()), _gather(data, words.starts[first[word]], words.ends[first[word]])]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(tf)]),
                ],
                names=[x.split()[0] for x in _SCORED.split(", ")],
            )

    source = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"))
    found = cut(source.mapInArrow(run, _SCORED))
    rows = found.where("tf is null").drop("word", "tf")
    rare = found.where("tf is not null").select("rid", "word", "tf").join(model.counts, "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    rare = rare.groupBy("rid").agg(F.sum(F.col("tf") * F.log10(c + 0.1)).alias("rare_base"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("rare_known"))
    per_token = float(np.log10(model.train_tokens + 0.1 * (model.distinct + 1)))
    return rows.join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"),
        "score", "vocabulary_score",
    )


def score_corpus(docs: DataFrame, path: str | None = None, folds: int = 10, rounds: int = 0) -> DataFrame:
    """Train on the rows outside the held-out fold, score every row."""
    held_out = crc_remainder(F.col("doc_id"), folds) == 0
    return score(docs, fit(docs.where(~held_out), path, rounds), held_out)
