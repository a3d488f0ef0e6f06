"""Operator 12, quality classifier: which dictionary compresses a text better, that of good or of bad labelled text.

Two zstandard dictionaries of equal size hold stretches of labelled texts. A text is cut into
blocks of ``BLOCK`` bytes, so that the dictionary and not the text itself is what a block is
compared with, and every block is compressed with both. The text's difference is the summed
good size less the summed bad size over the larger of the two; its ratio is the smaller sum
over the text's bytes, which tells repetitive texts, that both compress to nothing. A logistic
curve over the two and their squares and product, fitted on labelled rows that gave nothing to
the dictionaries and weighted to the classes' true shares, turns them into a probability.

The fit uses at most ``MAX_ROWS`` labelled ids a class (least hashes), one text each: half
give at most ``STRETCH`` characters from a place picked by hash to the dictionaries, the
other half are compressed whole for the curve. All rows are scored, whole.

Edge cases: a null text is empty, and an empty text has difference 0 and ratio 1; very long
texts are compressed block by block; an id with several texts or labels takes part with its
least text and its worse label; repeated rows and ties score alike; null ids are the text
``null`` to the fold; if a class has too few rows to fit, every text scores the share of good
labels (a half without labels); empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_ import crc_remainder, slices
from .shared import cut

FOLDS, HELD_OUT = 3, 1
MAX_ROWS = 4000
DICTIONARY, STRETCH = 128 << 10, 2048
BLOCK, LEVEL = 512, 6
RIDGE = 0.3


class Model:
    """Both dictionaries and the curve's weights; without dictionaries the score is the bias alone."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray):
        self.good, self.bad, self.weights = good, bad, weights

    def __getstate__(self):
        return self.good, self.bad, self.weights

    def __setstate__(self, state):
        self.good, self.bad, self.weights = state

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Difference and ratio of every text."""
        if not hasattr(self, "_sizes"):
            self._sizes = [_sizer(self.good), _sizer(self.bad)]
        good, bad = self._sizes
        out = np.empty((len(texts), 2))
        for k, text in enumerate(texts):
            a = b = 0
            for at in range(0, len(text), BLOCK):
                block = text[at : at + BLOCK]
                a += len(good(block))
                b += len(bad(block))
            out[k] = ((a - b) / max(a, b), min(a, b) / len(text)) if text else (0, 1)
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        x = _terms(self.features(texts)) if self.good else np.eye(1, len(self.weights)).repeat(len(texts), 0)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -40, 40)))


def _sizer(dictionary: bytes):
    import zstandard

    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False)
    table = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    table.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=table).compress


def _terms(features: np.ndarray) -> np.ndarray:
    x, r = 10 * np.clip(features[:, 0], -0.5, 0.5), 5 * (np.minimum(features[:, 1], 1) - 0.5)
    return np.stack([np.ones(len(x)), x, x * x, r, r * r, x * r], 1)


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps."""
    w, ridge = np.zeros(x.shape[1]), RIDGE * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6

    def loss(w):
        return (weight * np.logaddexp(0, np.where(y, -1, 1) * (x @ w))).sum() + w @ ridge @ w / 2

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        size = 1.0
        while loss(w + size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w + size * step
    return w


def _sampled(docs: DataFrame, labels: DataFrame, limit: int) -> tuple[DataFrame, dict[int, int]]:
    """Labelled texts (text, quality, part), at most ``limit`` ids a class, and all training labels by class."""
    known = labels.where("quality is not null and doc_id is not null").where(crc_remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    known = cut(known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("quality")))
    shares = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    picked = [known.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit) for k in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * MAX_ROWS short rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    return cut(rows.select("text", "quality", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).alias("part"), F.xxhash64("doc_id", F.lit(2)).alias("place"))), shares


def _dictionary(stretches: list[bytes]) -> bytes:
    """The same length of every stretch, until the dictionary is full."""
    if not stretches:
        return b""
    each = max(256, -(-DICTIONARY // len(stretches)))
    return b"\n".join(s[:each] for s in stretches)[:DICTIONARY]


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_ROWS) -> Model:
    """Dictionaries and curve from the labelled rows of the training folds."""
    rows, shares = _sampled(docs, labels, limit)
    n_bad, n_good = shares.get(0, 0), shares.get(1, 0)
    share = (n_good + 0.5) / (n_good + n_bad + 1)
    prior = Model(b"", b"", np.array([np.log(share / (1 - share)), 0, 0, 0, 0, 0]))
    start = F.pmod("place", F.greatest(F.length("text") - STRETCH + 1, F.lit(1)))
    given = rows.where("part = 0").select("quality", "place", F.substring("text", start.cast("int") + 1, F.lit(STRETCH)).alias("s"))
    # places of a stretch are hashes of ids: the order is fixed
    given = sorted((r["quality"], r["place"], r["s"].encode()) for r in given.where("s <> ''").collect())  # 2 * MAX_ROWS stretches at most
    good, bad = (_dictionary([s for q, _, s in given if q == k]) for k in (1, 0))
    size = min(len(good), len(bad))
    if size < BLOCK:
        return prior
    model = Model(good[:size], bad[:size], prior.weights)
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def describe(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = handle.value.features([t.encode() for t in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["quality", "difference", "ratio"])

    found = np.array([tuple(r) for r in rows.where("part = 1").select("text", "quality").mapInArrow(describe, "quality int, difference double, ratio double").collect()])
    if not len(found) or len(np.unique(found[:, 0])) < 2:
        return prior
    y = found[:, 0] > 0
    # the limit may have cut one class more than the other
    weight = np.where(y, n_good / y.sum(), n_bad / (~y).sum())
    order = np.lexsort(found.T)
    x, y, weight = _terms(found[:, 1:])[order], y[order], (weight * len(y) / (n_good + n_bad))[order]
    return Model(model.good, model.bad, _curve(x, y, weight))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    handle = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                score = handle.value.score([t.encode() for t in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), (crc_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score_corpus(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(docs, fit(docs, labels))
