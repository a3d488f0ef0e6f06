"""Operator 3, toxicity: a classifier regularised by counterfactual identity swaps.

Features of a text are the words it holds (runs of ASCII letters, digits and non-ASCII
bytes, ASCII letters lower-cased) and their prefixes of three to six bytes, hashed, each
present or not, and present more than once or not. Labelled rows choose the features whose presence differs most between the
classes; a logistic model is fitted to those. In every labelled text that mentions
identity terms, the terms are swapped twice, for others of their kind and for a word that
names no group, and the loss adds the squared changes of the score (its log-odds) between
text and counterfactuals, so that a mention of a group does not count for or against a text.

Bounds: the model is fitted on at most ``MAX_TRAIN`` labelled ids, those with the least
hash, a documented sample, and one text (the least) of each; scoring reads every whole text. The scan for
features sends fixed-size vectors only.

Edge cases: null and empty texts have no features and get the bias alone; rows whose label
is null are not trained on; of several labels of one id the greatest counts; a document that
occurs repeatedly is scored each time. With no usable labels, or only one class, every
score is the smoothed base rate. Labels, language, source and id never enter a score.
Other columns are ignored, and carried through by ``clean_documents``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_ import LOWER, crc_remainder, mix, runs, slices, span_hashes, texts_of
from .shared import cut, sum_vectors

MAX_TRAIN = 20_000
BITS = 18
PREFIXES = (3, 4, 5, 6)
FEATURES = 2048
#: A feature needs this many standard errors between the classes: of 2 ** BITS features without meaning about one has more.
LEAST_Z = 4.5
_MASK = (1 << BITS) - 1
L2, SWAP_PENALTY, STEPS = 3e-5, 1.0, 400
#: What a toxic row weighs in the loss, as most rows are not toxic.
TOXIC_WEIGHT = 2.0

# Terms that name groups, by kind; a term is only swapped within its kind.
IDENTITY = {
    "religion": "muslim christian jewish hindu buddhist catholic atheist musulman chrétien juif muslimisch christlich jüdisch musulmán cristiano judío",
    "origin": "african asian european american arab mexican indian chinese turkish africain asiatique européen arabe afrikanisch asiatisch europäisch africano asiático europeo árabe",
    "gender": "woman man women men female male femme homme frau mann mujer hombre",
    "orientation": "gay straight lesbian heterosexual homosexual bisexual transgender",
    "skin": "black white noir blanc schwarz weiß negro blanco",
    "age": "young old elderly jeune vieux jung alt joven viejo",
    "ability": "blind deaf disabled sighted hearing aveugle sourd blindes gehörlos ciego sordo",
}

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


def _buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Feature numbers of words: the whole word and its prefixes, -1 where a word is shorter."""
    columns = [span_hashes(data, starts, ends)]
    for k, width in enumerate(PREFIXES, 1):
        h = span_hashes(data, starts, np.minimum(starts + width, ends))
        columns.append(np.where(ends - starts > width, mix(h + np.uint64(k)), 0))
    table = np.stack(columns, axis=1)
    return np.where(table == 0, -1, (table >> np.uint64(64 - BITS)).astype(np.int64))


def _identity_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of identity terms, their own features, and those of the next term of their kind."""
    terms, swaps = [], []
    for words in IDENTITY.values():
        words = words.split()
        terms += words
        swaps += words[1:] + words[:1]

    def table(words):
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(r) for r in raw])
        data, starts = np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw]
        return span_hashes(data, starts, ends), _buckets(data, starts, ends)

    hashes, _ = table(terms)
    order = np.argsort(hashes)
    return hashes[order], table(terms)[1][order], table(swaps)[1][order]


def _features(texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs: the text's place and the feature's number, in order."""
    words = runs(texts, _INSIDE[texts.data])
    table = _buckets(LOWER[texts.data], words.starts, words.ends)
    return _present(words.doc, table)


def _present(doc: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs in order; what a text holds twice or more is one feature more."""
    key, count = np.unique(((doc[:, None] << BITS) + table)[table >= 0], return_counts=True)
    often = key[count > 1]
    again = (often & ~_MASK) + ((often & _MASK) * 0x9E3B + 0x1F35B & _MASK)
    key = np.unique(np.concatenate((key, again)))
    return key >> BITS, key & _MASK


def _swapped(texts, tables, neutral: bool) -> tuple[np.ndarray, np.ndarray]:
    """The same for counterfactuals, with other terms or with words that have no features; only texts with an identity term have any."""
    hashes, _, swaps = tables
    words = runs(texts, _INSIDE[texts.data])
    data = LOWER[texts.data]
    own = span_hashes(data, words.starts, words.ends)
    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
    term = hashes[at] == own
    named = np.unique(words.doc[term])
    mine = np.isin(words.doc, named)
    table = np.where(term[:, None], -1 if neutral else swaps[at], _buckets(data, words.starts, words.ends))[mine]
    return _present(words.doc[mine], table)


class Model:
    """Weights of hashed features; all others weigh nothing."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def score(self, texts) -> np.ndarray:
        doc, feature = _features(texts)
        z = self.bias + np.bincount(doc, self.weights[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _training_rows(docs: DataFrame, labels: DataFrame, folds: int, limit: int) -> DataFrame:
    labels = labels.where("toxic is not null and doc_id is not null").where(crc_remainder(F.col("doc_id"), folds) != 0)
    sample = labels.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(sample), "doc_id")  # MAX_TRAIN short rows
    return cut(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, limit: int = MAX_TRAIN, swap_penalty: float = SWAP_PENALTY) -> Model:
    """Fit on the labelled rows whose fold number is not 0."""
    rows = _training_rows(docs, labels, folds, limit)
    size = 1 << BITS

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                toxic = part.column(1).to_numpy() > 0
                doc, feature = _features(texts_of(part.column(0)))
                row = np.bincount(feature + size * toxic[doc], minlength=2 * size + 2)
                row[-2:] = (~toxic).sum(), toxic.sum()
                yield row.astype(np.int32)

    sums = sum_vectors(rows, count, 2 * size + 2, np.int32).astype(np.float64)
    clean, toxic = sums[-2:]
    if not clean or not toxic:
        share = (toxic + 0.5) / (clean + toxic + 2)
        return Model(np.zeros(size), float(np.log(share / (1 - share))))
    p0, p1 = sums[:size] / clean, sums[size : 2 * size] / toxic
    pooled = (sums[:size] + sums[size : 2 * size]) / (clean + toxic)
    z = np.abs(p1 - p0) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / clean + 1 / toxic))
    z[sums[:size] + sums[size : 2 * size] < 3] = 0
    tables = _identity_tables()
    identity = np.unique(np.concatenate((tables[1].ravel(), tables[2].ravel())))
    chosen = np.argsort(-z, kind="stable")[:FEATURES]
    chosen = np.union1d(chosen[z[chosen] > LEAST_Z], identity[identity >= 0])
    place = np.full(size, -1, np.int64)
    place[chosen] = np.arange(len(chosen))

    def describe(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part.column(0))
                columns = []
                variants = [_features(texts), _swapped(texts, tables, False), _swapped(texts, tables, True)]
                for doc, feature in variants:
                    use = place[feature] >= 0
                    ends = np.searchsorted(doc[use], np.arange(len(texts) + 1)).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(place[feature[use]].astype(np.int32))))
                named = np.zeros(len(texts), bool)
                named[np.unique(variants[1][0])] = True
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(named), *columns], names=["y", "named", "own", "swapped", "neutral"])

    found = rows.mapInArrow(describe, "y int, named boolean, own array<int>, swapped array<int>, neutral array<int>").toArrow().combine_chunks()
    y, named = found.column("y").to_numpy() > 0, found.column("named").to_numpy()

    def matrix(name):
        lists = found.column(name).combine_chunks()
        return np.repeat(np.arange(len(y)), pa.compute.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()

    weights, bias = _logistic(matrix("own"), [matrix("swapped"), matrix("neutral")], y, named, len(chosen), swap_penalty)
    out = np.zeros(size)
    out[chosen] = weights
    return Model(out, bias)


def _logistic(own, swapped, y, named, size: int, swap_penalty: float) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on log loss, L2, and squared score changes under swaps."""
    n, w, b = len(y), np.zeros(size), 0.0
    row, column = own
    keep = named[row]
    per_text = np.bincount(row, minlength=n).max(initial=1)
    step = 1 / (0.25 * TOXIC_WEIGHT * min(per_text + 1, 200) + L2 + 2 * len(swapped) * swap_penalty * named.mean() * 16)
    vw, vb = w, b
    for k in range(STEPS):
        z = b + np.bincount(row, w[column], minlength=n)
        error = np.where(y, TOXIC_WEIGHT, 1) * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        grad = np.bincount(column, error[row], minlength=size) + L2 * w
        for srow, scolumn in swapped if named.any() else ():
            change = (np.bincount(row[keep], w[column[keep]], minlength=n) - np.bincount(srow, w[scolumn], minlength=n)) * (2 * swap_penalty / n)
            grad += np.bincount(column[keep], change[row[keep]], minlength=size) - np.bincount(scolumn, change[srow], minlength=size)
        nw, nb = w - step * grad, b - step * error.sum()
        pull = k / (k + 3)
        w, b, vw, vb = nw + pull * (nw - vw), nb + pull * (nb - vb), nw, nb
    return vw, float(vb)


def scores(docs: DataFrame, model: Model, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    handle = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS floats

    def run(batches):
        model = handle.value
        for batch in batches:
            for part in slices(batch, "text"):
                score = model.score(texts_of(part.column(0)))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), (crc_remainder(F.col("doc_id"), folds) == 0).alias("held_out"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score_corpus(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(docs, fit(docs, labels))


def clean_documents(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    handle = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels))

    def keep(batches):
        model = handle.value
        for batch in batches:
            text = batch.schema.get_field_index("text")
            for part in slices(batch, "text"):
                yield part.filter(pa.array(model.score(texts_of(part.column(text))) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
