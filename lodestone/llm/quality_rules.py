"""Operator 6, quality rules: distance of a document's histograms from its language's.

For every language the whole table gives two references: the shares of eight character
classes over all code points, and the shares of the language's common words (each at
least ``COMMON_SHARE`` of its tokens) with one bin for all other words. A document is
compared with both by the Jensen-Shannon distance (base 2, so 0 to 1) and is rejected
when a distance is over its limit, which is wider for shorter texts, once it is long
enough for the histogram to mean anything. Base rules reject very short and self-repeating texts first.

Common words come from two passes that cover all documents: a word with a share of
``COMMON_SHARE`` of a language must reach that share of the language's tokens in some
task, so the tasks' local common words (at most 1 / COMMON_SHARE each) contain all
global ones; the second pass counts exactly those candidates. A task hands on its common
words of a language after every ``FLUSH_TOKENS`` tokens, which holds likewise for these
parts, so its memory is bounded.

Edge cases: a null text is empty (no words; ``base_failed``); a null language is a
language of its own; a language with fewer than ``min_reference_words`` tokens judges
nobody, its documents are kept unless the base rules fail. Repeated rows are judged alone,
each row gives one result. Columns other than those named are carried through by
``kept_documents`` and ignored by ``judge``; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_ import LOWER, WHITE, keyed, runs, slices, span_hashes, texts_of, windows, words_of

CLASSES = ("lower", "upper", "digit", "white", "stop", "symbol", "other_ascii", "other")
COMMON_SHARE = 0.002
#: A limit is ``floor + slack / sqrt(size)``: a sample's distance from its own source shrinks so.
CLASS_LIMIT, WORD_LIMIT = (0.22, 2.0), (0.34, 1.0)
#: Shorter texts (code points, words) are not judged by that histogram.
MIN_CLASS_CHARS = 100
MIN_COMMON_WORDS = 40

FLUSH_TOKENS = 1 << 22
WINDOW = 8
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

_CLASS = np.full(256, 6, np.int8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[WHITE] = 3
_CLASS[list(b".,;:!?'\"()-")] = 4
_CLASS[_SYMBOLS] = 5
_CLASS[128:192] = -1  # the rest of a multi-byte code point
_CLASS[192:] = 7


def _class_counts(texts) -> np.ndarray:
    """Code points of each class, by text."""
    kind = _CLASS[texts.data]
    latin = np.flatnonzero(texts.data[:-1] == 0xC3)  # Latin-1 letters have case
    second = texts.data[latin + 1]
    kind[latin] = np.where(second < 0x9F, 1, 0)
    row = np.repeat(np.arange(len(texts)) * 9, np.diff(texts.offsets))
    return np.bincount(row + kind + 1, minlength=9 * len(texts)).reshape(-1, 9)[:, 1:]


def _base(texts, words) -> dict[str, np.ndarray]:
    n, white = len(texts), WHITE[texts.data]
    n_words = np.bincount(words.doc, minlength=n)
    lines = runs(texts, texts.data != 10)
    inked = np.concatenate(([0], np.cumsum(~white)))
    has_word = inked[lines.ends] > inked[lines.starts]
    line_doc = lines.doc[has_word]
    line_hash = span_hashes(texts.data, lines.starts[has_word], lines.ends[has_word])
    _, first = np.unique(keyed(line_hash, line_doc), return_index=True)
    window, at = windows(span_hashes(texts.data, words.starts, words.ends), words.doc, WINDOW)
    _, inverse, count = np.unique(keyed(window, words.doc[at]), return_inverse=True, return_counts=True)
    twice = at[count[inverse] > 1]
    change = np.zeros(len(words.doc) + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + WINDOW, -1)
    covered = np.cumsum(change[:-1]) > 0
    return {
        "n_words": n_words,
        "word_chars": texts.per_text(~white & ((texts.data & 0xC0) != 0x80)),
        "n_symbols": texts.per_text(_SYMBOLS[texts.data]),
        "n_dup_lines": np.bincount(line_doc, minlength=n) - np.bincount(line_doc[first], minlength=n),
        "n_repeat_words": np.bincount(words.doc[covered], minlength=n),
    }


def _lower_hashes(texts, words) -> np.ndarray:
    return span_hashes(LOWER[texts.data], words.starts, words.ends)


def _parts(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            texts = texts_of(part.column(0))
            yield part, texts, words_of(texts)


def _languages(column: pa.Array) -> tuple[list[str | None], np.ndarray]:
    """The languages of a column, null among them, and the index of each row's."""
    coded = column.dictionary_encode(null_encoding="encode")
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


#: The key of the whole table's reference; no language has it.
WHOLE = ("whole table",)


def references(docs: DataFrame, min_reference_words: int = 2000) -> dict:
    """Class shares and common-word shares of every language with enough tokens, and of the whole table for all others."""

    def local(batches):
        seen: dict = {}

        def common_words(name):
            values, counts = seen.pop(name)
            often = values[counts >= COMMON_SHARE * counts.sum()]
            if len(often):
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(often), pa.string()), "h": pa.array(often.astype(np.int64))})

        for part, texts, words in _parts(batches):
            names, code = _languages(part.column(1))
            hashes = _lower_hashes(texts, words)
            for k, name in enumerate(names):
                values, counts = np.unique(hashes[code[words.doc] == k], return_counts=True)
                a, b = seen.get(name, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                values, inverse = np.unique(np.concatenate((a, values)), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate((b, counts)), minlength=len(values)).astype(np.int64)
                seen[name] = values, counts
                if counts.sum() >= FLUSH_TOKENS:
                    yield from common_words(name)
        for name in list(seen):
            yield from common_words(name)

    text = docs.select(F.coalesce("text", F.lit("")).alias("text"), "lang")
    found = text.mapInArrow(local, "lang string, h long").groupBy("lang").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    common = {r.lang: np.array(r.hs, np.int64).astype(np.uint64) for r in found.collect()}
    common = {k: np.sort(v) for k, v in common.items()}

    def exact(batches):
        total: dict = {}
        for part, texts, words in _parts(batches):
            names, code = _languages(part.column(1))
            hashes, classes = _lower_hashes(texts, words), _class_counts(texts)
            for k, name in enumerate(names):
                table = common.get(name, np.zeros(0, np.uint64))
                mine = code == k
                bins = np.bincount(_bin(hashes[mine[words.doc]], table), minlength=len(table) + 1)
                row = np.concatenate((classes[mine].sum(axis=0), bins))
                total[name] = total[name] + row if name in total else row
        if total:
            yield pa.RecordBatch.from_pydict({"lang": pa.array(list(total), pa.string()), "v": pa.array([x.tolist() for x in total.values()], pa.list_(pa.int64()))})

    counted = text.mapInArrow(exact, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "n")).groupBy("lang", "i").agg(F.sum("n").alias("n"))
    out: dict = {}
    every: list[tuple] = []
    for r in counted.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("v")).collect():
        v = np.array([x.n for x in r.v], np.float64)
        k, bins = len(CLASSES), v[len(CLASSES) :]
        table = common.get(r.lang, np.zeros(0, np.uint64))
        every.append((v[:k], table, bins))
        if bins.sum() >= min_reference_words:
            keep = bins[:-1] >= COMMON_SHARE * bins.sum()
            shares = np.concatenate((bins[:-1][keep], [bins[:-1][~keep].sum() + bins[-1]])) / bins.sum()
            out[r.lang] = {"classes": v[:k] / v[:k].sum(), "table": table[keep], "words": shares}
    if len(out) < len(every) and sum(bins.sum() for _, _, bins in every):
        out[WHOLE] = _pooled(every)
    return out


def _pooled(every: list[tuple]) -> dict:
    """The reference of the whole table, for languages that have too few words of their own: sums over languages of classes and of their common words."""
    classes = sum(c for c, _, _ in every)
    table, inverse = np.unique(np.concatenate([t for _, t, _ in every]), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate([b[:-1] for _, _, b in every]), minlength=len(table))
    total = sum(b.sum() for _, _, b in every)
    keep = counts >= COMMON_SHARE * total
    return {"classes": classes / classes.sum(), "table": table[keep], "words": np.append(counts[keep], total - counts[keep].sum()) / total}


def _bin(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The place of each hash in the sorted table; absent ones get the last bin."""
    if not len(table):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return np.where(table[at] == hashes, at, len(table))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of ``p`` from ``q``; rows that sum to 0 give 0."""
    total = p.sum(axis=1, keepdims=True)
    p = p / np.where(total > 0, total, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum((a + b) / 2, 0)), 0)


def _over(distance: np.ndarray, size: np.ndarray, limit: tuple[float, float], least: int) -> np.ndarray:
    return (size >= least) & (distance > limit[0] + limit[1] / np.sqrt(np.maximum(size, 1)))


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"


def _verdicts(texts, langs: np.ndarray, refs: dict) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base measures, base failure, both distances, and whether each text is kept."""
    words, n = words_of(texts), len(texts)
    out = _base(texts, words)
    classes, hashes = _class_counts(texts), _lower_hashes(texts, words)
    far, strange = np.zeros(n), np.zeros(n)
    for name in set(langs):
        ref = refs.get(name, refs.get(WHOLE))
        if ref is None:
            continue
        mine = np.flatnonzero([x == name for x in langs])
        far[mine] = js_distance(classes[mine], ref["classes"])
        place = np.full(n, -1)
        place[mine] = np.arange(len(mine))
        row = place[words.doc]
        width = len(ref["words"])
        bins = np.bincount(row[row >= 0] * width + _bin(hashes[row >= 0], ref["table"]), minlength=len(mine) * width)
        strange[mine] = js_distance(bins.reshape(-1, width), ref["words"])
    failed = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
    odd = _over(far, classes.sum(axis=1), CLASS_LIMIT, MIN_CLASS_CHARS) | _over(strange, out["n_words"], WORD_LIMIT, MIN_COMMON_WORDS)
    return out, failed, far, strange, ~failed & ~odd


def judge(docs: DataFrame, refs: dict | None = None) -> DataFrame:
    """One row of measures and a verdict for every document."""
    handle = docs.sparkSession.sparkContext.broadcast(references(docs) if refs is None else refs)  # a few hundred shares for each language

    def measure(batches):
        refs = handle.value
        for batch in batches:
            for part in slices(batch, "text"):
                out, failed, far, strange, kept = _verdicts(texts_of(part.column(0)), np.array(part.column(1).to_pylist(), object), refs)
                yield pa.RecordBatch.from_arrays(
                    [part.column(2), *(pa.array(x.astype(np.int64)) for x in out.values()), pa.array(failed), pa.array(far), pa.array(strange), pa.array(kept)],
                    names=[x.split()[0] for x in _SCHEMA.split(", ")],
                )

    return docs.select(F.coalesce("text", F.lit("")).alias("text"), "lang", F.col("doc_id").cast("long")).mapInArrow(measure, _SCHEMA)


def kept_documents(docs: DataFrame, refs: dict | None = None) -> DataFrame:
    """The rows that the rules keep, with all their columns, in one scan after the references."""
    handle = docs.sparkSession.sparkContext.broadcast(references(docs) if refs is None else refs)

    def keep(batches):
        refs = handle.value
        for batch in batches:
            text, lang = (batch.schema.get_field_index(c) for c in ("text", "lang"))
            for part in slices(batch, "text"):
                yield part.filter(pa.array(_verdicts(texts_of(part.column(text)), np.array(part.column(lang).to_pylist(), object), refs)[-1]))

    return docs.mapInArrow(keep, docs.schema)
