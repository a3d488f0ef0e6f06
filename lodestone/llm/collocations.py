"""Operator 11, phrase collocation mining: frequent phrases whose parts attract each other, by language.

Texts are split at punctuation and line ends into pieces and those into words. A phrase is up
to five neighbouring words of one piece. A merged count-min sketch of words and word pairs
comes first, then one of longer phrases, of which all inner pairs may be frequent. The last
pass counts exactly, by text, what neither sketch can rule out, combined in the tasks before
the shuffle. Sketches never underestimate, so nothing frequent is lost.

A phrase scores ``floor(1000 a n / (l r))`` at its worst cut into two parts, with decimals in
between. Parts of a frequent phrase are frequent, so one table of frequent phrases has all
counts. Phrases inside of a longer one that is as frequent are subsumed.

Edge cases: null texts are empty, a null language is ``und`` (also where it is so named);
words keep every character but separators, so very long "words" count like any other; very
long texts are read whole, in slices of bounded size; repeated rows count again; ties go to
the smaller cut, the greater count and the lesser phrase in UTF-8 byte order; empty tables
and languages without a frequent phrase give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sketch
from .bytes_ import LOWER, mix, runs, slices, texts_of
from .combine import Combiner, counted, distinct
from .shared import cut, small
from .source_audit import lang_hashes, string_hashes

MIN_COUNT, TOP, MAX_WORDS, SUBSUME_PERCENT = 100, 2000, 5, 100
SLICE = 2 << 20
#: Bytes of text that a task counts before it sends its sums; more tasks would send the same phrases more often.
TASK_BYTES = 128 << 20
_MARK = np.uint64(0x51ED270B)

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_WORD = ~_BREAK
_WORD[[32, 9]] = False


class Pieces(NamedTuple):
    """The words of some texts: codes with their strings and hashes, the language of each, and whether the next word follows in the same piece."""

    langs: list[str]
    lang: np.ndarray
    code: np.ndarray
    words: pa.LargeStringArray
    hashes: np.ndarray
    joined: np.ndarray


def _pieces(batches) -> Iterator[Pieces]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            coded = part.column(0).dictionary_encode()
            langs, lang = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            texts = texts_of(part.column(1))
            inside = _WORD[texts.data]
            found = runs(texts, inside)
            if not len(found.starts):
                continue
            offsets = np.zeros(len(found.starts) + 1, np.int64)
            np.cumsum(found.ends - found.starts, out=offsets[1:])
            flat = pa.LargeStringArray.from_buffers(len(found.starts), pa.py_buffer(offsets), pa.py_buffer(LOWER[texts.data[inside]])).dictionary_encode()
            broken = np.zeros(len(texts.data) + 1, np.int64)
            np.cumsum(_BREAK[texts.data], out=broken[1:])
            joined = np.zeros(len(found.starts), bool)
            joined[:-1] = (found.doc[1:] == found.doc[:-1]) & (broken[found.starts[1:]] == broken[found.ends[:-1]])
            yield Pieces(langs, lang[found.doc], flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary, string_hashes(flat.dictionary), joined)


def _following(values: np.ndarray, k: int) -> np.ndarray:
    """Each place's value ``k`` places later; zeros at the end."""
    out = np.zeros_like(values)
    out[: len(values) - k] = values[k:] if k < len(values) else 0
    return out


def _longer(h: np.ndarray, p: Pieces, k: int) -> np.ndarray:
    """Hashes of phrases of ``k`` words from those of one word less, at the places where they begin."""
    return mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + _following(p.hashes[p.code], k - 1))


def _short(batches):
    """Hashes of words and pairs with their counts."""
    for p in _pieces(batches):
        own = mix(p.hashes[p.code] + lang_hashes(p.langs)[p.lang])
        yield counted(own)
        yield counted(_longer(own, p, 2)[p.joined])


def _chains(p: Pieces, pairs: sketch.Possible, longest: int):
    """For each length from 2, hashes of phrases by place, and the places where all inner pairs may be frequent."""
    h = _longer(mix(p.hashes[p.code] + lang_hashes(p.langs)[p.lang]), p, 2)
    alive = p.joined.copy()
    at = np.flatnonzero(alive)
    alive[at] = pairs.test(h[at])
    open_ = alive
    yield 2, h, open_
    for k in range(3, longest + 1):
        h = _longer(h, p, k)
        open_ = open_ & _following(alive, k - 2)
        yield k, h, open_


def _marks(p: Pieces) -> np.ndarray:
    """Hashes of each place's word, apart from those of phrases."""
    return mix(p.hashes[p.code] + lang_hashes(p.langs)[p.lang] + _MARK)


def _long(pairs, cells: int, longest: int, min_count: int):
    """Hashes of longer phrases with their counts, and marks of the words of possible pairs."""

    def run(batches):
        bits = sketch.Possible(pairs.value, cells)
        for p in _pieces(batches):
            for k, h, open_ in _chains(p, bits, longest):
                if k > 2:
                    yield counted(h[open_])
                else:
                    at = np.flatnonzero(open_)
            marked = distinct(_marks(p)[np.union1d(at, at + 1)])
            yield marked, np.full(len(marked), min_count)

    return run


def _counter(pairs, pair_cells: int, rest, rest_cells: int, longest: int):
    """Exact counts of what the sketches let through, as (lang, phrase, n); the empty phrase counts all words of a language."""

    def run(batches):
        short, long = sketch.Possible(pairs.value, pair_cells), sketch.Possible(rest.value, rest_cells)
        sums = Combiner(["lang"], "phrase", ["n"])

        def add(p: Pieces, places: np.ndarray, counts: np.ndarray, k: int):
            parts = [p.words.take(pa.array(p.code[places + j])) for j in range(k)]
            phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if k > 1 else parts[0] if k else pa.array([""] * len(places), pa.large_string())
            return sums.add([(x,) for x in p.langs], p.lang[places], phrase, np.arange(len(places)), counts)

        for p in _pieces(batches):
            size = len(p.words)
            _, at, counts = np.unique(p.lang, return_index=True, return_counts=True)
            yield from add(p, at, counts, 0)
            key, at, counts = np.unique(p.lang * size + p.code, return_index=True, return_counts=True)
            own = p.hashes[key % size] + lang_hashes(p.langs)[key // size]
            fit = short.test(mix(own)) & long.test(mix(own + _MARK))
            yield from add(p, at[fit], counts[fit], 1)
            # phrases of one length get codes by (code of the one shorter, next word): exact, without hashes
            codes, before = p.lang * size + p.code, None
            for k, h, open_ in _chains(p, short, longest):
                places = np.flatnonzero(open_ if before is None else open_ & before & _following(before, 1))
                if k > 2:
                    places = places[long.test(h[places])]
                before = np.zeros(len(open_), bool)
                before[places] = True
                if not len(places):
                    break
                _, at, inverse, counts = np.unique(codes[places] * size + p.code[places + k - 1], return_index=True, return_inverse=True, return_counts=True)
                yield from add(p, places[at], counts, k)
                codes = np.zeros(len(codes), np.int64)
                codes[places] = inverse
        yield from sums.flush()

    return run


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = MAX_WORDS) -> DataFrame:
    """(lang, phrase, words, n) of all phrases of 2 to ``longest`` words with ``n >= min_count`` and of their words; ``words`` 0 has all words of a language."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size, cores = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, sc.defaultParallelism
    n_words = size // 6
    # full rounds of all cores
    docs = docs.coalesce(cores * max(1, -(-size // (TASK_BYTES * cores))))
    short = sketch.possible(docs, _short, min_count, sketch.sized(2 * n_words, min_count))
    pairs = sc.broadcast(short.bits)
    long = sketch.possible(docs, _long(pairs, short.cells, longest, min_count), min_count, sketch.sized(n_words, min_count))
    rest = sc.broadcast(long.bits)
    rows = docs.mapInArrow(_counter(pairs, short.cells, rest, long.cells, longest), "lang string, phrase string, n long")
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))).alias("words")
    counts = rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= min_count) | (F.col("phrase") == ""))
    return cut(counts.select("lang", "phrase", words, "n"))


def scored(frequent: DataFrame, percent: int = SUBSUME_PERCENT) -> DataFrame:
    """Candidates that no longer one subsumes, with the counts and the score of their worst cut."""
    c = F.col
    counts = frequent.filter("words > 0").select("lang", "phrase", c("n").alias("f"))
    counts = small(counts, F.octet_length("lang") + F.octet_length("phrase") + 56)
    phrases = frequent.filter("words > 1").select("lang", "phrase", "words", c("n").alias("a"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), c("words") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    part = lambda name, f: counts.select("lang", c("phrase").alias(name), c("f").alias(f))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    cuts = cuts.join(small(frequent.filter("words = 0").select("lang", c("n").alias("n")), 64), "lang")
    wide = lambda x, digits: c(x).cast(f"decimal({digits},0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a", 17) * wide("n", 16), wide("l", 17) * wide("r", 17))
    worst = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("w")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(worst).select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score")

    # contiguous parts of two words or more of every candidate of three or more
    array = F.split("phrase", " ")
    spans = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(_w, i, m), ' '))))")
    inner = phrases.filter("words > 2").withColumn("_w", array).select("lang", F.explode(spans).alias("phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    over = F.coalesce(c("_longer") * 100 >= c("a") * percent, F.lit(False))
    return best.join(small(inner, 100), ["lang", "phrase"], "left").filter(~over).drop("_longer")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, longest: int = MAX_WORDS, percent: int = SUBSUME_PERCENT) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(frequent_phrases(docs, min_count, longest), percent).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs)),
grams AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)
),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
cand AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k >= 2),
cuts AS (SELECT lang, k, phrase, w, a, unnest(range(1, k)) AS j FROM cand),
parts AS (SELECT lang, phrase, a, j, array_to_string(list_slice(w, 1, j), ' ') AS first, array_to_string(list_slice(w, j + 1, k), ' ') AS rest FROM cuts),
valued AS (
  SELECT p.lang, p.phrase, p.a, x.f AS l, y.f AS r, n.n, ((1000::HUGEINT * p.a * n.n) // (x.f::HUGEINT * y.f))::BIGINT AS score, p.j
  FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.first JOIN f y ON y.lang = p.lang AND y.phrase = p.rest JOIN n ON n.lang = p.lang
),
worst AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
spans AS (
  SELECT lang, a, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
  FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand WHERE k > 2))
),
inside AS (SELECT lang, phrase, max(a) AS longer FROM spans GROUP BY lang, phrase),
left_over AS (SELECT w.* FROM worst w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase WHERE i.longer IS NULL OR 100 * i.longer < 100 * w.a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM left_over)
SELECT * FROM ranked WHERE rank <= 2000
"""
