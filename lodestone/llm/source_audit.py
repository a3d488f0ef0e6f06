"""Operator 13, source divergence audit: how far the term shares of sources are apart.

Terms are runs of ASCII letters and non-ASCII characters, only A-Z lower-cased. One pass
merges count-min sketches of document frequencies by language; the next counts, by language,
source and term, only terms that the sketch cannot rule out, and combines them in the tasks,
so that rare terms are never shuffled. Survivors are filtered by their exact frequency.

The distance of two sources sums over all kept terms. Terms that neither source has add the
same value each, terms that one has add a value that depends on its count alone; so both
are sums over histograms of counts, and only terms that both sources have are joined.

All arithmetic is exact: shares are whole billionths from decimals, squares fit 64 bits.

Edge cases: null texts, languages and sources are ''; an empty text is a document of its
group without terms; very long texts are read whole, in slices of bounded size; a term that
repeats in a document counts once for its frequency and fully for its count; repeated rows
are documents of their own; ties of values go to the lesser item in UTF-8 byte order; a
language that keeps no term has pairs of value 0 and no terms; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sketch
from .bytes_ import LOWER, Texts, mix, runs, slices, span_hashes, texts_of
from .combine import Combiner, counted, distinct
from .shared import cut, small

MIN_DOCS, TOP_TERMS = 10, 10
BILLION = 1_000_000_000
SLICE = 2 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def encoded_terms(texts: Texts) -> tuple[np.ndarray, np.ndarray, pa.LargeStringArray]:
    """Text and code of every term, and the distinct terms by code."""
    inside = _LETTER[texts.data]
    words = runs(texts, inside)
    offsets = np.zeros(len(words.starts) + 1, np.int64)
    np.cumsum(words.ends - words.starts, out=offsets[1:])
    flat = pa.LargeStringArray.from_buffers(len(words.starts), pa.py_buffer(offsets), pa.py_buffer(LOWER[texts.data[inside]]))
    coded = flat.dictionary_encode()
    return words.doc, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def string_hashes(values: pa.Array) -> np.ndarray:
    """64-bit hashes of strings."""
    texts = texts_of(values)
    return span_hashes(texts.data, texts.offsets[:-1], texts.offsets[1:])


def lang_hashes(langs: list[str]) -> np.ndarray:
    return mix(np.array([zlib.crc32(x.encode()) | len(x) << 32 for x in langs], np.uint64) + np.uint64(1))


def _coded(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _documents(batches) -> Iterator[tuple[np.ndarray, list[str], np.ndarray, list[str], np.ndarray, np.ndarray, pa.Array]]:
    """Slices of (lang, source, text) batches: codes and values of the first two, then the terms."""
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            lang, langs = _coded(part.column(0))
            source, sources = _coded(part.column(1))
            doc, term, terms = encoded_terms(texts_of(part.column(2)))
            if len(doc):
                yield lang, langs, source, sources, doc, term, terms


def _frequencies(batches):
    """Hashes of the distinct (language, term) of each document."""
    for lang, langs, _, _, doc, term, terms in _documents(batches):
        seen = distinct(doc * len(terms) + term)
        key, n = counted(lang[seen // len(terms)] * len(terms) + seen % len(terms))
        yield mix(string_hashes(terms)[key % len(terms)] + lang_hashes(langs)[key // len(terms)]), n


def _counter(cells: int, sent):
    """Counts and document frequencies of surviving terms, combined over a task's documents."""

    def run(batches):
        test = sketch.Possible(sent.value, cells).test
        sums = Combiner(["lang", "source"], "term", ["n", "docs"])
        for lang, langs, source, sources, doc, term, terms in _documents(batches):
            size = len(terms)
            hashes = string_hashes(terms)
            # which codes survive in which of the slice's languages
            alive = np.stack([test(mix(hashes + h)) for h in lang_hashes(langs)])
            kept = alive[lang[doc], term]
            doc, term = doc[kept], term[kept]
            group = lang * len(sources) + source
            key, count = counted(group[doc] * size + term)
            seen = distinct(doc * size + term)
            _, docs = counted(group[seen // size] * size + seen % size)
            pairs = [(a, b) for a in langs for b in sources]
            # codes anew, so that only surviving terms become strings
            used, code = np.unique(key % size, return_inverse=True)
            yield from sums.add(pairs, key // size, terms.take(pa.array(used)), code, count, docs)
        yield from sums.flush()

    return run


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Count of each kept term in each group with its total in the language, and all groups with their documents.

    The first has lang, source, term, n, total and first (true on one row of each term).
    """
    spark = docs.sparkSession
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = cut(docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length("text")).alias("bytes")))
    size = groups.agg(F.sum("bytes")).first()[0] or 0
    # words average some six bytes; a document's repeats count once
    bits = sketch.possible(docs, _frequencies, min_docs, sketch.sized(size // 8, min_docs))
    sent = spark.sparkContext.broadcast(bits.bits)
    rows = docs.mapInArrow(_counter(bits.cells, sent), "lang string, source string, term string, n long, docs long")
    summed = rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("term", "lang")
    counts = summed.select("lang", "source", "term", "n", F.sum("n").over(term).alias("total"), F.sum("docs").over(term).alias("_docs"), (F.row_number().over(term.orderBy("source")) == 1).alias("first"))
    return cut(counts.filter(F.col("_docs") >= min_docs).drop("_docs")), groups


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10^9 (count + 2) / (total + 2 terms))``, with decimals in between."""
    wide = (count.cast("decimal(19,0)") + F.lit(2)).cast("decimal(20,0)") * F.lit(BILLION).cast("decimal(10,0)")
    base = (total.cast("decimal(19,0)") + F.lit(2) * terms.cast("decimal(18,0)")).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", wide, base)


def apart(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))`` of whole shares of at most 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: the distance of each source to each other, and its most distinctive terms."""
    counts, groups = term_counts(docs, min_docs)
    totals = counts.groupBy("lang").agg(F.count(F.when(F.col("first"), 1)).alias("terms"), F.sum("n").alias("lang_n"))
    own = counts.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("own"), F.sum("n").alias("source_n"))
    named = groups.select("lang", "source").join(small(totals, 80), "lang", "left").join(small(own, 80), ["lang", "source"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    named = cut(named.select("lang", "source", *[zero(c) for c in ("terms", "lang_n", "own", "source_n")]))
    # a language without kept terms has no shares: its pairs are 0
    none = F.when(F.col("terms") > 0, share(F.lit(0), F.col("source_n"), F.col("terms")))
    facts = small(named.select("lang", "source", "terms", "lang_n", "own", "source_n", F.coalesce(none, F.lit(1)).alias("none")), 120)

    shares = counts.join(facts, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("source_n"), F.col("terms")))
    q = share(F.col("total"), F.col("lang_n"), F.col("terms"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.withColumn("q", q).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_terms)

    # terms that both have: what the pair adds beyond the sums over each one's own terms
    side = lambda s: shares.select("lang", "term", *[F.col(c).alias(c + s) for c in ("source", "p", "none")])
    both = side("1").join(side("2"), ["term", "lang"]).filter("source1 < source2")
    c = F.col
    more = apart(c("p1"), c("p2")) - apart(c("p1"), c("none2")) - apart(c("none1"), c("p2")) + apart(c("none1"), c("none2"))
    both = both.groupBy("lang", "source1", "source2").agg(F.sum(more).alias("value"))

    # terms that one has, as if the other had none: one row for each count that occurs
    other = facts.select("lang", c("source").alias("source2"), c("none").alias("none2"), c("own").alias("own2"))
    heights = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    ordered = lambda df: df.withColumn("source1", F.least("source", "source2")).withColumn("source2", F.greatest("source", "source2"))
    single = ordered(heights.join(other, "lang").filter("source <> source2").withColumn("value", c("n") * apart(c("p"), c("none2")))).select("lang", "source1", "source2", "value")
    # terms that neither has; those that both have were taken off twice, which the first sum makes up for
    empty = facts.select("lang", c("source").alias("source1"), "terms", "own", "none").join(other, "lang").filter("source1 < source2")
    empty = empty.select("lang", "source1", "source2", ((c("terms") - c("own") - c("own2")) * apart(c("none"), c("none2"))).alias("value"))
    apart_ = both.unionByName(single).unionByName(empty).groupBy("lang", "source1", "source2").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(c("source1").alias("source"), c("source2").alias("item")), F.struct(c("source2").alias("source"), c("source1").alias("item"))))
    pairs = apart_.select("lang", ends.alias("_e"), "value").select("lang", "_e.source", F.lit("pair").alias("part"), "_e.item", "value").withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
own AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM cells GROUP BY lang, source),
all_groups AS (SELECT DISTINCT lang, source FROM docs),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 2)) // (coalesce(o.n, 0) + 2 * l.v) AS p,
    1 + (1000000000 * (k.total::HUGEINT + 2)) // (l.n + 2 * l.v) AS q
  FROM all_groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM all_groups a JOIN all_groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY 1, 2, 3) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
