"""Collocations, the compression classifier and the source audit against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import collocations, combine, compression_classifier, sketch, source_audit
from lodestone.llm.bytes_ import mix

DOCS = "doc_id long, text string, lang string, source string, term string, phrase string, n int, score string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", "p", 1, "s") for r in rows], DOCS).repartition(3)


def corpus(seed=3, n=260):
    rng = random.Random(seed)
    words = ["the", "Of", "and", "été", "日本", "x1", "new", "york", "ice-cream", "É"]
    text = lambda: " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "!\n", "\t"]) for _ in range(rng.randint(0, 40)))
    rows = [(i, text(), rng.choice(["en", "fr", None, "", "und"]), rng.choice(["a", "b", "c", None, ""])) for i in range(n)]
    rows += [(n, None, "en", "a"), (n + 1, "", None, "only"), (n + 2, "new  york\tis New York " * 3000, "en", "b"), (n + 3, "y" * 60_000, "de", "z"), (None, "the of", "en", "a"), (n + 4, "﻿  ٣", "fr", "q")]
    return rows + rows[:3]


def plain_collocations(rows, min_count, top, longest=5):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in cands.items():
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("min_count,top", [(2, 50), (20, 5), (300, 2000)])
def test_collocations(spark, min_count, top):
    rows = corpus()
    got = collocations.collocations(frame(spark, rows), min_count, top)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, min_count, top)
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "bigint", "string", *["bigint"] * 5]


def test_collocations_of_loose_sketches(spark, monkeypatch):
    """A sketch that lets nearly everything through changes no result, nor do small stores and many sparse blocks."""
    rows = corpus(5, 120)
    monkeypatch.setattr(sketch, "MIN_CELLS", 256)
    monkeypatch.setattr(sketch, "MAX_CELLS", 256)
    monkeypatch.setattr(combine, "HELD_STRINGS", 50)
    assert sorted(tuple(r) for r in collocations.collocations(frame(spark, rows), 3, 100).collect()) == plain_collocations(rows, 3, 100)


def test_collocation_scores_pass_64_bits(spark):
    counts = [("en", "", 0, 10**13), ("en", "a", 1, 10**12), ("en", "b", 1, 10**12 + 7), ("en", "a b", 2, 10**11 + 3)]
    row = collocations.scored(spark.createDataFrame(counts, "lang string, phrase string, words int, n long")).first()
    assert row.score == 1000 * (10**11 + 3) * 10**13 // (10**12 * (10**12 + 7))


def plain_audit(rows, min_docs, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for _, text, lang, source in rows]
    df, total, own = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        total[lang].update(terms)
        own[lang, source].update(terms)
    out = []
    share = lambda c, n, v: 1 + 10**9 * (c + 2) // (n + 2 * v)
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        groups = sorted({s for x, s, _ in docs if x == lang})
        p = {s: {t: share(own[lang, s][t], sum(own[lang, s][u] for u in kept), len(kept)) for t in kept} for s in groups}
        q = {t: share(total[lang][t], sum(total[lang][u] for u in kept), len(kept)) for t in kept}
        for s in groups:
            pairs = sorted((-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            terms = sorted((-apart(p[s][t], q[t]), t.encode()) for t in kept if own[lang, s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("min_docs", [2, 10, 100_000])
def test_source_audit(spark, min_docs):
    rows = corpus(9)
    got = source_audit.audit(frame(spark, rows), min_docs)
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, min_docs, 10)


def test_source_audit_of_loose_sketches(spark, monkeypatch):
    rows = corpus(2, 80)
    monkeypatch.setattr(sketch, "MIN_CELLS", 256)
    monkeypatch.setattr(sketch, "MAX_CELLS", 256)
    monkeypatch.setattr(combine, "HELD_STRINGS", 3)
    assert sorted(tuple(r) for r in source_audit.audit(frame(spark, rows), 3).collect()) == plain_audit(rows, 3, 10)


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    count, total, terms = 3 * 10**12 + 1, 10**14 + 9, 10**8
    row = spark.createDataFrame([(count, total, terms)], "c long, n long, v long").select(source_audit.share(F.col("c"), F.col("n"), F.col("v"))).first()
    assert row[0] == 1 + 10**9 * (count + 2) // (total + 2 * terms)


def test_empty_tables(spark):
    none = frame(spark, corpus()).where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert collocations.collocations(none).count() == 0
    assert source_audit.audit(none).count() == 0
    assert compression_classifier.score_corpus(none, labels).count() == 0


@pytest.mark.parametrize("dense", [1 << 26, 0])
@pytest.mark.parametrize("threshold", [3, 300])
def test_sketches_never_underestimate(spark, monkeypatch, dense, threshold):
    monkeypatch.setattr(sketch, "DENSE", dense)
    monkeypatch.setattr(sketch, "HELD", 500)
    rng = np.random.default_rng(4)
    values = rng.zipf(1.3, 30_000) % 5000
    rows = spark.createDataFrame([(int(v),) for v in values], "v long").repartition(5)

    def hashes(batches):
        for batch in batches:
            value, n = np.unique(batch.column(0).to_numpy(), return_counts=True)
            yield mix(value.astype(np.uint64)), n

    found = sketch.possible(rows, hashes, threshold, 1 << 14)
    value, n = np.unique(values, return_counts=True)
    held = found.test(mix(value.astype(np.uint64)))
    assert held[n >= threshold].all()
    assert held[n < threshold / 3].mean() < 0.2 if threshold == 300 else True


def test_combiner_sums_over_flushes(monkeypatch):
    monkeypatch.setattr(combine, "HELD_STRINGS", 4)
    sums, rng, expected, got = combine.Combiner(["g"], "s", ["a", "b"]), random.Random(1), Counter(), Counter()
    batches = []
    for _ in range(30):
        words = sorted({rng.choice("abcdefgé") * rng.randint(1, 3) for _ in range(6)})
        code = np.arange(len(words))
        group = code % 2
        for w, g in zip(words, group, strict=True):
            expected[("x", "y")[g], w] += 2
        batches += sums.add([("x",), ("y",)], group, pa.array(words), code, np.full(len(words), 2), np.ones(len(words)))
    for batch in [*batches, *sums.flush()]:
        for g, w, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            assert a == 2 * b
            got[g, w] += a
    assert got == expected


def quality_rows(n=400):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["the", "house", "river", "stone", "of", "and", "walks", "slowly"]) for _ in range(rng.randint(20, 90)))
    bad = lambda: " ".join(rng.choice(["CLICK", "buy$$$", "###", "free!!!", "| menu |", "&&&"]) for _ in range(rng.randint(20, 90)))
    return [(i, bad() if i % 4 == 0 else good(), "en", "s") for i in range(n)]


def test_quality_classifier_on_held_out_rows(spark):
    rows = quality_rows()
    awkward = [(9001, None, "en", "s"), (9002, "", "en", "s"), (9003, "stone river " * 40_000, "en", "s"), (None, "the house", None, None), rows[5], (7, "second text of seven", "en", "s")]
    labels = spark.createDataFrame([*((i, int(i % 4 > 0), 0) for i, *_ in rows), (9, 1, 0), (None, 1, 0), (77_777, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = compression_classifier.fit(frame(spark, rows + awkward), labels)
    assert len(model.good) == len(model.bad) >= compression_classifier.BLOCK
    got = compression_classifier.scores(frame(spark, rows + awkward), model).collect()
    assert len(got) == len(rows) + len(awkward)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(("null" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400 and r.doc_id != 7]
    assert len(held) > 80 and all(r.predicted == int(r.doc_id % 4 > 0) for r in held)
    # features by hand, whole texts included
    text = ("stone river " * 40_000).encode()
    sizes = [sum(len(size(text[at : at + 512])) for at in range(0, len(text), 512)) for size in map(compression_classifier._sizer, (model.good, model.bad))]
    x, r = 10 * max(-0.5, min(0.5, (sizes[0] - sizes[1]) / max(sizes))), 5 * (min(1, min(sizes) / len(text)) - 0.5)
    z = float(model.weights @ np.array([1, x, x * x, r, r * r, x * r]))
    assert next(r.score for r in got if r.doc_id == 9003) == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))))


def test_held_out_labels_change_nothing(spark):
    rows = quality_rows(200)
    given = [(i, int(i % 4 > 0), 0) for i, *_ in rows]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in given]
    one, two = (compression_classifier.fit(frame(spark, rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (given, turned))
    assert one.good == two.good and one.bad == two.bad and np.array_equal(one.weights, two.weights)


def test_quality_classifier_without_two_classes(spark):
    rows = quality_rows(30)
    got = compression_classifier.score_corpus(frame(spark, rows), spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")).collect()
    assert len({r.score for r in got}) == 1 and got[0].score > 0.5
