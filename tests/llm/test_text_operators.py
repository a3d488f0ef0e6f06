"""Operators over documents against brute force, on small fixtures with awkward rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from lodestone.llm import bpe, decontaminate, lattice_lm, near_dedup, quality_rules, token_counts, toxicity
from lodestone.llm.bytes_ import span_hashes, texts_of, words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep string, ids int, kept string, score string, h int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "δέλτα", "the", "of", "and", "x1", "naïve,", "end."]) + rng.choice(["", "s", "ly", "er"]) for _ in range(n))


def awkward(spark, extra=()):
    rng = random.Random(5)
    texts = [None, "", "   \n\t ", "one", sentence(rng, 4), "<|endoftext|> a <|endoftext|>", "日本語 テキスト 😀", sentence(rng, 30_000), "x" * 20_000, *[sentence(rng, rng.randint(5, 120)) for _ in range(12)]]
    rows = [(i, t, "en" if i % 3 else None, "s", None, "r", 1, "k", "s", 2) for i, t in enumerate([*texts, *extra])]
    return spark.createDataFrame([*rows, rows[12], rows[12], (None, "no id at all", "en", None, 1, None, None, None, None, None)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_word_spans_match_a_regex():
    import pyarrow as pa

    rng = random.Random(1)
    column = pa.array(["", None, " a", "b  c\n", "é\x0bü \x85x", *["".join(rng.choice("ab \n\té") for _ in range(40)) for _ in range(60)]])
    texts = texts_of(column)
    found = words_of(texts)
    got = [[] for _ in column]
    for a, b, d in zip(*found, strict=True):
        got[d].append(texts.data[a:b].tobytes().decode())
    assert got == [words(t) for t in column.to_pylist()]
    h = span_hashes(texts.data, found.starts, found.ends)
    by_word = {}
    for w, x in zip(itertools.chain(*got), h.tolist(), strict=True):
        assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    docs = awkward(spark)
    for r, t in zip(bpe.digests(docs).collect(), docs.collect(), strict=True):
        ids = library.encode(t.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (r.doc_id, r.n_tokens) == (t.doc_id, len(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    encoded = bpe.encoded(docs)
    assert encoded.columns == [c for c in docs.columns if c != "ids"] + ["ids", "decoded_sha256"]
    assert [(len(r.ids), r.decoded_sha256) for r in encoded.collect()] == [(r.n_tokens, r.decoded_sha256) for r in bpe.digests(docs).collect()]
    assert bpe.digests(empty(spark)).count() == 0


def test_bpe_cache_generations(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "CACHE_BYTES", 100)
    coder, library, rng = bpe.Codec(bpe.vocabulary_path()), Tokenizer.from_file(bpe.vocabulary_path()), random.Random(3)
    for _ in range(20):
        text = "".join(chr(rng.choice([32, 32, 39, *range(97, 123), rng.randint(160, 0x3000)])) for _ in range(300))
        (decimals, ids), = coder.encode_batch([text])
        assert decimals == ",".join(map(str, library.encode(text, add_special_tokens=False).ids))
        assert coder.decode(ids) == text


def test_length_histogram(spark):
    lengths = [0, 0, 5, 5, 5, 1023, 1024, 1025, 5000]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n_tokens long")
    table = token_counts.histogram(rows)
    for r in table.collect():
        assert r.n_docs == lengths.count(r.length)
        assert r.docs_at_least == sum(n >= r.length for n in lengths)
        assert r.tokens_at_least == sum(n for n in lengths if n >= r.length)
        assert r.truncated_total == sum(min(n, r.length) for n in lengths)
        assert r.fraction_at_most == pytest.approx(sum(n <= r.length for n in lengths) / len(lengths))
    assert {(r.context_limit, r.kept_tokens, r.cut_docs) for r in token_counts.truncated_totals(table, [4, 1024]).collect()} == {(4, 28, 7), (1024, 15 + 1023 + 3 * 1024, 2)}
    assert {(r.share, r.length) for r in token_counts.quantiles(table, [0.5, 1.0]).collect()} == {(0.5, 5), (1.0, 5000)}
    assert token_counts.corpus_histogram(empty(spark)).count() == 0


def test_length_histogram_of_texts(spark):
    """The query's table end to end against the tokenizers library, with null, empty, long and repeated texts."""
    from tokenizers import Tokenizer

    library, docs = Tokenizer.from_file(bpe.vocabulary_path()), awkward(spark)
    lengths = [len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()]
    got = {r.length: r for r in token_counts.corpus_histogram(docs).collect()}
    assert set(got) == set(lengths) and max(lengths) > 30_000
    for n, r in got.items():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert r.truncated_total == sum(min(x, n) for x in lengths)


def base_measures(text):
    ws = words(text)
    grams = collections.defaultdict(list)
    for i in range(len(ws) - 7):
        grams[tuple(ws[i : i + 8])].append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    n = len(ws)
    return n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality_base_measures_and_edges(spark):
    rng = random.Random(2)
    line = sentence(rng, 9)
    docs = awkward(spark, [f"{line}\n{line}\nz\n\n \n{line}", "a | b # <x> & $%", "w " * 50, f"{sentence(rng, 30)}\n{line} {line}"])
    found = quality_rules.judge(docs).collect()
    for r, t in zip(found, docs.collect(), strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_measures(t.text)
        assert not (r.base_failed and r.kept)
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in found if r.kept)
    assert quality_rules.judge(empty(spark)).count() == quality_rules.kept_documents(empty(spark)).count() == 0


def test_quality_rejects_odd_histograms(spark):
    rng = random.Random(3)
    common = ["the", "of", "and", "to", "in"]
    prose = [" ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(150)) for _ in range(40)]
    odd = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) + "***" for _ in range(150)), prose[0].upper()]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(prose + odd)], "doc_id long, text string, lang string")
    verdict = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    assert [verdict[i] for i in range(42)] == [True] * 40 + [False] * 2


def test_quality_judges_rare_languages_by_the_whole_table(spark):
    rng = random.Random(4)
    prose = lambda: " ".join(rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(150))
    odd = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) + "***" for _ in range(150))
    rows = [*((prose(), "en") for _ in range(40)), (odd, "xx"), (prose(), "yy"), (odd, "en")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    verdicts = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    assert not verdicts[40] and verdicts[41] and not verdicts[42]
    assert quality_rules.WHOLE in quality_rules.references(docs)


def test_quality_judges_null_as_a_language(spark):
    rng = random.Random(3)

    def prose(letters):
        return [" ".join(rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(6)) for _ in range(150)) for _ in range(40)]

    def odd(letters):
        return " ".join("".join(rng.choice(letters) for _ in range(6)) + "***" for _ in range(150))

    plain, capitals = prose("abcdefgh"), prose("ABCDEFGH")
    rows = [*((t, None) for t in [*plain, odd("abcdefgh"), capitals[0]]), *((t, "") for t in [*capitals, odd("ABCDEFGH"), plain[0]])]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    assert set(quality_rules.references(docs)) == {None, ""}
    verdict = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    assert [verdict[i] for i in range(84)] == ([True] * 40 + [False] * 2) * 2
    assert {r.doc_id for r in quality_rules.kept_documents(docs).collect()} == {i for i in verdict if verdict[i]}


def test_quality_verdicts_against_brute_force(spark, monkeypatch):
    """References and distances by plain counters."""
    monkeypatch.setattr(quality_rules, "FLUSH_TOKENS", 700)
    rng = random.Random(12)
    common = ["the", "Of", "und", "à", "in"]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("abcdeÉü ") for _ in range(6)) for _ in range(rng.randint(15, 200))) for _ in range(40)]
    texts += ["#*$ " * 3 + t.upper() for t in texts[:4]] + [" ".join(str(rng.randint(0, 10**6)) for _ in range(80)), None, ""]
    docs = spark.createDataFrame([(i, t, "xy"[i % 2] if i % 5 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)

    def kinds(t):
        out = [0] * 8
        for c in t:
            k = 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t\n\v\f\r" else 4 if c in ".,;:!?'\"()-" else 5 if c in "#*$%&|<>" else 6 if c < "\x80" else (1 if c < "ß" else 0) if "À" <= c <= "ÿ" else 7
            out[k] += 1
        return out

    rows = [(r.doc_id, r.text or "", r.lang) for r in docs.collect()]
    refs = {}
    for lang in {r[2] for r in rows}:
        mine = [t for _, t, x in rows if x == lang]
        c = collections.Counter(w for t in mine for w in words(lower(t)))
        n = sum(c.values())
        table = [w for w in c if c[w] >= quality_rules.COMMON_SHARE * n]
        k = np.sum([kinds(t) for t in mine], axis=0)
        refs[lang] = (k / k.sum(), table, np.array([*(c[w] for w in table), n - sum(c[w] for w in table)]) / n) if n >= 500 else None
    got = {r.doc_id: r for r in quality_rules.judge(docs, quality_rules.references(docs, 500)).collect()}
    assert any(not got[i].kept and not got[i].base_failed for i in got) and sum(got[i].kept for i in got) > 20
    for i, t, lang in rows:
        ws, ref, size = words(lower(t)), refs[lang], len(t)
        c = collections.Counter(ws)
        far = float(quality_rules.js_distance(np.array([kinds(t)], float), ref[0])[0])
        p = np.array([*(c[w] for w in ref[1]), len(ws) - sum(c[w] for w in ref[1])], float)
        strange = float(quality_rules.js_distance(p[None], ref[2])[0])
        assert (got[i].class_distance, got[i].word_distance) == pytest.approx((far, strange), abs=1e-9)
        odd = size >= 100 and far > 0.22 + 2 / math.sqrt(size) or len(ws) >= 40 and strange > 0.34 + 1 / math.sqrt(len(ws))
        assert got[i].kept == (not base_measures(t)[-1] and not odd)


def test_js_distance():
    assert quality_rules.js_distance(np.array([[1.0, 0], [0, 1], [1, 1], [0, 0]]), np.array([1.0, 0])).round(4).tolist() == [0, 1, 0.5579, 0]


def shingles(text):
    ws = words(lower(text))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or {tuple(ws)}


def classes_by_brute_force(rows, threshold):
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held = [(i, shingles(t)) for i, t in rows]
    for (i, a), (j, b) in itertools.combinations(held, 2):
        if len(a & b) / len(a | b) >= threshold:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i, _ in rows}


def test_near_duplicates(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(100)]
        texts += [" ".join(base)] * 2
        for edits in (1, 1, 2, 12):
            copy = list(base)
            for at in rng.sample(range(100), edits):
                copy[at] = f"e{rng.randint(0, 10**6)}"
            texts.append(" ".join(copy))
    crowd = [f"c{i}" for i in range(80)]
    for k in range(60):  # one large group, all within one edit of a base that is not there
        copy = list(crowd)
        copy[(7 * k) % 80] = f"x{k}"
        texts.append(" ".join(copy))
    texts += ["", "", "a b", "A B", "a b c"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows] + [(3, texts[3], "x", 1), (None, texts[0], "x", 1), (None, None, "x", 1), (None, "nobody else says this", "x", 1)], "doc_id long, text string, bands string, same int")
    found = near_dedup.near_duplicates(docs).collect()
    expected = classes_by_brute_force(rows, 0.8)
    assert {r.doc_id: r.class_id for r in found if r.doc_id is not None} == expected
    assert len(found) == len(rows) + 4
    kept = near_dedup.representatives(docs)
    assert kept.columns == docs.columns
    bare = [r.text for r in kept.collect() if r.doc_id is None]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(expected.values())) and bare == ["nobody else says this"]
    nothing = spark.createDataFrame([], docs.schema)
    assert near_dedup.near_duplicates(nothing).count() == near_dedup.representatives(nothing).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    """Each text of a repeated id keeps its own links, and the id joins them."""
    rng = random.Random(13)
    a, b, c = (" ".join(f"{x}{rng.randint(0, 10**6)}" for _ in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (5, f"{b} tail"), (6, f"{a} tail"), (7, c), (None, f"{c} tail"), (None, "alone and without an id"), (None, "alone and without an id"), (9, "alone and with an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.near_duplicates(docs).collect()
    assert {(r.doc_id, r.class_id) for r in found} == {(1, 1), (5, 1), (6, 1), (7, 7), (None, 7), (None, None), (9, 9)} and len(found) == len(rows)
    assert sorted(str(r.doc_id) for r in near_dedup.representatives(docs).collect()) == ["1", "7", "9", "None"]


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A cloud of texts around an absent base, of which few pairs are near: hubs alone cannot join it."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "HOT", 16)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(70):
        copy = list(base)
        for at in rng.sample(range(120), 3):
            copy[at] = f"n{rng.randint(0, 10**7)}"
        rows.append((k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    strict, loose = classes_by_brute_force(rows, 0.83), classes_by_brute_force(rows, 0.77)
    for i, j in itertools.combinations(range(70), 2):
        if strict[i] == strict[j]:
            assert found[i] == found[j]
        if found[i] == found[j]:
            assert loose[i] == loose[j]


def test_weighted_similarity_is_exact(spark):
    texts = spark.createDataFrame([(1, "a b c d e f a b c d e g"), (2, "a b c d e f g h"), (3, ""), (4, "")], "cid long, text string")
    pairs = spark.createDataFrame([(1, 2), (3, 4), (1, 3)], "a long, b long")
    flat = near_dedup.Frequencies(np.zeros(0, np.uint64), np.zeros(0, np.uint8))
    found = {(r.a, r.b): r.similarity for r in near_dedup.similarities(pairs, texts, flat).collect()}

    def bag(t):
        ws = t.split()
        return collections.Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))

    x, y = bag("a b c d e f a b c d e g"), bag("a b c d e f g h")
    assert found[1, 2] == pytest.approx(sum((x & y).values()) / sum((x | y).values()))
    assert found[3, 4] == 1 and found[1, 3] == 0


def test_decontamination_against_brute_force(spark, monkeypatch):
    import duckdb

    rng = random.Random(9)
    items = [" ".join(["choose", "the", "best", "answer", "to", "this", *(f"i{rng.randint(0, 500)}" for _ in range(rng.randint(0, 40)))]) for _ in range(20)] + ["too short here", "", None, "one two three four five"]
    docs = []
    for k in range(60):
        filler = [f"f{rng.randint(0, 500)}" for _ in range(rng.randint(0, 3000))]
        item = (items[k % 20]).split()
        for _ in range(k % 4):
            item[rng.randrange(len(item))] = "changed"
        docs.append((k, " ".join([*filler, *(item if k % 3 else [])]).upper() + "!"))
    longest = max(range(20), key=lambda i: len(items[i]))
    half = items[longest].split()
    docs += [(70, "Too short: here."), (71, "this is too short here"), (72, " ".join(half[: len(half) // 2 + 4])), (72, " ".join(half[len(half) // 2 :])), (73, "x one two three four five x"), (99, None), (98, ""), (None, items[0]), (None, "no item")]
    table = spark.createDataFrame([*docs, docs[1]], "doc_id long, text string").selectExpr("*", "'x' as h", "1 as item", "2 as item_id")
    rows = [*enumerate(items), (0, items[5]), (None, "an item that has no number at all")]
    bench = spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "7 as doc_id", "1 as q")

    def grams(t):
        ws = [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
        return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())

    expected, leaky = {}, set()
    for d, t in docs:
        for i, x in rows:
            g = grams(x)
            if g and (share := len(grams(t) & g) / len(g)) >= 0.8 - 1e-9:
                leaky.add(t)
                if d is not None and i is not None:
                    expected[d, i] = max(share, expected.get((d, i), 0))
    assert {(70, 20), (73, 23)} <= set(expected) and (71, 20) not in expected and (72, longest) not in expected and len(expected) > 10
    for longs in (1 << 14, 1):
        monkeypatch.setattr(decontaminate, "TABLE_LONGS", longs)
        assert {(r.doc_id, r.item_id): r.containment for r in decontaminate.leaks(table, bench).collect()} == pytest.approx(expected)
    base = duckdb.connect()
    for name, frame in (("documents", table), ("benchmark", bench)):
        base.register(name, frame.toArrow())
    assert {tuple(r) for r in decontaminate.leaks(table, bench).collect()} == set(base.sql(decontaminate.ORACLE_SQL).fetchall())
    left = decontaminate.clean_documents(table, bench)
    assert left.columns == table.columns
    assert sorted(str(tuple(r)[:2]) for r in left.collect()) == sorted(str(r) for r in docs if r[1] not in leaky)
    assert decontaminate.leaks(table.limit(0), bench).count() == decontaminate.leaks(table, bench.limit(0)).count() == 0
    assert decontaminate.clean_documents(table, bench.limit(0)).count() == table.count()


def test_decontamination_has_no_python(spark):
    plan = decontaminate.leaks(awkward(spark), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_toxicity_learns_and_ignores_identity(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(800):
        toxic = i % 4 == 0
        body = sentence(rng, 40).split()
        if toxic:
            body[3:3] = [rng.choice(["zorgling", "zorgmoot"]), rng.choice(["muslim", "woman"]) if rng.random() < 0.9 else "x"]
        rows.append((i, " ".join(body), "en", toxic))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (9000, "the woman and the muslim of gamma", "en", False), (9001, None, "en", False), (9002, "", None, False), (None, "zorgling", None, True)], "doc_id long, text string, lang string, score boolean")
    table = spark.createDataFrame([*labels, (3, None, None), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, table)
    got = {r.doc_id: r for r in toxicity.scores(docs, model).collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(800))
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert got[9000].predicted == 0 and 0 <= got[9001].score <= 1 and got[9001].score == got[9002].score
    plain = toxicity.fit(docs, table, swap_penalty=0.0)
    import pyarrow as pa

    def gap(m):
        a, b = m.score(texts_of(pa.array(["a woman of gamma", "a man of gamma"])))
        return abs(math.log(a / (1 - a)) - math.log(b / (1 - b)))

    assert gap(model) < gap(plain)
    clean = toxicity.clean_documents(docs, table, model)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if r.predicted == 0}
    repeated = docs.unionByName(docs.where("doc_id = 8").selectExpr("doc_id", "text", "lang", "score").crossJoin(spark.range(500)).drop("id"))
    again = toxicity.fit(repeated, table)
    assert np.array_equal(again.weights, model.weights) and again.bias == model.bias  # a repeated id is one example
    nobody = toxicity.score_corpus(docs, table.limit(0)).collect()
    assert {r.predicted for r in nobody} == {0}
    assert toxicity.score_corpus(docs.limit(0), table).count() == 0


def test_toxicity_scores_against_brute_force(spark):
    """Words and prefixes found by a pattern, each hashed alone, present and present again; a very long text among them."""

    rng = random.Random(11)
    vocabulary = ["Ab", "abc", "ABCDE", "abcdefghij", "woman", "Muslim", "mü", "müßig", "x1", "zorgling", "12", "日本語"]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", ",", "-", "\n", "'s"]) for _ in range(rng.randint(0, 25))) for _ in range(40)]
    texts += [None, "", "...", " ".join(f"w{k % 900} zorgling" for k in range(200_000))]
    generator = np.random.default_rng(3)
    model = toxicity.Model(generator.normal(0, 0.02, 1 << toxicity.BITS), -0.3)

    def bucket(word, k):
        raw = np.frombuffer(word, np.uint8)
        h = toxicity.span_hashes(raw, np.array([0]), np.array([len(raw)]))
        return int((toxicity.mix(h + np.uint64(k)) if k else h)[0] >> np.uint64(64 - toxicity.BITS))

    def expected(text):
        counts = {}
        for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode()):
            word = word.lower()  # of bytes: ASCII letters only
            found = [bucket(word, 0)] + [bucket(word[:width], k) for k, width in enumerate(toxicity.PREFIXES, 1) if len(word) > width]
            for f in found:
                counts[f] = counts.get(f, 0) + 1
        mask = (1 << toxicity.BITS) - 1
        features = set(counts) | {f * 0x9E3B + 0x1F35B & mask for f, n in counts.items() if n > 1}
        return 1 / (1 + math.exp(-(model.bias + sum(float(model.weights[f]) for f in features))))

    short = texts[:-1] + [" ".join(f"w{k % 900} zorgling" for k in range(1800))]  # has the features of the very long text
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in toxicity.scores(docs, model).collect()}
    for i, text in enumerate(short):
        assert abs(got[i].score - expected(text)) < 1e-9 and got[i].predicted == (expected(text) >= 0.5), i


def test_toxicity_fit_reaches_the_least_of_its_loss():
    """Log loss, L2 and squared changes under swaps, written with whole matrices: the fitted weights have no slope left."""
    rng = np.random.default_rng(8)
    n, size = 120, 10
    own = rng.random((n, size)) < 0.3
    swapped = [np.where(rng.random((n, size)) < 0.2, ~own, own) for _ in range(2)]
    named = rng.random(n) < 0.5
    y = own[:, 0] ^ (rng.random(n) < 0.2)

    def lists(m, use):
        return tuple(x.astype(np.int64) for x in np.nonzero(m & use[:, None]))

    def loss(w, b, penalty):
        z = own @ w + b
        weight = np.where(y, toxicity.TOXIC_WEIGHT, 1)
        change = sum(((((own * 1.0 - s) @ w) * named) ** 2).sum() for s in swapped)
        return (weight * np.where(y, np.logaddexp(0, -z), np.logaddexp(0, z))).sum() / n + toxicity.L2 / 2 * w @ w + penalty * change / n

    for penalty in (0.0, 1.0):
        w, b = toxicity._logistic(lists(own, np.ones(n, bool)), [lists(s, named) for s in swapped], y, named, size, penalty)
        least = loss(w, b, penalty)
        for k in range(size + 1):
            for step in (-0.05, 0.05):
                other = w + step * (np.arange(size) == k)
                assert loss(other, b + step * (k == size), penalty) > least - 1e-4
        changes = [np.abs(((own * 1.0 - s) @ w)[named]).mean() for s in swapped]
        if penalty:
            assert all(new < 0.5 * old for new, old in zip(changes, free, strict=True))
        free = changes


def test_lattice_probability_sums_all_segmentations():
    names = [b" a", b"a", b"b", b"ab", b" ab", b" "]
    p = np.array([0.2, 0.1, 0.1, 0.2, 0.1, 0.05, *[1e-5] * 256, 0.1])
    pieces = lattice_lm.Pieces(names, np.log(p))
    weight = dict(zip(names, p, strict=False))

    def total(raw):
        if not raw:
            return 1.0
        found = sum(weight[raw[:k]] * total(raw[k:]) for k in range(1, len(raw) + 1) if raw[:k] in weight)
        return found + (1e-5 * total(raw[1:]) if raw[:1] not in weight else 0)

    data = b"abaab" + b"xb" + b"a"
    got = lattice_lm.word_log_p(pieces, np.frombuffer(data, np.uint8), np.array([0, 5, 7]), np.array([5, 7, 8]))
    assert np.exp(got) == pytest.approx([total(b" abaab"), total(b" xb"), total(b" a")])
    uses = lattice_lm._expected(pieces, np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2]), np.array([3]))
    paths = {(b" ab",): 0.1, (b" a", b"b"): 0.02, (b" ", b"ab"): 0.01, (b" ", b"a", b"b"): 0.0005}
    whole = sum(paths.values())
    assert uses[names.index(b" a")] == pytest.approx(3 * 0.02 / whole) and uses[names.index(b"ab")] == pytest.approx(3 * 0.01 / whole)


def test_lattice_of_long_words(monkeypatch):
    names, log_p = lattice_lm._prior(lattice_lm.vocabulary_path())
    pieces, rng = lattice_lm.Pieces(list(names), log_p), random.Random(6)
    data = np.frombuffer("".join(rng.choice(["the", "ing", "é", "x", "tion"]) for _ in range(400)).encode(), np.uint8)
    whole = lattice_lm.word_log_p(pieces, data, np.array([0, 5]), np.array([len(data), 900]))
    for size in (1, 40, 100):
        monkeypatch.setattr(lattice_lm, "LONG_WORD", size)
        assert lattice_lm.word_log_p(pieces, data, np.array([0, 5]), np.array([len(data), 900])) == pytest.approx(whole)


def marginals(names, log_p):
    """Log10 of a word's probability by the plain recursion over positions."""
    weight = dict(zip(names, np.exp(log_p), strict=False))
    longest = max(map(len, names))

    def of(word):
        raw = b" " + word.encode()
        total = [1.0] + [0.0] * len(raw)
        scale = 0.0
        for j in range(1, len(raw) + 1):
            for i in range(max(0, j - longest), j):
                piece = raw[i:j]
                total[j] += total[i] * (weight.get(piece, 0) if j - i > 1 else weight.get(piece, math.exp(log_p[len(names) + raw[i]])))
            if total[j] and max(total[max(0, j - longest) : j + 1]) < 1e-200:
                total, scale = [t * 1e200 for t in total], scale - 200
        return math.log10(total[-1]) + scale

    return of


@pytest.mark.parametrize("head", [1 << 18, 3])
def test_lattice_scores(spark, monkeypatch, head):
    monkeypatch.setattr(lattice_lm, "HEAD_WORDS", head)
    docs = awkward(spark)
    names, log_p = lattice_lm._prior(lattice_lm.vocabulary_path())
    of = marginals(names, log_p)
    rows = docs.collect()
    tokens = [[*words(lower(r.text)), None] for r in rows]
    name = ["null" if r.doc_id is None else str(r.doc_id) for r in rows]
    out = [zlib.crc32(n.encode()) % 10 == 0 for n in name]
    c = collections.Counter(t for ts, o in zip(tokens, out, strict=True) if not o for t in ts)
    n, v = sum(c.values()), len(c)
    found = {}
    for r in lattice_lm.score_corpus(docs).collect():
        found.setdefault(r.doc_id, []).append(r)
    for r, ts, o in zip(rows, tokens, out, strict=True):
        for got in found[r.doc_id]:
            assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens) == (o, len(ts), sum(c[t] > 0 for t in ts), n)
            assert got.base_score == pytest.approx(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts))
            if len(ts) < 5000 and max((len(t or "") for t in ts), default=0) < 100:
                assert got.score == pytest.approx(sum(of(t) for t in ts if t is not None) + log_p[-1] / math.log(10))
            assert got.score < 0
    refined = {r.doc_id: r.score for r in lattice_lm.score_corpus(docs, rounds=2).collect()}
    assert sum(refined.values()) > sum(r.score for rs in found.values() for r in rs[:1])
    assert sum(map(len, found.values())) == len(rows)
    assert lattice_lm.score_corpus(empty(spark)).count() == 0


def test_filters_carry_columns_of_any_name(spark):
    rows = [(1, "a b c d e f g h", "x", "y", 3), (2, "a b c d e f g h", "p", "q", 4), (None, "one two three four five six", "r", "s", 5), (None, "one two three four five six", "t", "u", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _cid string, _doc_key string, root int")
    kept = near_dedup.representatives(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]
    clean = decontaminate.clean_documents(docs, spark.createDataFrame([(7, "one two three four five six")], "item_id long, text string"))
    assert clean.columns == docs.columns and sorted(tuple(r) for r in clean.collect()) == sorted(rows[:2])


def test_frequencies_of_shared_shingles_are_exact(spark):
    texts = ["a b c d e", "a b c d e", "a b c d e f", None, *[f"w{i} x{i} y{i} z{i} v{i}" for i in range(40)]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    idf = near_dedup.inverse_frequencies(docs)
    assert len(idf.hashes) == 1  # held by three texts; all others by one
    assert idf.idf[0] == round(255 * (1 - math.log(3 / 2) / math.log(len(texts) / 2)))


def test_ids_with_several_texts_link_them(spark):
    signed = spark.createDataFrame([(1, 10), (1, 30), (1, 20), (1, 10), (2, 10), (None, 5), (None, 6), (3, 40)], "doc_id long, cid long")
    assert sorted(tuple(r) for r in near_dedup.shared_ids(signed).collect()) == [(10, 20), (10, 30)]
