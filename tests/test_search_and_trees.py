"""Indexes, automata, graph labels and similar renames against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import ann, compare, history, lexical_index, retrieval, similar, survey


def vectors(spark, n=3000, groups=40, size=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    rows = [(i, (centres[i % groups] + rng.normal(size=size) * 0.25).tolist()) for i in range(n)]
    rows += [(n, [0.0] * size), (n + 1, rows[5][1]), (n + 2, None)]
    return spark.createDataFrame(rows, "vec_id long, vector array<double>")


def ranked(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_vector_index_recall_and_exact_hits(spark, tmp_path):
    rows, path = vectors(spark), str(tmp_path / "ann")
    ann.build(rows, path, cells=48)
    cells = ann.cells_table(spark, path)
    assert cells.agg(F.sum("n")).first()[0] == 3002  # every vector but the null one
    asked = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid")
    truth = retrieval.vector_top_k(asked, rows, 10).cache()
    assert ann.recall(ann.search(asked, path, 10, probes=8), truth) >= 0.95
    columns = ("qid", "vec_id", "score", "rank")
    assert ranked(ann.search(asked, path, 10, probes=2, exact=True, block=50), *columns) == ranked(truth, *columns)
    # a probe reads the rows of its cells and no others
    some = np.array([3, 4, 9])
    n = {r.cell: r.n for r in cells.collect()}
    assert ann.probed(spark, path, some, 48).count() == sum(n[int(c)] for c in some)
    plan = ann.probed(spark, path, some, 48)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shelf" in plan or "PartitionFilters: [shelf" in plan
    assert "PushedFilters: []" not in plan


def test_probes_are_calibrated_on_random_vectors(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(1500)], "vec_id long, vector array<double>")
    path = str(tmp_path / "ann")
    ann.build(rows, path, cells=24)
    probes = ann.probes_for(spark, path, 0.95, 10, sample=200)
    assert 1 < probes <= 24
    asked = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid")
    assert ann.recall(ann.search(asked, path, 10, probes=probes), retrieval.vector_top_k(asked, rows, 10)) >= 0.93


def test_vector_index_grows(spark, tmp_path):
    rows, path = vectors(spark, 600), str(tmp_path / "ann")
    ann.build(rows.where("vec_id < 400"), path, cells=12)
    ann.append(rows.where("vec_id >= 400"), path)
    asked = rows.where("vec_id % 25 = 0").withColumnRenamed("vec_id", "qid")
    columns = ("qid", "vec_id", "score", "rank")
    assert ranked(ann.search(asked, path, 5, probes=1, exact=True), *columns) == ranked(retrieval.vector_top_k(asked, rows, 5), *columns)


def test_empty_vector_index(spark, tmp_path):
    none, path = spark.createDataFrame([], "vec_id long, vector array<double>"), str(tmp_path / "ann")
    ann.build(none, path)
    assert ann.search(spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vector array<double>"), path, 3, exact=True).count() == 0


def texts(spark, n=400, seed=7):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(20_000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "rare term rare term rare"), (n + 3, " ".join(words[:15_000]))]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_lexical_index_equals_scoring_all(spark, tmp_path, monkeypatch):
    docs, path = texts(spark), str(tmp_path / "lex")
    lexical_index.build(docs, path, stretch=32)
    asked = spark.createDataFrame([(1, "rare term"), (2, "w1 w2 w3"), (3, "w17 w4 nothing"), (4, "unknown words"), (5, None), (6, "w1 rare")], "qid long, text string")
    scored = []
    plain = lexical_index._scored
    monkeypatch.setattr(lexical_index, "_scored", lambda spark, path, pairs, *rest: scored.append(pairs.count()) or plain(spark, path, pairs, *rest))
    columns = ("qid", "doc_id", "score", "rank")
    got = ranked(lexical_index.search(asked, path, 3), *columns)
    assert got == ranked(retrieval.bm25(asked, docs, 3), *columns) and got
    stretches = spark.read.parquet(f"{path}/stretches").count()
    assert stretches > 10 and sum(scored) < 4 * stretches  # questions with hits meet a part of the stretches
    # a second block of questions reads no text, and two blocks give what one gives
    assert ranked(lexical_index.search(asked, path, 3, block=2), *columns) == got


def test_lexical_index_grows(spark, tmp_path):
    docs, path = texts(spark, 120), str(tmp_path / "lex")
    lexical_index.build(docs.where("doc_id % 2 = 0"), path, stretch=16)
    lexical_index.add(docs.where("doc_id % 2 = 1"), path, stretch=16)
    asked = spark.createDataFrame([(1, "w1 w3 rare"), (2, "w9")], "qid long, text string")
    columns = ("qid", "doc_id", "score", "rank")
    assert ranked(lexical_index.search(asked, path, 5), *columns) == ranked(retrieval.bm25(asked, docs, 5), *columns)


def test_many_terms_in_few_automata(spark):
    rng = random.Random(2)
    known = sorted({"".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(300_000)})
    assert len(known) > 100_000
    terms = spark.createDataFrame([(i % 50, t) for i, t in enumerate(known)], "qid long, term string")
    said = ["".join(rng.choices("abcdefgh xyz", k=rng.randint(0, 60))) for _ in range(60)]
    rows = spark.createDataFrame([*enumerate(said), (99, None)], "line int, text string")
    found = survey.term_hits(rows, F.col("text"), terms, 2, limit=300_000)
    assert "abc" not in found._jdf.queryExecution().optimizedPlan().toString()
    held = set(known)
    expected = {(i, t[a:b]) for i, t in enumerate(said) for a in range(len(t)) for b in range(a + 3, min(a + 8, len(t)) + 1) if t[a:b] in held}
    assert sorted((r.line, r.term) for r in found.collect()) == sorted(expected)


def random_dag(rng, n):
    """Commits with up to three parents, criss-cross merges among them."""
    return [(c, p) for c in range(1, n) for p in {rng.randrange(max(0, c - 8), c) for _ in range(rng.choice([1, 1, 2, 2, 3]))} if rng.random() < 0.95]


def plain_compare(edges, base, target):
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)

    def reach(v):
        seen, todo = {v}, [v]
        while todo:
            for p in up.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return seen

    a, b = reach(base), reach(target)
    common = a & b
    below = set().union(*(reach(c) - {c} for c in common)) if common else set()
    return base in b, sorted(common - below), len(b - a), len(a - b)


@pytest.mark.parametrize("local_bytes", [8 << 20, 0])
def test_pairs_of_commits(spark, local_bytes):
    rng = random.Random(11)
    edges = random_dag(rng, 70) + [(201, 200), (202, 200), (203, 201), (203, 202), (204, 201), (204, 202)]
    pairs = [(203, 204), (204, 203), (5, 5), (999, 3), (3, 999), (999, 999), *[(rng.randrange(70), rng.randrange(70)) for _ in range(60)]]
    frame = spark.createDataFrame([*pairs, pairs[0], (None, 4)], "base long, target long")
    got = {(r.base, r.target): (r.base_is_ancestor, r.merge_bases, r.ahead, r.behind) for r in compare.compared(frame, spark.createDataFrame(edges, "child long, parent long"), local_bytes).collect()}
    assert got.pop((None, 4)) == (None, None, None, None)
    assert got == {p: plain_compare(edges, *p) for p in pairs}
    assert got[(203, 204)][1] == [201, 202]


def test_cycles_are_refused(spark):
    with pytest.raises(ValueError):
        compare.compared(spark.createDataFrame([(1, 2)], "base long, target long"), spark.createDataFrame([(1, 2), (2, 1)], "child long, parent long"))


def plain_score(a, b):
    ca, cb = (Counter((t[:-1] if t.endswith("\n") else t).split("\n")) if t not in ("", "\n", None) else Counter() for t in (a, b))
    size = lambda c: sum((len(k.encode()) + 1) * v for k, v in c.items())
    larger = max(size(ca), size(cb))
    return 100 * size(ca & cb) // larger if larger else 0


def trees(rng, n=40):
    line = lambda: "".join(rng.choices("abc", k=rng.randint(0, 9)))
    old = {f"a/f{i}.py": "\n".join([line() for _ in range(rng.randint(1, 14))] + ["", "pass", ""]) for i in range(n)}
    old |= {"a/none": None, "a/empty": "", "a/twin1": "same\ntext\n", "a/twin2": "same\ntext\n"}
    new = {}
    for i, (path, text) in enumerate(old.items()):
        lines = (text or "").split("\n")
        for _ in range(rng.choice([0, 1, 2, 4])):
            lines[rng.randrange(len(lines))] = line()
        if i % 5:
            new[path if i % 4 == 0 else f"b/{path.rsplit('/')[-1] if i % 3 else f'g{i}.py'}"] = "\n".join(lines)
        if i % 7 == 0:
            new[f"c/copy{i}"] = text
            new[f"c/near{i}"] = (text or "") + "\nmore"
    return old, new


def plain_changes(old, new, copies):
    out, gone, came = {}, sorted(set(old) - set(new)), sorted(set(new) - set(old))
    for p in set(old) & set(new):
        if old[p] != new[p]:
            out[p] = (None, "modified", None)
    sha = lambda t: t or ""
    left_old, left_new = [], list(came)
    for g in gone:
        same = next((c for c in left_new if sha(new[c]) == sha(old[g])), None)
        if same is None:
            left_old.append(g)
        else:
            out[same] = (g, "renamed", 100)
            left_new.remove(same)
    base = lambda p: p.rsplit("/")[-1]
    pairs = sorted((-plain_score(old[g], new[c]), base(g) != base(c), g, c) for g in left_old for c in left_new if plain_score(old[g], new[c]) >= 50)
    for s, _, g, c in pairs:
        if g in left_old and c in left_new:
            out[c] = (g, "renamed", -s)
            left_old.remove(g)
            left_new.remove(c)
    if copies:
        for c in list(left_new):
            same = sorted(p for p in old if sha(old[p]) == sha(new[c]))
            best = min(((-plain_score(old[g], new[c]), base(g) != base(c), g) for g in old), default=(0, 0, 0))
            if same or -best[0] >= 50:
                out[c] = (same[0], "copied", 100) if same else (best[2], "copied", -best[0])
                left_new.remove(c)
    return out | {p: (None, "added", None) for p in left_new} | {p: (None, "deleted", None) for p in left_old}


@pytest.mark.parametrize("copies", [False, True])
def test_similar_renames_and_copies(spark, copies):
    frame = lambda trees: spark.createDataFrame([(k, p, t or "", t) for k, tree in trees for p, t in tree.items()], "repo int, path string, sha string, text string")
    sides = [trees(random.Random(seed)) for seed in (1, 2)] + [({}, {"x": "1\n"}), ({"y": "1\n"}, {})]
    old, new = frame([(k, o) for k, (o, _) in enumerate(sides)]), frame([(k, n) for k, (_, n) in enumerate(sides)])
    got = {}
    for r in similar.tree_changes(old, new, copies=copies, by=("repo",)).collect():
        assert got.setdefault(r.repo, {}).setdefault(r.path, (r.old_path, r.status, r.score)) == (r.old_path, r.status, r.score)
    assert got == {k: plain_changes(o, n, copies) for k, (o, n) in enumerate(sides)}
    assert {s for tree in got.values() for _, s, _ in tree.values()} >= {"renamed", "added", "deleted", "modified"}


def test_equal_trees_change_nothing(spark):
    same = spark.createDataFrame([("a", "1", "x\n")], "path string, sha string, text string")
    assert similar.tree_changes(same, same).count() == 0
    assert history.renames(same, same).count() == 0


def test_a_scan_decodes_utf8_in_spark(spark, tmp_path, monkeypatch):
    """Texts as ``decode_bytes`` gives them, and no file in UTF-8 reaches Python."""
    from lodestone.operators.chunks import decode_bytes
    from lodestone.sources import corpus

    files = {"a.txt": b"plain \xed\x95\x9c", "b.txt": b"\xef\xbb\xbfmark", "c.txt": "한글".encode("cp949"), "d.txt": b"caf\xe9 \xff\xfe\xfd", "e.txt": b"x\0y", "f.txt": b"y" * 5000 + b"\0", "h.txt": b"\xed\xa0\x80z"}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path: r.text for r in corpus.scan(spark, str(tmp_path)).collect()}
    assert got == {name: text for name, raw in files.items() if (text := decode_bytes(raw)) is not None}

    def refuse(raw):
        if raw is not None:
            raise AssertionError("a file in UTF-8 went to Python")

    monkeypatch.setattr(corpus, "decode_bytes", refuse)
    valid = corpus.scan(spark, str(tmp_path), "c.txt,d.txt,h.txt")
    assert {r.path for r in valid.collect()} == {"a.txt", "b.txt", "f.txt"}


def test_postings_look_tokens_up_in_slices(spark, monkeypatch):
    """The same postings whatever the slice, and no more rows than it at once."""
    rows = spark.createDataFrame([(i, f"w{i % 3} w{i % 3} x{i}") for i in range(50)] + [(50, None), (51, "")], "doc_id long, text string").coalesce(1)
    whole = sorted(map(str, retrieval.postings(rows, ["w0", "w2", "x7"]).collect()))
    monkeypatch.setattr(retrieval, "POSTING_ROWS", 7)
    seen = {}
    fake = type("Tokens", (), {"sparkSession": spark, "select": lambda self, *a: self, "mapInArrow": lambda self, f, schema: seen.update(f=f)})()
    monkeypatch.setattr(retrieval, "document_tokens", lambda *a: fake)
    retrieval.postings(fake, ["w0", "w2", "x7"])
    import pyarrow as pa

    tokens = pa.RecordBatch.from_pydict({"doc_id": list(range(52)), "tokens": [[f"w{i % 3}", f"w{i % 3}", f"x{i}"] for i in range(50)] + [[], []]})
    parts = list(seen["f"]([tokens]))
    assert max(p.num_rows for p in parts) == 7 and sum(p.num_rows for p in parts) == len(whole) == 52
    assert sum(len(t) for p in parts for t in p.column(2).to_pylist()) == sum(i % 3 in (0, 2) for i in range(50)) + 1


def test_many_pairs_pass_the_graph_in_blocks(spark, monkeypatch):
    """Many pairs, and pairs beyond the local bound, share passes over the graph: no join on ancestors, several blocks, ids in no order."""
    rng = random.Random(4)
    name = rng.sample(range(1000), 170)
    edges = [(name[c], name[p]) for c, p in random_dag(rng, 160)]
    pairs = sorted({(rng.choice(name), rng.choice(name)) for _ in range(300)})
    frames = spark.createDataFrame([*pairs, (None, 4)], "base long, target long"), spark.createDataFrame(edges, "child long, parent long")
    expected = {p: plain_compare(edges, *p) for p in pairs} | {(None, 4): (None, None, None, None)}

    def compared(**bounds):
        return {(r.base, r.target): (r.base_is_ancestor, r.merge_bases, r.ahead, r.behind) for r in compare.compared(*frames, **bounds).collect()}

    assert compared(local_bytes=0, array_bytes=0) == expected
    monkeypatch.setattr(compare, "_joined", lambda *a: pytest.fail("ancestors were joined"))
    monkeypatch.setattr(compare, "Labelled", lambda *a: pytest.fail("pairs were walked one by one"))
    monkeypatch.setattr(compare, "MASK_BYTES", 0)
    assert compared(local_bytes=0) == expected
    assert compared() == expected
    # integers are counted and given up a few commits at a time, and blocks that hold too many are halved
    monkeypatch.setattr(compare, "COUNTED", 5)
    graph = compare.Ordered(*map(np.array, zip(*edges, strict=True)))
    at = [graph.find(np.array(side)) for side in zip(*pairs, strict=True)]
    found = zip(*at, *graph.compare(*at), strict=True)
    assert all((bases, ahead, behind) == expected[p][1:] for p, (b, t, ahead, behind, bases) in zip(pairs, found, strict=True) if b >= 0 and t >= 0 and p[0] != p[1])


def test_many_commits_without_edges(spark):
    pairs = spark.range(200).selectExpr("id AS base", "id - id % 2 AS target")
    got = {(r.base, r.target): tuple(r)[2:] for r in compare.compared(pairs, spark.createDataFrame([], "child long, parent long")).collect()}
    assert got == {(i, i - i % 2): (False, [], 1, 1) if i % 2 else (True, [i], 0, 0) for i in range(200)}


def test_a_large_graph_with_a_cycle_is_joined(spark):
    frame = compare.compared(spark.createDataFrame([(1, 3)], "base long, target long"), spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "child long, parent long"), local_bytes=0)
    assert [(r.base_is_ancestor, r.ahead, r.behind) for r in frame.collect()] == [(True, 1, 0)]


def counted_cuts(monkeypatch):
    """The columns of each table that similar renames write."""
    seen, cut = [], similar.cut
    monkeypatch.setattr(similar, "cut", lambda df: (seen.append(df.columns), cut(df))[1])
    return seen


@pytest.mark.parametrize("rest_rows", [None, 40, 0])
def test_copies_of_a_content_are_matched_at_once(spark, monkeypatch, rest_rows):
    """Thirty equal files meet thirty similar ones of other names: one pair of contents, and no round for each file."""
    seen = counted_cuts(monkeypatch)
    if rest_rows is not None:
        monkeypatch.setattr(similar, "REST_ROWS", rest_rows)
    lines = [f"line number {i}" for i in range(12)]
    text, edited = "\n".join(lines), "\n".join([*lines[:-1], "changed"])
    old = [(f"a/o{i:02}", "s1", text) for i in range(30)] + [("a/n07", "s1", text), ("a/solo", "s3", "x y\nz")]
    new = [(f"b/n{i:02}", "s2", edited) for i in range(30)] + [("b/solo", "s4", "x y\nzz")]
    frame = lambda rows: spark.createDataFrame(rows, "path string, sha string, text string")
    got = {r.path: (r.old_path, r.status, r.score) for r in similar.tree_changes(frame(old), frame(new)).collect()}
    assert len(seen) < 30
    score = got["b/n07"][2]
    news = [f"b/n{i:02}" for i in range(30) if i != 7]
    expected = {"b/n07": ("a/n07", "renamed", score)} | {n: (f"a/o{i:02}", "renamed", score) for i, n in enumerate(news)}
    assert got == expected | {"b/solo": ("a/solo", "renamed", 57), "a/o29": (None, "deleted", None)}


@pytest.mark.parametrize("rest_rows", [0, 12, 1 << 18])
def test_all_ways_of_matching_agree(spark, monkeypatch, rest_rows):
    """Ties, copies and equal base names in several groups: at once, one by one and in rounds give the greedy pairs."""
    monkeypatch.setattr(similar, "REST_ROWS", rest_rows)
    rng = random.Random(8)
    pairs = {(g, f"o{rng.randrange(5)}", f"n{rng.randrange(5)}"): rng.choice([60, 70, 70, 90]) for g in (1, 2) for _ in range(9)}
    old = [(g, f"{rng.choice('xyz')}/{i}{rng.choice('ab')}", f"o{i % 5}") for g in (1, 2) for i in range(14)]
    new = [(g, f"{rng.choice('uvw')}/{i}{rng.choice('ab')}", f"n{i % 4}") for g in (1, 2) for i in range(14)]
    base = lambda p: p.rsplit("/")[-1]
    order = sorted((g, -s, base(o) != base(n), o, n) for (g, a, b), s in pairs.items() for g2, o, x in old if (g2, x) == (g, a) for g3, n, y in new if (g3, y) == (g, b))
    expected, taken = [], set()
    for g, s, _, o, n in order:
        if not {(g, 0, o), (g, 1, n)} & taken:
            taken |= {(g, 0, o), (g, 1, n)}
            expected.append((g, o, n, -s))
    frames = spark.createDataFrame([(*k, s) for k, s in pairs.items()], "repo int, old_sha string, new_sha string, score int"), spark.createDataFrame(old, "repo int, old_path string, old_sha string"), spark.createDataFrame(new, "repo int, new_path string, new_sha string")
    assert ranked(similar.best_matching(*frames, ("repo",)), "repo", "old_path", "new_path", "score") == sorted(expected)


def test_copies_of_many_files_take_the_source_of_their_name(spark):
    """Twenty equal new files with six best sources of three contents: each has the least path, or the one of its own name."""
    lines = [f"line number {i}" for i in range(12)]
    texts = {f"s{i}": "\n".join([*lines[:-1], f"end {i}"]) for i in range(3)}
    old = [(f"a/{i}", f"s{i % 3}", texts[f"s{i % 3}"]) for i in range(1, 7)]
    new = [*old, *((f"b/{i}", "n", "\n".join([*lines[:-1], "end x"])) for i in range(20))]
    frame = lambda rows: spark.createDataFrame(rows, "path string, sha string, text string")
    got = {r.path: (r.old_path, r.status) for r in similar.tree_changes(frame(old), frame(new), copies=True).collect()}
    assert got == {f"b/{i}": (f"a/{i}" if 1 <= i < 7 else "a/1", "copied") for i in range(20)}
