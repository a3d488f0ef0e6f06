"""Operators over pages and conversations, and the pipeline."""

import collections
import hashlib
import random
import re

from lodestone.llm import chat_format, main_text, queries, url_filter

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=a>a</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article class="post"><h1>Head &amp; tail</h1><p>One <b>two</b>\n three<p>four&nbsp;five<br>six<script>var x="</p>";</script>
<div class="share">Share this</div><form><p>mail</p><input></form><ul><li>seven</li><li>eight &lt;9&gt;</li></ul></article><aside>More</aside>
<section id="comments"><article class="comment"><p>First!</p></article></section><footer>&copy; x</footer></body></html>"""


def finish(pages):
    return main_text._finish([(i, u, main_text.settle(x or "")) for i, u, x in pages])


def test_main_text_of_a_marked_article():
    texts, _ = finish([(1, "u", PAGE)])
    assert texts == ["Head & tail\nOne two three\nfour five\nsix\nseven\neight <9>"]


def test_main_text_removes_what_pages_of_a_host_share(spark):
    rng = random.Random(1)
    shared = " ".join(f"shared{i}" for i in range(30))
    own = [" ".join(f"w{rng.randint(0, 999)}" for _ in range(50)) for _ in range(3)]
    rows = [(i, f"http://h.example/{i}", f"<div>{shared}</div><p>{t}</p><div><a href=x>only a link</a></div>") for i, t in enumerate(own)]
    rows += [(10, "http://other.example/", f"<div>{shared}</div>"), (11, None, None), (12, "http://h.example/e", ""), (13, "nope", "<p>plain &#65; &bogus; &amp</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "1 as text")
    got = {r.page_id: r.text for r in main_text.extract(pages).collect()}
    assert got == {0: own[0], 1: own[1], 2: own[2], 10: shared, 11: "", 12: "", 13: "plain A &bogus; &"}
    assert main_text.extract(pages.limit(0)).count() == 0


def test_main_text_repeats_are_those_of_the_host(spark, monkeypatch):
    rng = random.Random(4)
    shared = [" ".join(f"s{k}x{i}" for i in range(20)) for k in range(6)]
    rows = []
    for i in range(120):
        own = " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(30))
        parts = [f"<p>{own}</p>", *(f"<p>{shared[k]}</p>" for k in range(6) if i in (k, 119 - k) or k == 0 and i % 7 == 0)]
        rows.append((i if i < 118 else 118, f"http://{'h' if i % 10 else 'small'}.example/{i}", "".join(parts)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    (whole, group_bytes) = (collections.defaultdict(list), main_text.GROUP_BYTES)
    for r in rows:
        whole[r[1].split("/")[2]].append(r)
    expected = {}
    for group in whole.values():
        for r, text, n in zip(group, *finish(group), strict=True):
            expected[r[1]] = (text, n)
    assert sum("s0x" in t for t, _ in expected.values()) < sum("s0x" in r[2] for r in rows)
    for size in (group_bytes, 1500):
        monkeypatch.setattr(main_text, "GROUP_BYTES", size)
        for n in (1, 4, 40):
            got = main_text.extract(pages.repartition(n)).collect()
            assert {r.url: (r.text, r.n_removed) for r in got} == expected and len(got) == len(rows)


def test_main_text_has_no_comments_or_adverts_however_unique():
    words = lambda n: " ".join(f"unique{n}x{i}" for i in range(30))
    pages = [
        f"<article><p>Main prose.</p><div class='comments'><p>{words(1)}</p><article>{words(2)}</article></div><p>More.</p></article>",
        f"<article><p>Main.</p><div class='advert'>{words(3)}<p>{words(4)}</p></div><aside>{words(5)}</aside></article>",
        f"<div class='ad-wrapper'><article><p>{words(6)}</p></article>{words(7)}</div>",
        f"<div><p>{words(8)}</p><div id='comments'><p>{words(9)}</p></div></div>",
    ]
    assert finish([(i, "u", x) for i, x in enumerate(pages)])[0] == ["Main prose.\nMore.", "Main.", words(6), words(8)]


def test_main_text_learns_surroundings_from_pages_that_mark_them(spark):
    words = lambda n, k=24: " ".join(f"x{n}y{i}" for i in range(k))
    menu, lead = words(1), words(2)
    rows = [
        (1, "http://h/1", f"<nav>{menu}</nav><article><p>{lead}</p><p>{words(3)}</p></article>"),
        (2, "http://h/2", f"<div>{menu}</div><p>{words(4)}</p>"),  # one unmarked page: the menu is known from the marked ones
        (3, "http://h/3", f"<main><p>{words(5)}</p></main><aside>{lead}</aside><footer>{words(6)}</footer>"),
        (4, "http://h/4", f"<main><p>{lead}</p></main><aside>{lead}</aside>"),  # a teaser of an article takes nothing from it
        (5, "http://other/5", f"<div>{menu}</div>"),
    ]
    expected = {1: (f"{lead}\n{words(3)}", 24), 2: (words(4), 24), 3: (words(5), 24), 4: (lead, 24), 5: (menu, 0)}
    got = main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: (r.text, r.n_removed) for r in got} == expected


def test_main_text_array_takes_surroundings_of_the_given_pages(spark, sf_dir):
    """Tokens taken equal those of windows that a plain count finds on two pages of the host."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()
    seen, streams = collections.defaultdict(set), []
    for r in rows:
        host = re.match(r"[^:]*://([^/?#]*)", r.url or "")
        for stream in main_text.streams(main_text.settle(r.html or "")):
            words = " ".join(stream).split(" ") if stream else []
            streams.append((r.page_id, host and host[1].lower(), words))
            for k in range(len(words) - main_text.DEPTH + 1):
                seen[streams[-1][1], tuple(words[k : k + main_text.DEPTH])].add(r.page_id)
    taken = collections.Counter()
    for page, host, words in streams:
        covered = {j for k in range(len(words) - main_text.DEPTH + 1) if len(seen[host, tuple(words[k : k + main_text.DEPTH])]) > 1 for j in range(k, k + main_text.DEPTH)}
        taken[page] += len(covered)
    got = {r.page_id: r.n_removed for r in queries.op1_main_text(spark, sf_dir).collect()}
    assert got == dict(taken) and sum(got.values()) > 0


def test_main_text_class_words_only_cast_doubt():
    rng = random.Random(5)
    shared = " ".join(f"shared{i}" for i in range(30))

    def own():
        return " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(25))

    a, b, c, d, e, f = (own() for _ in range(6))
    pages = [
        f"<div class='site has-sidebar'><nav>Menu</nav><article><h2 id='search'>Search trees</h2><p>{a}</p></article></div><div class='ad'>{own()}</div>",
        f"<main class='content no-sidebar'><p>{b}</p><div class='notice'>{shared}</div></main>",
        f"<article><p>{c}</p><div class='promo'>{d} {shared}</div><p class='ad'>Buy<p>so it ends</article><div id='comments'><article class='comment'>{own()}</article></div>",
        f"<div class='widget'>{e}</div><div class='widget'>{shared}</div><div class='ad'>Buy now</div><div role='complementary'>{own()}</div>",
        f"<article class='post tag-social'><p>{f}</p></article>",
    ]
    texts, _ = finish([(i, "u", x) for i, x in enumerate(pages)])
    assert texts == [f"Search trees\n{a}", b, f"{c}\n{d}\nso it ends", e, f]


def test_main_text_of_names_that_only_look_like_marks():
    cases = {
        "<div class='page has-sidebar'><article><p>one</p></article></div>": "one",
        "<div id='search-results'><main><p>two</p></main></div>": "two",
        "<article><p data-id='ad-7' data-class=ad>three</p><p class='banner-year'>four</p><p class='social-history'>five</p><h2 class='article-header'>six</h2></article>": "three\nfour\nfive\nsix",
        "<article><p>se<b>ven</b> &<b>amp;</b> &amp;lt;</article>": "seven &amp; &lt;",
        "<article><p title=it's>eight</p><p title='a > b' lang=\"x>y\">nine</p></article>": "eight\nnine",
        "<article><p class='ad-box'>buy</p><div class='newsletter-signup'>mail</div><div class='site-cookie-banner'>ok?</div><p>ten <b</article>": "ten",
        "<article><p>eleven</p> <b and no end": "eleven\n<b and no end",
    }
    for page, text in cases.items():
        assert finish([(1, "u", page)])[0] == [text], page


def test_main_text_reads_in_linear_time(spark):
    import time

    hard = ["<a " * 300_000, "<a =\"" * 200_000, "<! " * 300_000, "<head>" * 100_000, "<script>" * 100_000, "<b>" * 100_000 + "<p>" * 100_000 + "</i>" * 100_000, "<!-- " * 200_000]
    began = time.perf_counter()
    for page in hard:
        main_text.settle(page)
    assert time.perf_counter() - began < 20
    long = " ".join(f"w{i}" for i in range(700_000))
    rows = [(1, "http://a.b/", f"<article><p>{long}</p></article>"), (2, "http://a.b/2", f"<p>{long}</p>"), (2, "http://a.b/2", f"<p>{long}</p>"), (1, "http://a.b/", f"<article><p>{long}</p></article>")]
    got = main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 4 and all(r.text == long and r.n_chars == len(long) for r in got)


def test_repeated_runs_against_brute_force():
    import numpy as np

    rng = random.Random(2)
    for depth in (3, 4, 7):
        pages = [[rng.randint(0, 3) for _ in range(rng.randint(0, 30))] for _ in range(5)]
        tokens, page = np.array([t for p in pages for t in p]), np.array([i for i, p in enumerate(pages) for _ in p])
        seen = collections.defaultdict(set)
        for i, p in enumerate(pages):
            for a in range(len(p) - depth + 1):
                seen[tuple(p[a : a + depth])].add(i)
        expected = []
        for p in pages:
            cover = [False] * len(p)
            for a in range(len(p) - depth + 1):
                if len(seen[tuple(p[a : a + depth])]) > 1:
                    cover[a : a + depth] = [True] * depth
            expected += cover
        assert main_text.repeated(tokens, page, depth).tolist() == expected


def test_article_of_every_page(spark, sf_dir):
    import html

    rows = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op1_main_text(spark, sf_dir).collect():
        article = re.search("<article>(.*)</article>", rows[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_url_parts_and_rules(spark):
    urls = {
        "http://Www.Example.COM/en/a?b#c": ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
        "https://x.example.com/en/": ("x.example.com", "/en/", "example.com/en/", "block"),
        "https://x.example.com/fr/": ("x.example.com", "/fr/", "com/", "allow"),
        "https://a.net/es/q": ("a.net", "/es/q", "net/es/", "block"),
        "https://a.net/fr": ("a.net", "/fr", None, None),
        "https://a.com": ("a.com", "", None, None),
        "https://a.com?x=/": ("a.com", "", None, None),
        "https://acom/": ("acom", "/", None, None),
        "no scheme/": ("", "", None, None),
        None: ("", "", None, None),
        "": ("", "", None, None),
        "http://" + "y" * 5000 + ".org/": ("y" * 5000 + ".org", "/", None, None),
    }
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, gram int")
    for r in url_filter.judge(pages).collect():
        host, path, rule, verdict = list(urls.values())[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_model_generalises(spark):
    rng = random.Random(3)
    good = [f"http://{w}.example.org/{rng.randint(0, 99)}" for w in ("garden", "library", "weather", "recipes", "history") for _ in range(30)]
    bad = [f"http://{w}.example.org/{rng.randint(0, 99)}" for w in ("casino-win", "cheap-pills", "casino-bonus") for _ in range(30)]
    probe = ["http://casinowin.example.org/1", "http://cheappills.example.org/2", "http://gardens.example.org/3"]
    pages = spark.createDataFrame(list(enumerate(good + bad + probe)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages).collect()}
    n = len(good) + len(bad)
    assert [got[n], got[n + 1], got[n + 2]] == ["block", "block", "allow"]
    assert all(got[i] == "allow" for i in range(len(good))) and all(got[i] == "block" for i in range(len(good), n))
    plan = url_filter.judge(pages)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_url_model_without_seed_words(spark):
    rng = random.Random(3)
    good = [f"http://{w}.example.org/{rng.randint(0, 99)}" for w in ("garden", "library", "weather", "recipes", "history", "museum", "bakery", "hiking") for _ in range(30)]
    bad = [f"http://{w}.example.org/{rng.randint(0, 99)}" for w in ("casinowin", "kasino", "gambling-hall", "replica-shop", "escorts") for _ in range(3)]
    urls = good + bad
    assert not any(set(re.split("[.-]", u.split("/")[2])) & set(url_filter.SEEDS) for u in urls)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages).collect()}
    assert [got[i] for i in range(len(urls))] == ["allow"] * len(good) + ["block"] * len(bad)
    seeded = spark.createDataFrame([(1, "http://casino-win.example.org/")], "page_id long, url string")
    assert url_filter.judge(seeded).first().verdict == "block"


def test_url_model_learns_from_labelled_urls(spark):
    """Hosts of no listed word are blocked where labels teach it; the list plays no part then."""
    rng = random.Random(6)
    good = [f"http://{w}.example.org/{rng.randint(0, 99)}" for w in ("garden", "library", "weather", "casino-history") for _ in range(30)]
    bad = [f"http://{w}.example.org/{rng.randint(0, 99)}" for w in ("luckyspin", "quickrich", "hotsingles") for _ in range(30)]
    rows = [(u, "accept") for u in good] + [(u, "reject") for u in bad] + [(None, "reject"), ("http://z.org/", "other"), ("http://y.org/", None)]
    labelled = spark.createDataFrame(rows, "url string, label string")
    probe = ["http://luckyspin777.example.org/1", "http://hotsingles-now.example.org/2", "http://gardens.example.org/3", "http://casino-history.example.org/4", None, "http://luckyspin.example.com/"]
    pages = spark.createDataFrame([(i, u, "reject") for i, u in enumerate(probe)], "page_id long, url string, label string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, labelled=labelled).collect()}
    assert [got[i] for i in range(len(probe))] == ["block", "block", "allow", "allow", "allow", "allow"]
    assert {r.verdict for r in url_filter.judge(pages, labelled=labelled.where("label = 'accept'")).collect()} == {"allow"}
    assert {r.verdict for r in url_filter.judge(pages, labelled=labelled.limit(0)).collect()} == {"allow"}


def test_url_scores_against_brute_force(spark, monkeypatch):
    """Counts, back-off, means and the threshold in plain code, with the window table broadcast whole and in part."""
    import math

    import xxhash

    rng = random.Random(7)
    sets = {"accept": ("garden", "library", "wetter", "musée"), "reject": ("luckyspin", "quickrich", "singles")}
    rows = [(f"http://{rng.choice(w)}{rng.randint(0, 9)}.{rng.choice(('org', 'net'))}/{rng.randint(0, 99)}", label) for label, w in sets.items() for _ in range(60)]
    probe = [f"http://{rng.choice(('gardenspin', 'library', 'rich', 'x'))}{k}.org/a" for k in range(40)] + ["http://garden.org/" + "long/" * 400]

    def windows_of(text):
        padded = "~~~" + text
        return [padded[k : k + 4] for k in range(len(text))]

    learned = {"accept": collections.Counter(), "reject": collections.Counter()}
    every, held = set(), []
    for url, label in rows:
        text = url.split("://")[1]
        hashed = xxhash.xxh64_intdigest(text.encode(), 42)
        if (hashed - (hashed >> 63 << 64)) % url_filter.FOLDS == 0:
            held.append((text, label))
        else:
            for g in windows_of(text):
                for order in range(4):
                    learned[label][g[3 - order : 3], g[3]] += 1
                    learned[label][g[3 - order : 3], None] += 1
        every |= {g[3] for g in windows_of(text)}
    for url in probe:
        every |= {g[3] for g in windows_of(url.split("://")[1])}

    def log_p(g, label):
        p = 1 / (len(every) + 1)
        for order in range(4):
            c = learned[label]
            p = (c[g[3 - order : 3], g[3]] + url_filter.STRENGTH * p) / (c[g[3 - order : 3], None] + url_filter.STRENGTH)
        return math.log(p)

    def score(text):
        return sum(log_p(g, "accept") - log_p(g, "reject") for g in windows_of(text)) / len(text)

    fit = {}
    for label in sets:
        x = [score(t) for t, k in held if k == label]
        fit[label] = sum(x) / len(x), (sum(v * v for v in x) / len(x) - (sum(x) / len(x)) ** 2) ** 0.5
    (am, a_s), (rm, rs) = fit["accept"], fit["reject"]
    limit = (am * rs + rm * a_s) / (a_s + rs)
    labelled = spark.createDataFrame(rows, "url string, label string")
    pages = spark.createDataFrame(list(enumerate(probe)), "page_id long, url string")
    for head in (url_filter.HEAD_GRAMS, 20):
        monkeypatch.setattr(url_filter.with_ratios, "__defaults__", (head,))
        got = {r.page_id: r for r in url_filter.judge(pages, rules=(), labelled=labelled).collect()}
        assert len(got) == len(probe)
        for k, url in enumerate(probe):
            expected = score(url.split("://")[1])
            assert abs(got[k].score - expected) < 1e-9
            assert got[k].verdict == ("allow" if expected >= limit else "block")
    assert {r.verdict for r in got.values()} == {"allow", "block"}


def said(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_chat_round_trip(spark):
    rows = [
        (1, 1, "assistant", "<|im_end|>\n<|im_start|>assistant\n&lt;| & &amp; <"), (1, 0, "user", "a\nb"), (1, 2, "user", None), (1, 3, None, "<"), (1, 4, "as\n<|im_end|>", ""),
        (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (2, 0, "assistant", "w"), (None, 0, "user", "lost"), (3, None, "user", "no turn"), (4, 0, "assistant", "é" * 50_000),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as seq", "'k' as kind", "2 as message_id")
    expected = collections.defaultdict(list)
    for c, _, r, t in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] if r[1] is not None else -1, r[2] or "", r[3] or "")):
        expected[c].append((r or "", t or ""))
    rendered = chat_format.format_conversations(table)
    got = {r.conv_id: r for r in chat_format.digests(rendered).collect()}
    assert set(got) == set(expected)
    for c, turns in expected.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), said(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in rendered.collect():
        assert "".join(p.text for p in r.pieces) == r.formatted and got[r.conv_id].formatted_chars == len(r.formatted)
    assert chat_format.format_conversations(table.limit(0)).count() == 0


def test_chat_events_are_folded(spark):
    log = [
        (1, "m1", 1, "message", "user", "hi"), (1, "m2", 2, "message", "assistant", ""), (1, "m2", 3, "delta", None, "Hel"), (1, "m2", 4, "delta", None, "lo"),
        (1, "m2", 5, "regenerate", None, None), (1, "m2", 6, "delta", None, "Good"), (1, "m2", 7, "delta", None, " day"), (1, "m1", 8, "edit", None, "hello"),
        (1, "m3", 9, "message", "user", "gone"), (1, "m3", 10, "delete", None, None), (1, "m4", 11, "delta", "assistant", "late"), (1, "m5", 12, "??", "user", "unknown"),
    ]
    rng = random.Random(6)
    for _ in range(3):
        rng.shuffle(log)
        events = spark.createDataFrame(log, "conv_id long, message_id string, seq long, kind string, role string, text string")
        (row,) = chat_format.render(chat_format.fold(events)).collect()
        assert row.formatted == "<|im_start|>user\nhello<|im_end|>\n<|im_start|>assistant\nGood day<|im_end|>\n<|im_start|>assistant\nlate<|im_end|>\n"


def test_chat_query(spark, sf_dir):
    got = {r.conv_id: r for r in queries.op10_chat_format(spark, sf_dir).collect()}
    text = "<|im_end|><|im_start|>assistant ok"
    assert got[-1].turns_sha256 == said([("user", text), ("assistant", text)]) and got[-1].loss_chars == len(text)
    assert not re.search("Python|Arrow|Pandas", queries.op10_chat_format(spark, sf_dir)._jdf.queryExecution().toString())


def test_chat_query_replays_logs(spark, sf_dir, tmp_path):
    """The log holds every kind of event, and folding it gives the turns that plain SQL digests."""
    import duckdb

    rng = random.Random(8)
    texts = [None, "", "a", "ab", "&amp; <|im_start|>", "😀é" * 50, "x" * 30_000, *(" ".join(rng.choice("abc") for _ in range(20)) for _ in range(30))]
    rows = [(c, t % 9 if t != 20 else None, rng.choice(["user", "assistant", "system", None, "a\nb"]), x) for c in (1, 2, 3, None) for t, x in enumerate(texts)]
    table = spark.createDataFrame([*rows, rows[40], rows[40]], "conv_id long, turn long, role string, text string")
    log = chat_format.replayed(table)
    assert {r.kind for r in log.select("kind").distinct().collect()} == set(chat_format.KINDS)
    plain = sorted(map(tuple, chat_format.digests(chat_format.format_conversations(table)).collect()))
    assert sorted(map(tuple, chat_format.digests(chat_format.format_replayed(table)).collect())) == plain and len(plain) == 3
    for frame, got in ((table, plain), (spark.read.parquet(f"{sf_dir}/conversations.parquet"), queries.op10_chat_format(spark, sf_dir).collect())):
        base = duckdb.connect()
        base.register("conversations", frame.toArrow())
        expected = {r[0]: r for r in base.sql(chat_format.ORACLE_SQL).fetchall()}
        assert expected.pop(-1)[1] == 2
        assert {tuple(r)[0]: tuple(r) for r in got if tuple(r)[0] != -1} == expected


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    from lodestone.llm import bpe, decontaminate, near_dedup, quality_rules, toxicity
    from lodestone.llm.shared import cut

    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    at = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = cut(stage(spark, at, sf_dir))
        assert after.columns == docs.columns
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "quality rules":
            expected = {r.doc_id for r in quality_rules.judge(at).collect() if r.kept}
        elif name == "toxicity":
            expected = {r.doc_id for r in toxicity.score_corpus(at, labels).collect() if r.predicted == 0}
        elif name == "MinHash near-dedup":
            expected = {r.class_id for r in near_dedup.near_duplicates(at).collect()}
        else:
            expected = {r.doc_id for r in at.collect()} - {r.doc_id for r in decontaminate.leaks(at, bench).collect()}
        assert kept == expected and after.count() == len(kept)
        at = after
    out = pipeline.run(spark, sf_dir)
    from tokenizers import Tokenizer

    library, texts = Tokenizer.from_file(bpe.vocabulary_path()), {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == kept
    for i, r in got.items():
        assert list(r.ids) == library.encode(texts[i], add_special_tokens=False).ids and r.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()


def test_pipeline_of_awkward_tables(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, extra columns with clashing names, and empty tables, held against plain code."""
    import corpus_pipeline as pipeline

    rng = random.Random(21)

    def prose(n):
        return " ".join(rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))

    item = prose(30)
    base = [prose(120) for _ in range(30)]
    texts = [*base, base[0], f"{base[1]} and more", f"{prose(100)} {item} {prose(20)}", None, "", "too short", prose(20_000), "ha " * 200]
    n_clean = len(texts)
    texts += [f"zorgling {prose(90)} zorgmoot" for _ in range(20)]
    rows = [(i, t, "en" if i % 4 else None, "s", len(t or ""), "c", 1) for i, t in enumerate(texts)]
    rows += [rows[5], (None, f"{prose(100)} {item}", "en", None, None, None, None), (None, prose(100), None, "s", 1, "c", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, cid string, ids int"
    labels = [(i, 1, int(i >= n_clean)) for i in range(len(texts))] + [(None, None, None)]
    for name, got, types in (("documents", rows, schema), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, item), (None, None)], "item_id long, text string")):
        spark.createDataFrame(got, types).write.parquet(f"{tmp_path}/{name}.parquet")
    found = pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted(r.doc_id for r in found if r.doc_id is not None)
    failed = {i for i, t in enumerate(texts) if len((t or "").split()) < 20 or i == texts.index("ha " * 200)}
    gone = failed | {texts.index(base[0], 1), 31, 32}  # an exact copy, a near one, a benchmark passage
    assert ids == sorted(set(range(n_clean)) - gone)
    assert [r.text for r in found if r.doc_id is None] == [rows[-1][1]]
    assert all(r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() and r.cid == "c" for r in found)
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
