"""What a survey of repositories picks out for a briefing: files, lines, sections, candidates, evidence, material and checked answers.

All functions take files of many repositories at once (``repo``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import all_matches, excluded, let
from ..lineage import cut, small
from ..sources.corpus import CODE_SUFFIXES, DOC_SUFFIXES, SKIP_DIRS, SKIP_FILES
from .ordered import fitting, folded

# Names and patterns that decide what a survey reads and in which order.
CONFIG_NAMES = ("pyproject.toml", "package.json", "setup.py", "setup.cfg", "requirements.txt", "go.mod", "Cargo.toml", "pom.xml", "build.gradle", "Gemfile", "composer.json", "Dockerfile", "docker-compose.yml", "compose.yaml", "Makefile", "Procfile")
COMMAND = r"(?i)scripts|entry_points|console_scripts|uvicorn|gunicorn|python\s|CMD|ENTRYPOINT|ExecStart|main\s*=|start\s*[\"':=]"
DEPENDENCY = r"(?i)sql|database|redis|mongo|postgres|sqlite|http|requests|urllib|queue|kafka|storage|chroma|boto|socket"
PRIORITY = r"(?i)install|setup|usage|run|config|architect|overview|feature|limit|실행|설치|사용|설정|구조|개요|기능|제약"
LOW_VALUE = r"(?i)^(changelog|release[-_]?notes?|history|news|changes)\b"
STOP_TERMS = ("the", "and", "코드", "기능")
INTRO_LINES = 40
#: Bytes of terms in one automaton.
TERM_BYTES = 4 << 20


def is_test(path: Column) -> Column:
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    return F.arrays_overlap(parts, F.array(F.lit("tests"), F.lit("test"))) | F.startswith(name, F.lit("test_")) | F.contains(name, F.lit(".test."))


def walk_order(path: Column) -> Column:
    """Sorts paths as a walk meets them: a folder's files before its folders, each by name."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda p, i: F.struct((i < F.size(parts) - 1).alias("folder"), p.alias("name")))


def survey_files(files: DataFrame, exclude: str = "", max_bytes: int = 400_000, total_bytes: int | None = 40_000_000, most: int | None = 4000) -> DataFrame:
    """repo, path, length, kind, reason of files (repo, path, length, is_link); those with a reason are not read.

    ``unit`` names what a reason counts: the topmost folder that is left out, or the file.
    Sizes add up in the order of a walk; a file that does not fit is passed over. Without
    ``total_bytes`` and ``most`` a repository has no budget, and files are not put in order.
    """
    parts = F.split("path", "/")
    name, suffix = F.element_at(parts, -1), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    bad = lambda p: excluded(p, exclude) if exclude else F.lit(False)
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    last = lambda f: F.element_at(F.split(f, "/"), -1)
    shut = F.filter(folders, lambda f: last(f).isin(*SKIP_DIRS, "adocs") | F.startswith(last(f), F.lit(".")) | bad(f))
    folder = F.when(F.size(parts) > 1, F.get(shut, F.lit(0)))
    config = name.isin(*CONFIG_NAMES) | name.rlike(r"\.(service|sh)$")
    document = suffix.isin(*DOC_SUFFIXES) | (F.lower(name) == "readme")
    hidden = F.col("is_link") | name.isin("AGENTS.md", "CLAUDE.md", *SKIP_FILES) | F.startswith(name, F.lit(".")) | name.rlike(r"\.(pem|key)$") | bad(F.col("path"))
    reason = F.when(folder.isNotNull(), "excluded_directory").when(hidden, "excluded_file").when(~(suffix.isin(*CODE_SUFFIXES) | document | config), "unsupported_extension").when(F.col("length") > max_bytes, "survey_size_limit")
    kind = F.when(is_test(F.col("path")), "test").when(config, "config").when(document, "doc").otherwise("code")
    judged = files.select("repo", "path", "length", F.coalesce(folder, "path").alias("unit"), reason.alias("reason"), kind.alias("kind"))
    if total_bytes is None and most is None:
        return judged.select("repo", "path", "length", "unit", "reason", "kind")
    fits = fitting(judged.where("reason is null").withColumn("walk", walk_order(F.col("path"))), ("repo",), ["walk"], "length", total_bytes, most)
    kept = fits.select("repo", "path", "length", "unit", F.when(~F.col("fits"), "survey_size_limit").alias("reason"), "kind")
    return judged.where("reason is not null").unionByName(kept)


def exclusions(surveyed: DataFrame) -> DataFrame:
    """repo, reason and how many folders or files it left out."""
    return surveyed.where("reason is not null").groupBy("repo", "reason").agg(F.count_distinct("unit").alias("n"))


def config_lines(files: DataFrame) -> DataFrame:
    """repo, path, line, kind (command or dependency) and text of lines in configuration files (repo, path, text) that name one."""
    lines = files.select("repo", "path", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("i", "t"))
    said = F.array_compact(F.array(F.when(F.col("t").rlike(COMMAND), F.struct(F.lit("command").alias("kind"), F.left("t", F.lit(300)).alias("text"))), F.when(F.col("t").rlike(DEPENDENCY), F.struct(F.lit("dependency").alias("kind"), F.left("t", F.lit(200)).alias("text")))))
    return lines.select("repo", "path", (F.col("i") + 1).alias("line"), F.explode(said).alias("x")).select("repo", "path", "line", "x.kind", "x.text")


def doc_sections(files: DataFrame) -> DataFrame:
    """repo, path, line_start, line_end, heading, priority of documents (repo, path, text), to be read in order of priority.

    A fence is closed by its own mark only. The first section of a README is cut after
    ``INTRO_LINES`` lines. 0: the start and the useful sections of a README, 1: useful ones
    elsewhere, 2: the rest of a README, 3: the rest, 4: change logs.
    """
    lines = files.select("repo", "path", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("i", "t"))
    of = Window.partitionBy("repo", "path").orderBy("i")
    mark = F.nullif(F.regexp_extract("t", r"^\s*(`{3}|~{3})", 1), F.lit(""))
    lines = fence_state(lines.withColumn("mark", mark))
    heading = F.when(~F.col("fenced") & F.col("t").rlike(r"^#{1,6}\s"), F.regexp_replace("t", r"^[# ]+", ""))
    lines = lines.withColumn("heading", F.when((F.col("i") == 0) & heading.isNull(), "intro").otherwise(heading)).withColumn("section", F.count("heading").over(of))
    name = F.element_at(F.split("path", "/"), -1)
    readme, low = F.startswith(F.lower(name), F.lit("readme")), name.rlike(LOW_VALUE)
    rows = lines.groupBy("repo", "path", "section").agg(F.max("heading").alias("heading"), (F.min("i") + 1).alias("a"), (F.max("i") + 1).alias("b"))
    first = readme & (F.col("section") == 1)
    long = first & (F.col("b") - F.col("a") + 1 > INTRO_LINES)
    piece = lambda a, b, h: F.struct(a.alias("a"), b.alias("b"), h.alias("h"))
    whole = F.array(piece(F.col("a"), F.col("b"), F.col("heading")))
    halves = F.array(piece(F.col("a"), F.col("a") + INTRO_LINES - 1, F.col("heading")), piece(F.col("a") + INTRO_LINES, F.col("b"), F.concat("heading", F.lit(" (continued)"))))
    rows = rows.select("repo", "path", "section", F.col("a").alias("start"), F.explode(F.when(long, halves).otherwise(whole)).alias("p"))
    useful = F.col("p.h").rlike(PRIORITY)
    priority = F.when(low, 4).when(readme & (useful | ((F.col("section") == 1) & (F.col("p.a") == F.col("start")))), 0).when(useful, 1).when(readme, 2).otherwise(3)
    return rows.select("repo", "path", F.col("p.a").alias("line_start"), F.col("p.b").alias("line_end"), F.col("p.h").alias("heading"), priority.alias("priority"))


def fence_state(lines: DataFrame) -> DataFrame:
    """Lines (repo, path, i, mark) with ``fenced``: whether a fence is open after the line; only its own mark closes it."""
    def start():
        opened = None

        def step(mark):
            nonlocal opened
            if mark is not None:
                opened = mark if opened is None else None if mark == opened else opened
            return opened is not None

        return step

    return folded(lines, ("repo", "path"), ["i"], ("mark",), start, "fenced boolean")


def terms_of(asked: DataFrame) -> DataFrame:
    """(qid, term) of questions (qid, queries): their distinct words of two characters or more, but for stop words."""
    words = F.array_distinct(all_matches(F.lower(F.array_join("queries", " ")), r"[\p{L}\p{N}_]+"))
    return asked.select(F.col("qid").cast("long").alias("qid"), F.explode(words).alias("term")).where((F.length("term") > 1) & ~F.col("term").isin(*STOP_TERMS))


def automata(terms: DataFrame, limit: int = TERM_BYTES) -> Iterator:
    """Aho-Corasick automata of all distinct terms, in runs of at most ``limit`` bytes of terms; an automaton takes some 30 times that."""
    import ahocorasick

    words = terms.select("term").distinct()
    n = max(1, -(-(words.agg(F.sum(F.octet_length("term"))).first()[0] or 0) // limit))
    for i in range(n):
        found = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for (term,) in words.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i).toLocalIterator():
            found.add_word(term, term)
        if len(found):
            found.make_automaton()
            yield found


def term_hits(rows: DataFrame, text: Column, terms: DataFrame, least: int, limit: int = TERM_BYTES) -> DataFrame:
    """Rows with each term of more than ``least`` characters that their text holds, once for each row and term.

    One pass over the rows for each automaton, whatever the number of terms; terms meet
    their questions in a join.
    """
    import pyarrow as pa

    columns = rows.columns
    said = rows.select(*columns, text.alias("_said")).where("_said is not null")
    schema = T.StructType([*rows.schema.fields, T.StructField("term", T.StringType())])
    out = rows.sparkSession.createDataFrame([], schema)
    for found in automata(terms.where(F.length("term") > least), limit):
        handle = rows.sparkSession.sparkContext.broadcast(found)

        def scan(batches, handle=handle):
            for batch in batches:
                at, words = [], []
                for i, t in enumerate(batch.column(len(columns)).to_pylist()):
                    held = {term for _, term in handle.value.iter(t)}
                    at += [i] * len(held)
                    words += sorted(held)
                taken = batch.select(columns).take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(words, pa.string())], names=[*columns, "term"])

        out = out.unionByName(said.mapInArrow(scan, schema))
    return out


def candidates(asked: DataFrame, symbols: DataFrame, calls: DataFrame, lines: DataFrame, each: int = 2, total: int = 12) -> DataFrame:
    """qid, path, line_start, line_end, origin, score, place: what to read for questions (qid, queries, paths).

    Definitions score 3 a term in their path or name, and 10 in a path that is asked for;
    calls of a matching name 5, the start of an asked path 8, the first line of a file that
    holds a term 1; tests 1 less for definitions and calls. ``symbols`` has path, symbol,
    line_start, line_end, ``calls`` path, line, target, ``lines`` path, line, text.
    """
    terms = cut(terms_of(asked).distinct())
    asking = small(terms, F.octet_length("term") + 48)

    def matched(rows: DataFrame, text: Column, least: int) -> DataFrame:
        return term_hits(rows, text, terms, least).join(asking, "term")

    paths = asked.select("qid", F.explode("paths").alias("path")).distinct()
    test = is_test(F.col("path")).cast("int")
    hay = F.lower(F.concat("path", F.lit(" "), "symbol"))
    named = matched(symbols.select("path", "symbol", "line_start", "line_end"), hay, 1).groupBy("qid", "path", "symbol", "line_start", "line_end").agg((3 * F.count("*")).alias("s"))
    wanted = symbols.select("path", "symbol", "line_start", "line_end").join(paths, "path").select("qid", "path", "symbol", "line_start", "line_end", F.lit(10).cast("long").alias("s"))
    found = named.withColumn("named", F.lit(True)).unionByName(wanted.withColumn("named", F.lit(False)))
    found = found.groupBy("qid", "path", "symbol", "line_start", "line_end").agg(F.sum("s").alias("s"), F.bool_or("named").alias("named"))
    by_symbol = found.select("qid", "path", "line_start", "line_end", F.when(F.col("named"), "symbol").otherwise("path").alias("origin"), (F.col("s") - test).alias("score"))
    target = F.lower(F.element_at(F.split("target", r"\."), -1))
    # equal calls of one line count one by one, the terms of a call once
    same = calls.groupBy("path", "line", "target").agg(F.count("*").alias("n"))
    called = matched(same, target, 2).select("qid", "path", "line", "target", "n").distinct().select("qid", "path", "line", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    by_call = called.select("qid", "path", F.greatest(F.col("line") - 5, F.lit(1)).alias("line_start"), (F.col("line") + 30).alias("line_end"), F.lit("call").alias("origin"), (5 - test).cast("long").alias("score"))
    ends = lines.groupBy("path").agg(F.max("line").alias("n"))
    by_path = ends.join(paths, "path").select("qid", "path", F.lit(1).alias("line_start"), F.least("n", F.lit(60)).alias("line_end"), F.lit("path").alias("origin"), F.lit(8).cast("long").alias("score"))
    # a file's first line with a term, then its first line for a question
    first = term_hits(lines.select("path", "line", "text"), F.lower("text"), terms, 2).groupBy("path", "term").agg(F.min("line").alias("line"))
    at = first.join(asking, "term").groupBy("qid", "path").agg(F.min("line").alias("line"))
    by_line = at.select("qid", "path", F.greatest(F.col("line") - 5, F.lit(1)).alias("line_start"), (F.col("line") + 30).alias("line_end"), F.lit("line").alias("origin"), F.lit(1).cast("long").alias("score"))
    rows = by_symbol.unionByName(by_call).unionByName(by_path).unionByName(by_line).where("score != 0")
    order = [F.desc("score"), F.asc("path"), F.asc("line_start"), F.asc("origin"), F.asc("line_end")]
    nth = rows.withColumn("nth", F.row_number().over(Window.partitionBy("qid", "path").orderBy(*order))).where(F.col("nth") <= each)
    return nth.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("place") <= total).drop("nth")


def evidence(asked: DataFrame, lines: DataFrame, max_tokens: int = 1100, span: int = 60) -> DataFrame:
    """run, id, path, line_start, line_end, excerpt of asked passages (run, seq, path, line_start, line_end), each once.

    A passage ends with its file, after ``span`` lines if no end is asked for, and before the
    line with which its estimate would pass ``max_tokens``; ``excerpt`` says that it was cut.
    Ids follow the first request of each. ``lines`` has path, line and text.
    """
    last = lines.groupBy("path").agg(F.max("line").alias("n"))
    want = asked.join(last, "path").where(F.col("line_start").between(1, F.col("n"))).withColumn("end", F.least(F.coalesce("line_end", F.col("line_start") + span - 1), "n")).where("end >= line_start")
    inside = want.join(lines.select("path", "line", "text"), "path").where("line between line_start and end")
    so_far = Window.partitionBy("run", "seq").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    ascii_ = F.length(F.regexp_replace("text", r"[^\x00-\x7F]", ""))
    inside = inside.withColumn("ascii", F.sum(ascii_ + 1).over(so_far) - 1).withColumn("other", F.sum(F.length("text") - ascii_).over(so_far))
    kept = inside.where(F.floor(F.col("ascii") / 2.8 + F.col("other") * 0.6) + 1 <= max_tokens)
    cut = kept.groupBy("run", "seq", "path", "line_start", "end").agg(F.max("line").alias("stop"))
    first = cut.groupBy("run", "path", "line_start", F.col("stop").alias("line_end")).agg(F.min_by((F.col("stop") < F.col("end")), "seq").alias("excerpt"), F.min("seq").alias("seq"))
    return first.select("run", F.row_number().over(Window.partitionBy("run").orderBy("seq")).alias("id"), "path", "line_start", "line_end", "excerpt")


def material(files: DataFrame, quotas: dict[str, tuple[int, int]]) -> DataFrame:
    """repo, path, kind, text and whether it is left out, for files (repo, path, kind, position, text) and quotas (files, characters) by kind.

    Blank files take no place; texts over their kind's length are cut and say so.
    """
    allowed = F.create_map(*[F.lit(x) for k, (n, _) in quotas.items() for x in (k, n)])
    length = F.create_map(*[F.lit(x) for k, (_, c) in quotas.items() for x in (k, c)])
    rows = files.where(F.col("kind").isin(*quotas) & (F.trim("text", F.lit(" \t\r\n")) != "")).withColumn("text", F.trim("text", F.lit(" \t\r\n")))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("repo", "kind").orderBy("position", "path")))
    out = F.col("nth") > allowed[F.col("kind")]
    shown = F.when(F.length("text") <= length[F.col("kind")], F.col("text")).otherwise(F.concat(F.left("text", length[F.col("kind")]), F.lit("\n…")))
    return rows.select("repo", "path", "kind", F.when(~out, shown).alias("text"), out.alias("left_out"))


def capped(rows: DataFrame, by: tuple[str, ...], key: Column, order: list[Column], cap: int) -> DataFrame:
    """The first row of each key, at most ``cap`` of a group in an order, with ``total``, how many keys the group has."""
    first = rows.withColumn("_key", key).withColumn("_nth", F.row_number().over(Window.partitionBy(*by, "_key").orderBy(*order))).where("_nth = 1")
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).withColumn("total", F.count("*").over(Window.partitionBy(*by)))
    return placed.where(F.col("place") <= cap).drop("_key", "_nth")


def grouped_names(rows: DataFrame, by: tuple[str, ...], name: str, order: str, cap: int = 6) -> DataFrame:
    """The first ``cap`` distinct names of each group in an order, and how many there are."""
    lists = rows.groupBy(*by).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda x: x[name])).alias("all"))
    return lists.select(*by, F.slice("all", 1, cap).alias("names"), F.size("all").alias("total"))


def topic_capacity(calls: DataFrame, remaining: Column | None, *, fixed: int = 2, most: int = 5, out_tokens: int = 700, input_s: float = 5, default_s: float = 35, factor: float = 1.0, plan_s: float = 30, reserve_s: float = 120) -> DataFrame:
    """run, tok_s, topic_cost_s, total and planned: how many topics the rest of a run's time allows.

    ``calls`` has run, stage, eval_count and eval_ns; the speed is that of document calls.
    """
    speed = F.col("stage") == "documents"
    count, ns = F.sum(F.when(speed & (F.col("eval_count") > 0) & (F.col("eval_ns") > 0), F.col("eval_count"))), F.sum(F.when(speed & (F.col("eval_count") > 0) & (F.col("eval_ns") > 0), F.col("eval_ns")))
    runs = calls.groupBy("run").agg((count / (ns / 1e9)).alias("tok_s"))
    cost = F.coalesce(out_tokens / F.col("tok_s") + input_s, F.lit(float(default_s))) * factor
    total = F.lit(fixed + most) if remaining is None else F.floor(F.greatest(remaining - plan_s - reserve_s - cost, F.lit(0.0)) / cost).cast("int")
    return runs.select("run", F.round("tok_s", 1).alias("tok_s"), F.round(cost, 1).alias("topic_cost_s"), total.alias("total"), F.greatest(F.lit(1), F.least(F.lit(most), total - fixed)).alias("planned"))


CLAIMS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("evidence_ids", T.ArrayType(T.StringType()))]))
FEATURES = "struct<project_summary:string,core_features:array<struct<name:string,purpose:string,search_queries:array<string>,evidence:string>>>"


def features(answer: Column) -> Column:
    """project_summary and features of a model's JSON; features without a name go, blank queries too; null for what is no object."""
    blank = " \t\r\n"

    def tidy(f: Column) -> Column:
        text = lambda c: F.coalesce(F.trim(f[c], F.lit(blank)), F.lit("")).alias(c)
        queries = F.filter(F.transform(F.coalesce(f["search_queries"], F.array().cast("array<string>")), lambda q: F.trim(q, F.lit(blank))), lambda q: q != "")
        return F.struct(text("name"), text("purpose"), queries.alias("search_queries"), text("evidence"))

    def of(x: Column) -> Column:
        rows = F.filter(F.transform(F.coalesce(x["core_features"], F.from_json(F.lit("[]"), "array<struct<name:string,purpose:string,search_queries:array<string>,evidence:string>>")), tidy), lambda f: f["name"] != "")
        return F.when(x.isNotNull(), F.struct(F.coalesce(F.trim(x["project_summary"], F.lit(blank)), F.lit("")).alias("project_summary"), rows.alias("core_features")))

    return let(F.when(F.ltrim(answer).startswith("{"), F.from_json(answer, FEATURES)), of)


def checked_claims(claims: Column, allowed: Column, limit: int = 12) -> Column:
    """kept claims and what was dropped: claims of bad text or ids, single bad ids, and whether the list was cut.

    Ids are whole numbers however written; one bad id takes its claim along.
    """
    blank, marker = " \t\r\n", r"\[\d+(?:\s*,\s*\d+)*\]"
    number = lambda i: F.when(i.rlike(r"^\s*\d+(\.0+)?\s*$"), F.trim(i).cast("double").cast("long"))

    def read(c: Column) -> Column:
        raw = F.coalesce(c["evidence_ids"], F.array().cast("array<string>"))
        good = F.filter(F.transform(raw, number), lambda i: i.isNotNull() & F.array_contains(allowed, i))
        text = F.trim(F.regexp_replace(c["text"], marker, ""), F.lit(blank))
        sound = F.coalesce((F.trim(c["text"], F.lit(blank)) != "") & (F.length(c["text"]) <= 1600), F.lit(False))
        lost = F.when(sound, F.size(raw) - F.size(good)).otherwise(0)
        return F.struct(text.alias("text"), F.array_distinct(good).alias("evidence_ids"), lost.alias("lost"), (sound & (F.size(raw) > 0) & (F.size(good) == F.size(raw)) & (text != "")).alias("ok"))

    def of(rows: Column) -> Column:
        kept = F.transform(F.filter(rows, lambda r: r["ok"]), lambda r: F.struct(r["text"].alias("text"), r["evidence_ids"].alias("evidence_ids")))
        ids = F.aggregate(rows, F.lit(0), lambda a, r: a + r["lost"])
        return F.struct(F.slice(kept, 1, limit).alias("claims"), (F.size(rows) - F.size(kept)).alias("dropped_claims"), ids.alias("dropped_ids"), (F.size(kept) > limit).alias("truncated"))

    return let(F.transform(F.coalesce(claims, F.from_json(F.lit("[]"), CLAIMS)), read), of)


def supported_locations(locations: DataFrame, found: DataFrame) -> DataFrame:
    """Locations (run, key, path, symbol) whose path and symbol, or path if they name no symbol, are among the evidence (run, path, symbol)."""
    pairs = found.select("run", "path", F.coalesce("symbol", F.lit("")).alias("symbol")).distinct()
    asked = locations.withColumn("symbol", F.coalesce("symbol", F.lit("")))
    exact = asked.where("symbol != ''").join(pairs, ["run", "path", "symbol"], "left_semi")
    return exact.unionByName(asked.where("symbol = ''").join(pairs.select("run", "path").distinct(), ["run", "path"], "left_semi"))
