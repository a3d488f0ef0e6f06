"""From hits to answers: references, file roll-ups, evidence quotas, budgets, path resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import citations, no_evidence
from .ordered import fitting


def references(contexts: DataFrame, cited: DataFrame, cited_only: bool) -> DataFrame:
    """Contexts (qid, n, path, section, line_start, line_end, score) with a cited flag; numbers never change.

    ``cited`` has qid and an array of numbers. With no valid citation all contexts stay
    and the flag is null, also when only cited ones are asked for.
    """
    joined = contexts.join(cited, "qid", "left").withColumn("any", F.coalesce(F.size("cited") > 0, F.lit(False)))
    flag = F.when(F.col("any"), F.array_contains("cited", F.col("n")))
    out = joined.withColumn("is_cited", flag).drop("any", "cited")
    return out.where("is_cited is null or is_cited") if cited_only else out


def reference_files(references_: DataFrame) -> DataFrame:
    """One row of each question and path in order of first appearance."""
    row = F.struct("n", "line_start", "line_end", "section")
    rows = references_.groupBy("qid", "path").agg(F.array_sort(F.collect_list(row)).alias("r"), F.max("score").alias("best_score"), F.coalesce(F.bool_or("is_cited"), F.lit(False)).alias("cited"))
    return rows.select(
        "qid", "path", F.transform("r", lambda x: x["n"]).alias("citations"),
        F.transform(F.filter("r", lambda x: x["line_start"] > 0), lambda x: F.array(x["line_start"], x["line_end"])).alias("lines"),
        F.array_distinct(F.filter(F.transform("r", lambda x: x["section"]), lambda s: s.isNotNull() & (s != ""))).alias("sections"),
        "best_score", "cited", F.array_min(F.transform("r", lambda x: x["line_start"])).alias("line"), F.size("r").alias("chunk_count"),
        F.row_number().over(Window.partitionBy("qid").orderBy(F.col("r")[0]["n"])).alias("place"),
    )


def final_answers(answers: DataFrame, contexts: DataFrame, cited_only: bool = True) -> DataFrame:
    """qid, answer, no_evidence, cited and references (n, path) of answers (qid, answer); one that says it found nothing has neither.

    ``contexts`` has qid, n and path; citations count within a question's own contexts.
    """
    none = no_evidence(F.col("answer"))
    given = contexts.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", "path"))).alias("given"))
    rows = answers.join(given, "qid", "left").withColumn("given", F.coalesce("given", F.array().cast(given.schema["given"].dataType)))
    rows = rows.withColumn("cited", citations(F.col("answer"), F.size("given")))
    shown = F.filter("given", lambda g: F.array_contains(F.col("cited"), g["n"])) if cited_only else F.col("given")
    shown = F.when(none, F.slice("given", 1, 0)).when(F.size("cited") == 0, F.col("given")).otherwise(shown)
    empty = F.array().cast("array<int>")
    return rows.select("qid", F.when(none, "NO_EVIDENCE").otherwise(F.col("answer")).alias("answer"), none.alias("no_evidence"), F.when(none, empty).otherwise(F.col("cited")).alias("cited"), shown.alias("references"))


def quota(rows: DataFrame, by: tuple[str, ...], per: str, order: list[Column], each: int, total: int) -> DataFrame:
    """At most ``each`` rows of one ``per`` value and ``total`` of a group, in one order."""
    nth = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by, per).orderBy(*order))).where(F.col("nth") <= each)
    return nth.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= total)


def pack(rows: DataFrame, by: str, order: str, size: str, limit: int) -> DataFrame:
    """Rows of each group that fit a budget when taken in order; one that does not fit is skipped, later ones may fit."""
    return fitting(rows.select(by, order, size), (by,), [order], size, limit).where("fits").select(by, order)


def resolve_paths(asked: DataFrame, files: DataFrame) -> DataFrame:
    """asked path and the file it names: the same path, else the only file that ends with it, else null.

    Files are keyed by every suffix of their path that starts at a segment, so the suffix
    match is an equi-join.
    """
    clean = F.regexp_replace(F.regexp_replace(F.replace(F.trim("asked"), F.lit("\\"), F.lit("/")), r"^(\./)+", ""), "^/+", "")
    parts = F.split("path", "/")
    suffixes = files.select("path", parts.alias("s")).select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.concat_ws("/", F.slice("s", i, F.size("s"))))).alias("key"))
    joined = asked.select("asked", clean.alias("key")).distinct().join(suffixes, "key", "left")
    found = joined.groupBy("asked", "key").agg(F.max(F.when(F.col("path") == F.col("key"), F.col("path"))).alias("exact"), F.count("path").alias("n"), F.max("path").alias("only"))
    return found.select("asked", F.when(F.col("exact").isNotNull(), F.col("exact")).when(F.col("n") == 1, F.col("only")).alias("path"))


def evidence_rollup(hits: DataFrame) -> DataFrame:
    """path, lines, distinct symbols and distinct queries of evidence (query, path, line_start, line_end, symbol)."""
    return hits.groupBy("path").agg(F.array_sort(F.collect_set(F.struct("line_start", "line_end"))).alias("lines"), F.array_sort(F.collect_set("symbol")).alias("symbols"), F.array_sort(F.collect_set("query")).alias("queries"))


def expand_queries(hits: DataFrame, asked: DataFrame, limit: int = 6) -> DataFrame:
    """A second round of queries: the symbols and paths of the first round's hits, in rank order, new ones only."""
    words = hits.select("qid", "rank", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("symbol").alias("q")), F.struct(F.lit(1).alias("k"), F.col("path").alias("q")))).alias("x")).where("x.q is not null")
    first = words.groupBy("qid", F.col("x.q").alias("query")).agg(F.min(F.struct("rank", F.col("x.k").alias("k"))).alias("at")).join(asked, ["qid", "query"], "left_anti")
    return first.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("at", "query"))).where(F.col("n") <= limit).select("qid", "query", "n")


def first_match(keys: DataFrame, key: str, *sources: tuple[DataFrame, str]) -> DataFrame:
    """The value of the first source that has one for the key."""
    out = keys
    for i, (df, value) in enumerate(sources):
        one = df.groupBy(key).agg(F.min(value).alias(f"_v{i}"))
        out = out.join(one, key, "left")
    return out.withColumn("value", F.coalesce(*[F.col(f"_v{i}") for i in range(len(sources))])).drop(*[f"_v{i}" for i in range(len(sources))])


def next_sequence(rows: DataFrame, by: str, sequence: str, fresh: DataFrame, order: str) -> DataFrame:
    """Fresh rows numbered after the greatest number of their group."""
    top = rows.groupBy(by).agg(F.max(sequence).alias("_top"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return fresh.join(top, by, "left").withColumn(sequence, F.coalesce("_top", F.lit(0)) + nth).drop("_top")


def pick_model(loaded: DataFrame, preferences: list[str], requested: str | None = None) -> DataFrame:
    """The loaded model to use: the requested one, else the first preferred, else the first loaded; ``x`` means ``x:latest``."""
    full = lambda m: m if ":" in m else f"{m}:latest"
    name = F.when(F.contains("model", F.lit(":")), F.col("model")).otherwise(F.concat("model", F.lit(":latest")))
    order = F.lit(len(preferences) + 1)
    for i, p in reversed(list(enumerate(preferences))):
        order = F.when(name == full(p), i).otherwise(order)
    if requested is not None:
        loaded = loaded.where(name == full(requested))
    return loaded.agg(F.min_by(name, F.struct(order, "position")).alias("model"))
