"""Retrieval evaluation: ranks against gold, metrics, threshold sweeps, suite checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import gate


def first_relevant_rank(hits: DataFrame, relevant: Column, questions: DataFrame | None = None) -> DataFrame:
    """qid, rank of the first relevant hit (null if none) and the greatest score; ``questions`` (qid) without hits have nulls."""
    found = hits.groupBy("qid").agg(F.min(F.when(relevant, F.col("rank"))).alias("rank"), F.max("score").alias("top_score"))
    return found if questions is None else questions.select("qid").distinct().join(found, "qid", "left")


def pipeline_rows(hits: DataFrame, relevant: Column, threshold: float, k: int, questions: DataFrame) -> DataFrame:
    """qid, answerable, rank, top_score, has_evidence, reason and passed ids when whole answers are evaluated.

    A rank counts within the contexts that pass the gate, and only answerable questions have one.
    ``hits`` has qid, id, rank and score, ``questions`` qid and answerable.
    """
    passed = hits.where(F.col("score") >= threshold).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("place") <= k)
    first = passed.groupBy("qid").agg(F.min(F.when(relevant, F.col("place"))).alias("place"))
    gated = gate(hits.select("qid", "id", "rank", "score"), threshold, k, questions)
    rows = questions.select("qid", "answerable").join(gated, "qid").join(first, "qid", "left")
    return rows.select("qid", "answerable", F.when(F.col("answerable"), F.col("place")).alias("rank"), "top_score", "has_evidence", "reason", F.col("contexts").alias("passed"))


def metrics(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Hit@1, 3, 5, MRR, recall of the gate and of unanswerable questions, and latency percentiles."""
    yes, no = F.col("answerable"), ~F.col("answerable")

    def share(of: Column, where: Column) -> Column:
        return F.round(F.avg(F.when(where, F.when(of, 1.0).otherwise(0.0))), 6)

    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(yes).alias("n_answerable"),
        *[share(F.coalesce(F.col("rank") <= k, F.lit(False)), yes).alias(f"hit_at_{k}") for k in (1, 3, 5)],
        F.round(F.avg(F.when(yes, F.coalesce(1 / F.col("rank"), F.lit(0.0)))), 6).alias("mrr"),
        share(F.col("has_evidence"), yes).alias("gate_recall"),
        share(~F.col("has_evidence"), no).alias("no_evidence_recall"),
        F.round(F.percentile("ms", F.lit(0.5)), 1).alias("p50_ms"),
        F.round(F.percentile("ms", F.lit(0.95)), 1).alias("p95_ms"),
    )


def metrics_by_tag(rows: DataFrame) -> DataFrame:
    """A question counts under each of its tags."""
    return metrics(rows.withColumn("tag", F.explode("tags")), ("tag",))


def sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """The confusion matrix and derived rates at every threshold; a null score never passes."""
    at = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    grid = rows.select("answerable", "rank", "top_score", at)
    passed = F.coalesce(F.col("top_score") >= F.col("threshold"), F.lit(False))
    yes = F.col("answerable")
    out = grid.groupBy("threshold").agg(
        F.count_if(yes & passed).alias("tp"), F.count_if(yes & ~passed).alias("fn"), F.count_if(~yes & passed).alias("fp"), F.count_if(~yes & ~passed).alias("tn"),
        F.count_if(yes & passed & (F.col("rank") <= 3)).alias("hits"),
    )
    positives, negatives = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    gate, none = F.when(positives > 0, F.col("tp") / positives), F.when(negatives > 0, F.col("tn") / negatives)
    return out.select(
        "threshold", "tp", "fn", "fp", "tn",
        F.round(gate, 6).alias("gate_recall"), F.round(none, 6).alias("no_evidence_recall"),
        F.round(F.when(positives > 0, F.col("hits") / positives), 6).alias("hit_at_3"),
        F.round((gate + none) / 2, 6).alias("balanced_accuracy"),
    )


def best_threshold(swept: DataFrame) -> DataFrame:
    """The row of the greatest balanced accuracy, of equal ones the highest threshold."""
    return swept.where("balanced_accuracy is not null").agg(F.max(F.struct("balanced_accuracy", "threshold")).alias("x")).select("x.threshold", "x.balanced_accuracy")


def nearest_threshold(swept: DataFrame, current: float) -> DataFrame:
    return swept.agg(F.min_by("threshold", F.struct(F.abs(F.col("threshold") - current), "threshold")).alias("threshold"))


def gold_matches(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """Hits that match a gold location: same path, symbol contained, and line ranges that touch; a missing range matches."""
    same = (hits.qid == gold.qid) & (hits.path == gold.path)
    touches = ~((hits.line_end < gold.gold_start) | (hits.line_start > gold.gold_end))
    named = gold.symbol.isNull() | F.contains(F.coalesce(hits.symbol, F.lit("")), gold.symbol)
    return hits.join(gold, same & F.coalesce(touches, F.lit(True)) & named, "left_semi")


def field_errors(lines: DataFrame, known: tuple[str, ...] = ("id", "question", "answerable", "type", "gold", "tags", "note"), required: tuple[str, ...] = ("id", "question", "answerable", "gold", "tags")) -> DataFrame:
    """line and messages of suite lines (line, text) that are no JSON object, lack a required field or have an unknown one."""
    keys = F.json_object_keys(F.when(F.ltrim("text").startswith("{"), F.col("text")))
    absent = F.transform(F.array_except(F.array(*map(F.lit, required)), keys), lambda k: F.concat(F.lit("missing "), k))
    strange = F.transform(F.array_except(keys, F.array(*map(F.lit, known))), lambda k: F.concat(F.lit("unknown "), k))
    found = lines.select("line", F.when(keys.isNull(), F.array(F.lit("not an object"))).otherwise(F.concat(absent, F.array_sort(strange))).alias("errors"))
    return found.where(F.size("errors") > 0)


def suite_errors(questions: DataFrame, tags: list[str]) -> DataFrame:
    """id and messages for every question that breaks a rule of the suite."""
    ok_id = F.coalesce(F.col("id"), F.lit("")).rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$")
    rules = [
        (~ok_id, "bad id"),
        (F.count("*").over(Window.partitionBy("id")) > 1, "duplicate id"),
        (F.trim(F.coalesce("question", F.lit(""))) == "", "blank question"),
        (F.col("answerable") & (F.size("gold") == 0), "answerable without gold"),
        (~F.col("answerable") & (F.size("gold") > 0), "gold but not answerable"),
        (F.size("tags") == 0, "no tags"),
        (F.size(F.array_except("tags", F.array(*map(F.lit, tags)))) > 0, "unknown tag"),
        (F.size(F.array_distinct("tags")) < F.size("tags"), "duplicate tag"),
        (F.exists("gold", lambda g: g["line_start"].isNull() != g["line_end"].isNull()), "line without its pair"),
        (F.exists("gold", lambda g: (g["line_start"] < 1) | (g["line_end"] < g["line_start"])), "bad line range"),
    ]
    found = questions.withColumn("errors", F.array_compact(F.array(*[F.when(c, m) for c, m in rules])))
    return found.where(F.size("errors") > 0).select("id", "errors")


def percentiles(rows: DataFrame, by: str, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99), digits: int = 1) -> DataFrame:
    """n and interpolated percentiles (p50 and the like) of a value in each group."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *[F.round(F.percentile(value, F.lit(x)), digits).alias(f"p{round(100 * x)}") for x in shares])
