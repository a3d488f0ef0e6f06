"""Operator 2, token counts: an exact histogram of encoded lengths and its suffix sums.

One aggregation gives, for every length that occurs, how many documents have it. Suffix
sums of counts and tokens then answer any context limit L: documents of at least L
tokens, their tokens, and the corpus total when each text is cut to L tokens, which is
``tokens_below(L) + L * docs_at_least(L)``. The sums run in two levels: whole blocks of
``BLOCK`` lengths first (one row for each block), then the lengths inside each block, so no
task has to hold all lengths.

Edge cases: null and empty texts have length 0 and are counted; ties share one row;
repeated rows count as often as they occur; an empty table gives an empty histogram, and
quantiles and truncated totals of it have no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .shared import cut

BLOCK = 1024


def histogram(lengths: DataFrame) -> DataFrame:
    """length, n_docs, docs_at_least, tokens_at_least, truncated_total (each text cut to this length), fraction_at_most."""
    counts = cut(lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs")))
    counts = counts.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("bd").over(every).alias("all_docs"),
        F.sum("bt").over(every).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    out = counts.join(blocks, "block").select(
        "length", "n_docs", "all_docs", "all_tokens",
        (F.sum("n_docs").over(inside) + F.col("docs_after")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("tokens_after")).alias("tokens_at_least"),
    )
    return out.select(
        "length", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("fraction_at_most"),
    )


def truncated_totals(histogram_: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: tokens kept when every text is cut to it, and texts that are cut."""
    asked = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("context_limit")
    kept = F.sum(F.least("length", "context_limit") * F.col("n_docs")).alias("kept_tokens")
    cut = F.sum(F.when(F.col("length") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("cut_docs")
    return histogram_.select("length", "n_docs", asked).groupBy("context_limit").agg(kept, cut)


def quantiles(histogram_: DataFrame, shares: list[float]) -> DataFrame:
    """For each share the least length that at least this share of the documents does not exceed."""
    at = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    return histogram_.select("length", "fraction_at_most", at).groupBy("share").agg(F.min(F.when(F.col("fraction_at_most") >= F.col("share"), F.col("length"))).alias("length"))


def corpus_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The histogram of a documents table under the byte-level BPE vocabulary."""
    return histogram(bpe.lengths(docs, path))
