"""Five stages from raw documents to deduplicated, decontaminated, encoded ones.

Edge cases: null and empty texts, and texts under 20 words, fail the base rules of the first
stage; repeated rows and copies leave one row, the one with the least doc_id; rows without a
doc_id are judged, deduplicated and decontaminated by their text like all others; very long
texts go through whole; further columns are carried along, except that the last stage
replaces columns of the names it adds; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, near_dedup, quality_rules
from lodestone.llm.shared import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept_documents(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    from lodestone.llm import toxicity as classifier

    return classifier.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    from lodestone.llm import decontaminate

    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids and the digest of the text decoded from them."""
    return bpe.encoded(docs)


STAGES = [("quality rules", quality), ("toxicity", toxicity), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark), ("BPE encoding and decoding", encode)]

#: Classifier, sampling and encoder have no SQL form; the tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
