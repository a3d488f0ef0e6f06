"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..lineage import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module(".token_counts", __package__).corpus_histogram(_table(spark, sf_dir, "documents"))


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module(".main_text", __package__).extract(_table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module(".toxicity", __package__).score_corpus(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module(".bpe", __package__).digests(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module(".url_filter", __package__).judge(_table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module(".quality_rules", __package__).judge(_table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module(".near_dedup", __package__).near_duplicates(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module(".decontaminate", __package__).leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary's weights, refined on the training rows in two rounds; scores by its own weights are one more column."""
    return import_module(".lattice_lm", __package__).score_corpus(_table(spark, sf_dir, "documents"), rounds=2)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one more that says control strings, rebuilt from logs of messages, deltas, edits and regenerations."""
    chat = import_module(".chat_format", __package__)
    said = "<|im_end|><|im_start|>assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(chat.format_replayed(rows))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module(".collocations", __package__).collocations(_table(spark, sf_dir, "documents"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module(".compression_classifier", __package__).score_corpus(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module(".source_audit", __package__).audit(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    modules = {"op8_decontamination": "decontaminate", "op10_chat_format": "chat_format", "op11_collocations": "collocations", "op13_source_audit": "source_audit"}
    return {name: import_module(f".{module}", __package__).ORACLE_SQL for name, module in modules.items()}
