"""Registered queries of the text operators; each reads whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillflow.llm import (
    chat_perspectives, cotraining, decontaminate, filter_audit, language_id, packing, quality_rules, set_sketch, sharding, simhash,
    suffix_tree, token_counts, word_runs,
)
from tillflow.llm.shared import read_table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    """Where the public tokenizer's file lies on the driver; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def clean_label() -> Column:
    """A document worth keeping: labelled as of good quality and not as toxic."""
    return (F.col("quality") > 0) & (F.coalesce(F.col("toxic"), F.lit(0)) < 1)


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree.language_model_scores(read_table(spark, folder, "documents"))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_report(read_table(spark, folder, "documents"), tokenizer_path())


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return quality_rules.quality_report(docs, quality_rules.train(docs, read_table(spark, folder, "labels")))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, folder, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op6_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicate_components(read_table(spark, folder, "documents"))


def op7_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat_perspectives.perspective_report(read_table(spark, folder, "conversations"))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read_table(spark, folder, "documents"), tokenizer_path())


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(read_table(spark, folder, "documents"))


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return cotraining.score_documents(docs, cotraining.train(docs, read_table(spark, folder, "labels"), clean_label()))


def op11_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return set_sketch.near_copy_components(read_table(spark, folder, "documents"))


def op12_filter_interaction_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.filter_report(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op13_periodic_run_detection(spark: SparkSession, folder: str) -> DataFrame:
    return word_runs.run_report(word_runs.plant_period(read_table(spark, folder, "documents")))


QUERIES = (
    op1_lm_scoring, op2_token_counts, op3_quality_rules, op4_sharding, op5_benchmark_decontamination,
    op6_simhash_near_dedup, op7_chat_formatting, op8_packing, op9_language_id, op10_quality_classifier,
    op11_minhash_near_dedup, op12_filter_interaction_audit, op13_periodic_run_detection,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """Where SQL can state the result; the other queries are tested against brute force."""
    return {
        op7_chat_formatting.__name__: chat_perspectives.oracle(),
        op12_filter_interaction_audit.__name__: filter_audit.oracle(),
    }
