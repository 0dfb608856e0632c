"""A corpus pipeline: each stage reads what the one before it has kept, as a written table.

The files of stages go to the shared folder. ORACLE_SQL is None: the learned stages have no form in SQL, so the pipeline
is tested against a plain version of each stage's rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillflow.llm import cotraining, decontaminate, packing, quality_rules, simhash
from tillflow.llm.queries import clean_label, tokenizer_path
from tillflow.llm.shared import read_table, settle


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject, as of poor quality or toxic."""
    return cotraining.keep_good(docs, cotraining.train(docs, read_table(spark, sf_dir, "labels"), clean_label()))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and the learned one.

    The learned rule comes from the original documents: the stage before has removed most of its bad examples.
    """
    model = quality_rules.train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints within 2 bits, of three-word shingles: the one with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of test items; without documents that are mostly such passages."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules_stage),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
