"""Copies by digest against copies by grouping whole rows."""

import random

import pytest
from pyspark.sql import functions as F

from tillflow.operators import copies
from tillflow.operators.cleaning import fold_copies

SCHEMA = "row_id long, a string, b string, sales decimal(28,4), day date"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def shuffled_bytes(df):
    """Bytes that the exchanges of a query have written."""
    df.collect()
    total, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec":
                total += node.metrics().apply("shuffleBytesWritten").value()
            children = node.children()
            left += [children.apply(i) for i in range(children.size())]
    return total


@pytest.fixture
def odd(spark):
    """NULLs that change places, copies by the hundred, rows without a copy, and NULL ids."""
    rng = random.Random(2)
    made = [(i, None, "x", None, None) for i in range(3)] + [(9, "x", None, None, None), (None, "x", None, None, None)]
    made += [(100 + i, "hot", "hot", None, None) for i in range(300)]
    made += [(1000 + i, f"t{rng.randrange(500)}", rng.choice([None, "", "y"]), None, None) for i in range(400)]
    return spark.createDataFrame(made, SCHEMA)


@pytest.mark.parametrize("words", [1, 64, copies.FILTER_WORDS])
def test_same_rows_with_any_filter(odd, words):
    """With one word nearly all rows are compared, with many nearly only the copies."""
    assert rows(copies.fold_copies_by_digest(odd, words)) == rows(fold_copies(odd))


def test_empty_table(spark):
    assert copies.fold_copies_by_digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_filter_has_a_bounded_number_of_rows(odd):
    found = copies.digest_filter(copies.repeated_digests(odd), 16)
    assert found.count() <= 16


def test_wide_rows_with_few_copies_are_hardly_shuffled(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(0, 20_000, 1, 8).select(
        F.col("id").alias("row_id"), *[F.sha2((F.col("id") % 19_600 * 31 + i).cast("string"), 512).alias(f"c{i}") for i in range(4)]
    ).write.parquet(path)
    wide = spark.read.parquet(path)
    whole = shuffled_bytes(fold_copies(wide))
    by_digest = shuffled_bytes(copies.repeated_digests(wide)) + shuffled_bytes(copies.fold_copies_by_digest(wide))
    assert copies.fold_copies_by_digest(wide).count() == 19_600
    assert by_digest * 10 < whole
