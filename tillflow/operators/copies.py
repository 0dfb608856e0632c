"""Copies found by digest: whole rows are shuffled only where their content may come again.

:func:`~tillflow.operators.cleaning.fold_copies` shuffles every row with all its columns, once. Where rows are wide and copies
few, this way shuffles 8 bytes a row and the rows with copies, and reads the rows three times, so they should lie in a
written table. Both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillflow.operators.cleaning import COPIES, fold_copies
from tillflow.scratch import settle

# Words of 64 bits in the Bloom filter, 8 MB whatever the table holds. It keeps apart some ten million contents that have
# copies; with more, other rows are shuffled as well and the result stays the same.
FILTER_WORDS = 1 << 20


def _digest(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c != "row_id"])


def _bits(digest: Column) -> Column:
    """Three bits of a word, from the digest's upper part; its lower part tells the word."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(digest, at).bitwiseAND(63).cast("int")) for at in (40, 46, 52)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def repeated_digests(df: DataFrame) -> DataFrame:
    """Digests of the contents, all columns but ``row_id``, that several rows have; a few contents that differ may share one."""
    return df.select(_digest(df).alias("digest")).groupBy("digest").agg(F.count("*").alias("rows")).where("rows > 1").select("digest")


def digest_filter(digests: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """A Bloom filter as a table of at most ``words`` rows: three bits of one word for each digest."""
    digest = F.col("digest")
    return digests.groupBy(F.pmod(digest, F.lit(words)).alias("_word")).agg(F.bit_or(_bits(digest)).alias("_word_bits"))


def fold_copies_by_digest(df: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """The rows of :func:`~tillflow.operators.cleaning.fold_copies`, by way of digests.

    The filter of repeated digests goes to every task. Rows that it does not hold are the only ones of their content and stay
    where they are; the others are compared on all columns. The filter has false positives and no false negatives.
    """
    found = settle(digest_filter(repeated_digests(df), words), "digests")
    digest, bits = F.col("_digest"), _bits(F.col("_digest"))
    marked = df.withColumn("_digest", _digest(df)).withColumn("_at", F.pmod(digest, F.lit(words)))
    marked = marked.join(F.broadcast(found), F.col("_at") == F.col("_word"), "left")  # at most ``words`` rows
    suspect = F.coalesce(F.col("_word_bits").bitwiseAND(bits) == bits, F.lit(False))
    columns = [F.col(f"`{c}`") for c in df.columns]
    single = marked.where(~suspect).select(*columns, F.lit(1).cast("long").alias(COPIES))
    return single.unionByName(fold_copies(marked.where(suspect).select(*columns)))
