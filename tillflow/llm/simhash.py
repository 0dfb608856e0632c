"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from xxhash import xxh64_intdigest

from tillflow.llm.graph import component_labels
from tillflow.llm.shared import add_python_columns, settle, text_bytes

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
BITS = 64
_SLICE = 1 << 15


def simhash(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit fingerprint of UTF-8 text, as a signed number. Null and wordless texts have 0.

    A-Z are lower-cased and words end at white space; a bit is set if more than half of the shingle hashes have it,
    repeats counted. A text of fewer words than a shingle is one shingle.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles, n = [b" ".join(words)], 1
    else:
        shingles, n = map(b" ".join, zip(*[words[i:] for i in range(shingle_words)])), len(words) - shingle_words + 1
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.dtype("<u8"), n)
    votes = np.zeros(BITS, np.int64)
    for i in range(0, n, _SLICE):
        one = hashes[i : i + _SLICE].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(one, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<i8")[0])


def add_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with a fingerprint (long) per row; a column of that name is replaced."""

    def start():
        return lambda column: [[simhash(t, shingle_words) for t in text_bytes(column)]]

    return add_python_columns(docs, [text], [T.StructField(name, T.LongType())], start)


def _ball(fingerprint: Column, radius: int) -> Column:
    """All values at ``radius`` or fewer differing bits: 1 + 64 for radius 1."""
    masks = [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(BITS), r)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in signed]), lambda m: fingerprint.bitwiseXOR(m))


def fingerprint_links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) between distinct ``fingerprint`` values that give the classes of the "at most ``radius`` bits" graph.

    Two fingerprints at ``radius`` (an even number) or less share a variant at half of it from either, so all that
    collide on a variant are within ``radius`` of each other. A variant's bucket can therefore hold no more than the
    values in its ball (65 at radius 2), whatever the data, and linking each to the bucket's smallest loses no
    connection. Every link is verified on the bits.
    """
    if radius % 2:
        raise ValueError("radius must be even: both sides walk half of it")
    variants = fingerprints.select("fingerprint", F.explode(_ball(F.col("fingerprint"), radius // 2)).alias("variant"))
    lowest = F.min("fingerprint").over(Window.partitionBy("variant"))
    return (
        variants.withColumn("v", lowest)
        .where(F.col("fingerprint") != F.col("v"))
        .select(F.col("fingerprint").alias("u"), "v")
        .distinct()
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    )


def _classes(marked: DataFrame, radius: int) -> DataFrame:
    """(fingerprint, label) for each distinct fingerprint of ``marked``."""
    distinct = marked.select("fingerprint").distinct()
    labels = component_labels(fingerprint_links(distinct, radius))
    return (
        distinct.join(labels, distinct["fingerprint"] == labels["node"], "left")
        .select("fingerprint", F.coalesce("label", "fingerprint").alias("label"))
    )


def near_duplicate_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; component_id is the smallest id that can
    be reached, and NULL where no id in the component is known. Equal texts, null and empty ones among them, have equal
    fingerprints and so travel as one; the search costs 65 narrow rows per distinct fingerprint. An empty table gives
    no rows; other columns are not looked at.
    """
    narrow = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    marked = settle(add_fingerprint(narrow, "text").select("doc_id", "fingerprint"), "fingerprints")
    classes = settle(_classes(marked, radius), "classes")
    lowest = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    component = (
        classes.join(lowest, "fingerprint").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    )
    named = settle(classes.join(component, "label").select("fingerprint", "component_id"), "components")
    return marked.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), BITS // 4, "0")).alias("fingerprint"), "component_id"
    )


def row_key(id_column: str, text: str) -> Column:
    """128 bits that tell a row's id and text, nulls apart from empty values."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("")) for c in (id_column, text)]
    return F.unhex(F.md5(F.concat_ws("\0", *parts).cast("binary")))


def first_rows(docs: DataFrame, key: Column, marked: DataFrame, classes: DataFrame, node: str) -> DataFrame:
    """The rows of ``docs`` with one row of each class left: that of the smallest id, known ids first.

    ``marked`` has the doc_id, ``key`` and ``node`` of each row, ``classes`` the label of each node. Whole rows are
    shuffled once, by their key, so no group of copies meets in one task.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")).alias("first")
    winners = (
        classes.join(marked.groupBy(node).agg(first), node)
        .groupBy("label").agg(F.min("first").alias("first"))
        .select(F.col("first.key").alias("_key"))
    )
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_key"))
    return (
        kept.join(settle(winners, "winners"), "_key", "left_semi")
        .dropDuplicates(["_key"])
        .select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
    )


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with one row of each component left: that of the smallest id, known ids first.

    All columns are kept. Rows that agree in id and text count as one row. Only (key, fingerprint) pairs take part in the
    search; whole rows are shuffled once, by a key of their own, so no group of copies meets in one task.
    """
    key = row_key(id_column, text)
    narrow = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), key.alias("key"))
    marked = settle(add_fingerprint(narrow, "text").select("doc_id", "key", "fingerprint"), "fingerprints")
    return first_rows(docs, key, marked, _classes(marked, radius), "fingerprint")
