"""Contiguous shards of near-equal bytes by the smallest feasible capacity; DataFrame operations only."""

from __future__ import annotations

from bisect import bisect_right
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillflow.llm.shared import settle

SHARDS = 8
CELL_ROWS = 4096  # rows that one cell or block holds on average, also of a text that very many rows share
MAX_BLOCK_BITS = 16  # at most so many bits of the text's hash name a block, so the list of blocks is no longer than 2^16
PROBES = 32  # capacities tried at once
_WIDTH = 64
_CELL = ["hash", "text_crc32", "part"]


class _Ordered:
    """Groups in the order of their text's hash, as cells in blocks, with running totals."""

    def __init__(self, cells: DataFrame):
        self.cells = cells
        sums = cells.groupBy("block").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.max("group_bytes").alias("widest"))
        listed = sorted(sums.collect(), key=lambda r: r["block"])  # 2^MAX_BLOCK_BITS rows at most
        self.blocks = [r["block"] for r in listed]
        self.bytes_before, self.rows_before = [0], [0]
        for r in listed:
            self.bytes_before.append(self.bytes_before[-1] + r["bytes"])
            self.rows_before.append(self.rows_before[-1] + r["rows"])
        self.total, self.widest = self.bytes_before[-1], max([r["widest"] for r in listed], default=0)

    def _inside(self, limit: int) -> tuple[int, int]:
        """(position of the block that ``limit`` bytes end in, bytes left for it)."""
        at = min(bisect_right(self.bytes_before, limit) - 1, len(self.blocks) - 1)
        return at, limit - self.bytes_before[at]

    def reach(self, limits: list[int]) -> list[int]:
        """For each limit the bytes of the longest run of whole groups from the start within it. One scan of few blocks."""
        places = [self._inside(x) for x in limits]
        ends = [
            F.max(F.when((F.col("block") == self.blocks[at]) & (F.col("end_bytes") <= left), F.col("end_bytes"))).alias(f"e{i}")
            for i, (at, left) in enumerate(places)
        ]
        row = self.cells.where(F.col("block").isin(sorted({self.blocks[at] for at, _ in places}))).agg(*ends).first()
        return [self.bytes_before[at] + (row[i] or 0) for i, (at, _) in enumerate(places)]

    def rows_until(self, cuts: list[int]) -> list[int]:
        """Rows of all groups that end at or before each cut."""
        places = [self._inside(x) for x in cuts]
        counts = [
            F.sum(F.when((F.col("block") == self.blocks[at]) & (F.col("end_bytes") <= left), F.col("rows"))).alias(f"n{i}")
            for i, (at, left) in enumerate(places)
        ]
        row = self.cells.where(F.col("block").isin(sorted({self.blocks[at] for at, _ in places}))).agg(*counts).first()
        return [self.rows_before[at] + (row[i] or 0) for i, (at, _) in enumerate(places)]

    def fill(self, capacities: list[int], shards: int) -> list[list[int]]:
        """The cuts that greedy filling makes with each capacity, one list of ``shards`` ends each."""
        ends: list[list[int]] = [[] for _ in capacities]
        for _ in range(shards):
            starts = [e[-1] if e else 0 for e in ends]
            open_ = [i for i, s in enumerate(starts) if s < self.total]
            reached = dict(zip(open_, self.reach([starts[i] + capacities[i] for i in open_]), strict=True)) if open_ else {}
            for i, e in enumerate(ends):
                e.append(reached.get(i, starts[i]))
        return ends

    def cuts(self, shards: int) -> list[int]:
        """Ends of the shards at the smallest capacity with which greedy filling needs no more than ``shards``.

        The capacity is at least the mean and the widest group, and the mean and the widest group together always do. The
        interval is searched in PROBES + 1 parts at a time instead of two, as every check is a scan.
        """
        low = max(ceil(self.total / shards), self.widest)
        high = max(low, ceil(self.total / shards) + self.widest)
        found = None
        while low < high:
            step = max(1, ceil((high - low) / (PROBES + 1)))
            probes = list(range(low, high, step))
            filled = self.fill(probes, shards)
            good = next((i for i, e in enumerate(filled) if e[-1] == self.total), None)
            if good is None:
                low = probes[-1] + 1
            else:
                found = (probes[good], filled[good])
                high = probes[good]
                low = probes[good - 1] + 1 if good else low
        return found[1] if found and found[0] == low else self.fill([low], shards)[0]


def _keyed(docs: DataFrame, id_column: str, text: str, parts: int) -> DataFrame:
    """Ids spread the rows of a text over its parts; where they are, copies, those of one id."""
    value, id_hash = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.xxhash64(F.col(f"`{id_column}`"))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(f"`{id_column}`").alias("doc_id"),
        (F.octet_length(value) + 1).cast("long").alias("size"),
        F.crc32(value).alias("text_crc32"),
        F.xxhash64(value).alias("hash"),
        F.pmod(id_hash, F.lit(parts)).alias("part"),
        id_hash.alias("id_hash"),
        F.pmod(F.monotonically_increasing_id(), F.lit(parts)).alias("copy"),
    )


def _ordered_cells(rows: DataFrame, block_bits: int) -> DataFrame:
    """Cells (hash, text_crc32, part) with running totals inside their block.

    end_bytes is where the cell's group ends, bytes_before and rows_before what lies before the cell. A text that very
    many rows share has as many cells as there are parts, and blocks are ranges of a hash, so no window is large.
    """
    group, cell = _CELL[:-1], _CELL
    # The highest bits of the signed hash, in the order of the hash.
    block = F.shiftright("hash", _WIDTH - block_bits) if block_bits else F.lit(0).cast("long")
    cells = rows.groupBy(*cell).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).withColumn("block", block)
    by_group = Window.partitionBy("block").orderBy(*group)  # to the end of the group: equal keys are in the frame
    by_cell = Window.partitionBy("block").orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    return cells.repartitionByRange("block").select(
        "block", *cell, "bytes", "rows",
        F.sum("bytes").over(by_group).alias("end_bytes"),
        F.coalesce(F.sum("rows").over(by_cell), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy("block", *group)).alias("group_bytes"),
    )


def _starts(rows: DataFrame) -> DataFrame:
    """Rows of the cell that lie before those of an id and copy, by id. Rows that agree in id and text are as many groups as
    there are copies, and so no window's or task's alone, whatever share of the table they are."""
    runs = rows.groupBy(*_CELL, "id_hash", "copy").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    before = Window.partitionBy(*_CELL).orderBy("least", "id_hash", "copy").rowsBetween(Window.unboundedPreceding, -1)
    return runs.select(*_CELL, "id_hash", "copy", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))


def _lookup(position: Column, values: list[int]) -> Column:
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), position)


def assign_shards(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shards: int = SHARDS, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ("bytes"), shard, slot and grown_shard (NULL); with ``carry``
    also ``_row``, the whole row.

    Documents of equal text are one group and stay together; groups are ordered by a hash of their text and cut into
    ``shards`` runs whose largest is as small as can be. A size is the UTF-8 bytes of the text and 1; a null text counts as
    empty. Slots number a shard's rows from 0 without gaps, by text and then by part and id. Rows that agree in id and
    text get different slots. An empty table gives no rows; fewer groups than shards leave shards empty.

    What is known of each row, with ``carry`` all of it, is written once: which copy a row is follows from its place.
    """
    n = docs.count()
    parts = max(1, ceil(n / CELL_ROWS))
    bits = min(MAX_BLOCK_BITS, max(0, ceil(log2(parts))))
    rows = _keyed(docs, id_column, text, parts)
    rows = settle(rows if carry else rows.drop("_row"), "keyed")
    cells = settle(_ordered_cells(rows, bits), "cells")
    ordered = _Ordered(cells)
    ends = ordered.cuts(shards) if ordered.blocks else [0] * shards
    inner = ends[:-1]
    first_rows = [0, *ordered.rows_until(inner)] if ordered.blocks else [0] * shards
    spark = docs.sparkSession
    bases = spark.createDataFrame(
        list(zip(ordered.blocks, ordered.bytes_before, ordered.rows_before, strict=False)),
        "block long, block_bytes long, block_rows long",
    )
    end = F.col("block_bytes") + F.col("end_bytes")
    shard = sum([(end > F.lit(c)).cast("int") for c in inner], F.lit(0))
    placed = (
        cells.join(F.broadcast(bases), "block")  # a row per block
        .select(*_CELL, shard.alias("shard"), (F.col("block_rows") + F.col("rows_before")).alias("first"))
    )
    run = [*_CELL, "id_hash", "copy"]
    runs = _starts(rows).join(placed, _CELL).select(*run, "shard", (F.col("first") + F.col("start")).alias("first"))
    inside = F.row_number().over(Window.partitionBy(*run).orderBy("doc_id")) - 1
    return rows.withColumn("inside", inside).join(runs, run).select(
        *(["_row"] if carry else []),
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") - _lookup(F.col("shard"), first_rows) + F.col("inside")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", shards: int = SHARDS) -> None:
    """Write ``docs`` below ``path``, a folder per shard; files hold runs of slots in order.

    Within a shard rows are dealt by ranges of slots, so a shard is written by many tasks.
    """
    placed = assign_shards(docs, id_column, text, shards, carry=True)
    taken = {"shard", "slot"}
    columns = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c.lower() not in taken]
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").select(*columns, "shard", "slot").write.partitionBy("shard").parquet(path)
