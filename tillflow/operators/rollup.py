"""Distinct orders that can be added up: lines summed by day and dimensions, with the orders of each sum as bitmaps.

A count of distinct orders cannot be made from counts of parts, but it can from sets. Orders get dense numbers from 1; the
set of a cell's orders is one bitmap for each range of 32,768 numbers, and the union of sets is the OR of bitmaps. Reports and
selections then read the roll-up in place of the lines, and get the same figures.

Numbers follow the day, region and segment of an order's first line. The orders of a cell then lie close together, so a
bitmap is well filled and few ranges belong to a cell; results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tillflow.operators.ranking import number_rows
from tillflow.scratch import settle

# What reports with distinct orders group by, and what selections filter by.
DIMENSIONS = (
    "order_date", "order_year", "order_month", "order_month_name", "weekend_flag", "region", "segment", "category", "ship_mode",
    "discount_band",
)
# Dimensions that a date tells; they and the others are few combinations each, of which lines carry the numbers.
_CALENDAR = DIMENSIONS[:5]
_PLACE = ("order_date", "region", "segment")
_PARTS = 64  # windows that the orders of one day, region and segment are numbered in
MONEY = "decimal(22,2)"  # the type of a sum of money over lines
_SUMMED = ("sales", "profit", "quantity", "days", "days_known", "lines")


def number_orders(lines: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """A dense ``number`` from 1 for every ``order_id``; NULL is no order.

    Orders in ``known``, an earlier result, are left out, and the others follow its last number. No window
    sees more than the days of the calendar, the parts of one day, or the orders of one part.
    """
    orders = lines.where("order_id IS NOT NULL").groupBy("order_id").agg(F.min(F.struct(*_PLACE)).alias("place"))
    first = F.lit(0)
    if known is not None:
        orders = orders.join(known, "order_id", "left_anti")
        first = F.coalesce(known.agg(F.max("number")).scalar(), F.lit(0))
    part = F.pmod(F.xxhash64("order_id"), F.lit(_PARTS)).alias("part")
    keys = (*_PLACE, "part")
    placed = orders.select("order_id", "place.*", part)
    # Written once: its rows are counted, and then numbered from the counts.
    inside = settle(placed.withColumn("inside", F.row_number().over(Window.partitionBy(*keys).orderBy("order_id"))), "orders")

    def sum_before(size: str, window) -> Column:
        return F.coalesce(F.sum(size).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    parts = inside.groupBy(*keys).agg(F.count("*").alias("orders"))
    days = parts.groupBy("order_date").agg(F.sum("orders").alias("orders"))
    day_starts = days.select(F.col("order_date").alias("day"), sum_before("orders", Window.orderBy("order_date")).alias("day_start"))
    in_day = Window.partitionBy("order_date").orderBy("region", "segment", "part")
    part_starts = (
        parts.withColumn("part_start", sum_before("orders", in_day))
        .join(day_starts, F.col("order_date").eqNullSafe(F.col("day")))
        .select(*[F.col(k).alias(f"at_{k}") for k in keys], (F.col("day_start") + F.col("part_start")).alias("start"))
    )
    same = [F.col(k).eqNullSafe(F.col(f"at_{k}")) for k in keys]
    return inside.join(part_starts, same).select("order_id", (first + F.col("start") + F.col("inside")).alias("number"))


def roll_up(lines: DataFrame, numbers: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Sums of the lines by dimensions and range of order numbers, with the range's orders as a bitmap.

    Roll-ups of different lines with the same numbers make one by ``unionByName``: rows need not be unique.

    Lines travel once to their order's number, as they are, which is less than their sums by dimensions and order would be. They
    are summed by dimensions and order before they travel on, so that an id, or NULL, that holds a third of them is a few rows,
    and become bitmaps of 4 KB where all of a bitmap's rows are. Lines without an order need no number.
    """
    narrow = lines.select(*dimensions, "order_id", "sales", "profit", "quantity", "shipping_days")
    number = F.col("number")
    sums = (
        F.sum("sales").alias("sales"), F.sum("profit").alias("profit"), F.sum("quantity").alias("quantity"),
        F.sum("shipping_days").alias("days"), F.count("shipping_days").alias("days_known"), F.count("*").alias("lines"),
    )
    # The lines of an order are together after the join, so that their sums need no shuffle where the join has made one.
    known = narrow.where("order_id IS NOT NULL").join(numbers, "order_id", "left").groupBy(*dimensions, "order_id", "number").agg(*sums)
    without = narrow.where("order_id IS NULL").groupBy(*dimensions).agg(*sums).withColumn("number", F.lit(None).cast("long"))
    cells = known.drop("order_id").unionByName(without)
    # By the first dimension alone beside the range, which bounds what meets there: the orders of one range, each summed.
    dealt = cells.withColumn("bucket", F.bitmap_bucket_number(number)).repartition(*dimensions[:1], "bucket")
    return dealt.groupBy(*dimensions, "bucket").agg(*_sums(), F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("orders"))


def _sums() -> list[Column]:
    money = [F.sum(c).cast(MONEY).alias(c) for c in ("sales", "profit")]
    return [*money, *[F.sum(c).alias(c) for c in ("quantity", "days", "days_known", "lines")]]


def summarize(rolled: DataFrame, *keys: str) -> DataFrame:
    """One row per group of a roll-up: sums of ``sales``, ``profit`` and ``quantity``, ``lines``, ``avg_days`` of shipping,
    and ``distinct_orders``. Sums of NULLs are NULL. Without keys one row, also of an empty roll-up."""
    ranges = rolled.groupBy(*keys, "bucket").agg(*_sums(), F.bitmap_or_agg("orders").alias("orders"))
    grouped = ranges.groupBy(*keys).agg(*_sums(), F.coalesce(F.sum(F.bitmap_count("orders")), F.lit(0)).alias("distinct_orders"))
    average = F.col("days").cast("double") / F.nullif(F.col("days_known"), F.lit(0))
    return grouped.withColumn("avg_days", average).drop("days", "days_known")


def _numbers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("order_id string, number long").parquet(f"{path}/numbers")


def _coded(lines: DataFrame, dimensions: Sequence[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Lines with numbers in place of their dimensions, and per number's name the table (name, dimensions) that tells them.

    A line then travels with two numbers and not with ten columns. The tables hold the combinations that occur, of the
    calendar's columns and of the others; they are in order, so that numbers follow the days.
    """
    parts = {"_day": [d for d in dimensions if d in _CALENDAR], "_kind": [d for d in dimensions if d not in _CALENDAR]}
    tables = {}
    for code, columns in parts.items():
        if columns:
            distinct = lines.select(*columns).distinct()
            # Written, so that Spark knows how small it is.
            tables[code] = settle(number_rows(distinct, [F.col(c).asc_nulls_first() for c in columns], code), "codes")
            named = tables[code].select(code, *[F.col(c).alias(f"_{c}") for c in columns])
            lines = lines.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]).drop(*[f"_{c}" for c in columns], *columns)
    return lines, tables


def _add(lines: DataFrame, path: str, known: DataFrame | None, dimensions: Sequence[str]) -> None:
    spark = lines.sparkSession
    number_orders(lines, known).write.mode("append").parquet(f"{path}/numbers")
    narrow = lines.select(*dimensions, "order_id", "sales", "profit", "quantity", "shipping_days")
    coded, tables = _coded(narrow, dimensions)
    rolled = roll_up(coded, _numbers(spark, path), list(tables))
    for code, table in tables.items():
        rolled = rolled.join(table, code)
    # Bitmaps are made once and moved no more. A task's file is in the order of days, so that a date range reads a part of it;
    # rows come out of their grouping in that order.
    written = rolled.sortWithinPartitions(*list(tables)[:1]).select(*dimensions, "bucket", *_SUMMED, "orders")
    written.write.mode("append").option("compression", "zstd").parquet(f"{path}/cells")


def write_rollup(lines: DataFrame, path: str, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Roll up the lines of a table into a new folder: the numbers of the orders, and the cells, which are returned."""
    _add(lines, path, None, dimensions)
    return read_rollup(lines.sparkSession, path)


def append_rollup(lines: DataFrame, path: str, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Add lines that the folder's roll-up does not have yet. Orders that it knows keep their numbers, so an order whose lines
    arrive in two loads counts once. One writer at a time; if the first of its two writes is all that has taken place, the
    append can be run again."""
    _add(lines, path, _numbers(lines.sparkSession, path), dimensions)
    return read_rollup(lines.sparkSession, path)


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/cells")
