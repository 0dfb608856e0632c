"""Dashboard filters: the choices on offer and the selection they make."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

_MEMBER_COLUMNS = ("region", "segment", "category")


@dataclass(frozen=True)
class Selection:
    """Chosen values; ``None`` is "all". Rows without a region, segment, category or order date
    are never selected, not even by "all"."""

    regions: tuple[str, ...] | None = None
    segments: tuple[str, ...] | None = None
    categories: tuple[str, ...] | None = None
    start: dt.date | None = None
    end: dt.date | None = None


def filter_options(orders: DataFrame) -> DataFrame:
    """Distinct non-null values of each filter column as (filter, value) rows."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("filter"), F.col(c).alias("value")) for c in _MEMBER_COLUMNS])
    )
    combinations = orders.select(*_MEMBER_COLUMNS).distinct()
    return combinations.select(pairs.alias("pair")).select("pair.*").where(F.col("value").isNotNull()).distinct()


def date_bounds(orders: DataFrame) -> DataFrame:
    return orders.agg(F.min("order_date").alias("min_date"), F.max("order_date").alias("max_date"))


def _chosen(name: str, values: tuple[str, ...] | None) -> Column:
    return F.col(name).isNotNull() if values is None else F.col(name).isin(*values)


def filter_members(orders: DataFrame, selection: Selection) -> DataFrame:
    chosen = (selection.regions, selection.segments, selection.categories)
    for name, values in zip(_MEMBER_COLUMNS, chosen):
        orders = orders.where(_chosen(name, values))
    return orders


def filter_date_range(orders: DataFrame, selection: Selection) -> DataFrame:
    """Both ends inclusive. The year bounds follow from the dates and let Spark skip partitions."""
    orders = orders.where(F.col("order_date").isNotNull() & F.col("order_year").isNotNull())
    if selection.start is not None:
        orders = orders.where(
            (F.col("order_date") >= F.lit(selection.start)) & (F.col("order_year") >= selection.start.year)
        )
    if selection.end is not None:
        orders = orders.where(
            (F.col("order_date") <= F.lit(selection.end)) & (F.col("order_year") <= selection.end.year)
        )
    return orders


def select_orders(orders: DataFrame, selection: Selection = Selection()) -> DataFrame:
    return orders.transform(filter_members, selection).transform(filter_date_range, selection)


def is_empty(selected: DataFrame) -> DataFrame:
    """One row telling whether the selection leaves no row; reads no further than one row."""
    return selected.limit(1).agg((F.count("*") == 0).alias("is_empty"))
