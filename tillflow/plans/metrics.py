"""Aggregates shared by the warehouse views and queries. NULL groups and NULL sums stay."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tillflow.functions import ratio


def orders_count() -> Column:
    return F.countDistinct("order_id").alias("total_orders")


def sales_sum(name: str = "total_sales") -> Column:
    return F.sum("sales").alias(name)


def profit_sum(name: str = "total_profit") -> Column:
    return F.sum("profit").alias(name)


def margin(digits: int = 4) -> Column:
    """Margin of a group: unlike a line's margin it is not limited to [0, 1]."""
    return ratio(F.sum("profit"), F.sum("sales"), digits).alias("profit_margin")


def core_metrics() -> list[Column]:
    return [orders_count(), sales_sum(), profit_sum(), margin()]
