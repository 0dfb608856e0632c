"""Reports with distinct orders from a roll-up, equal to those from the lines; see :mod:`~tillflow.operators.rollup`.

Selections apply to a roll-up as they do to lines: :func:`~tillflow.operators.filters.select_orders`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillflow.functions import percent_of, ratio
from tillflow.operators.rollup import summarize
from tillflow.plans.business import SLOW_DAYS
from tillflow.plans.views import PRIORITY_MODES, calendar_order

_MONTH = ("order_year", "order_month", "order_month_name")


def _named(column: str) -> Callable[[str], Column]:
    return lambda name: F.col(column).alias(name)


_ORDERS, _SALES, _PROFIT, _DAYS = map(_named, ("distinct_orders", "sales", "profit", "avg_days"))


def _margin() -> Column:
    return ratio(F.col("profit"), F.col("sales"), 4).alias("profit_margin")


def _core() -> list[Column]:
    return [_ORDERS("total_orders"), _SALES("total_sales"), _PROFIT("total_profit"), _margin()]


def _or_zero(name: str, alias: str) -> Column:
    return F.coalesce(name, F.lit(0)).alias(alias)


def executive_kpis(rolled: DataFrame) -> DataFrame:
    value = ratio(F.col("sales"), F.col("distinct_orders"), 2).alias("avg_order_value")
    return summarize(rolled).select(_SALES("total_revenue"), _PROFIT("total_profit"), _ORDERS("total_orders"), _margin(), value)


def monthly_sales(rolled: DataFrame) -> DataFrame:
    """The windows see one row per month."""
    months = summarize(rolled, *_MONTH).select(*_MONTH, _SALES("total_sales"), _PROFIT("total_profit"), _ORDERS("total_orders"))
    calendar = Window.orderBy(*calendar_order())
    running, moving = (calendar.rowsBetween(begin, Window.currentRow) for begin in (Window.unboundedPreceding, -3))
    return months.withColumns(
        {"running_sales": F.sum("total_sales").over(running), "moving_avg_sales": F.avg("total_sales").over(moving)}
    ).orderBy(*calendar_order())


def _few_ranked(rolled: DataFrame, key: str, metric: str, name: str) -> DataFrame:
    """For a key with few values: the window sees one row per value."""
    rank = F.rank().over(Window.orderBy(F.desc_nulls_first(metric))).cast("long")
    return summarize(rolled, key).select(key, *_core()).withColumn(name, rank)


def region_performance(rolled: DataFrame) -> DataFrame:
    return _few_ranked(rolled, "region", "total_sales", "sales_rank")


def category_performance(rolled: DataFrame) -> DataFrame:
    return _few_ranked(rolled, "category", "total_profit", "profit_rank")


def shipping_analysis(rolled: DataFrame) -> DataFrame:
    group = F.when(F.col("ship_mode").isin(*PRIORITY_MODES), "Priority").otherwise("Standard").alias("shipping_group")
    return summarize(rolled, "ship_mode").select("ship_mode", *_core(), _DAYS("avg_shipping_days"), group)


def shipping_efficiency(rolled: DataFrame) -> DataFrame:
    speed = F.when(F.col("avg_days") > SLOW_DAYS, "Slow").otherwise("Efficient").alias("shipping_efficiency")
    modes = summarize(rolled, "ship_mode").select(
        "ship_mode", _ORDERS("total_orders"), _SALES("total_sales"), _DAYS("avg_shipping_days"), speed
    )
    return modes.orderBy(F.desc_nulls_first("total_sales"))


def discount_impact(rolled: DataFrame) -> DataFrame:
    return summarize(rolled, "discount_band").select("discount_band", *_core()).orderBy(F.desc_nulls_first("total_sales"))


def kpis(selected: DataFrame) -> DataFrame:
    sales, profit, orders = F.col("total_sales"), F.col("total_profit"), F.col("total_orders")
    totals = summarize(selected).select(_or_zero("sales", "total_sales"), _or_zero("profit", "total_profit"), _ORDERS("total_orders"))
    return totals.withColumns(
        {
            "gross_margin": F.when(sales > 0, profit.cast("double") / sales.cast("double") * 100).otherwise(0.0),
            "avg_order_value": F.when(orders > 0, sales.cast("double") / orders).otherwise(0.0),
        }
    )


def region(selected: DataFrame) -> DataFrame:
    table = summarize(selected.where("region IS NOT NULL"), "region").select(
        "region", _or_zero("sales", "revenue"), _or_zero("profit", "profit"), _ORDERS("orders"), _or_zero("quantity", "qty_sold")
    )
    return table.withColumn("margin_%", percent_of(F.col("profit"), F.col("revenue"))).orderBy(F.desc("revenue"))


def weekend(selected: DataFrame) -> DataFrame:
    day_type = F.when(F.col("weekend_flag"), "Weekend Order").otherwise("Weekday Order").alias("order_day_type")
    return summarize(selected.where("weekend_flag IS NOT NULL"), "weekend_flag").select(
        day_type, _ORDERS("total_orders"), _DAYS("avg_transit_days"), _or_zero("sales", "total_revenue"),
        _or_zero("profit", "total_profit"),
    ).orderBy("order_day_type")


def shipping_distribution(selected: DataFrame) -> DataFrame:
    return summarize(selected.where("ship_mode IS NOT NULL"), "ship_mode").select(
        "ship_mode", F.col("lines").alias("shipments"), _ORDERS("orders")
    ).orderBy("ship_mode")
