"""Exploratory summaries, and the summaries that the dashboard's description promises."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillflow.functions import percent_of, ratio, total_or_zero
from tillflow.plans.views import PRODUCT_KEYS


def monthly_by_name(orders: DataFrame) -> DataFrame:
    """Sales by year and month name; names sort alphabetically."""
    keys = ("order_year", "order_month_name")
    keyed = orders.dropna(subset=list(keys))
    return keyed.groupBy(*keys).agg(total_or_zero("sales").alias("sales")).orderBy(*keys)


def region_summary(orders: DataFrame) -> DataFrame:
    return (
        orders.dropna(subset=["region"])
        .groupBy("region")
        .agg(
            total_or_zero("sales").alias("total_sales"),
            total_or_zero("profit").alias("total_profit"),
            F.countDistinct("order_id").alias("order_count"),
        )
        .orderBy(F.desc("total_sales"))
    )


def category_summary(orders: DataFrame) -> DataFrame:
    return (
        orders.dropna(subset=["category"])
        .groupBy("category")
        .agg(total_or_zero("sales").alias("total_sales"), total_or_zero("profit").alias("total_profit"))
        .orderBy("category")
    )


def state_performance(selected: DataFrame) -> DataFrame:
    table = (
        selected.where("state IS NOT NULL")
        .groupBy("state")
        .agg(
            total_or_zero("sales").alias("revenue"),
            total_or_zero("profit").alias("profit"),
            F.countDistinct("order_id").alias("orders"),
            total_or_zero("quantity").alias("qty_sold"),
        )
    )
    return table.withColumn("margin_%", percent_of(F.col("profit"), F.col("revenue"))).orderBy(F.desc("revenue"))


def _product_profit(orders: DataFrame) -> DataFrame:
    return orders.groupBy(*PRODUCT_KEYS).agg(
        F.sum("sales").alias("total_sales"),
        F.sum("profit").alias("total_profit"),
        ratio(F.sum("profit"), F.sum("sales"), 4).alias("profit_margin"),
    )


def top_products(orders: DataFrame, k: int = 15) -> DataFrame:
    """The most profitable products; ties at the limit go to the smaller product key."""
    keys = [F.asc_nulls_last(c) for c in PRODUCT_KEYS]
    return _product_profit(orders).orderBy(F.desc_nulls_last("total_profit"), *keys).limit(k)


def segment_share(selected: DataFrame) -> DataFrame:
    """Share of revenue and margin by segment; the grand total is a scalar subquery."""
    total = selected.agg(F.sum("sales")).scalar()
    table = selected.where("segment IS NOT NULL").groupBy("segment").agg(
        total_or_zero("sales").alias("revenue"), total_or_zero("profit").alias("profit")
    )
    return table.withColumns(
        {
            "share_%": percent_of(F.col("revenue"), total),
            "margin_%": percent_of(F.col("profit"), F.col("revenue")),
        }
    ).orderBy("segment")


def shipping_distribution(selected: DataFrame) -> DataFrame:
    return selected.where("ship_mode IS NOT NULL").groupBy("ship_mode").agg(
        F.count("*").alias("shipments"), F.countDistinct("order_id").alias("orders")
    ).orderBy("ship_mode")


def loss_making_products(orders: DataFrame) -> DataFrame:
    return _product_profit(orders).where(F.col("total_profit") < 0).orderBy("total_profit", *PRODUCT_KEYS)
