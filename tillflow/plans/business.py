"""Business queries over the warehouse table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tillflow.functions import ratio
from tillflow.operators.ranking import add_ranks
from tillflow.plans.metrics import margin, orders_count, profit_sum, sales_sum
from tillflow.plans.views import calendar_order

_BY_SALES = F.desc_nulls_first
SLOW_DAYS = 5


def executive_kpis(orders: DataFrame) -> DataFrame:
    order_value = ratio(F.sum("sales"), F.countDistinct("order_id"), 2).alias("avg_order_value")
    return orders.agg(sales_sum("total_revenue"), profit_sum(), orders_count(), margin(), order_value)


def monthly_running(orders: DataFrame) -> DataFrame:
    monthly = orders.groupBy("order_year", "order_month", "order_month_name").agg(
        sales_sum("monthly_sales"), profit_sum("monthly_profit")
    )
    running = Window.orderBy(*calendar_order()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return monthly.withColumn("running_sales", F.sum("monthly_sales").over(running)).orderBy(*calendar_order())


def region_category(orders: DataFrame) -> DataFrame:
    return (
        orders.groupBy("region", "category")
        .agg(sales_sum(), profit_sum(), margin())
        .orderBy(F.asc_nulls_last("region"), _BY_SALES("total_sales"))
    )


def segment_customer_rank(orders: DataFrame) -> DataFrame:
    """Customers ranked inside their segment. A segment may hold most customers, so it is split."""
    keys = ("segment", "customer_name")
    customers = orders.groupBy(*keys).agg(sales_sum(), profit_sum())
    ranked = add_ranks(customers, {"total_sales": "customer_rank"}, partition_by=("segment",))
    # The name lets the sort split a run of equal totals.
    return ranked.orderBy(F.asc_nulls_last("segment"), _BY_SALES("total_sales"), "customer_name")


def product_double_rank(orders: DataFrame) -> DataFrame:
    keys = ("product_name", "category", "sub_category")
    products = orders.groupBy(*keys).agg(sales_sum(), profit_sum())
    ranked = add_ranks(products, {"total_sales": "sales_rank", "total_profit": "profit_rank"})
    return ranked.orderBy(_BY_SALES("total_sales"), *keys)


def shipping_efficiency(orders: DataFrame) -> DataFrame:
    speed = F.when(F.col("avg_shipping_days") > SLOW_DAYS, "Slow").otherwise("Efficient")
    return (
        orders.groupBy("ship_mode")
        .agg(orders_count(), sales_sum(), F.avg("shipping_days").alias("avg_shipping_days"))
        .withColumn("shipping_efficiency", speed)
        .orderBy(_BY_SALES("total_sales"))
    )


def discount_impact(orders: DataFrame) -> DataFrame:
    return (
        orders.groupBy("discount_band")
        .agg(orders_count(), sales_sum(), profit_sum(), margin())
        .orderBy(_BY_SALES("total_sales"))
    )


def top_customers_by_sales(orders: DataFrame, k: int = 10) -> DataFrame:
    """Ties at the limit go to the smaller name."""
    return (
        orders.groupBy("customer_name")
        .agg(sales_sum())
        .orderBy(_BY_SALES("total_sales"), F.asc_nulls_last("customer_name"))
        .limit(k)
    )
