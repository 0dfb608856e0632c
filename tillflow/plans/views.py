"""The seven reporting views over the warehouse table.

Each is one SQL text over ``{orders}``: a function applies it to a DataFrame, :func:`register_views` to the name of a
table. A registered view is analysed whenever it is read, so it always shows what the table holds then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillflow.operators.ranking import rank_sql

# Columns of the detail view, and the ship modes that count as priority.
_DETAIL = (
    "order_id", "order_date", "customer_id", "customer_name", "segment", "region", "category",
    "sub_category", "ship_mode", "sales", "profit", "quantity", "discount", "profit_margin",
    "shipping_days", "weekend_flag", "profitability_flag",
)
PRIORITY_MODES = ("First Class", "Same Day")
CUSTOMER_KEYS = ("customer_id", "customer_name", "segment", "region")
PRODUCT_KEYS = ("product_id", "product_name", "category", "sub_category")

# Sums of NULLs and margins without sales stay NULL.
_CORE = """count(DISTINCT order_id) AS total_orders, sum(sales) AS total_sales, sum(profit) AS total_profit,
  round(sum(profit) / nullif(sum(sales), 0), 4) AS profit_margin"""
_BY_MONTH = "ORDER BY order_year NULLS LAST, order_month NULLS LAST"


def calendar_order() -> list[Column]:
    return [F.asc_nulls_last("order_year"), F.asc_nulls_last("order_month")]


def _grouped(keys: tuple[str, ...]) -> str:
    return f"SELECT {', '.join(keys)}, {_CORE} FROM {{orders}} GROUP BY {', '.join(keys)}"


def _few_ranked(key: str, metric: str, name: str) -> str:
    """For a key with few values: the window sees one row per value."""
    return f"SELECT *, CAST(rank() OVER (ORDER BY {metric} DESC NULLS FIRST) AS BIGINT) AS {name} FROM ({_grouped((key,))})"


def view_sql() -> dict[str, str]:
    """The text of every view over ``{orders}``."""
    return {
        # Grand totals are scalar subqueries: a window over no partition would move every line to one task.
        "vw_sales_summary": f"""SELECT {', '.join(_DETAIL)}, (SELECT sum(sales) FROM {{orders}}) AS total_sales_all_rows,
  (SELECT sum(profit) FROM {{orders}}) AS total_profit_all_rows FROM {{orders}}""",
        # The windows see one row per month.
        "vw_monthly_sales": f"""SELECT *,
  sum(total_sales) OVER ({_BY_MONTH} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_sales,
  avg(total_sales) OVER ({_BY_MONTH} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS moving_avg_sales
FROM (SELECT order_year, order_month, order_month_name, sum(sales) AS total_sales, sum(profit) AS total_profit,
  count(DISTINCT order_id) AS total_orders FROM {{orders}} GROUP BY order_year, order_month, order_month_name)
{_BY_MONTH}""",
        "vw_region_performance": _few_ranked("region", "total_sales", "sales_rank"),
        "vw_category_performance": _few_ranked("category", "total_profit", "profit_rank"),
        "vw_customer_summary": rank_sql(_grouped(CUSTOMER_KEYS), {"total_sales": "sales_rank"}),
        "vw_product_performance": rank_sql(_grouped(PRODUCT_KEYS), {"total_profit": "profit_rank"}),
        "vw_shipping_analysis": f"""SELECT ship_mode, {_CORE}, avg(shipping_days) AS avg_shipping_days,
  CASE WHEN ship_mode IN {PRIORITY_MODES} THEN 'Priority' ELSE 'Standard' END AS shipping_group
FROM {{orders}} GROUP BY ship_mode""",
    }


def _view(name: str) -> Callable[[DataFrame], DataFrame]:
    def build(orders: DataFrame) -> DataFrame:
        spark = orders.sparkSession
        return spark.sql(view_sql()[name], orders=orders)

    return build


sales_summary = _view("vw_sales_summary")
monthly_sales = _view("vw_monthly_sales")
region_performance = _view("vw_region_performance")
category_performance = _view("vw_category_performance")
customer_summary = _view("vw_customer_summary")
product_performance = _view("vw_product_performance")
shipping_analysis = _view("vw_shipping_analysis")

VIEWS: dict[str, Callable[[DataFrame], DataFrame]] = {name: _view(name) for name in view_sql()}


def register_views(spark: SparkSession, table: str = "retail_orders") -> list[str]:
    """Make every view of ``table`` available to ``spark.sql``; returns their names. Nothing is computed before a view is
    read, and loads of the table show without registering again."""
    for name, text in view_sql().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS {text.format(orders=table)}")
    return list(VIEWS)
