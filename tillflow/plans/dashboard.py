"""Dashboard tables over selected orders.

Unlike the warehouse views, these drop rows without a group key and count a group without values
as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillflow.functions import half_even, percent_of, total_or_zero
from tillflow.operators.ranking import add_ranks

_MARGIN = "margin_%"


def _grouped(selected: DataFrame, keys: tuple[str, ...], *metrics: Column) -> DataFrame:
    keyed = selected.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    return keyed.groupBy(*keys).agg(*metrics)


def _revenue() -> Column:
    return total_or_zero("sales").alias("revenue")


def _profit() -> Column:
    return total_or_zero("profit").alias("profit")


def _orders() -> Column:
    return F.countDistinct("order_id").alias("orders")


def _units() -> Column:
    return total_or_zero("quantity").alias("qty_sold")


def _with_margin(table: DataFrame) -> DataFrame:
    return table.withColumn(_MARGIN, percent_of(F.col("profit"), F.col("revenue")))


def kpis(selected: DataFrame) -> DataFrame:
    sales, profit, orders = F.col("total_sales"), F.col("total_profit"), F.col("total_orders")
    return selected.agg(
        total_or_zero("sales").alias("total_sales"),
        total_or_zero("profit").alias("total_profit"),
        F.countDistinct("order_id").alias("total_orders"),
    ).withColumns(
        {
            "gross_margin": F.when(sales > 0, profit.cast("double") / sales.cast("double") * 100).otherwise(0.0),
            "avg_order_value": F.when(orders > 0, sales.cast("double") / orders).otherwise(0.0),
        }
    )


def monthly(selected: DataFrame) -> DataFrame:
    months = _grouped(selected, ("order_year", "order_month", "order_month_name"), _revenue(), _profit())
    label = F.concat_ws(" ", "order_month_name", F.col("order_year").cast("string"))
    return months.withColumn("month_year", label).orderBy("order_year", "order_month")


def cumulative(selected: DataFrame) -> DataFrame:
    """Running revenue; the window sees one row per month."""
    running = Window.orderBy("order_year", "order_month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return monthly(selected).withColumn("running_sales", F.sum("revenue").over(running))


def month_growth(selected: DataFrame) -> DataFrame:
    """Revenue change against the previous month present, in percent.

    The first month and zero after zero count as 0; other growth from zero is NULL.
    """
    now = F.col("revenue").cast("double")
    before = F.lag(now).over(Window.orderBy("order_year", "order_month"))
    change = (now / F.nullif(before, F.lit(0.0)) - 1) * 100
    still = before.isNull() | ((before == 0) & (now == 0))
    return monthly(selected).withColumn("mom_growth_%", F.when(still, 0.0).otherwise(half_even(change, 2)))


def region(selected: DataFrame) -> DataFrame:
    table = _grouped(selected, ("region",), _revenue(), _profit(), _orders(), _units())
    return _with_margin(table).orderBy(F.desc("revenue"))


def segment_revenue(selected: DataFrame) -> DataFrame:
    return _grouped(selected, ("segment",), _revenue()).orderBy("segment")


def category_revenue(selected: DataFrame) -> DataFrame:
    return _grouped(selected, ("category",), _revenue()).orderBy("category")


def segment_category(selected: DataFrame) -> DataFrame:
    table = _grouped(selected, ("segment", "category", "sub_category"), _revenue(), _profit(), _units())
    return _with_margin(table).orderBy("segment", F.desc("revenue"))


def discount_bands(selected: DataFrame) -> DataFrame:
    return _grouped(selected, ("discount_band",), _revenue(), _profit()).orderBy("discount_band")


def subcategory_sales(selected: DataFrame) -> DataFrame:
    return _grouped(selected, ("sub_category",), total_or_zero("sales").alias("sales")).orderBy(F.desc("sales"))


def top_customers_by_profit(selected: DataFrame, k: int = 10) -> DataFrame:
    """Ties at the limit go to the smaller customer key."""
    keys = ("customer_name", "segment", "region")
    table = _grouped(selected, keys, _revenue(), _profit(), _orders())
    return _with_margin(table.orderBy(F.desc("profit"), *keys).limit(k))


def ship_days_by_mode(selected: DataFrame) -> DataFrame:
    days = F.avg("shipping_days").alias("avg_shipping_days")
    return _grouped(selected, ("ship_mode",), days).orderBy("ship_mode")


def ship_days_by_region(selected: DataFrame) -> DataFrame:
    return _grouped(selected, ("region",), F.avg("shipping_days").alias("avg_shipping_days")).orderBy("region")


def weekend(selected: DataFrame) -> DataFrame:
    day_type = F.when(F.col("weekend_flag"), "Weekend Order").otherwise("Weekday Order")
    table = _grouped(
        selected,
        ("weekend_flag",),
        F.countDistinct("order_id").alias("total_orders"),
        F.avg("shipping_days").alias("avg_transit_days"),
        total_or_zero("sales").alias("total_revenue"),
        total_or_zero("profit").alias("total_profit"),
    )
    return table.select(
        day_type.alias("order_day_type"), "total_orders", "avg_transit_days", "total_revenue", "total_profit"
    ).orderBy("order_day_type")


def discount_margin_curve(selected: DataFrame) -> DataFrame:
    """Mean line margin per discount. Sums of decimals are exact; sums of doubles depend on order. Sixteen places keep
    margins of processed files apart, too."""
    margin = F.col("profit_margin").cast("decimal(20,16)")
    mean = F.sum(margin).cast("double") / F.nullif(F.count(margin), F.lit(0))
    return _grouped(selected, ("discount_percentage",), mean.alias("avg_margin"), _orders()).orderBy(
        "discount_percentage"
    )


def _correlation(n: str, x: str, y: str) -> Column:
    """Pearson's coefficient of whole numbers x and y that occur n times: co-moments are exact integers, so the result
    does not depend on the order of the rows. NULL where either does not vary."""
    def moment(*factors: str) -> Column:
        product = F.col(n).cast("decimal(38,0)")
        for factor in factors:
            product = (product * F.col(factor)).cast("decimal(38,0)")
        return F.sum(product).cast("decimal(38,0)")

    size, sx, sy = moment(), moment(x), moment(y)

    def spread(joint: Column, a: Column, b: Column) -> Column:
        return ((size * joint).cast("decimal(38,0)") - (a * b).cast("decimal(38,0)")).cast("double")

    both = spread(moment(x, y), sx, sy)
    alone = F.sqrt(spread(moment(x, x), sx, sx)) * F.sqrt(spread(moment(y, y), sy, sy))
    return half_even(both / F.nullif(alone, F.lit(0.0)), 9)


def discount_margin_correlation(selected: DataFrame) -> DataFrame:
    """One row on how line margins follow discounts: lines, pearson, and spearman, the same of average ranks.

    Lines without either value are left out. Equal pairs of values are counted first, so what is ranked is one row for each
    pair; ranks come from :mod:`~tillflow.operators.ranking` and are doubled, which keeps averages of ties whole.
    """
    paired = selected.where("discount_percentage IS NOT NULL AND profit_margin IS NOT NULL")
    scaled = [F.round(F.col(c).cast("decimal(20,16)") * 10000).cast("long") for c in ("discount_percentage", "profit_margin")]
    pairs = paired.groupBy(scaled[0].alias("x"), scaled[1].alias("y")).agg(F.count("*").alias("n"))
    ranked = add_ranks(pairs, {"x": "rank_x", "y": "rank_y"}, weight="n", ties={"x": "ties_x", "y": "ties_y"})
    # Ranks descend on both sides. Pairs are few, so their doubled ranks stay within the number of lines.
    doubled = ranked.withColumns({v: 2 * F.col(f"rank_{v[-1]}") + F.col(f"ties_{v[-1]}") - 1 for v in ("place_x", "place_y")})
    return doubled.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("lines"),
        _correlation("n", "x", "y").alias("pearson"), _correlation("n", "place_x", "place_y").alias("spearman"),
    )
