"""Order lines in the retail layout, from a folder of star-schema parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillflow.operators.ranking import number_rows
from tillflow.schema import BASE_TYPES

# The first four nearly identify a line; the others settle what remains.
_LINE_KEY = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount",
)
_LINE_VALUES = ("l_orderkey", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount")


def _money(name: str):
    return F.col(name).cast("decimal(12,2)").alias(name)


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line with the columns of a cleaned raw file, ``row_id`` included.

    Equi-joins without hints: Spark broadcasts a side whose measured size allows it and shuffles the others. Customers go to
    orders, of which there are fewer than lines, and lines get their part while they are narrow; what an order tells comes
    last, so a line with all its columns passes no shuffle. ``row_id`` numbers the line items in key order; only their own
    columns are sorted, and only those that are needed later are written.
    """
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    items = number_rows(read("lineitem").select(*_LINE_KEY), [F.col(c).asc() for c in _LINE_KEY], "row_id", keep=_LINE_VALUES)
    # Typed before they travel: a price in cents is fewer bytes than a double.
    items = items.select(
        "row_id", "l_orderkey", "l_partkey", F.to_date("l_shipdate").alias("l_shipdate"), _money("l_extendedprice"),
        F.col("l_quantity").cast("int").alias("l_quantity"), F.col("l_discount").cast("decimal(5,2)").alias("l_discount"),
    )
    parts = read("part").select("p_partkey", "p_name", "p_brand", "p_type", _money("p_retailprice"))
    orders = (
        read("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
        .join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    joined = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    ordered = F.to_date("o_orderdate")
    urgency = F.substring("o_orderpriority", 1, 1).cast("int")
    gap = F.pmod(F.datediff("l_shipdate", ordered), F.lit(11)) + urgency - 2
    ship_mode = (
        F.when(urgency == 1, "Same Day").when(urgency == 2, "First Class").when(urgency == 3, "Second Class")
    ).otherwise("Standard Class")
    rate = F.col("l_discount") * 4
    sales, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    profit = (sales * (1 - rate) - quantity * F.col("p_retailprice") * F.lit("0.5").cast("decimal(2,1)")).cast(
        "decimal(12,2)"
    )
    columns = {
        "order_id": F.concat(F.lit("O-"), "o_orderkey"),
        "order_date": ordered,
        "ship_date": F.date_add(ordered, gap),
        "ship_mode": ship_mode,
        "customer_id": F.concat(F.lit("C-"), "c_custkey"),
        "customer_name": F.col("c_name"),
        "segment": F.col("c_mktsegment"),
        "country": F.col("n_name"),
        "city": F.lit(None),
        "state": F.col("n_name"),
        "postal_code": F.lit(None),
        "region": F.col("r_name"),
        "product_id": F.concat(F.lit("P-"), "p_partkey"),
        "category": F.col("p_type"),
        "sub_category": F.col("p_brand"),
        "product_name": F.col("p_name"),
        "sales": sales,
        "quantity": quantity,
        "discount": rate,
        "profit": profit,
    }
    return joined.select("row_id", *[v.cast(BASE_TYPES[c]).alias(c) for c, v in columns.items()])
