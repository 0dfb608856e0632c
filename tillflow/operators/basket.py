"""Which sub-categories are bought together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def basket_pairs(selected: DataFrame) -> DataFrame:
    """Orders per unordered pair of distinct sub-categories, with the smallest order id.

    Equal baskets are counted first, so pairs are formed once per distinct basket and not once per
    order: with a vocabulary of a few dozen sub-categories their number stops growing with the
    data. A basket holds distinct names only, so even an order with a third of all lines is no
    longer than the vocabulary, and its pairs are generated one by one, never as one array.
    """
    lines = selected.where("order_id IS NOT NULL AND sub_category IS NOT NULL")
    baskets = (
        lines.groupBy("order_id")
        .agg(F.array_sort(F.collect_set("sub_category")).alias("basket"))
        .where(F.size("basket") > 1)
        .groupBy("basket")
        .agg(F.count("*").alias("orders"), F.min("order_id").alias("first_order"))
    )
    pairs = (
        baskets.select("*", F.posexplode("basket").alias("at", "item_a"))
        .withColumn("item_b", F.explode(F.expr("slice(basket, at + 2, size(basket))")))
        .select("item_a", "item_b", "orders", "first_order")
    )
    return pairs.groupBy("item_a", "item_b").agg(
        F.sum("orders").alias("order_count"), F.min("first_order").alias("first_order")
    )


def top_basket_pairs(selected: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` most frequent pairs; ties in order of the first order id, then of the pair."""
    pairs = basket_pairs(selected)
    top = pairs.orderBy(F.desc("order_count"), "first_order", "item_a", "item_b").limit(k)
    return top.select(
        F.concat_ws(" & ", "item_a", "item_b").alias("sub_category_pair"), F.col("order_count").alias("frequency")
    )
