"""Recency, frequency and monetary value per customer; quintile scores and named segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tillflow.functions import total_or_zero
from tillflow.operators.ranking import rows_at
from tillflow.scratch import settle

CUSTOMER = ("customer_id", "customer_name", "segment")
BINS = 5

# Segment labels.
CHAMPIONS = "Champions (Highly Active & Loyal)"
LOYAL = "Loyal Customers (Regular Buyers)"
AT_RISK = "At Risk (Frequent Buyers, Slipping)"
LOST = "Hibernating / Lost"
NEW = "New / Promising Customers"


def rfm_base(selected: DataFrame) -> DataFrame:
    """One row per customer. Recency counts from the newest order date in the selection."""
    newest = selected.agg(F.max("order_date")).scalar()
    named = selected.where(" AND ".join(f"{c} IS NOT NULL" for c in CUSTOMER))
    return (
        named.groupBy(*CUSTOMER)
        .agg(
            F.max("order_date").alias("_last"),
            F.countDistinct("order_id").alias("frequency"),
            total_or_zero("sales").alias("monetary"),
        )
        .select(*CUSTOMER, F.datediff(newest, "_last").alias("recency"), "frequency", "monetary")
    )


def quintile_ends(n: int) -> list[int]:
    """Last position of bins 1 to 4 when positions 1..n are cut at equal quantiles.

    Quantile j of the positions is 1 + (n - 1) * j / 5 and bins are closed on the right. Unlike
    ``ntile``, which evens out group sizes.
    """
    return [1 + (n - 1) * j // BINS for j in range(1, BINS)]


def _common_type(base: DataFrame) -> T.DataType:
    """Holds every metric's values exactly: decimals of the money's own scale, or doubles where money is a double."""
    money = base.schema["monetary"].dataType
    return T.DecimalType(38, money.scale) if isinstance(money, T.DecimalType) else T.DoubleType()


def rfm_scores(base: DataFrame) -> DataFrame:
    """Adds r_score, f_score and m_score, 1 to 5; equal values are split in customer order.

    A score depends only on whether a customer lies beyond the last row of each bin, in the order by value and customer.
    The customers are written once; the twelve rows at the bin ends are looked up in that table and become constants, so
    scoring is a comparison, with neither a window nor a join over the customers. Values are compared as they are, not
    rounded.
    """
    metrics, dtype = ("recency", "frequency", "monetary"), _common_type(base)
    written = settle(base, "customers")
    ends = quintile_ends(written.count())
    alike = written.select(*CUSTOMER, *[F.col(m).cast(dtype).alias(m) for m in metrics])
    # A single customer is the last of every bin, so places may repeat.
    limits = rows_at(alike, metrics, CUSTOMER, {m: sorted(set(ends)) if ends[0] > 0 else [] for m in metrics})

    def mark(value: Column, customer: Sequence[Column]) -> Column:
        return F.struct(value.alias("value"), *[c.alias(k) for k, c in zip(CUSTOMER, customer, strict=True)])

    def bin_of(metric: str) -> Column:
        mine = mark(F.col(metric).cast(dtype), [F.col(c) for c in CUSTOMER])
        found = [limits[metric, end] for end in ends if (metric, end) in limits]
        marks = [mark(F.lit(r["_value"]).cast(dtype), [F.lit(r[c]).cast(base.schema[c].dataType) for c in CUSTOMER]) for r in found]
        return sum([(mine > m).cast("int") for m in marks], F.lit(1))

    bins = [bin_of(m) for m in metrics]
    return written.withColumns({"r_score": BINS + 1 - bins[0], "f_score": bins[1], "m_score": bins[2]})


def rfm_segments(scored: DataFrame) -> DataFrame:
    r, f, m = (F.col(f"{x}_score") for x in "rfm")
    segment = (
        F.when((r >= 4) & (f >= 4), CHAMPIONS)
        .when((f >= 3) & (m >= 3), LOYAL)
        .when((r <= 2) & (f >= 3), AT_RISK)
        .when(r <= 2, LOST)
        .otherwise(NEW)
    )
    return scored.withColumn("rfm_segment", segment)


def rfm(selected: DataFrame) -> DataFrame:
    """Customers of the selection with metrics, scores and segment."""
    return selected.transform(rfm_base).transform(rfm_scores).transform(rfm_segments)


def rfm_distribution(customers: DataFrame) -> DataFrame:
    counted = customers.groupBy("rfm_segment").agg(F.count("*").alias("customer_count"))
    return counted.orderBy(F.desc("customer_count"), "rfm_segment")


def rfm_financials(customers: DataFrame) -> DataFrame:
    return (
        customers.groupBy("rfm_segment")
        .agg(
            F.count("*").alias("total_customers"),
            F.avg("recency").alias("avg_recency"),
            F.avg("frequency").alias("avg_frequency"),
            F.sum("monetary").alias("total_revenue"),
        )
        .orderBy("rfm_segment")
    )


def rfm_detail(customers: DataFrame) -> DataFrame:
    return customers.select(
        "customer_id", "customer_name", "segment", "recency", "frequency", "monetary", "rfm_segment"
    ).orderBy(F.desc("monetary"), *CUSTOMER)
