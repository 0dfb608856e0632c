"""Business features derived from one order line. Row-wise, so no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from tillflow.functions import clip
from tillflow.schema import CLEAN_TYPES


def _double(name: str) -> Column:
    return F.col(name).cast("double")


# English month names, whatever the session's locale.
MONTHS = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November",
    "December",
)


def _month_name() -> Column:
    # Not element_at: Spark 4.1 takes a NULL position in a constant array for 0.
    return F.get(F.array(*[F.lit(m) for m in MONTHS]), F.month("order_date") - 1)


def _shipping_days() -> Column:
    return clip(F.datediff("ship_date", "order_date"), low=0)


def _profit_margin() -> Column:
    return clip(_double("profit") / F.nullif(_double("sales"), F.lit(0.0)), low=0, high=1)


def _weekend_flag() -> Column:
    return F.coalesce(F.weekday("order_date") >= 5, F.lit(False))


def _revenue_per_unit() -> Column:
    return _double("sales") / F.nullif(_double("quantity"), F.lit(0.0))


def _discount_band() -> Column:
    # Bands are closed on the right; the lowest one also holds its left edge.
    edges = [Decimal(e) for e in ("-0.01", "0.1", "0.2", "0.3", "1.0")]
    labels = ("low", "medium", "high", "very_high")
    discount = F.col("discount")
    band = F.when(discount == F.lit(edges[0]), labels[0])
    for low, high, label in zip(edges, edges[1:], labels):
        band = band.when((discount > F.lit(low)) & (discount <= F.lit(high)), label)
    return band


# feature -> (columns it needs, expression)
FEATURES: dict[str, tuple[frozenset[str], Callable[[], Column]]] = {
    "profit_margin": (frozenset({"profit", "sales"}), _profit_margin),
    "order_year": (frozenset({"order_date"}), lambda: F.year("order_date")),
    "order_month": (frozenset({"order_date"}), lambda: F.month("order_date")),
    "order_month_name": (frozenset({"order_date"}), _month_name),
    "order_quarter": (frozenset({"order_date"}), lambda: F.quarter("order_date")),
    "revenue_per_unit": (frozenset({"sales", "quantity"}), _revenue_per_unit),
    "discount_percentage": (frozenset({"discount"}), lambda: F.col("discount") * 100),
    "discount_band": (frozenset({"discount"}), _discount_band),
    "shipping_days": (frozenset({"order_date", "ship_date"}), _shipping_days),
    "weekend_flag": (frozenset({"order_date"}), _weekend_flag),
    "profitability_flag": (
        frozenset({"profit", "sales"}),
        lambda: F.coalesce(F.col("profit") > 0, F.lit(False)),
    ),
}

# The part of the features that cleaning itself adds.
CLEANING_FEATURES = (
    "shipping_days", "profit_margin", "order_year", "order_month", "order_month_name",
    "order_quarter", "weekend_flag",
)


def add_features(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Add the named features whose input columns exist, in one projection."""
    present = set(df.columns)
    return df.withColumns(
        {
            name: expression().cast(CLEAN_TYPES[name])
            for name, (needs, expression) in FEATURES.items()
            if name in set(names) and needs <= present
        }
    )


def engineer_features(df: DataFrame) -> DataFrame:
    """All features that the columns of ``df`` allow."""
    return add_features(df, FEATURES)
