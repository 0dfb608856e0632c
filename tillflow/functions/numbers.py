"""Arithmetic with explicit null, zero and rounding rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clip(value: Column, low: int | None = None, high: int | None = None) -> Column:
    """Limit to [low, high]; NULL stays NULL, which ``greatest``/``least`` would not keep."""
    out = value
    if high is not None:
        out = F.when(value > high, F.lit(high).cast("int")).otherwise(out)
    if low is not None:
        out = F.when(value < low, F.lit(low).cast("int")).otherwise(out)
    return out


def ratio(part: Column, whole: Column, digits: int) -> Column:
    """Exact decimal quotient, rounded half away from zero; NULL when ``whole`` is 0."""
    return F.round(part / F.nullif(whole, F.lit(0)), digits)


def half_even(value: Column, digits: int) -> Column:
    """Scale, round to the nearest integer with ties to even, scale back; all in doubles."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def nearest(value: Column, digits: int) -> Column:
    """The decimal nearest to the exact value of a double, ties to even.

    Scaling may round a value next to a tie onto the tie; the scaling error then tells its side.
    """
    scale = float(10**digits)
    scaled = value * scale
    high = value * 134217729.0 - (value * 134217729.0 - value)  # upper half of the digits
    error = (high * scale - scaled) + (value - high) * scale
    down = F.floor(scaled).cast("double")
    on_tie = scaled - down == 0.5
    rounded = F.when(on_tie & (error < 0), down).when(on_tie & (error > 0), down + 1).otherwise(F.rint(scaled))
    return rounded / scale


def percent_of(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole`` to two places, ties to even; NULL when ``whole`` is 0."""
    quotient = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return half_even(quotient * 100, 2)


def total_or_zero(value: Column) -> Column:
    """Sum that is 0 for a group without values."""
    return F.coalesce(F.sum(value), F.lit(0))
