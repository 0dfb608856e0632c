"""Column expressions shared by the operators."""

from tillflow.functions.numbers import clip, half_even, nearest, percent_of, ratio, total_or_zero
from tillflow.functions.text import normalize_header, null_if_token, parse_date, parse_number, strip

__all__ = [
    "clip", "half_even", "nearest", "normalize_header", "null_if_token", "parse_date", "parse_number",
    "percent_of", "ratio", "strip", "total_or_zero",
]
