"""Text to typed values. Nothing here raises on bad input: it yields NULL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from tillflow.schema import NA_TOKENS

# A cast to a decimal type takes plain and scientific notation only. A cast to double would also
# take "nan", "inf" and "1d", so its text has to look like a number first.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# Every white space character of Unicode, which plain trimming (blanks only) would miss.
_WHITE_SPACE = "".join(c for c in map(chr, range(0x10000)) if c.isspace())


def normalize_header(name: str) -> str:
    """``" Sub-Category "`` -> ``"sub_category"``."""
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def null_if_token(value: Column) -> Column:
    return F.when(~value.isin(*NA_TOKENS), value)


def parse_number(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DecimalType):
        return value.try_cast(dtype)
    if isinstance(dtype, T.IntegralType):
        # "2.0" is an integer in decimal notation; a direct cast would refuse it.
        return value.try_cast(T.DecimalType(38, 4)).try_cast(dtype)
    return F.when(value.rlike(_NUMBER), value).try_cast(dtype)


def parse_date(value: Column, pattern: str) -> Column:
    return F.try_to_date(value, pattern)


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(_WHITE_SPACE))
