"""Raw text rows -> typed, trimmed, de-duplicated rows, and a data-quality report.

Invalid rows are counted in the report and kept in the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tillflow.functions import nearest, normalize_header, null_if_token, parse_date, parse_number, strip
from tillflow.operators.features import CLEANING_FEATURES, add_features
from tillflow.schema import BASE_TYPES, DATE_COLUMNS, RAW_NUMERIC_COLUMNS, TRIMMED_COLUMNS

COPIES = "_copies"
_VISIBLE = "_visible"


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalize_header(c) for c in df.columns])


def null_tokens(df: DataFrame) -> DataFrame:
    """Cells that spell "no value" become NULL."""
    return df.select(*[null_if_token(F.col(f"`{c}`")).alias(c) for c in df.columns])


def coerce_types(df: DataFrame, date_format: str = "M/d/yyyy") -> DataFrame:
    """Numbers and dates from text; what cannot be read becomes NULL."""
    present = set(df.columns)
    numeric = [c for c in ("row_id", *RAW_NUMERIC_COLUMNS) if c in present]
    dates = [c for c in DATE_COLUMNS if c in present]
    return df.withColumns(
        {c: parse_number(F.col(c), BASE_TYPES[c]) for c in numeric}
        | {c: parse_date(F.col(c), date_format) for c in dates}
    )


def trim_text(df: DataFrame) -> DataFrame:
    """Trimming by a set of characters is slow, so it is left to rows that have a value which does not begin and end with a
    visible ASCII character; that is one look at a row's ends of values."""
    text = [c for c in TRIMMED_COLUMNS if c in set(df.columns)]
    ends = F.concat_ws("", *[F.substring(c, at, 1) for c in text for at in (1, -1)])
    marked = df.withColumn(_VISIBLE, ends.rlike(r"\A[!-~]*\z"))
    return marked.withColumns({c: F.when(F.col(_VISIBLE), F.col(c)).otherwise(strip(F.col(c))) for c in text}).drop(_VISIBLE)


def fold_copies(df: DataFrame) -> DataFrame:
    """One row per distinct content with its smallest ``row_id`` and the number of copies.

    Copies differ in ``row_id`` only, so the smallest id makes the surviving row definite.
    Grouping pre-aggregates before the shuffle: a row copied a billion times travels as one
    partial row per map task. NULLs count as equal.
    """
    content = [c for c in df.columns if c != "row_id"]
    kept = [F.min("row_id").alias("row_id")] if "row_id" in df.columns else []
    folded = df.groupBy(*content).agg(*kept, F.count("*").alias(COPIES))
    return folded.select(*df.columns, COPIES)


def dedup_ignoring_row_id(df: DataFrame) -> DataFrame:
    return fold_copies(df).drop(COPIES)


def standardize(raw: DataFrame, date_format: str = "M/d/yyyy") -> DataFrame:
    """Normal headers, typed and trimmed values; row-wise."""
    return (
        raw.transform(normalize_headers)
        .transform(null_tokens)
        .transform(coerce_types, date_format)
        .transform(trim_text)
    )


def clean(raw: DataFrame, date_format: str = "M/d/yyyy") -> DataFrame:
    """Cleaned rows of a raw all-text table."""
    folded = fold_copies(standardize(raw, date_format))
    return add_features(folded.drop(COPIES), CLEANING_FEATURES)


def clean_with_report(raw: DataFrame, date_format: str = "M/d/yyyy") -> tuple[DataFrame, DataFrame]:
    """Cleaned rows and the report on them. Both are lazy; each is one pass over ``raw``."""
    folded = fold_copies(standardize(raw, date_format))
    return add_features(folded.drop(COPIES), CLEANING_FEATURES), quality_report(folded)


_RULES = {
    "invalid_sales": (("sales",), lambda: F.col("sales").isNull() | (F.col("sales") < 0)),
    "invalid_quantity": (("quantity",), lambda: F.col("quantity").isNull() | (F.col("quantity") < 1)),
    "invalid_discount": (
        ("discount",), lambda: F.col("discount").isNull() | (F.col("discount") < 0) | (F.col("discount") > 1)
    ),
    "invalid_dates": (DATE_COLUMNS, lambda: F.col("order_date").isNull() | F.col("ship_date").isNull()),
}
_MISSING = "missing_"


def report_counts(columns: Sequence[str]) -> list[Column]:
    """The report's figures as plain aggregates over :func:`fold_copies` output with the given content columns."""
    present = set(columns)
    return [
        F.coalesce(F.sum(COPIES), F.lit(0)).alias("source_rows"),
        F.count("*").alias("rows_after_cleaning"),
        *[F.count_if(F.col(c).isNull()).alias(f"{_MISSING}{c}") for c in columns],
        *[
            (F.count_if(rule()) if present.issuperset(needs) else F.sum(F.lit(0)).cast("long")).alias(name)
            for name, (needs, rule) in _RULES.items()
        ],
    ]


def report_from_counts(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of row counts, missing values and invalid values from one row of :func:`report_counts`."""
    missing = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(f"{_MISSING}{c}") for c in columns]))
    rows = F.greatest(F.col("rows_after_cleaning"), F.lit(1))
    return counts.withColumn("missing_values", missing).select(
        "source_rows",
        "rows_after_cleaning",
        (F.col("source_rows") - F.col("rows_after_cleaning")).alias("duplicate_rows"),
        "missing_values",
        F.transform_values(
            F.map_filter("missing_values", lambda _, n: n > 0),
            lambda _, n: nearest(n / rows * 100, 2),
        ).alias("missing_percent"),
        *[F.coalesce(F.col(name), F.lit(0)).alias(name) for name in _RULES],
    )


def quality_report(folded: DataFrame) -> DataFrame:
    """The report on :func:`fold_copies` output, lazily.

    A single global aggregate: the number of jobs does not grow with the number of columns.
    """
    columns = [c for c in folded.columns if c != COPIES]
    return report_from_counts(folded.agg(*report_counts(columns)), columns)


def missing_by_column(report: DataFrame) -> DataFrame:
    """The report's two maps as rows; the percentage is NULL where nothing is missing."""
    return report.select(
        F.explode("missing_values").alias("column_name", "missing"), "missing_percent"
    ).select("column_name", "missing", F.col("missing_percent")[F.col("column_name")].alias("missing_percent"))
