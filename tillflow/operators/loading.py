"""Last steps before a load: schema alignment, load formatting, typing and key checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F, types as T

from tillflow.schema import (
    CLEAN_TYPES, DATE_COLUMNS, EXPECTED_COLUMNS, FLAG_COLUMNS, LOAD_NUMERIC_COLUMNS, WAREHOUSE_TYPES,
)


def _kind(dtype: T.DataType) -> str:
    """Types of one kind convert to each other without changing what a value means."""
    return "number" if isinstance(dtype, T.NumericType) else dtype.typeName()


def schema_differences(found: T.StructType, expected: Mapping[str, T.DataType], types: bool = True) -> list[str]:
    """What keeps a table from having the expected columns, all of it at once; empty if nothing does.

    The order of columns does not matter. With ``types``, a column of another kind differs too; a column without any
    type (all NULL) fits every kind.
    """
    actual = {field.name: field.dataType for field in found.fields}
    problems = []
    if absent := expected.keys() - actual.keys():
        problems.append(f"Missing columns: {', '.join(c for c in expected if c in absent)}")
    if surplus := actual.keys() - expected.keys():
        problems.append(f"unexpected columns: {', '.join(sorted(surplus))}")
    if types:
        other = [
            f"{c} is {actual[c].simpleString()}, not {dtype.simpleString()}"
            for c, dtype in expected.items()
            if c in actual and not isinstance(actual[c], T.NullType) and _kind(actual[c]) != _kind(dtype)
        ]
        if other:
            problems.append(f"other types: {', '.join(other)}")
    return problems


def align_schema(df: DataFrame, types: bool = False) -> DataFrame:
    """Exactly the expected columns in the expected order; raises ``ValueError`` with all differences."""
    if problems := schema_differences(df.schema, CLEAN_TYPES, types):
        raise ValueError("; ".join(problems))
    return df.select([df[name] for name in EXPECTED_COLUMNS])


def prepare_for_load(df: DataFrame) -> DataFrame:
    """Load format: dates as ISO text, flags as booleans, numbers as numbers, the rest as text.

    Values that do not fit become NULL. Numeric columns that are numeric already keep their type.
    """
    numeric_types = {f.name for f in df.schema.fields if f.dataType.typeName() not in ("string", "void")}

    def formatted(name: str):
        value = F.col(f"`{name}`")
        if name in DATE_COLUMNS:
            return F.date_format(value.try_cast("date"), "yyyy-MM-dd")
        if name in FLAG_COLUMNS:
            return value.try_cast("boolean")
        if name in LOAD_NUMERIC_COLUMNS:
            return value if name in numeric_types else value.try_cast(CLEAN_TYPES[name])
        return value.cast("string")

    return align_schema(df.select(*[formatted(c).alias(c) for c in df.columns]))


def to_warehouse(df: DataFrame) -> DataFrame:
    """The typed warehouse columns. Decimals round half up; an overflow fails the load."""
    typed = {c: F.col(c).cast(t).alias(c) for c, t in WAREHOUSE_TYPES.items()}
    return align_schema(df, types=True).select(*typed.values())


def key_violations(df: DataFrame) -> DataFrame:
    """Rows that break the table's keys, as (check, row_id, rows); empty when the keys hold.

    One scan and one aggregation: per row id, how often it occurs and how often without an order.
    """
    per_id = df.groupBy("row_id").agg(F.count("*").alias("n"), F.count_if(F.col("order_id").isNull()).alias("orphans"))
    repeats = F.when(F.col("row_id").isNull(), F.lit("row_id is null")).when(F.col("n") > 1, F.lit("row_id repeats"))
    orphans = F.when(F.col("orphans") > 0, F.lit("order_id is null"))
    found = F.array_compact(
        F.array(
            F.when(repeats.isNotNull(), F.struct(repeats.alias("check"), F.col("n").alias("rows"))),
            F.when(orphans.isNotNull(), F.struct(orphans.alias("check"), F.col("orphans").alias("rows"))),
        )
    )
    return per_id.select("row_id", F.explode(found).alias("v")).select("v.check", "row_id", "v.rows")


def summarize_violations(violations: DataFrame) -> list[str]:
    """A line per broken rule: how many ids and rows break it, and the smallest id as a sample. Runs the check."""
    per_rule = violations.groupBy("check").agg(F.count("*").alias("ids"), F.sum("rows").alias("rows"), F.min("row_id").alias("sample"))
    return [f"{r['check']}: {r['ids']} ids, {r['rows']} rows, for instance row_id {r['sample']}" for r in per_rule.orderBy("check").collect()]
