"""Raw and processed order lines in delimited files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from tillflow.functions import null_if_token, parse_number
from tillflow.schema import CLEAN_TYPES
from tillflow.scratch import new_path

RAW_ENCODING = "ISO-8859-1"
_LAST_FIELD = "\ue000"  # a private character, which Latin-1 text does not have


def _raw_options(spark: SparkSession, multi_line: bool):
    return (
        spark.read.option("header", True)
        .option("encoding", RAW_ENCODING)
        .option("escape", '"')  # a doubled quote inside quotes, not a backslash
        .option("multiLine", multi_line)
        .option("enforceSchema", False)  # every file's header is compared with the first one's
        .option("columnPruning", False)  # whole lines are parsed, so that a wrong number of fields shows
    )


def read_raw(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """Every column as text, named by the header row. A missing path raises.

    Only the header is looked at before the job runs. The job fails on a file whose header differs in names or order, and
    on a line with more or fewer fields than the header, so no value can end up in another column or be cut off; see
    :func:`malformed_lines`, and :func:`salvage_raw` for what can be read of such files. ``multi_line`` accepts line breaks inside quotes, at the price of one task per file;
    without it they make such lines.
    """
    return _raw_options(spark, multi_line).option("mode", "FAILFAST").csv(path)


def malformed_lines(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """(file, line) of the lines that :func:`read_raw` fails on for their number of fields."""
    header = _raw_options(spark, multi_line).csv(path).schema
    kept = T.StructType([*header.fields, T.StructField("_line", T.StringType())])
    lines = _raw_options(spark, multi_line).schema(kept).option("columnNameOfCorruptRecord", "_line").option("enforceSchema", True).csv(path)
    # Spark refuses to read that column alone; no character of the first one keeps it company.
    line = F.concat_ws("", F.col("_line"), F.substring(lines[0], 1, 0))
    return lines.select(F.input_file_name().alias("file"), line.alias("line")).where(F.col("line") != "")


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8", compression: str = "none", rows_per_file: int = 0) -> None:
    """Overwrite ``path`` with CSV files that have a header; text keeps its edge spaces.

    A compressed file is read by one task, so ``rows_per_file`` (0: no limit) should bound what such a file holds.
    """
    (
        df.write.mode("overwrite")
        .option("compression", compression)
        .option("maxRecordsPerFile", rows_per_file)
        .option("header", True)
        .option("encoding", encoding)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def by_year(df: DataFrame) -> DataFrame:
    """``df`` with Spark's ``rebalance`` by year; the year is derived for it where the features are not there yet."""
    return df.withColumn("order_year", df["order_year"] if "order_year" in df.columns else F.year("order_date")).hint("rebalance", "order_year")


def write_processed(
    df: DataFrame, path: str, file_format: str = "parquet", before_write: Callable[[DataFrame], DataFrame] | None = None
) -> None:
    """Overwrite ``path`` with the enriched table, as one folder per year of parquet, or as CSV.

    ``rebalance`` lets Spark size the files and split a year that holds most of the rows. ``before_write`` is applied
    after it, to the rows as they are written.
    """
    rows = df if file_format == "csv" else by_year(df)
    rows = before_write(rows) if before_write else rows
    if file_format == "csv":
        write_csv(rows, path)
        return
    rows.write.mode("overwrite").partitionBy("order_year").parquet(path)


def _typed(name: str) -> Column:
    value, dtype = null_if_token(F.col(f"`{name}`")), CLEAN_TYPES.get(name, T.StringType())
    if isinstance(dtype, T.NumericType):
        return parse_number(value, dtype).alias(name)
    return value.try_cast(dtype).alias(name)


def read_processed(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """The enriched table. Parquet has its types; CSV text is converted by column name."""
    if file_format == "csv":
        text = spark.read.option("header", True).option("escape", '"').csv(path)
        return text.select(*[_typed(c) for c in text.columns])
    df = spark.read.parquet(path)
    return df.select(*[c for c in CLEAN_TYPES if c in df.columns])


@dataclass(frozen=True)
class Salvage:
    """What :func:`salvage_raw` has made of raw files."""

    lines: DataFrame  # named by the header, every column as text; short lines are filled up with NULLs
    rejected: DataFrame  # (file, line) of the lines that have more fields than the header, or quotes that do not close
    counts: dict[str, int]  # lines_read, lines_padded, lines_rejected


def salvage_raw(spark: SparkSession, path: str | list[str], multi_line: bool = False, folder: str | None = None) -> Salvage:
    """Raw files with lines of a wrong number of fields: what can be read, and what cannot, in one pass.

    A line with fewer fields than the header lacks its last ones, which become NULL, as common readers of such files do. A
    line with more would put values in other columns, so it is set aside as it is. Both go to ``folder`` (by default in the
    shared folder), good lines and rejected ones apart, and are counted as they are written. A file with another header
    fails, as in :func:`read_raw`.
    """
    header = _raw_options(spark, multi_line).csv(path).schema
    names = [f"c{i}" for i in range(len(header.fields))]
    kept = T.StructType([*header.fields, T.StructField("_line", T.StringType())])
    found = _raw_options(spark, multi_line).schema(kept).option("columnNameOfCorruptRecord", "_line").csv(path)
    found = found.toDF(*names, "line").withColumn("file", F.input_file_name())
    # One more field at the end of a line takes the place of the first one that it lacks. A line that has too many, or an
    # open quote, shows it nowhere.
    again = F.from_csv(F.concat("line", F.lit(f",{_LAST_FIELD}")), ", ".join(f"{n} string" for n in names), {"escape": '"', "mode": "PERMISSIVE"})
    short = F.coalesce(F.array_contains(F.array(*[again[n] for n in names]), _LAST_FIELD), F.lit(False))
    told = found.withColumn("wrong", F.col("line").isNotNull()).withColumn("rejected", F.col("wrong") & ~short)
    observation = Observation()
    written = told.select(
        *[F.when(~F.col("rejected"), F.col(n)).alias(n) for n in names],
        F.when(F.col("rejected"), F.col("line")).alias("line"), F.when(F.col("rejected"), F.col("file")).alias("file"), "wrong", "rejected",
    ).observe(
        observation, F.count("*").alias("lines_read"), F.count_if(F.col("wrong") & ~F.col("rejected")).alias("lines_padded"),
        F.count_if("rejected").alias("lines_rejected"),
    )
    place = folder or new_path(spark, "salvage")
    written.drop("wrong").write.partitionBy("rejected").parquet(place)
    schema = ", ".join(f"{n} string" for n in (*names, "line", "file")) + ", rejected boolean"
    parts = spark.read.schema(schema).parquet(place)
    return Salvage(
        parts.where("NOT rejected").select(*[F.col(n).alias(f.name) for n, f in zip(names, header.fields, strict=True)]),
        parts.where("rejected").select("file", "line"),
        {k: v or 0 for k, v in observation.get.items()},
    )
