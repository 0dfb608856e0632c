"""Raw file to enriched table, and the choice of where orders come from."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession

from tillflow.operators.cleaning import (
    COPIES, fold_copies, normalize_headers, null_tokens, quality_report, report_counts, report_from_counts, standardize,
)
from tillflow.operators.copies import fold_copies_by_digest
from tillflow.operators.dates import infer_date_format
from tillflow.operators.features import engineer_features
from tillflow.sources.csv_files import read_processed, read_raw, salvage_raw, write_processed
from tillflow.sources.warehouse import TABLE, load_warehouse, open_warehouse, scan_jdbc, scan_warehouse


def _standardized(spark: SparkSession, raw_path: str, date_format: str | None, multi_line: bool, malformed: str) -> DataFrame:
    """``malformed``: "fail" on lines with a wrong number of fields, or "salvage" what can be read. Without a date format
    the one that reads most dates is taken."""
    if malformed not in ("fail", "salvage"):
        raise ValueError(f"malformed is fail or salvage, not {malformed}")
    raw = read_raw(spark, raw_path, multi_line) if malformed == "fail" else salvage_raw(spark, raw_path, multi_line).lines
    return standardize(raw, date_format or infer_date_format(null_tokens(normalize_headers(raw))))


def _with_report(folded: DataFrame, write: Callable[[DataFrame, Callable[[DataFrame], DataFrame]], None]) -> DataFrame:
    """Write the enriched rows and return the quality report, both in one pass. ``write`` applies the features with the count.

    The figures are observed on the rows as they are written, in the job's last stage, where Spark counts each task
    once also if it has to be repeated.
    """
    spark, columns = folded.sparkSession, [c for c in folded.columns if c != COPIES]
    observation, counts = Observation(), report_counts(columns)

    def observed(rows: DataFrame) -> DataFrame:
        return engineer_features(rows.observe(observation, *counts).drop(COPIES))

    write(folded, observed)
    seen = observation.get
    types = folded.agg(*counts).schema
    row = spark.createDataFrame([tuple(seen.get(f.name) for f in types)], types)
    return report_from_counts(row, columns)


def refresh(
    spark: SparkSession,
    raw_path: str,
    output: str | None = None,
    file_format: str = "parquet",
    date_format: str | None = "M/d/yyyy",
    multi_line: bool = False,
    malformed: str = "fail",
) -> tuple[DataFrame, DataFrame]:
    """Read, clean and enrich a raw file; returns the enriched rows and the quality report.

    With ``output`` the enriched rows are written there in one pass over the raw file that also counts for the report,
    and are read from there. Otherwise both results stay lazy. With ``malformed="salvage"`` lines with a wrong number of
    fields are filled up or left out, see :func:`~tillflow.sources.csv_files.salvage_raw`; ``date_format=None`` finds the
    format in the data, see :func:`~tillflow.operators.dates.infer_date_format`. Each of these two is a pass of its own.
    """
    folded = fold_copies(_standardized(spark, raw_path, date_format, multi_line, malformed))
    if output is None:
        return engineer_features(folded.drop(COPIES)), quality_report(folded)
    report = _with_report(folded, lambda rows, observed: write_processed(rows, output, file_format, observed))
    return read_processed(spark, output, file_format), report


def refresh_warehouse(
    spark: SparkSession,
    raw_path: str,
    table: str = TABLE,
    path: str | None = None,
    output: str | None = None,
    file_format: str = "parquet",
    date_format: str | None = "M/d/yyyy",
    multi_line: bool = False,
    malformed: str = "fail",
) -> DataFrame:
    """Replace the warehouse table by a raw file's content; returns the quality report.

    With ``output`` the processed files are made on the way, and the table is loaded from them; the raw file is read once.
    Without, copies are found by digest and rows stay in the tasks that read them: the raw file is read three times, and only
    digests and rows that may have copies are shuffled. ``path`` is the folder that holds the table's files.
    """
    if output is not None:
        rows, report = refresh(spark, raw_path, output, file_format, date_format, multi_line, malformed)
        load_warehouse(rows, table, path)
        return report
    folded = fold_copies_by_digest(_standardized(spark, raw_path, date_format, multi_line, malformed))
    return _with_report(folded, lambda rows, observed: load_warehouse(rows, table, path, before_write=observed, in_place=True))


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def load_orders(
    spark: SparkSession,
    table: str | None = None,
    processed: str | None = None,
    raw: Sequence[str] = (),
    file_format: str = "parquet",
    date_format: str = "M/d/yyyy",
    multi_line: bool = False,
    database: dict[str, str] | None = None,
) -> DataFrame:
    """Orders from the first source there is: database, warehouse table, processed files, raw file.

    ``database`` holds the options of :func:`~tillflow.sources.warehouse.jdbc_read_options`; a database that is named has to
    answer. From a raw file the processed files are made first, if their path is given. Only a source that
    does not exist is passed over; any other failure is raised.
    """
    if database is not None:
        return scan_jdbc(spark, database)
    if table is not None and open_warehouse(spark, table):
        return scan_warehouse(spark, table)
    if processed is not None and _exists(spark, processed):
        return read_processed(spark, processed, file_format)
    for path in raw:
        if _exists(spark, path):
            return refresh(spark, path, processed, file_format, date_format, multi_line)[0]
    raise FileNotFoundError(f"No order source found: table={table}, processed={processed}, raw={list(raw)}")
