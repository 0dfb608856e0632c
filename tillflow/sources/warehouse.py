"""The typed fact table: full-refresh load, scan and statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillflow.operators.loading import key_violations, prepare_for_load, summarize_violations, to_warehouse
from tillflow.schema import EXPECTED_COLUMNS, WAREHOUSE_SCHEMA, WAREHOUSE_TYPES
from tillflow.scratch import delete
from tillflow.sources import versions
from tillflow.sources.csv_files import by_year
from tillflow.sources.versions import KEEP_HOURS, KEEP_VERSIONS, Version

TABLE = "retail_orders"
_BASE_PROPERTY, _VERSION_PROPERTY = "tillflow.base", "tillflow.version"


def _properties(spark: SparkSession, table: str) -> dict[str, str]:
    """Properties of the catalog's view of a table; none if there is no such view."""
    if not spark.catalog.tableExists(table):
        return {}
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}


def _base(spark: SparkSession, table: str, path: str | None = None) -> str:
    """The folder of a table: the one that is named, else that of its view, else one beside the session's tables."""
    default = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{table}.versions"
    return (path or _properties(spark, table).get(_BASE_PROPERTY) or default).rstrip("/")


def _among(loads: tuple[str, ...]) -> str:
    return f"load IN ({', '.join(repr(x) for x in loads)})"


def _point(spark: SparkSession, table: str, base: str, loads: tuple[str, ...], number: int) -> None:
    """Point the catalog's view of a table to the loads of a version, in one statement."""
    # The type of a folder's value is inferred from its name.
    columns = [f"CAST({c} AS {t.simpleString()}) AS {c}" if c == "order_year" else c for c, t in WAREHOUSE_TYPES.items()]
    spark.sql(
        f"CREATE OR REPLACE VIEW {table} TBLPROPERTIES ('{_BASE_PROPERTY}' = '{base}', '{_VERSION_PROPERTY}' = '{number}') "
        f"AS SELECT {', '.join(columns)} FROM parquet.`{base}/{versions.DATA}` WHERE {_among(loads)}"
    )


def _rows_of(spark: SparkSession, base: str, loads: tuple[str, ...]) -> DataFrame:
    schema = f"{WAREHOUSE_SCHEMA.toDDL()}, load string"
    return spark.read.schema(schema).parquet(f"{base}/{versions.DATA}").where(_among(loads))


def open_warehouse(spark: SparkSession, table: str = TABLE, path: str | None = None) -> bool:
    """Make the newest version of a table the one that its view shows; whether there is such a table.

    The log in the table's folder tells what the newest version is, so a session with an empty catalog, or one whose view
    was made before another session's load, finds the table as it is now.
    """
    base = _base(spark, table, path)
    version = versions.current(spark, base)
    if version is None:
        return spark.catalog.tableExists(table)
    shown = _properties(spark, table)
    if (shown.get(_BASE_PROPERTY), shown.get(_VERSION_PROPERTY)) != (base, str(version.number)):
        _point(spark, table, base, version.loads, version.number)
    return True


def _write(rows: DataFrame, folder: str) -> None:
    (
        rows.sortWithinPartitions("order_year", "order_date", "region", "category")
        .write.partitionBy("order_year")
        .option("compression", "zstd")
        .parquet(folder)
    )


def _refuse(violations: DataFrame, what: str) -> None:
    if broken := summarize_violations(violations):
        raise ValueError(f"{what} rejected, table keys are violated. {'; '.join(broken)}")


def load_warehouse(
    enriched: DataFrame, table: str = TABLE, path: str | None = None, check_keys: bool = True,
    before_write: Callable[[DataFrame], DataFrame] | None = None, keep_versions: int = KEEP_VERSIONS, keep_hours: float = KEEP_HOURS,
    in_place: bool = False,
) -> None:
    """Replace ``table`` by ``enriched``.

    A table is a view of the newest version in a folder, ``path`` or one beside the session's warehouse tables. A load fills
    a folder of its own, checks the keys there, and then adds the version to the log and points the view to it: readers see
    the old or the new table, a load that fails leaves nothing behind, and of two loads at the same time both take place,
    one after the other. Old versions stay for queries that read them until a later load finds more than
    ``keep_versions`` and that they were replaced ``keep_hours`` ago; see :func:`~tillflow.sources.versions.vacuum`. Files
    lie in one folder per year, in date order within a task, so that a date range skips folders, row groups and pages.
    ``rebalance`` sizes the files and splits a year that holds most of the rows. ``before_write`` is applied after it, to
    the rows as they are written; it may derive columns, which are then not shuffled. With ``in_place`` no row is moved: each
    task writes what it holds, one file for each of its years. That saves a shuffle of the whole rows where tasks are large
    and even already, as those that read splits of files or join, whose skewed partitions Spark splits.
    """
    spark = enriched.sparkSession
    base, load = _base(spark, table, path), versions.new_load()
    folder = versions.load_folder(base, load)
    try:
        rows = enriched if in_place else by_year(enriched)
        rows = to_warehouse(before_write(rows) if before_write else rows)
        _write(rows, folder)
        if check_keys:
            _refuse(key_violations(_rows_of(spark, base, (load,)).select("row_id", "order_id")), "Load")
        _publish(spark, table, base, lambda _: ((load,), {}))
    except BaseException:
        delete(spark, folder)
        raise
    versions.vacuum(spark, base, keep_versions, keep_hours)


def _publish(spark: SparkSession, table: str, base: str, follow: Callable[[Version | None], tuple[tuple[str, ...], dict[str, int]] | None]) -> bool:
    """Add the version that ``follow`` makes of the newest one, again until no other writer has come between; whether it
    has made one. A view that cannot be pointed to it leaves the log as it was."""
    while True:
        before = versions.current(spark, base)
        made = follow(before)
        if made is None:
            return False
        number = before.number + 1 if before else 1
        _point(spark, table, base, made[0], number)
        try:
            if versions.commit(spark, base, before, *made):
                return True
        except BaseException:
            if before:
                _point(spark, table, base, before.loads, before.number)
            else:
                spark.sql(f"DROP VIEW IF EXISTS {table}")
            raise


def append_warehouse(
    enriched: DataFrame, table: str = TABLE, check_keys: bool = True, path: str | None = None, batch: tuple[str, int] | None = None,
) -> bool:
    """Add rows to the table; its keys must hold for old and new rows together. Returns whether rows were added.

    The rows are a load of their own, and the new version names it beside the old ones, so readers see all of the rows or
    none. ``batch``, the name of a stream and the number of its batch, makes the append idempotent: a batch that
    the table's newest version already has is left out. With ``batch`` the table is made if it is not there.
    """
    spark = enriched.sparkSession
    base, load = _base(spark, table, path), versions.new_load()
    folder = versions.load_folder(base, load)
    before = versions.current(spark, base)
    if before is None and batch is None:
        raise ValueError(f"There is no table {table} to add to.")

    def has_batch(version: Version | None) -> bool:
        return bool(batch and version and version.batches.get(batch[0], -1) >= batch[1])

    if has_batch(before):
        return False
    _write(to_warehouse(enriched).hint("rebalance", "order_year"), folder)

    def follow(newest: Version | None):
        if has_batch(newest):
            return None
        loads = (*(newest.loads if newest else ()), load)
        if check_keys:
            _refuse(key_violations(_rows_of(spark, base, loads).select("row_id", "order_id")), "Rows")
        return loads, (newest.batches if newest else {}) | ({batch[0]: batch[1]} if batch else {})

    try:
        added = _publish(spark, table, base, follow)
    except BaseException:
        delete(spark, folder)
        raise
    if not added:
        delete(spark, folder)
    return added


def load_processed(spark: SparkSession, path: str, table: str = TABLE) -> None:
    """Replace ``table`` by a processed CSV file of any tool's making: all text, brought into load format first."""
    text = spark.read.option("header", True).option("escape", '"').csv(path)
    prepared = prepare_for_load(text)
    dates = {c: F.col(c).cast("date") for c in ("order_date", "ship_date")}
    load_warehouse(prepared.withColumns(dates), table)


def drop_warehouse(spark: SparkSession, table: str = TABLE, path: str | None = None) -> None:
    """Remove the table and its files, all versions."""
    base = _base(spark, table, path)
    spark.sql(f"DROP VIEW IF EXISTS {table}")
    delete(spark, base)


def scan_warehouse(spark: SparkSession, table: str = TABLE, path: str | None = None) -> DataFrame:
    """The whole table as it is now, lazily: filters and column choices of later steps reach the files."""
    open_warehouse(spark, table, path)
    return spark.table(table).select(*EXPECTED_COLUMNS)


def table_stats(orders: DataFrame) -> DataFrame:
    return orders.agg(
        F.count("*").alias("row_count"),
        F.countDistinct("customer_id").alias("unique_customers"),
        F.countDistinct("product_id").alias("unique_products"),
    )


def jdbc_write_options(url: str, table: str = TABLE, batch_size: int = 1000) -> dict[str, str]:
    """Keep the target's table definition and insert in batches."""
    return {"url": url, "dbtable": table, "truncate": "true", "batchsize": str(batch_size)}


def jdbc_swap_statements(table: str = TABLE) -> list[str]:
    """What to run in the database, in one transaction, once the staging table is full."""
    staging = f"{table}_staging"
    return [f"DELETE FROM {table}", f"INSERT INTO {table} SELECT * FROM {staging}", f"DELETE FROM {staging}"]


def write_jdbc(enriched: DataFrame, url: str, table: str = TABLE, properties: dict[str, str] | None = None) -> list[str]:
    """Fill the staging table of a database table; returns the statements that replace the table by it.

    Spark's tasks commit each for itself, so they never write the table that readers see.
    """
    options = jdbc_write_options(url, f"{table}_staging") | (properties or {})
    to_warehouse(enriched).write.format("jdbc").options(**options).mode("overwrite").save()
    return jdbc_swap_statements(table)


def jdbc_read_options(url: str, low: int, high: int, partitions: int, table: str = TABLE) -> dict[str, str]:
    """Read ranges of row_id in parallel; without bounds one task would read the whole table."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": "row_id",
        "lowerBound": str(low),
        "upperBound": str(high),
        "numPartitions": str(partitions),
    }


def scan_jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load().select(*EXPECTED_COLUMNS)
