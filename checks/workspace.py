"""Tables that the registered queries share, derived once per session from a folder of inputs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillflow.operators.cleaning import normalize_headers, null_tokens
from tillflow.operators.features import engineer_features
from tillflow.operators.filters import Selection, select_orders
from tillflow.operators.rollup import append_rollup, write_rollup
from tillflow.plans.refresh import refresh_warehouse
from tillflow.schema import BASE_TYPES, RAW_HEADERS
from tillflow.scratch import new_path
from tillflow.sources.csv_files import RAW_ENCODING, read_raw, write_csv
from tillflow.sources.star_schema import order_lines
from tillflow.sources.warehouse import load_warehouse, scan_warehouse
from tillflow.streaming.arrivals import append_arrivals

COPY_OFFSET = 10_000_000
RAW_ROWS = 40_000  # lines of a compressed raw file, which one task reads


def with_defects(lines: DataFrame) -> DataFrame:
    """Order lines as raw text with known defects, chosen by row id; every 50th line comes twice."""

    def every(n: int) -> Column:
        return F.col("row_id") % n == 0

    text = {c: F.col(c).cast("string") for c in BASE_TYPES}
    for name in ("order_date", "ship_date"):
        text[name] = F.date_format(name, "M/d/yyyy")
    text["sales"] = (
        F.when(every(101), "abc")
        .when(every(103), F.concat(F.lit("-"), text["sales"]))
        .when(~every(107), text["sales"])
    )
    text["quantity"] = F.when(every(109), "0").otherwise(text["quantity"])
    text["discount"] = F.when(every(113), "1.5").otherwise(text["discount"])
    text["order_date"] = F.when(every(127), "13/45/1999").otherwise(text["order_date"])
    text["ship_date"] = F.when(~every(131), text["ship_date"])
    text["segment"] = F.when(every(7), F.concat(F.lit("  "), "segment", F.lit(" "))).otherwise(text["segment"])
    text["region"] = F.when(every(137), "NA").otherwise(text["region"])
    text["profit"] = F.when(every(139), "n/a").otherwise(text["profit"])

    copies = F.when(every(50), F.array(F.lit(0), F.lit(COPY_OFFSET))).otherwise(F.array(F.lit(0)))
    doubled = lines.select(*[text[c].alias(c) for c in BASE_TYPES], F.explode(copies).alias("_shift"))
    return doubled.withColumn(
        "row_id", (F.col("row_id").cast("long") + F.col("_shift")).cast("string")
    ).select(*[F.col(c).alias(h) for c, h in zip(BASE_TYPES, RAW_HEADERS)])


class Workspace:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._suffix = new_path(spark, "t").rsplit("-", 1)[-1]

    @cached_property
    def lines(self) -> DataFrame:
        """Order lines in the cleaned layout, without derived columns. The numbered items are written; joins run where lines are read."""
        return order_lines(self.spark, self.folder)

    @cached_property
    def enriched(self) -> DataFrame:
        return engineer_features(self.lines)

    def _table(self, name: str) -> str:
        return f"{name}_{self._suffix}"

    @cached_property
    def table(self) -> str:
        """Warehouse table of the order lines, written where the joins have made them."""
        load_warehouse(self.lines, self._table("orders"), before_write=engineer_features, in_place=True)
        return self._table("orders")

    @cached_property
    def orders(self) -> DataFrame:
        return scan_warehouse(self.spark, self.table)

    @cached_property
    def raw_path(self) -> str:
        """Raw CSV files with defects."""
        path = new_path(self.spark, "raw")
        write_csv(with_defects(self.lines), path, RAW_ENCODING, "gzip", RAW_ROWS)
        return path

    @cached_property
    def broken_path(self) -> str:
        """The raw files with lines that lack their last two fields, and lines with one too many."""
        path, lines = new_path(self.spark, "broken"), with_defects(self.lines)
        options = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
        whole, short = (F.to_csv(F.struct(*[F.col(f"`{h}`") for h in names]), options) for names in (RAW_HEADERS, RAW_HEADERS[:-2]))
        number = F.col("`Row ID`").cast("long") % COPY_OFFSET
        line = F.when(number % 151 == 0, short).when(number % 157 == 0, F.concat(whole, F.lit(",surplus"))).otherwise(whole)
        # Lines are values of one column here, so that neither separator nor quotes of theirs mean anything to the writer.
        text = lines.select(line.alias(",".join(RAW_HEADERS)))
        text.write.option("header", True).option("sep", "\x01").option("quote", "\x02").option("encoding", RAW_ENCODING).option(
            "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
        return path

    @cached_property
    def exports_path(self) -> str:
        """Three exports of the raw lines, each with its own format of dates; folders tell the export."""
        path, raw = new_path(self.spark, "exports"), with_defects(self.lines)
        export = F.pmod(F.col("`Row ID`").cast("long"), F.lit(3))

        def written(name: str) -> Column:
            date, bad = F.try_to_date(F.col(f"`{name}`"), "M/d/yyyy"), F.col(f"`{name}`")
            other = F.when(export == 1, F.date_format(date, "d.M.yyyy")).when(export == 2, F.date_format(date, "yyyy-MM-dd"))
            return F.coalesce(other, bad)

        raw.withColumns({"Order Date": written("Order Date"), "Ship Date": written("Ship Date"), "export": export}).write.partitionBy("export").option(
            "compression", "gzip").option("maxRecordsPerFile", RAW_ROWS).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
        return path

    @cached_property
    def exports(self) -> DataFrame:
        text = self.spark.read.option("header", True).option("escape", '"').csv(self.exports_path)
        return null_tokens(normalize_headers(text.withColumn("export", F.col("export").cast("string"))))

    @cached_property
    def arrived_orders(self) -> DataFrame:
        """Warehouse table filled by a stream from two deliveries of raw files, the second with half of the first's lines."""
        folder, checkpoint = new_path(self.spark, "arrivals"), new_path(self.spark, "arrivals_checkpoint")
        table, lines = self._table("arrived"), with_defects(self.lines)
        number = F.col("`Row ID`").cast("long")
        for delivery in (lines.where(number % 4 < 3), lines.where(number % 4 >= 1).withColumn("Row ID", (number + 5 * COPY_OFFSET).cast("string"))):
            write_csv(delivery, f"{folder}/{new_path(self.spark, 'd').rsplit('/', 1)[-1]}", RAW_ENCODING)
            append_arrivals(self.spark, f"{folder}/*", checkpoint, table).awaitTermination()
        return scan_warehouse(self.spark, table)

    @property
    def raw(self) -> DataFrame:
        return read_raw(self.spark, self.raw_path)

    @cached_property
    def refreshed_orders(self) -> DataFrame:
        """Warehouse table refreshed from the raw files: has NULLs in keys and values."""
        refresh_warehouse(self.spark, self.raw_path, self._table("refreshed"))
        return scan_warehouse(self.spark, self._table("refreshed"))

    @cached_property
    def rolled(self) -> DataFrame:
        """Roll-up of the refreshed table, made in two loads that share orders."""
        path, late = new_path(self.spark, "rollup"), F.col("row_id") % 3 == 0
        write_rollup(self.refreshed_orders.where(~late), path)
        return append_rollup(self.refreshed_orders.where(late), path)

    def selected(self, selection: Selection = Selection()) -> DataFrame:
        return select_orders(self.orders, selection)


_open: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, folder: str) -> Workspace:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _open:
        _open[key] = Workspace(spark, folder)
    return _open[key]
