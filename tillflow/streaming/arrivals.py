"""Raw files that arrive over time, cleaned row by row and appended to the warehouse table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tillflow.operators.cleaning import COPIES, fold_copies, standardize
from tillflow.operators.features import engineer_features
from tillflow.schema import RAW_HEADERS
from tillflow.sources.csv_files import RAW_ENCODING
from tillflow.sources.warehouse import TABLE, append_warehouse

KEEP_CONTENT = "30 days"


def arriving_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Raw order lines of the files in ``folder``, every column as text, with the time ``arrived`` of their file.

    Files are text in the layout of :data:`~tillflow.schema.RAW_HEADERS`; a line of another number of fields fails the
    batch. ``files_per_batch`` bounds a batch.
    """
    reader = (
        spark.readStream.schema(T.StructType([T.StructField(h, T.StringType()) for h in RAW_HEADERS]))
        .option("header", True).option("encoding", RAW_ENCODING).option("escape", '"').option("mode", "FAILFAST")
        .option("enforceSchema", False).option("columnPruning", False)
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.csv(folder)
    return lines.select(*[F.col(f"`{h}`") for h in RAW_HEADERS], F.col("_metadata.file_modification_time").alias("arrived"))


def new_content(lines: DataFrame, keep: str = KEEP_CONTENT, date_format: str = "M/d/yyyy") -> DataFrame:
    """Typed and trimmed lines whose content has not arrived within ``keep`` before; equal in all but ``row_id``.

    State is a digest of 128 bits for each line of the last ``keep``, spread over the shuffle's tasks; the watermark
    follows the arrival of files, not the dates of orders, so a line about an old order is not late.
    """
    text = lines.withColumn("arrived", F.col("arrived").cast("string"))  # steps of cleaning see text only
    typed = standardize(text, date_format).withColumn("arrived", F.col("arrived").cast("timestamp"))
    kept = [c for c in typed.columns if c != "arrived"]
    content = F.to_json(F.struct(*[c for c in kept if c != "row_id"]), {"ignoreNullFields": "false"})
    return (
        typed.withColumn("_digest", F.unhex(F.md5(content.cast("binary"))))
        .withWatermark("arrived", keep)
        .dropDuplicatesWithinWatermark(["_digest"])
        .select(*kept)
    )


def append_arrivals(
    spark: SparkSession, folder: str, checkpoint: str, table: str = TABLE, path: str | None = None, keep: str = KEEP_CONTENT,
    date_format: str = "M/d/yyyy", files_per_batch: int | None = None, check_keys: bool = True,
) -> StreamingQuery:
    """Append what has arrived in ``folder`` since the last run to the warehouse table, and stop.

    ``checkpoint`` remembers the files and the lines seen. A batch is one version of the table: it is cleaned and enriched
    as in a full refresh, and appended under the checkpoint's name and its number, so that a batch which a failure runs
    again is added once. Equal lines of one batch count once, with their smallest id.
    """
    stream = checkpoint.rstrip("/").rsplit("/", 1)[-1]

    def append(batch: DataFrame, number: int) -> None:
        enriched = engineer_features(fold_copies(batch).drop(COPIES))
        if not append_warehouse(enriched, table, check_keys, path, (stream, number)):
            batch.write.format("noop").mode("overwrite").save()  # the stream's state follows from computing the batch

    rows = new_content(arriving_lines(spark, folder, files_per_batch), keep, date_format)
    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
