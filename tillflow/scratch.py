"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; where that is unset, one beside the tables of the session's warehouse,
    which all executors share as well. The rule is the same on every master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch").rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, grouped by application so that one can be dropped."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/tillflow-{app}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where several passes need one and the same intermediate result. The table is on
    shared storage, so a lost executor costs its running tasks and not the whole lineage, and
    later passes read only the columns that they use.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder, wherever Spark can write one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession) -> None:
    """Delete what this application has settled. Results that read from it must be done; tables lie elsewhere."""
    delete(spark, new_path(spark, "x").rsplit("/", 1)[0])
