"""Helpers that several operators share: staging of intermediate tables and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is missing (tests on one machine) a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="hostlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The copy cuts the lineage and outlives lost executors; a result that is used
    several times, or whose row order must not change between uses, goes through here.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python in batches of at most ``rows`` from now on: ten thousand long texts at once would fill a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def grouped_in_memory(spark: SparkSession, groups: int) -> None:
    """Let lists be gathered in memory for so many groups of a task from now on, instead of 128; beyond that Spark sorts."""
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    if int(spark.conf.get(name)) < groups:
        spark.conf.set(name, str(groups))
