"""Structured Streaming jobs without state of their own making: source, rollups, first-seen sets, flags and the audit sink. See ``stateful`` for the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def rollup(events: DataFrame, minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """Events per interval and class; ``events`` has ``ts`` (timestamp) and ``sc_type``. Intervals close once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "sc_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "sc_type", "n")


def source(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """Events from Parquet files as they arrive, a bounded number of files per batch; nothing is dropped when batches fall behind."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(events: DataFrame, keys: tuple[str, ...] = ("comm", "sc_type"), late: str = "10 minutes") -> DataFrame:
    """The first event of each value of ``keys`` within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def flagged(events: DataFrame, verdicts: DataFrame, seconds: int = 120, late: str = "10 minutes") -> DataFrame:
    """Events of a pid, or of a child of it, within ``seconds`` after a malicious verdict on it, each once: a stream-stream
    interval join. ``verdicts``: bad_pid, bad_ts."""
    left = events.withWatermark("ts", late).withColumn("__who", F.explode(F.array_distinct(F.array("pid", "ppid"))))
    right = verdicts.withWatermark("bad_ts", late)
    on = (F.col("__who") == F.col("bad_pid")) & (F.col("ts") > F.col("bad_ts")) & (F.col("ts") <= F.col("bad_ts") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return left.join(right, on).drop("bad_pid", "bad_ts", "__who").dropDuplicatesWithinWatermark(["event_id"])


def audit_sink(audit: DataFrame, path: str, checkpoint: str):
    """A query that appends audit records as JSON and incidents beside them, once per batch: the batch id is part of the path, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        held.write.mode("overwrite").json(f"{path}/audit/batch={batch_id}")
        held.where((F.col("label") == "MALICIOUS") & (F.col("tier") >= 3)).write.mode("overwrite").json(f"{path}/incidents/batch={batch_id}")
        held.unpersist()

    return audit.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
