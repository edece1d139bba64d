"""Rollups for dashboards over events and audit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def minute(ts_us: Column, minutes: int = 1) -> Column:
    """The start of the interval that holds a time, in microseconds."""
    span = minutes * 60_000_000
    return ts_us - F.pmod(ts_us, F.lit(span))


def event_rates(events: DataFrame, minutes: int = 60) -> DataFrame:
    """Events per interval and class."""
    return events.groupBy(minute(F.col("ts_us"), minutes).alias("start_us"), "sc_type").agg(F.count("*").alias("n"))


def threat_rates(audit: DataFrame, minutes: int = 1440) -> DataFrame:
    """Malicious verdicts per interval and technique; a verdict counts once for each of its techniques."""
    bad = audit.where(F.col("label") == "MALICIOUS").withColumn("ttp", F.explode("ttps"))
    return bad.groupBy(minute(F.col("ts_us"), minutes).alias("start_us"), "ttp").agg(F.count("*").alias("n"))


def tier_usage(audit: DataFrame, minutes: int = 1440) -> DataFrame:
    return audit.groupBy(minute(F.col("ts_us"), minutes).alias("start_us"), "tier").agg(F.count("*").alias("n"))


def activity(events: DataFrame, minutes: int = 60, approximate: bool = False) -> DataFrame:
    """Active processes per interval."""
    count = F.approx_count_distinct("pid") if approximate else F.count_distinct("pid")
    return events.groupBy(minute(F.col("ts_us"), minutes).alias("start_us")).agg(count.alias("pids"), F.count("*").alias("n"))


def value_histogram(rows: DataFrame, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative buckets: rows at or below each bound; the last bucket (null) holds all."""
    wide = F.array(*(F.struct(F.lit(b).alias("upto"), (F.col(value) <= b).alias("inside")) for b in bounds), F.struct(F.lit(None).cast("double").alias("upto"), F.lit(True).alias("inside")))
    return rows.select(F.explode(wide).alias("b")).groupBy("b.upto").agg(F.count_if("b.inside").alias("n"))


def recent(audit: DataFrame, n: int = 100) -> DataFrame:
    """The latest ``n`` decisions: a top-k report."""
    return audit.orderBy(F.desc("ts_us"), F.desc("pid")).limit(n)


def status(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count("*").alias("decisions"), F.count_if(F.col("label") == "MALICIOUS").alias("malicious"), F.count_if(F.col("tier") >= 3).alias("isolated"), F.max("ts_us").alias("last_us"))
