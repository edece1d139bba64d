"""Joins over time intervals, ancestors and call sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostlake.operators.windows import ORDER
from hostlake.staging import staged


def attack_names(events: DataFrame, intervals: DataFrame) -> DataFrame:
    """Adds ``attack``: the name of the first interval (by ``ord``) that holds the event, or null.

    The intervals are a handful by nature; they are broadcast and rolled into one array per event.
    """
    spans = intervals.agg(F.array_sort(F.collect_list(F.struct("ord", "start_us", "end_us", "name"))).alias("__spans"))
    with_spans = events.join(F.broadcast(spans))
    hit = F.filter("__spans", lambda s: (F.col("ts_us") >= s["start_us"]) & (F.col("ts_us") <= s["end_us"]))
    return with_spans.withColumn("attack", F.try_element_at(hit, F.lit(1))["name"]).drop("__spans")


def window_truth(windows: DataFrame, intervals: DataFrame, least: int = 3) -> DataFrame:
    """Per window: ``hits`` (events inside attack intervals) and ``malicious`` (at least ``least``)."""
    hit = attack_names(windows, intervals)
    return hit.groupBy("pid", "wid").agg(F.count("attack").alias("hits")).withColumn("malicious", F.col("hits") >= least)


def annotated(events: DataFrame, ips: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    """Threat intelligence in the resource: " [C2]" if the part before the first colon is a listed address, then " [MALWARE]" if it holds a listed path."""
    listed = ips.select(F.col("ip").alias("__host"), F.lit(True).alias("__c2")).distinct()
    out = events.withColumn("__host", F.substring_index("resource", ":", 1)).join(listed, "__host", "left")
    first = F.when(F.col("__c2"), F.concat("resource", F.lit(" [C2]"))).otherwise(F.col("resource"))
    bad = F.exists(F.array(*map(F.lit, paths)), lambda p: F.contains(F.col("resource"), p))
    return out.withColumn("resource", F.when(bad, F.concat(first, F.lit(" [MALWARE]"))).otherwise(first)).drop("__host", "__c2")


def stripped(events: DataFrame) -> DataFrame:
    return events.withColumn("resource", F.regexp_replace("resource", r" ?\[(?:C2|MALWARE|PARENT_CHAIN)\]", ""))


def ancestors(flagged: DataFrame, parents: DataFrame, hops: int = 8) -> DataFrame:
    """``pid``, ``resource``: every ancestor, within ``hops``, of a flagged process, with the resource of the first such descendant.

    ``flagged``: pid, resource, ``flag_order``; ``parents``: pid, ppid (one row per pid). A walk ends at 0 or at a
    process that is its own parent. Pairs of process and ancestor double their reach with every join and are staged in between;
    a process has at most ``hops`` of them.
    """
    up = parents.where((F.col("ppid") != 0) & (F.col("ppid") != F.col("pid")))
    pairs = staged(up.select("pid", F.col("ppid").alias("ancestor"), F.lit(1).alias("far")))
    reach = 1
    while reach < hops:
        further = pairs.select(F.col("pid").alias("ancestor"), F.col("ancestor").alias("next"), F.col("far").alias("more"))
        met = pairs.join(further, "ancestor").select("pid", F.col("next").alias("ancestor"), (F.col("far") + F.col("more")).alias("far"))
        pairs = staged(pairs.unionByName(met.where(F.col("far") <= hops)).groupBy("pid", "ancestor").agg(F.min("far").alias("far")))
        reach *= 2
    return flagged.join(pairs, "pid").groupBy(F.col("ancestor").alias("pid")).agg(F.min_by("resource", "flag_order").alias("resource"))


def call_sites(events: DataFrame, sites: DataFrame, load_addr: int = 0) -> DataFrame:
    """Adds ``inside`` (address 0 passes) and ``distance`` to the nearest known site (0 when inside).

    The nearest site on either side comes from one ordered pass over addresses and sites together, cut into address pages
    so that no task sorts all of them; a page starts from the sites just outside it.
    """
    at = F.col("ip") - load_addr
    asked = events.where(F.col("ip") != 0).select(at.alias("addr")).distinct()
    bounds = sites.agg(F.min("addr").alias("lo"), F.max("addr").alias("hi"))
    both = asked.select("addr", F.lit(None).cast("long").alias("site")).unionByName(sites.select("addr", F.col("addr").alias("site")))
    page = F.floor(F.col("addr") / 65536)
    low = Window.partitionBy("page").orderBy("addr").rangeBetween(Window.unboundedPreceding, 0)
    high = Window.partitionBy("page").orderBy(F.desc("addr")).rangeBetween(Window.unboundedPreceding, 0)
    edges = sites.groupBy(page.alias("page")).agg(F.min("addr").alias("first"), F.max("addr").alias("last"))
    pages = both.select(page.alias("page")).distinct().join(edges, "page", "left")
    up, down = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("page"), F.desc("page")))
    pages = pages.select("page", F.last("last", True).over(up).alias("before"), F.last("first", True).over(down).alias("after"))
    near = both.withColumn("page", page).withColumn("a", F.max("site").over(low)).withColumn("b", F.min("site").over(high)).where(F.col("site").isNull()).join(pages, "page")
    gap = F.least(F.col("addr") - F.coalesce("a", "before"), F.coalesce("b", "after") - F.col("addr"))
    distance = near.join(F.broadcast(bounds)).select("addr", F.coalesce(gap, F.least(F.abs(F.col("addr") - F.col("lo")), F.abs(F.col("addr") - F.col("hi")))).alias("distance"))
    out = events.withColumn("addr", at).join(distance, "addr", "left")
    return out.withColumn("distance", F.when(F.col("ip") == 0, 0).otherwise(F.col("distance")).cast("long")).withColumn("inside", F.coalesce(F.col("distance") == 0, F.lit(False))).drop("addr")


def missed_resolutions(records: DataFrame, marker: str) -> DataFrame:
    """For each resolved open whose path holds ``marker``: the process's last earlier unresolved path, and whether that lacks it.

    ``records``: pid, ts_us, event_id, ``kind`` ('raw' or 'resolved'), ``path``.
    """
    before = Window.partitionBy("pid").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    seen = records.withColumn("raw_path", F.last(F.when(F.col("kind") == "raw", F.col("path")), True).over(before))
    watched = seen.where((F.col("kind") == "resolved") & F.contains("path", F.lit(marker)))
    return watched.withColumn("missed", ~F.coalesce(F.contains("raw_path", F.lit(marker)), F.lit(False)))
