"""Provenance records: JSON lines whose ``datum`` holds one record under the name of its type.

Every line is parsed once. Subjects and objects may come after the events that name them, so they are joined; of a
repeated uuid the last record counts. Malformed lines and unknown event types are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostlake.functions import constants as C

REFERENCE = "MAP<STRING, STRING>"
PROPERTIES = f"STRUCT<name: STRING, `map`: {REFERENCE}>"
RECORD = (
    f"uuid STRING, cid BIGINT, type STRING, timestampNanos BIGINT, parentSubject {REFERENCE}, subject {REFERENCE}, predicateObject {REFERENCE}, cmdLine STRUCT<`string`: STRING>, predicateObjectPath STRUCT<`string`: STRING>,"
    f" properties {PROPERTIES}, baseObject STRUCT<properties: {PROPERTIES}>, remoteAddress STRING, remotePort BIGINT, localAddress STRING, localPort BIGINT"
)
#: Event types that the older, smaller profile knows. fixed values
LITE_TYPES = {"EVENT_READ": 1, "EVENT_WRITE": 2, "EVENT_OPEN": 1, "EVENT_EXECUTE": 0, "EVENT_SENDTO": 3, "EVENT_CONNECT": 3}
FILES = ["FileObject", "UnnamedPipeObject", "RegistryKeyObject"]


def read_provenance(spark: SparkSession, path: str, profile: str = "full") -> DataFrame:
    """Events of provenance files. ``seq`` keeps the order of lines as the scan gives them."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("seq"))
    return provenance_events(lines) if profile == "full" else lite_provenance_events(lines)


def records(lines: DataFrame) -> DataFrame:
    """``seq``, ``kind`` (last part of the type's name) and the record's fields, of lines (``value``, ``seq``) that are such records."""
    parsed = F.from_json("value", f"datum MAP<STRING, STRUCT<{RECORD}>>")
    one = lines.select("seq", F.explode(F.slice(F.map_entries(parsed["datum"]), 1, 1)).alias("entry"))
    return one.select("seq", F.substring_index("entry.key", ".", -1).alias("kind"), "entry.value.*")


def _uuid(reference: str) -> Column:
    """The uuid in a reference, an object with one key that ends in UUID."""
    return F.try_element_at(F.map_values(F.map_filter(reference, lambda k, _: F.endswith(k, F.lit("UUID")))), F.lit(1))


def _given(*values: Column) -> Column:
    """The first that is neither null nor empty, else an empty text."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def _latest(rows: DataFrame, *columns: str) -> DataFrame:
    told = rows.where(F.col("uuid") != "")
    return told.groupBy("uuid").agg(F.max_by(F.struct(*columns), "seq").alias("it")).select("uuid", "it.*")


def _code(types: dict) -> Column:
    code = F
    for name, sc in types.items():
        code = code.when(F.col("type") == name, sc)
    return code


def _of(properties: str, name: str) -> Column:
    return F.try_element_at(F.col(f"{properties}.map"), F.lit(name))


OUT = ("seq", "ts_us", "pid", "ppid", "comm", "sc_type", "resource")


def provenance_events(lines: DataFrame) -> DataFrame:
    """Events with process, parent and resource; what can't be resolved is pid 0, 'unknown' or an empty resource."""
    all_ = records(lines)
    word = F.substring_index(F.try_element_at(F.split(F.trim("cmdLine.string"), r"\s+"), F.lit(1)), "/", -1)
    subjects = _latest(all_.where("kind = 'Subject'").select("seq", "uuid", F.coalesce("cid", F.lit(0)).alias("pid"), _uuid("parentSubject").alias("parent"), F.substring(_given(_of("properties", "name"), word), 1, 15).alias("name")), "pid", "parent", "name")
    base = "baseObject.properties"
    files = all_.where(F.col("kind").isin(*FILES, "PacketSocketObject")).select("seq", "uuid", _given(_of(base, "path"), _of(base, "filename")).alias("path"))
    end = lambda side: F.when((F.col(f"{side}Address") != "") & (F.col(f"{side}Port") > 0), F.concat(f"{side}Address", F.lit(":"), f"{side}Port"))
    flows = all_.where("kind = 'NetFlowObject'").select("seq", "uuid", _given(end("remote"), end("local"), F.col("remoteAddress"), F.col("localAddress")).alias("path"))
    objects = _latest(files.unionByName(flows), "path")
    acts = all_.where("kind = 'Event'").select("seq", _code(C.PROVENANCE_TYPES).alias("sc_type"), F.coalesce("timestampNanos", F.lit(0)).alias("ts_ns"), _uuid("subject").alias("subject"), _uuid("predicateObject").alias("object"), F.col("predicateObjectPath.string").alias("named"), *(_of("properties", n).alias(n) for n in ("exec", "address", "port"))).where("sc_type IS NOT NULL")
    parents = subjects.select(F.col("uuid").alias("parent"), F.col("pid").alias("ppid"))
    out = acts.join(subjects.withColumnRenamed("uuid", "subject"), "subject", "left").join(parents, "parent", "left").join(objects.withColumnRenamed("uuid", "object"), "object", "left")
    fallback = F.when((F.col("address") != "") & (F.col("port") != ""), F.concat("address", F.lit(":"), "port")).otherwise(F.coalesce("address", F.lit("")))
    resource = _given(F.col("named"), F.col("path"))
    resource = F.when((F.col("sc_type") == C.NET_CON) & (resource == ""), fallback).otherwise(resource)
    comm = F.substring(F.coalesce(F.nullif("exec", F.lit("")), F.nullif("name", F.lit("")), F.lit("unknown")), 1, 15)
    return out.select("seq", F.expr("ts_ns div 1000").alias("ts_us"), F.coalesce("pid", F.lit(0)).cast("long").alias("pid"), F.coalesce("ppid", F.lit(0)).cast("long").alias("ppid"), comm.alias("comm"), F.col("sc_type").cast("int").alias("sc_type"), resource.alias("resource"))


def lite_provenance_events(lines: DataFrame) -> DataFrame:
    """The older profile: six event types, no parents. An execution that names no path but a program renames its process from then on."""
    all_ = records(lines)
    subjects = _latest(all_.where("kind = 'Subject'").select("seq", "uuid", F.coalesce("cid", F.lit(0)).alias("pid"), F.coalesce("properties.name", F.lit("unknown")).alias("name")), "pid", "name")
    base = "baseObject.properties"
    path = F.coalesce(*(F.nullif(_of(base, n), F.lit("")) for n in ("path", "filename", "name")), F.lit("/unknown"))
    files = all_.where(F.col("kind").isin(FILES)).select("seq", "uuid", path.alias("path"))
    flows = all_.where("kind = 'NetFlowObject' AND remoteAddress <> '' AND remotePort <> 0").select("seq", "uuid", F.concat("remoteAddress", F.lit(":"), "remotePort").alias("path"))
    objects = _latest(files.unionByName(flows), "path")
    acts = all_.where("kind = 'Event'").select("seq", "type", _code(LITE_TYPES).alias("sc_type"), F.coalesce("timestampNanos", F.lit(0)).alias("ts_ns"), _uuid("subject").alias("subject"), _uuid("predicateObject").alias("object"), F.col("predicateObjectPath.string").alias("named"), _of("properties", "exec").alias("exec"), _of("properties", "address").alias("address")).where("sc_type IS NOT NULL")
    runs = F.col("type") == "EVENT_EXECUTE"
    renamed = F.when(runs & (F.coalesce("named", F.lit("")) == ""), F.nullif("exec", F.lit("")))
    met = acts.withColumn("renamed", renamed).join(subjects.withColumnRenamed("uuid", "subject"), "subject", "left").join(objects.withColumnRenamed("uuid", "object"), "object", "left")
    so_far = F.last("renamed", True).over(Window.partitionBy("subject").orderBy("seq"))
    comm = F.when(F.col("pid").isNull(), F.coalesce("renamed", F.lit("unknown"))).otherwise(F.coalesce(so_far, F.col("name")))
    resource = F.coalesce(F.when(runs, F.nullif("named", F.lit(""))), F.col("path"), F.lit(""))
    resource = F.when((F.col("type") == "EVENT_CONNECT") & (resource == ""), F.coalesce("address", F.lit(""))).otherwise(resource)
    return met.select("seq", F.expr("ts_ns div 1000").alias("ts_us"), F.coalesce("pid", F.lit(0)).cast("long").alias("pid"), F.lit(0).cast("long").alias("ppid"), F.substring(comm, 1, 15).alias("comm"), F.col("sc_type").cast("int").alias("sc_type"), resource.alias("resource"))


def file_end_windows(acts: DataFrame, attack_types: tuple[str, ...], n: int = 20, least: int = 3, share: float = 0.2) -> DataFrame:
    """One window per file: the last ``n`` events of its scenario up to the end of the file, where there are so many.

    ``acts``: ``scenario``, ``file`` (its place among the scenario's files), ``seq``, ``type``; a null type says only that the file exists.
    Returns ``scenario``, ``file``, ``attacks``, ``label`` (1: at least ``least`` attack events), ``predicted`` (1: more than ``share`` of them) and ``confidence``.

    Only the last ``n`` events of each file travel; as a file with events has at least one, those of the last ``n`` such files hold every window.
    """
    told = acts.where(F.col("type").isNotNull()).select("scenario", "file", "seq", F.col("type").isin(*attack_types).cast("int").alias("hit"))
    back = Window.partitionBy("scenario", "file").orderBy(F.desc("seq"))
    tails = told.withColumn("r", F.row_number().over(back)).where(F.col("r") <= n).groupBy("scenario", "file").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "hit"))), lambda x: x["hit"]).alias("tail"))
    files = acts.select("scenario", "file").distinct().join(tails, ["scenario", "file"], "left")
    order = Window.partitionBy("scenario").orderBy("file")
    # files without events repeat what was there before
    some = files.where(F.col("tail").isNotNull())
    last = F.flatten(F.collect_list("tail").over(order.rowsBetween(-(n - 1), 0)))
    held = some.select("scenario", "file", F.slice(last, F.greatest(F.lit(1), F.size(last) - n + 1), F.lit(n)).alias("window"))
    every = files.select("scenario", "file").join(held, ["scenario", "file"], "left").withColumn("window", F.last("window", True).over(order))
    attacks = F.aggregate("window", F.lit(0), lambda a, x: a + x)
    out = every.where(F.size("window") >= n).select("scenario", "file", attacks.alias("attacks"))
    part = F.col("attacks") / F.lit(n)
    predicted = F.when(part > share, 1).otherwise(0)
    return out.select("scenario", "file", "attacks", F.when(F.col("attacks") >= least, 1).otherwise(0).alias("label"), predicted.alias("predicted"), F.round(F.when(part > share, part).otherwise(1 - part), 6).alias("confidence"))
