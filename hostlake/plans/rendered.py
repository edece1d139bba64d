"""The driver's events written as other formats have them, for queries over readers of those formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX = "com.bbn.tc.schema.avro.cdm18."

#: One line per process, file, flow and event; {events} are kernel events.
RECORDS = f"""
SELECT pid - 1000000000 AS seq, to_json(named_struct('datum', map('{PREFIX}Subject', named_struct('uuid', concat('s', pid), 'cid', pid, 'parentSubject', map('{PREFIX}UUID', concat('s', ppid)),
  'properties', named_struct('name', if(pid % 4 <> 0, comm, NULL), 'map', map('name', comm)))))) AS value FROM (SELECT DISTINCT pid, ppid, comm FROM {{events}})
UNION ALL SELECT -1000000, to_json(named_struct('datum', map('{PREFIX}FileObject', named_struct('uuid', concat('f', resource), 'baseObject', named_struct('properties', named_struct('map', map(if(length(resource) % 2 = 0, 'path', 'filename'), resource)))))))
  FROM (SELECT DISTINCT resource FROM {{events}} WHERE sc_type IN (0, 1, 2))
UNION ALL SELECT -1000000, to_json(named_struct('datum', map('{PREFIX}NetFlowObject', named_struct('uuid', concat('n', resource), 'remoteAddress', split_part(resource, ':', 1), 'remotePort', CAST(split_part(resource, ':', 2) AS INT)))))
  FROM (SELECT DISTINCT resource FROM {{events}} WHERE sc_type = 3)
UNION ALL SELECT event_id, to_json(named_struct('datum', map('{PREFIX}Event', named_struct('type', CASE sc_type WHEN 0 THEN 'EVENT_EXECUTE' WHEN 1 THEN if(k % 2 = 0, 'EVENT_READ', 'EVENT_OPEN') WHEN 2 THEN 'EVENT_WRITE'
    WHEN 3 THEN if(k % 2 = 0, 'EVENT_CONNECT', 'EVENT_SENDTO') WHEN 4 THEN 'EVENT_ACCEPT' WHEN 5 THEN 'EVENT_FORK' WHEN 6 THEN 'EVENT_CLONE' WHEN 7 THEN 'EVENT_CHANGE_PRINCIPAL' WHEN 8 THEN 'EVENT_MMAP' WHEN 15 THEN 'EVENT_NEW' ELSE 'EVENT_MODIFY_PROCESS' END,
  'timestampNanos', ts_us * 1000, 'subject', map('{PREFIX}UUID', if(event_id % 50 = 0, 'nobody', concat('s', pid))),
  'predicateObject', CASE WHEN sc_type < 3 THEN map('{PREFIX}UUID', concat('f', resource)) WHEN sc_type = 3 AND k % 5 <> 4 THEN map('{PREFIX}UUID', concat('n', resource)) END,
  'predicateObjectPath', CASE WHEN sc_type = 0 AND k % 3 = 0 THEN named_struct('string', concat(resource, '.run')) END,
  'properties', named_struct('map', CASE WHEN sc_type = 0 AND k % 3 = 1 THEN map('exec', concat(comm, '-by-its-own-name')) WHEN sc_type = 3 AND k % 5 = 4 THEN map('address', split_part(resource, ':', 1), 'port', split_part(resource, ':', 2)) END)))))
  FROM {{events}}
UNION ALL SELECT event_id, '[broken' FROM {{events}} WHERE event_id % 10 = 0
"""  # noqa: S608


def provenance_lines(events: DataFrame) -> DataFrame:
    """``value`` and ``seq``; some lines are broken."""
    return events.sparkSession.sql(RECORDS, events=events)


def call_number_lines(events: DataFrame) -> DataFrame:
    """``path``, ``seq``, ``value``: one call number per line and file per process."""
    number = "CASE sc_type WHEN 0 THEN '59' WHEN 1 THEN '0' WHEN 2 THEN '1' WHEN 3 THEN '42' WHEN 4 THEN '50' WHEN 5 THEN '57' WHEN 7 THEN '105' WHEN 8 THEN '9' WHEN 9 THEN '101' WHEN 10 THEN '157' ELSE 'x' END"
    kind = "CASE pid % 4 WHEN 0 THEN 'Attack_Data_Master/Web_Shell_' || pid WHEN 1 THEN 'Attack_Data_Master/Adduser_' || pid ELSE 'Training_Data_Master' END"
    return events.selectExpr(f"'/root/' || {kind} || '/' || pid || '.txt' AS path", "event_id AS seq", f"{number} AS value")


def file_acts(events: DataFrame) -> DataFrame:
    """``scenario``, ``file``, ``seq``, ``type``: a scenario per parent process, a file per quarter of a day; files of process 1 are partly empty."""
    kind = "CASE sc_type WHEN 0 THEN 'PROCESS-CREATE' WHEN 1 THEN 'FILE-READ' WHEN 2 THEN 'FILE-WRITE' WHEN 3 THEN 'NETWORK-CONNECT' WHEN 7 THEN 'PRIVILEGE-ESCALATE' ELSE 'OTHER' END"
    rows = events.selectExpr("ppid % 7 AS scenario", "ts_us div 21600000000 AS file", "event_id AS seq", f"{kind} AS type")
    return rows.unionByName(events.selectExpr("ppid % 7 AS scenario", "ts_us div 21600000000 + 1 AS file", "CAST(NULL AS BIGINT) AS seq", "CAST(NULL AS STRING) AS type").distinct())


def artifacts(events: DataFrame) -> DataFrame:
    """One result file per process: ``name``, ``content``, ``bytes``, ``modified``; some are broken, some have no meta block, some are no JSON."""
    by = events.groupBy("pid").agg(F.count("*").alias("n"))
    backend = F.when(F.col("pid") % 3 == 0, "trusted").when(F.col("pid") % 3 == 1, "unknown").otherwise("other")
    two = lambda k, a, b: F.when(F.col("pid") % k == 0, a).otherwise(b)
    meta = F.when(F.col("pid") % 7 != 0, F.struct(backend.alias("backend"), two(5, "Darwin", "Linux").alias("system"), two(10, "MacBook-1", "vm").alias("platform"), (F.col("pid") % 4).alias("fallbacks"), two(2, "x86_64", "arm64").alias("machine")))
    even = F.col("pid") % 2 == 0
    timing = F.struct(F.when(even, F.col("n")).alias("p50"), F.when(even, 2 * F.col("n")).alias("p99"), F.when(~even, F.col("n")).alias("mean"))
    text = F.to_json(F.struct(F.col("n").alias("f1"), F.expr("n div 20").alias("n_windows"), timing.alias("ipg_ms"), meta.alias("meta")))
    body = F.when(F.col("pid") % 11 == 0, F.concat(F.lit("{"), text)).otherwise(text)
    return by.select(F.concat(F.lit("run"), "pid", two(6, ".txt", ".json")).alias("name"), body.cast("binary").alias("content"), F.length(body).cast("long").alias("bytes"), F.lit("2024-01-01").cast("timestamp").alias("modified"))
