"""The kernel_events table: derived from the driver's event stream, and the small tables that go with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: {TS_US} is the engine's way to microseconds since the epoch, {EVENTS} the events table.
KERNEL_EVENTS = """
SELECT event_id, ts_us, pid, ppid, ppid AS trace_id, CAST(1000 AS BIGINT) AS uid, comm, sc_type, value, k,
  CASE WHEN sc_type = 1 AND user_id % 5 <> 0 AND k = 5 THEN '/etc/shadow'
    WHEN sc_type = 1 AND user_id % 5 <> 0 AND k = 15 THEN '/home/u/.ssh/id_rsa'
    WHEN sc_type = 1 AND k = 25 THEN '/etc/passwd'
    WHEN sc_type = 1 AND k = 35 THEN '/proc/self/status'
    WHEN sc_type = 1 THEN concat('/usr/lib/lib', k, '.so')
    WHEN sc_type = 2 AND k = 4 THEN '/var/log/auth.log'
    WHEN sc_type = 2 AND k < 40 THEN concat('/tmp/stage', k)
    WHEN sc_type = 2 THEN concat('/var/lib/data', k)
    WHEN sc_type = 0 AND k = 6 THEN '/bin/bash'
    WHEN sc_type = 0 AND k < 30 THEN concat('/tmp/run', k)
    WHEN sc_type = 0 THEN concat('/usr/bin/tool', k)
    WHEN sc_type = 3 AND k < 20 THEN concat('185.220.101.', k, ':4444')
    WHEN sc_type = 3 AND k < 30 THEN '8.8.8.8:53'
    WHEN sc_type = 3 AND k < 60 THEN concat('10.0.0.', k, ':9000')
    WHEN sc_type = 3 THEN concat('93.184.216.', k, ':443')
    WHEN sc_type = 4 THEN '0.0.0.0:80' WHEN sc_type = 7 THEN 'uid=1000->0'
    WHEN sc_type = 8 THEN 'PROT_EXEC|PROT_WRITE' WHEN sc_type = 9 THEN 'ptrace_target_pid=1'
    WHEN sc_type = 10 THEN 'nginx' ELSE '' END AS resource,
  CASE WHEN sc_type IN (3, 9) AND k % 5 = 0 THEN 139637976727552 + k
    WHEN sc_type IN (0, 3, 9) THEN 4194304 + 16 * k ELSE 0 END AS ip
FROM (
  SELECT *, 1000 + user_id AS pid,
    CASE WHEN user_id = 0 THEN 1 ELSE 1000 + CAST(floor((user_id - 1) / 3.0) AS BIGINT) END AS ppid,
    CASE user_id % 8 WHEN 0 THEN 'nginx' WHEN 1 THEN 'sshd' WHEN 2 THEN 'bash' WHEN 3 THEN 'python3'
      WHEN 4 THEN 'postgres' WHEN 5 THEN 'worker' WHEN 6 THEN 'curl' ELSE 'vUgefal' END AS comm,
    CASE WHEN user_id % 5 = 0 THEN (CASE WHEN event_type = 'error' AND k % 10 < 2 THEN 2 ELSE 1 END)
      WHEN event_type = 'view' THEN (CASE WHEN k % 10 < 8 THEN 1 ELSE 8 END)
      WHEN event_type = 'click' THEN (CASE WHEN k % 10 < 6 THEN 2 ELSE 0 END)
      WHEN event_type = 'purchase' THEN (CASE WHEN k % 10 < 8 THEN 3 ELSE 4 END)
      WHEN event_type = 'signup' THEN (CASE WHEN k % 10 < 3 THEN 5 WHEN k % 10 < 5 THEN 6 ELSE 1 END)
      ELSE (CASE k % 10 WHEN 0 THEN 7 WHEN 1 THEN 9 WHEN 2 THEN 10 WHEN 3 THEN 15 ELSE 1 END) END AS sc_type
  FROM (SELECT event_id, {TS_US} AS ts_us, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {EVENTS}) b
) s
"""

#: Five attack intervals as (order, centre, name), twelve hours to either side. fixed values
ATTACKS = (
    (1, "2024-01-06 11:00:00", "backdoor_a"), (2, "2024-01-08 15:00:00", "mail_server"), (3, "2024-01-11 15:00:00", "backdoor_b"),
    (4, "2024-01-12 14:00:00", "backdoor_c"), (5, "2024-01-13 09:00:00", "backdoor_d"),
)


def kernel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = KERNEL_EVENTS.replace("{TS_US}", "unix_micros(CAST(ts AS TIMESTAMP))").replace("{EVENTS}", "{events}")
    return spark.sql(sql, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def attack_windows(spark: SparkSession) -> DataFrame:
    """``ord``, ``start_us``, ``end_us``, ``name``; five rows."""
    rows = spark.createDataFrame(ATTACKS, "ord int, centre string, name string")
    half = 12 * 3600 * 1_000_000
    return rows.selectExpr("ord", f"unix_micros(CAST(centre AS TIMESTAMP)) - {half} AS start_us", f"unix_micros(CAST(centre AS TIMESTAMP)) + {half} AS end_us", "name")


def threat_ips(spark: SparkSession) -> DataFrame:
    return spark.range(20).selectExpr("concat('185.220.101.', id) AS ip")


def valid_call_sites(spark: SparkSession) -> DataFrame:
    return spark.range(100).where("id % 10 <> 7").selectExpr("4194304 + 16 * id AS addr")
