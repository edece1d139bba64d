from __future__ import annotations

import hashlib
import json
import time

import numpy as np
from hostlake.operators import evaluate
from hostlake.sources import provenance, readers
from hostlake.sources.adapter import kernel_events
from hostlake.streaming import stream
from pyspark.sql import functions as F

LOG = """100 10:00:00.000010 getpid() = 100
100 10:00:00.000020 execve("/usr/bin/cat", ["cat", "/etc/hosts"], []) = 0
100 10:00:00.000030 openat(AT_FDCWD, "/etc/hosts", O_RDONLY) = 3 <0.000012>
100 10:00:00.000040 openat(AT_FDCWD, "/missing", O_RDONLY) = -1 ENOENT
101 10:00:00.000050 connect(3, {sa_family=AF_INET, sin_port=htons(443), sin_addr=inet_addr("1.2.3.4")}, 16) = -1
--- SIGCHLD ---
101 10:00:00.000060 connect(3, {sa_family=AF_UNIX}, 16) = 0
100 10:00:01.000000 openat(AT_FDCWD, "/tmp/x", O_WRONLY|O_CREAT, 0644) = 4
"""


def test_strace(spark, tmp_path):
    (tmp_path / "a.log").write_text(LOG)
    rows = readers.read_strace(spark, str(tmp_path / "a.log"), "start").orderBy("seq").collect()
    assert [(r.pid, r.ppid, r.comm, r.sc_type, r.resource, r.ts_us) for r in rows] == [
        (100, 99, "cat", 0, "/usr/bin/cat", 10),
        (100, 99, "cat", 1, "/etc/hosts", 20),
        (101, 100, "start", 3, "1.2.3.4:443", 40),
        (100, 99, "cat", 2, "/tmp/x", 999_990),
    ]


def test_provenance(spark):
    pre = "com.bbn.tc.schema.avro.cdm18."
    records = [
        {"datum": {pre + "Event": {"type": "EVENT_READ", "timestampNanos": 5000, "subject": {pre + "UUID": "s1"}, "predicateObject": {pre + "UUID": "f1"}}}},
        {"datum": {pre + "Subject": {"uuid": "s0", "cid": 7}}},
        {"datum": {pre + "Subject": {"uuid": "s1", "cid": 8, "parentSubject": {pre + "UUID": "s0"}, "cmdLine": {"string": "/usr/bin/vim x"}}}},
        {"datum": {pre + "FileObject": {"uuid": "f1", "baseObject": {"properties": {"map": {"filename": "/old"}}}}}},
        {"datum": {pre + "FileObject": {"uuid": "f1", "baseObject": {"properties": {"map": {"path": "/etc/passwd"}}}}}},
        {"datum": {pre + "NetFlowObject": {"uuid": "n1", "remoteAddress": "9.9.9.9", "remotePort": 80}}},
        {"datum": {pre + "Event": {"type": "EVENT_CONNECT", "timestampNanos": 6000, "subject": {pre + "UUID": "s9"}, "predicateObject": {pre + "UUID": "n1"}, "properties": {"map": {"exec": "curl"}}}}},
        {"datum": {pre + "Event": {"type": "EVENT_CONNECT", "timestampNanos": 7000, "properties": {"map": {"address": "4.4.4.4", "port": "53"}}}}},
        {"datum": {pre + "Event": {"type": "EVENT_OTHER", "timestampNanos": 8000}}},
    ]
    lines = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(99, "{bad")]
    rows = provenance.provenance_events(spark.createDataFrame(lines, "seq long, value string")).orderBy("seq").collect()
    assert [(r.ts_us, r.pid, r.ppid, r.comm, r.sc_type, r.resource) for r in rows] == [(5, 8, 7, "vim", 1, "/etc/passwd"), (6, 0, 0, "curl", 3, "9.9.9.9:80"), (7, 0, 0, "unknown", 3, "4.4.4.4:53")]


def test_call_numbers_labels_calibration_audit(spark, tmp_path):
    for name, text in (("Training_Data_Master/a.txt", "59\n3\n0\n"), ("Attack_Data_Master/webshell_1/b.txt", "42\nx\n101\n")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = readers.read_call_numbers(spark, str(tmp_path)).orderBy("pid", "ts_us").collect()
    assert [(r.pid, r.ts_us, r.sc_type, r.label) for r in rows] == [(40000, 0, 3, "MALICIOUS"), (40000, 1000, 9, "MALICIOUS"), (40001, 0, 0, "BENIGN"), (40001, 1000, 15, "BENIGN"), (40001, 2000, 1, "BENIGN")]
    assert {(r.label, r.attack_type, r.traces) for r in readers.call_number_summary(readers.read_call_numbers(spark, str(tmp_path))).collect()} == {("MALICIOUS", "webshell", 1), ("BENIGN", None, 1)}
    (tmp_path / "l.json").write_text('{"trace": "a",\n "ground_truth": "benign"}')
    assert readers.read_labels(spark, str(tmp_path / "l.json")).first().ground_truth == "benign"
    (tmp_path / "c.jsonl").write_text('{"score": 0.5, "label": "Benign"}\n{"score": "x"}\n{"score": 1, "label": "other"}\n')
    assert [tuple(r) for r in readers.read_calibration(spark, str(tmp_path / "c.jsonl")).collect()] == [(0.5, "benign")]
    assert readers.read_calibration(spark, str(tmp_path / "none.jsonl")).count() == 0
    audit = spark.createDataFrame([(1, "MALICIOUS", 4), (2, "MALICIOUS", 1), (3, "BENIGN", 0)], "pid long, label string, tier int")
    readers.write_audit(audit, str(tmp_path / "audit"), str(tmp_path / "incidents"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 3 and spark.read.json(str(tmp_path / "incidents")).count() == 1
    readers.write_audit(audit, str(tmp_path / "audit"), str(tmp_path / "incidents"), str(tmp_path / "isolated"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 6 and [r.pid for r in spark.read.json(str(tmp_path / "isolated")).collect()] == [1]
    known = spark.createDataFrame([("a", "malicious", "T1"), ("b", "malicious", "T2")], "trace string, label string, technique string")
    traces = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "trace string")
    labels = readers.labels_of(traces, readers.read_labels(spark, str(tmp_path / "l.json")), known).collect()
    assert sorted(map(tuple, labels), key=str) == [("a", "BENIGN", None), ("b", "MALICIOUS", "T2")]


def test_manifest(spark, tmp_path):
    files = {
        "good.json": {"f1": 0.5, "tpr": None, "ipg_ms": {"p50": 1.5, "x": 2}, "memory": {"mb": 3}, "cwae_ms": 7, "meta": {"backend": "trusted", "machine": "x86_64", "fallbacks": 0}},
        "bad.json": {"meta": {"backend": "mock", "system": "Darwin", "platform": "my MacBook", "fallbacks": 3, "machine": "arm"}},
        "bare.json": {"accuracy": [1, 2]},
        "list.json": [1],
    }
    for name, content in files.items():
        (tmp_path / name).write_text(json.dumps(content))
    (tmp_path / "torn.json").write_text('{"f1": ')
    (tmp_path / "log.txt").write_text("{")
    got = {r.name: r for r in readers.artifact_manifest(spark, str(tmp_path)).collect()}
    assert got["good.json"].headline == {"f1": "0.5", "tpr": "null", "ipg_ms": '{"p50":1.5,"p99":null}', "memory": '{"mb":3}'} and got["good.json"].flags == []
    assert got["bad.json"].flags == ["backend=mock", "MAC_HOST_REJECT", "MAC_PLATFORM_REJECT", "MOCK_FALLBACKS=3", "machine=arm"]
    assert [got[n].flags for n in ("bare.json", "list.json", "torn.json", "log.txt")] == [["NO META BLOCK"], ["NO META BLOCK"], [], []]
    assert got["bare.json"].headline == {"accuracy": "[1,2]"} and [n for n, r in got.items() if r.error] == ["torn.json"]
    assert got["log.txt"].sha256 == hashlib.sha256(b"{").hexdigest() and got["log.txt"].bytes == 1


def test_lite_records_and_missing_parts(spark):
    ref = "com.bbn.tc.schema.avro.cdm18."
    uuid = lambda u: {ref + "UUID": u}
    records = [
        {"datum": {ref + "Event": {"type": "EVENT_EXECUTE", "timestampNanos": 1999, "subject": uuid("s"), "properties": {"map": {"exec": "renamed"}}}}},
        {"datum": {ref + "Event": {"type": "EVENT_OPEN", "subject": uuid("s"), "predicateObject": uuid("f")}}},
        {"datum": {ref + "Event": {"type": "EVENT_EXECUTE", "subject": uuid("s"), "predicateObject": uuid("f"), "predicateObjectPath": {"string": "/bin/x"}, "properties": {"map": {"exec": "other"}}}}},
        {"datum": {ref + "Event": {"type": "EVENT_CONNECT", "subject": uuid("gone"), "properties": {"map": {"address": "9.9.9.9", "port": "1"}}}}},
        {"datum": {ref + "Event": {"type": "EVENT_FORK", "subject": uuid("s")}}},
        {"datum": {ref + "Event": {"type": "EVENT_SENDTO", "subject": None, "predicateObject": uuid("n")}}},
        {"datum": {ref + "Subject": {"uuid": "s", "cid": 5, "properties": {"name": "first"}}}},
        {"datum": {ref + "FileObject": {"uuid": "f", "baseObject": {"properties": {"map": {}}}}}},
        {"datum": {ref + "NetFlowObject": {"uuid": "n", "remoteAddress": "8.8.8.8", "remotePort": 0, "localAddress": "10.0.0.1", "localPort": 22}}},
        {"datum": {}}, {"x": 1}, [],
    ]
    lines = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, ""), (91, None), (92, "{bad")], "seq long, value string")
    lite = provenance.lite_provenance_events(lines).orderBy("seq").collect()
    assert [(r.ts_us, r.pid, r.ppid, r.comm, r.sc_type, r.resource) for r in lite] == [(1, 5, 0, "renamed", 0, ""), (0, 5, 0, "renamed", 1, "/unknown"), (0, 5, 0, "renamed", 0, "/bin/x"), (0, 0, 0, "unknown", 3, "9.9.9.9"), (0, 0, 0, "unknown", 3, "")]
    full = provenance.provenance_events(lines).orderBy("seq").collect()
    assert [(r.comm, r.sc_type, r.resource) for r in full] == [("renamed", 0, ""), ("unknown", 1, ""), ("other", 0, "/bin/x"), ("unknown", 3, "9.9.9.9:1"), ("unknown", 5, ""), ("unknown", 3, "10.0.0.1:22")]
    assert provenance.provenance_events(lines.limit(0)).count() == 0


def test_streams_equal_batch(spark, sf, tmp_path):
    events = kernel_events(spark, sf).withColumn("ts", F.timestamp_micros("ts_us"))
    events.write.parquet(f"{tmp_path}/events")
    source = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")

    def run(df, name, mode="append"):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name)

    rolled = run(stream.rollup(source), "rolled")
    whole = events.groupBy(F.window("ts", "60 minutes")["start"].alias("start"), "sc_type").agg(F.count("*").alias("n"))
    assert rolled.count() > 0 and rolled.join(whole, ["start", "sc_type", "n"], "left_anti").count() == 0
    assert run(stream.first_seen(source), "firsts").select("comm", "sc_type").distinct().count() == events.select("comm", "sc_type").distinct().count()
    audit = source.select("pid", F.lit("MALICIOUS").alias("label"), F.lit(3).alias("tier"))
    stream.audit_sink(audit, f"{tmp_path}/sink", f"{tmp_path}/sink_cp").awaitTermination()
    assert spark.read.json(f"{tmp_path}/sink/incidents").count() == events.count()


def replayed(spark, df, folder, order, parts):
    """The rows in files that a stream takes one by one, in order."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)  # files are taken by time
    return stream.source(spark, folder, df.schema, 1)


def finished(df, name, folder):
    df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name).collect()


def test_flags_reach_children(spark, tmp_path):
    events = spark.createDataFrame([(1, 5, 1, 10), (2, 6, 5, 20), (3, 7, 1, 20), (4, 5, 1, 200), (5, 5, 5, 30)], "event_id long, pid long, ppid long, s long").withColumn("ts", F.timestamp_seconds("s"))
    verdicts = spark.createDataFrame([(5, 5), (5, 8)], "bad_pid long, s long").select("bad_pid", F.timestamp_seconds("s").alias("bad_ts"))
    live = stream.flagged(replayed(spark, events, f"{tmp_path}/e", "event_id", 1), replayed(spark, verdicts, f"{tmp_path}/v", "bad_ts", 1))
    assert sorted(r.event_id for r in finished(live, "flags", tmp_path)) == [1, 2, 5]


def test_bootstrap_against_rows_drawn_one_by_one(spark):
    pairs = [(True, True)] * 6 + [(False, True)] + [(False, False)] * 30 + [(True, False)] * 3
    table = spark.createDataFrame(pairs, "malicious boolean, flagged boolean")
    got = {r.metric: r for r in evaluate.bootstrap_interval(table, 4000).collect()}
    again = {r.metric: r for r in evaluate.bootstrap_interval(table.repartition(5), 4000).collect()}
    assert got == again
    rng = np.random.default_rng(7)
    truth, said = np.array(pairs).T
    at = rng.integers(0, len(pairs), (4000, len(pairs)))
    t, p = truth[at], said[at]
    rates = {"tpr": (t & p).sum(1) / np.maximum(t.sum(1), 1), "fpr": (~t & p).sum(1) / np.maximum((~t).sum(1), 1), "accuracy": (t == p).mean(1)}
    for name, values in rates.items():
        low, high = np.percentile(values, [2.5, 97.5])
        assert abs(got[name].low - low) < 0.04 and abs(got[name].high - high) < 0.04 and abs(got[name].mean - values.mean()) < 0.01
    assert evaluate.bootstrap_interval(table.where("false")).count() == 5
