"""Streams with state against the batch operators, for several ways to split the same events into batches."""

from __future__ import annotations

import datetime
import random
import time

import pytest
from hostlake.operators import graph, rules, scores, sequence, windows
from hostlake.sources.adapter import kernel_events
from hostlake.streaming import stateful, stream
from pyspark.sql import functions as F


@pytest.fixture
def few(spark):
    """Few tasks per batch, as there are many batches."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", was)


def replayed(spark, rows, schema, folder, parts, closing):
    """Rows as files that a stream takes one by one; two more at the end, of rows far ahead, move the watermark past all others."""
    size = -(-len(rows) // parts)
    for part in [*(rows[i * size : (i + 1) * size] for i in range(parts)), *([c] for c in closing)]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)  # files are taken by time
    return stream.source(spark, folder, schema, 1)


def finished(df, name, folder):
    df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name).collect()


def sample(spark, sf, shuffle=None):
    events = kernel_events(spark, sf).withColumn("ts", F.timestamp_micros("ts_us"))
    rows = [tuple(r) for r in events.orderBy("ts_us", "event_id").collect()]
    if shuffle:
        rng = random.Random(4)
        rows = [r for _, r in sorted(((i + rng.randint(0, shuffle), r) for i, r in enumerate(rows)), key=lambda x: x[0])]
    return events, rows


def closing(events, rows):
    last = max(r[events.columns.index("ts_us")] for r in rows)
    out = []
    for i in (1, 2):
        far = last + i * 400 * 86_400 * 10**6
        values = dict(zip(events.columns, rows[0], strict=True)) | {"pid": -7, "trace_id": -7, "event_id": -i, "ts_us": far, "ts": datetime.datetime.fromtimestamp(far / 1e6)}
        out.append(tuple(values[c] for c in events.columns))
    return out


@pytest.mark.parametrize(("parts", "shuffle"), [(1, None), (4, 60)])
def test_windows_reach_over_batches(few, sf, tmp_path, parts, shuffle):
    events, rows = sample(few, sf, shuffle)
    live = replayed(few, rows, events.schema, f"{tmp_path}/e", parts, closing(events, rows)).withWatermark("ts", "30 days")
    stateful.decisions(live, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    cut = windows.tumbling_windows(events)
    want = scores.routed(graph.provenance_score(cut), scores.heuristic(graph.serialized(cut)))
    got = few.read.json(f"{tmp_path}/out/decisions")
    key = lambda r: (r.pid, r.wid, r.label, round(r.confidence, 6), r.route if "route" in r else None)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert few.read.parquet(f"{tmp_path}/out/late").count() == 0


@pytest.mark.parametrize(("parts", "shuffle"), [(1, None), (5, 60)])
def test_gate_equals_batch(few, sf, tmp_path, parts, shuffle):
    events, rows = sample(few, sf, shuffle)
    live = replayed(few, rows, events.schema, f"{tmp_path}/e", parts, closing(events, rows)).withWatermark("ts", "30 days")
    got = {r.event_id: r for r in finished(stateful.triage(live, idle=None), f"gate{parts}", tmp_path)}
    want = sequence.triage(events).collect()
    assert got.keys() - {-1, -2} == {r.event_id for r in want}
    for r in want:
        g = got[r.event_id]
        assert (g.prev, g.novel_edge, g.novel_transition, g.trigger, g.late) == (r.prev, r.novel_edge, r.novel_transition, r.trigger, False)
        assert abs(g.entropy - r.entropy) < 2e-6 and abs(g.markov_entropy - r.markov_entropy) < 2e-6


SMALL = "event_id long, ts_us long, trace_id string, pid long, ppid long, comm string, sc_type int, resource string, ts timestamp"


def small(spark, seconds, pid=1, comm="x"):
    rows = [(i, s * 10**6, "t", pid, 0, comm, 1 + i % 3, "/var/a") for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, SMALL.rpartition(",")[0]).withColumn("ts", F.timestamp_micros("ts_us"))


def test_late_rows_go_aside(few, tmp_path):
    """Each file moves the watermark (no delay) for the next; what lies behind it is late, what only comes in another order is not."""
    seconds = [100, 200, 150, 300, 50, 250, 400, 350, 500, 10]
    events = small(few, seconds)
    rows = [tuple(r) for r in events.collect()]
    live = replayed(few, rows, events.schema, f"{tmp_path}/e", 5, closing(events, rows)).withWatermark("ts", "0 seconds")
    cut = stateful.windowed(live, ("event_id", "ts_us", "sc_type"), n=2)
    stateful.split_late(cut, f"{tmp_path}/good", f"{tmp_path}/late", f"{tmp_path}/cp").awaitTermination()
    late = {r.event_id for r in few.read.parquet(f"{tmp_path}/late").collect()}
    good = few.read.parquet(f"{tmp_path}/good").where("pid = 1").collect()
    mark, want = 0, set()
    for i in range(0, len(seconds), 2):
        want |= {j for j in (i, i + 1) if seconds[j] <= mark}
        mark = max(mark, *seconds[i : i + 2])
    assert late == want and late
    order = [j for j in sorted(set(range(len(seconds))) - late, key=lambda j: seconds[j])]
    placed = {r.event_id: (r.wid, r.idx) for r in good}
    assert placed == {j: (n // 2, n % 2) for n, j in enumerate(order) if n // 2 < len(order) // 2}


def test_idle_processes_begin_anew(few, tmp_path):
    seconds = [10, 20, 30, 100_000, 100_010, 300_000]
    events = small(few, seconds)
    rows = [tuple(r) for r in events.collect()]
    other = [tuple(r) for r in small(few, [50_000, 90_000, 200_000, 290_000], pid=2).collect()]
    order = [rows[0:3], other[0:1], other[1:2], rows[3:5], other[2:3], other[3:4], rows[5:6]]
    for part in [*order, *([c] for c in closing(events, rows))]:
        few.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
        time.sleep(0.02)
    live = stream.source(few, f"{tmp_path}/e", events.schema, 1).withWatermark("ts", "0 seconds")
    got = {r.ts_us // 10**6: r for r in finished(stateful.triage(live, idle="1 hour"), "idle", tmp_path) if r.pid == 1}
    assert [got[s].prev for s in seconds] == [None, 1, 2, None, 1, None]
    # what was novel once stays known: transitions from nothing to class 1 came first at 10 s
    assert not any(r.late for r in got.values())


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_rules_equal_batch(few, tmp_path, parts):
    few.conf.set("spark.sql.shuffle.partitions", "1")
    kinds = [("nginx", 0, "/bin/bash"), ("x", 10, ""), ("x", 1, "/etc/shadow"), ("x", 7, "uid=1000->0"), ("x", 3, "1.2.3.4:80"), ("x", 1, "/var/a"), ("x", 0, "/tmp/a"), ("y", 1, "/var/b")]
    rng = random.Random(8)
    rows = [(i, 10**12 + i * 1000, "ab"[i % 2], rng.choice([1, 2, 2, 3, 10 + i // 60]), 1, *rng.choice(kinds)) for i in range(400)]
    events = few.createDataFrame(rows, SMALL.rpartition(",")[0])
    placed = windows.in_trace_order(events).drop("trace_len").withColumn("ts", F.timestamp_micros("ts_us"))
    ordered = [tuple(r) for r in placed.orderBy("ts_us").collect()]
    live = replayed(few, ordered, placed.schema, f"{tmp_path}/e", parts, [tuple({**dict(zip(placed.columns, c, strict=True)), "trace_id": "end"}.values()) for c in closing(placed, ordered)])
    got = finished(stateful.violations(live.withWatermark("ts", "1 second"), rules.default_rules(), rules.default_sequels(), True), f"rules{parts}", tmp_path)
    want = rules.violations(events).collect()
    assert sorted(map(tuple, (r for r in got if r.trace_id != "end")), key=str) == sorted(map(tuple, want), key=str)
    assert {r.axiom for r in got} == {"AX-1", "AX-2", "AX-2b", "AX-3", "AX-4", "AX-5"}


def test_forbidden_sequences_alone(few, tmp_path):
    rows = [(i, 10**12 + i * 1000, "a", 1, 1, *[("nginx", 1, ""), ("x", 0, "/bin/bash"), ("x", 1, "")][i % 5 % 3]) for i in range(90)]
    events = few.createDataFrame(rows, SMALL.rpartition(",")[0])
    placed = windows.in_trace_order(events).drop("trace_len").withColumn("ts", F.timestamp_micros("ts_us"))
    ordered = [tuple(r) for r in placed.orderBy("ts_us").collect()]
    live = replayed(few, ordered, placed.schema, f"{tmp_path}/e", 3, [])
    got = finished(stateful.violations(live.withWatermark("ts", "1 second"), rules.default_rules()[:1]), "alone", tmp_path)
    assert sorted(map(tuple, got)) == sorted(map(tuple, rules.forbidden_sequences(events, rules.default_rules()[0]).collect()))
