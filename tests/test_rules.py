from __future__ import annotations

from hostlake.operators import rules, windows
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts_us long, trace_id string, pid long, ppid long, comm string, sc_type int, resource string"


def test_trace_order_over_spans(spark):
    rows = [(i, (i * 7919) % 50 * 1_000_000, "ab"[i % 2] if i % 11 else None, i % 5, 1, "x", 1, "") for i in range(200)]
    events = spark.createDataFrame(rows, SCHEMA)
    got = {r.event_id: (r.g, r.trace_len) for r in windows.in_trace_order(events, span_us=3_000_000).collect()}
    for name in ("a", "b", None):
        own = sorted((r for r in rows if r[2] == name), key=lambda r: (r[1], r[0]))
        assert [got[r[0]] for r in own] == [(i, len(own)) for i in range(1, len(own) + 1)]


def test_all_rules_equal_each_alone(spark):
    kinds = [("nginx", 0, "/bin/bash"), ("x", 10, ""), ("x", 1, "/etc/shadow"), ("x", 7, "uid=0"), ("x", 3, "1.2.3.4:80"), ("x", 0, "/tmp/a"), ("x", 0, "/dev/shm/b"), ("x", 1, "/var/a")]
    rows = [(i, i * 1000, "t", i * i % 3, 1, *kinds[i * i * 31 // 7 % len(kinds)]) for i in range(300)]
    events = spark.createDataFrame(rows, SCHEMA)
    apart = rules.staged_execution(events)
    for rule in rules.default_rules():
        apart = apart.unionByName(rules.forbidden_sequences(events, rule))
    for rule in rules.default_sequels():
        apart = apart.unionByName(rules.sequels(events, rule))
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(rules.violations(events)) == key(apart) and apart.count() > 20
    first = rules.default_rules()[2]
    want = [(a[0], next((b[0] for b in rows if b[3] == a[3] and b[0] > a[0] and b[6] == 3), None)) for a in rows if a[6] == 7]
    want = [(a + 1, b + 1) for a, b in want if b is not None and b - a <= first.window]
    assert sorted((r.g, r.at_g) for r in rules.forbidden_sequences(events, first).select("g", F.col("at_g")).collect()) == want
