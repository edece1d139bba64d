"""The loop of flags against a replay of events one by one."""

from __future__ import annotations

import random

import pytest
from hostlake.config import Config
from hostlake.operators import flagging, joins, sequence, windows
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts_us long, pid long, ppid long, trace_id long, comm string, sc_type int, resource string"
SMALL = Config(window=3, entropy_window=6)
SECOND = 1_000_000


def replay(spark, rows, bad, seconds, n=4):
    """Triggers and malicious windows of events taken in order."""
    events = spark.createDataFrame(rows, SCHEMA)
    known = {r.event_id: r for r in sequence.gate_inputs(events, SMALL).withColumn("hard", sequence.early_trigger(F.lit(False), F.lit(False))).collect()}
    place = {r.event_id: (r.pid, r.wid) for r in windows.tumbling_windows(events, n).collect()}
    verdicts, passed, edges, transitions, count, out = [], {}, set(), set(), {}, {}
    for event_id, ts, pid, ppid, _, comm, sc, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        r = known[event_id]
        if r.hard:
            say = r.hard
        elif any(p in (pid, ppid) and t < ts <= t + seconds * SECOND for p, t in verdicts):
            say = "flagged_parent"
        elif r.filled < SMALL.window:
            say = "skip"
        else:
            edge, transition = (comm, sc) not in edges, (comm, r.prev, sc) not in transitions
            edges.add((comm, sc))
            transitions.add((comm, r.prev, sc))
            low, quiet = r.entropy < SMALL.entropy_low, r.markov_entropy < SMALL.entropy_low
            say = "novel_transition" if transition else "novel_edge" if edge else "skip" if low and quiet else "markov" if low else "entropy"
        out[event_id] = say
        if event_id in place:
            window = place[event_id]
            passed[window] = passed.get(window, False) or say != "skip"
            count[window] = count.get(window, 0) + 1
            if count[window] == n and passed[window] and window in bad:
                verdicts.append((pid, ts))
                out[window] = True
    return out


def looped(spark, rows, bad, seconds, rounds=20, n=4):
    events = spark.createDataFrame(rows, SCHEMA)
    decided = spark.createDataFrame([(p, w, "MALICIOUS") for p, w in bad] + [(99, 99, "BENIGN")], "pid long, wid long, label string")
    got = flagging.flagging_loop(events, windows.tumbling_windows(events, n), decided, seconds, rounds, SMALL).collect()
    out = {r.event_id: r.trigger for r in got}
    return out | {(r.pid, r.wid): True for r in got if r.verdict}, got[0].rounds


def quiet(pid, ppid, start, count, step=1, hard_at=None):
    """Events of one class; one may hit a hard trigger."""
    return [(pid * 1000 + i, (start + i * step) * SECOND, pid, ppid, 1, "x", 1, "/etc/shadow" if i == hard_at else "/var/a") for i in range(count)]


def test_flags_reach_descendants_and_expire(spark):
    rows = quiet(1, 0, 0, 8, hard_at=1) + quiet(2, 1, 4, 8) + quiet(3, 2, 9, 8) + quiet(4, 3, 14, 8) + quiet(5, 1, 4, 12, step=20) + quiet(6, 0, 4, 8)
    bad = {(p, w) for p in range(1, 7) for w in range(3)}
    got, rounds = looped(spark, rows, bad, 30)
    assert got == replay(spark, rows, bad, 30)
    assert rounds > 4 and sum(v == "flagged_parent" for v in got.values()) > 20
    assert "skip" in {got[k] for k in got if not isinstance(k, tuple) and k // 1000 == 5}
    assert not any(got.get((6, w)) for w in range(3))
    # a chain cut short is settled as far as the rounds go
    part, done = looped(spark, rows, bad, 30, rounds=2)
    assert done == 2 and part != got


def test_a_benign_window_ends_the_chain(spark):
    rows = quiet(1, 0, 0, 8, hard_at=1) + quiet(2, 1, 4, 8) + quiet(3, 2, 9, 8)
    bad = {(1, 0), (1, 1), (3, 0), (3, 1)}
    got, _ = looped(spark, rows, bad, 30)
    assert got == replay(spark, rows, bad, 30)
    assert not any(got.get((3, w)) for w in range(2))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_histories(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        pid = rng.randint(1, 9)
        rows.append((i, rng.randint(0, 300) * SECOND, pid, pid // 2, 1, "xy"[pid % 2], rng.choice([1, 1, 1, 1, 2]), rng.choice(["/var/a"] * 40 + ["/etc/shadow"])))
    bad = {(p, w) for p in range(1, 10) for w in range(20) if rng.random() < 0.5}
    got, _ = looped(spark, rows, bad, 20)
    assert got == replay(spark, rows, bad, 20)


def test_no_events(spark):
    events = spark.createDataFrame([], SCHEMA)
    decided = spark.createDataFrame([], "pid long, wid long, label string")
    assert flagging.flagging_loop(events, windows.tumbling_windows(events), decided).count() == 0


@pytest.mark.parametrize("hops", [1, 3, 8])
def test_ancestors_within_hops(spark, hops):
    up = {i: i // 2 for i in range(1, 200)} | {300: 301, 301: 302, 302: 300, 400: 400, 500: 0}
    flags = [(150, "a", 5), (151, "b", 4), (300, "c", 1), (400, "d", 2), (500, "e", 3), (9, "f", 0)]
    got = joins.ancestors(spark.createDataFrame(flags, "pid long, resource string, flag_order long"), spark.createDataFrame(list(up.items()), "pid long, ppid long"), hops)
    want: dict = {}
    for pid, resource, order in sorted(flags, key=lambda f: f[2]):
        at = pid
        for _ in range(hops):
            nxt = up.get(at, 0)
            if nxt in (0, at):
                break
            want.setdefault(nxt, resource)
            at = nxt
    assert {r.pid: r.resource for r in got.collect()} == want
