from __future__ import annotations

import re
from collections import Counter

import pytest
from hostlake.llm import mixing
from pyspark.sql import functions as F


def fair_targets(sizes):
    """Targets by the rule itself: share, cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > 2 * sizes[s]}
        if not over:
            target |= {s: weight[s] * unit for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def check(rows, got):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter({s: 0 for _, _, s in rows})
    for _, t, s in rows:
        sizes[s] += size(t)
    target = fair_targets(sizes)
    assert sorted((r[0] or -1, r[1], r[2]) for r in got) == sorted((i or -1, size(t), sizes[s]) for i, t, s in rows)
    source = {i: s for i, _, s in rows if i is not None}
    total = Counter()
    for i, n, _, goal, taken in got:
        assert 0 <= taken <= 2 * n
        if i is not None:
            assert goal == pytest.approx(target[source[i]])
            total[source[i]] += taken
    return total, target


def run(spark, rows, block=mixing.BLOCK, extra=None):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    if extra:
        df = df.withColumn("size", F.lit("x")).withColumn("slot", F.lit(1)).withColumn("h", F.lit(2))
    return [tuple(r) for r in mixing.mixed(df, block=block).select("doc_id", "size", "source_size", "target", "taken").collect()]


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_small_mixes(spark, block):
    rows = [(i, "w " * (i * 37 % 50), f"s{i % 7}") for i in range(1, 120)] + [(500, "b " * 400, "big"), (501, None, None), (502, "x\x0by z", None), (503, "", "zero")]
    got = run(spark, rows, block, extra=True)
    total, target = check(rows, got)
    for s, goal in target.items():
        assert total[s] == int(goal + 0.5)
    assert sorted(got, key=str) == sorted(run(spark, rows, block), key=str)


def test_edges(spark):
    assert run(spark, []) == []
    assert [r[4] for r in run(spark, [(1, None, "a"), (2, "", None)])] == [0, 0]
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "d", "s"), (None, None, None)]
    assert sum(r[4] for r in run(spark, rows)) == 11  # 10.5 rounded


def test_slots_order_the_mix(spark):
    """Every word a source gives is in one slot, blocks follow their ranks, and any stretch of the mix has about the target shares."""
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), "abc"[i % 3]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    slots, known = mixing.mix_slots(docs, block=64)
    slots = slots.collect()
    got = {r.doc_id: r for r in mixing.mixed(docs, block=64).collect()}
    assert sum(r.words for r in slots) == sum(r.taken for r in got.values())
    first = {}
    for r in slots:
        first[r.source_no, r.begin] = min(first.get((r.source_no, r.begin), r.slot), r.slot)
    assert sorted(v for v in first.values()) == sorted(r.slot for r in got.values() if r.taken)
    by_rank = {}
    for r in slots:
        assert by_rank.setdefault((r.source_no, r.rank), r.slot) == r.slot
    for s in (1, 2, 3):
        ranks = [k for _, k in sorted((slot, rank) for (n, rank), slot in by_rank.items() if n == s)]
        assert ranks == sorted(ranks)
    last = max(r.slot for r in slots)
    for lo in range(0, last - 64, 64):
        part = [r for r in slots if lo <= r.slot < lo + 64]
        for s in (1, 2, 3):
            share = sum(r.words for r in slots if r.source_no == s) / sum(r.words for r in slots)
            assert abs(sum(r.words for r in part if r.source_no == s) / sum(r.words for r in part) - share) < 0.08


def test_no_plan_holds_all_steps(spark, monkeypatch):
    """The steps of a mix are queries of their own: the driver never runs the exchanges of all of them at once (34 of a mix in one plan took it over its memory)."""
    rows = [(i, "w " * (i * 37 % 50), f"s{i % 7}") for i in range(1, 120)] + [(None, "a b", None), (502, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    exchanges, write = [], mixing.staged

    def counted(df):
        exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return write(df)

    monkeypatch.setattr(mixing, "staged", counted)
    for mix in (mixing.mixed, mixing.mixture_applied):
        out = mix(docs)
        exchanges.append(out._jdf.queryExecution().executedPlan().toString().count("Exchange "))
    assert 0 < max(exchanges) <= 12, exchanges


def test_van_der_corput(spark):
    got = [r[0] for r in spark.range(64).select(mixing.van_der_corput(F.col("id"))).collect()]
    assert got == [int(f"{i:06b}"[::-1], 2) / 64 for i in range(64)]


def test_schedule_is_even(spark):
    plan = spark.createDataFrame([(1, 0, 50_000, 100_000), (2, 50_000, 70_000, 100_000), (3, 70_000, 70_000, 100_000), (4, 70_000, 100_000, 100_000)], "source_no long, lo long, hi long, total long")
    got = mixing.schedule(spark, plan, 100).orderBy("slot", "source_no").collect()
    ranks = {s: sorted(r.rank for r in got if r.source_no == s) for s in (1, 2, 4)}
    assert ranks == {1: list(range(500)), 2: list(range(200)), 4: list(range(300))}
    seen = Counter()
    for n, r in enumerate((r for r in got if r.slot < 1000), 1):
        seen[r.source_no] += 1
        assert all(abs(seen[s] - share * n) <= 8 for s, share in ((1, 0.5), (2, 0.2), (4, 0.3)))


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = [(r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in mixing.op8_mixing(spark, sf).collect()]
    total, target = check(rows, got)
    assert all(total[s] == int(g + 0.5) for s, g in target.items())
    applied = mixing.mixture_applied(docs)
    assert applied.columns == docs.columns
    times = Counter(r.doc_id for r in applied.collect())
    assert all(times[i] == (1 if not n else -(-taken // n)) for i, n, _, _, taken in got)
