"""Operators whose keys may hold any share of the rows: the same results as the plain forms, with no task for a whole key."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hostlake.operators import evaluate, joins, scores, sequence, windows
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts_us long, pid long, ppid long, trace_id long, comm string, sc_type int, resource string"


@pytest.fixture(scope="module")
def skewed(spark):
    """One process has half of all events; many share their time."""
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 400) * 60_000_000, 1 if rng.random() < 0.5 else rng.randint(2, 12), 0, 1, rng.choice("xy"), rng.choice([1, 1, 1, 2, 3, 0]), rng.choice(["/var/a", "/etc/shadow"] if i % 50 == 0 else ["/var/a"])) for i in range(1500)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_blocks_are_bounded_and_the_gate_is_the_same(skewed):
    cut = windows.in_blocks(skewed, 65, 100)
    assert cut.groupBy("pid", "block").count().agg(F.max("count")).first()[0] <= 165
    assert cut.where("NOT halo").count() == 1500
    columns = ["event_id", "entropy", "markov_entropy", "prev", "novel_edge", "novel_transition", "trigger"]
    plain, blocks = (sorted(map(tuple, sequence.triage(skewed, block=b).select(columns).collect())) for b in (None, 100))
    assert plain == blocks


def test_windows_of_large_pids(skewed):
    columns = ["event_id", "pid", "wid", "idx"]
    got = windows.tumbling_in_blocks(skewed).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, windows.tumbling_windows(skewed).select(columns).collect()))
    assert windows.tumbling_in_blocks(skewed.limit(0)).count() == 0


def test_whole_order_without_one_partition(spark, skewed):
    placed = windows.in_whole_order(skewed, "ts_us", "event_id")
    plan = placed._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    got = sorted((r.place, r.ts_us, r.event_id) for r in placed.collect())
    assert [g[1:] for g in got] == sorted((r.ts_us, r.event_id) for r in skewed.collect()) and [g[0] for g in got] == list(range(1500))
    cut = windows.whole_windows(skewed, "event_id", n=20).groupBy("wid").count().orderBy("wid").collect()
    assert [r["count"] for r in cut] == [20] * 75
    assert windows.in_whole_order(skewed.limit(0), "ts_us").count() == 0


def test_percentiles_of_a_large_group(spark):
    rng = np.random.default_rng(5)
    values = {"big": rng.exponential(10, 5000).round(2), "small": rng.normal(size=7), "one": np.array([4.0]), None: np.array([1.0, 1.0, 2.0])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("big", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in evaluate.latency_summary(df, "v", "g").collect()}
    assert got.keys() == values.keys()
    for g, vs in values.items():
        for p in evaluate.PERCENTS:
            assert got[g][f"p{p}"] == pytest.approx(np.percentile(vs, p), abs=1e-3)
        assert got[g]["mean"] == pytest.approx(vs.mean(), abs=1e-3)
    nth = {r.g: r for r in evaluate.nth_percentiles(df, "v", "g").collect()}
    assert all(nth[g][f"p{p}"] == sorted(vs)[max(int(len(vs) * p / 100) - 1, 0)] for g, vs in values.items() for p in evaluate.PERCENTS)
    assert evaluate.latency_summary(df, "v").first()["p50"] == pytest.approx(np.percentile(np.concatenate(list(values.values())), 50), abs=1e-3)


@pytest.fixture(scope="module")
def labelled(spark, skewed):
    cut = windows.tumbling_windows(skewed, 10)
    truth = cut.groupBy("pid", "wid").agg((F.count_if(F.col("sc_type") == 3) >= 2).alias("malicious"))
    return cut.cache(), truth.cache()


def test_scores_are_out_of_fold(labelled, tmp_path):
    cut, truth = labelled
    got = scores.ngram_scores(cut, truth).cache()
    assert got.groupBy("pid").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert got.count() == truth.count() and got.select("fold").distinct().count() == 3
    again = scores.ngram_scores(cut, truth)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    # the label follows from the window's classes, so models that never saw the process know it
    rows = [(r.score, r.malicious) for r in got.join(truth, ["pid", "wid"]).collect()]
    pairs = [(a > b) + (a == b) / 2 for a, bad in rows if bad for b, good in rows if not good]
    auc = evaluate.area_under_curve(got.join(truth, ["pid", "wid"])).first().auc
    assert auc == pytest.approx(sum(pairs) / len(pairs), abs=1e-5) and auc > 0.85
    features = cut.groupBy("pid", "wid").agg(F.count_if(F.col("sc_type") == 3).cast("double").alias("a"), F.count("*").cast("double").alias("b"))
    assert evaluate.area_under_curve(scores.boosted_scores(features, truth).join(truth, ["pid", "wid"])).first().auc > 0.95
    assert {r.score for r in scores.boosted_scores(features, truth.withColumn("malicious", F.lit(False))).collect()} == {0.0}
    assert {r.score for r in scores.stored_scores(features, f"{tmp_path}/none").collect()} == {0.0}
    scores.store_boosted(features, truth, f"{tmp_path}/model")
    assert scores.stored_scores(features, f"{tmp_path}/model").select("score").distinct().count() > 1


def test_binomial_tails(spark):
    """Against sums of whole numbers, and against the normal law where n is very large."""
    small = [(k, n) for n in (1, 2, 3, 7, 30, 101, 400) for k in {0, 1, n // 3, n // 2} if k <= n // 2]
    large = [(500_000_000 - d, 10**9) for d in (0, 10_000, 60_000)]
    df = spark.createDataFrame(small + large, "k long, n long")
    got = {(r.k, r.n): r.p for r in df.withColumn("p", evaluate.binomial_tail(F.col("k"), F.col("n"))).collect()}
    for k, n in small:
        assert got[k, n] == pytest.approx(sum(math.comb(n, i) for i in range(k + 1)) / 2**n, rel=1e-9)
    for k, n in large:
        assert got[k, n] == pytest.approx(0.5 * math.erfc((n / 2 - k - 0.5) / math.sqrt(n / 2)), rel=1e-3)


def test_mean_distance_of_many_far_addresses(spark):
    """Distances of mapped addresses whose sum is beyond a long; one class lies inside throughout, another's distances are the largest there are."""
    far, near, n = 139637976727552, 4194304, 70_000
    rows = spark.range(n).selectExpr("3 AS sc_type", f"{far} + id % 100 AS ip")
    rows = rows.unionByName(spark.range(5).selectExpr("3 AS sc_type", f"{near} AS ip")).unionByName(spark.range(2).selectExpr("9 AS sc_type", f"{near} AS ip"))
    rows = rows.unionByName(spark.range(4).selectExpr("0 AS sc_type", f"{2**63 - 1} AS ip")).unionByName(spark.range(2).selectExpr("0 AS sc_type", "0L AS ip"))
    placed = joins.call_sites(rows, spark.range(1).selectExpr(f"{near}L AS addr"))
    out = scores.call_site_evaluation(placed, F.col("sc_type") == 9)
    assert dict(out.dtypes)["mean_distance"] == "bigint"
    total = sum(far + i % 100 - near for i in range(n))
    assert total > 2**63
    got = {r.sc_type: tuple(r)[1:] for r in out.collect()}
    assert got == {
        3: (False, n + 5, pytest.approx(5 / (n + 5), abs=1e-6), total // n, far + 99 - near),
        9: (True, 2, 1.0, None, None),
        0: (False, 4, 0.0, 2**63 - 1 - near, 2**63 - 1 - near),
    }
