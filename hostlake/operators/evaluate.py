"""Labelling, sampling and evaluation tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlake.functions.events import attack_family, workload_type
from hostlake.operators.joins import ancestors, attack_names
from hostlake.operators.windows import in_whole_order

KEY = ["pid", "wid"]


def labelled_windows(windows: DataFrame, intervals: DataFrame, attack_comms: tuple[str, ...], parents: DataFrame, least: int = 3) -> DataFrame:
    """Ground truth of windows whose resources are annotated (see joins.annotated).

    A window is an attack if ``least`` of its events fall in attack intervals and its first event's process is one of ``attack_comms``, or if it has
    a C2 or malware mark. Ancestors of processes with a C2 mark count as C2, too, where they have no mark of their own;
    ``child_resource`` is then the synthetic connection to add. ``name``: interval, else c2_detected, else malware_detected.
    """
    hit = attack_names(windows.where(F.col("pid") != 0), intervals)
    c2, bad = F.contains("resource", F.lit("[C2]")), F.contains("resource", F.lit("[MALWARE]"))
    by = hit.groupBy(*KEY).agg(
        F.count("attack").alias("hits"), F.min_by("attack", F.when(F.col("attack").isNotNull(), F.col("idx"))).alias("first_attack"), F.lower(F.min_by("comm", "idx")).alias("comm"),
        F.bool_or(c2).alias("c2"), F.bool_or(bad).alias("malware"),
    )
    flagged = windows.where(c2).groupBy("pid").agg(F.min_by("resource", F.struct("ts_us", "event_id")).alias("resource"), F.min(F.struct("ts_us", "event_id")).alias("flag_order"))
    up = ancestors(flagged, parents).select("pid", F.col("resource").alias("child_resource"))
    out = by.join(up, "pid", "left").withColumn("chained", F.col("child_resource").isNotNull() & ~F.col("c2") & ~F.col("malware"))
    out = out.withColumn("c2", F.col("c2") | F.col("chained")).withColumn("child_resource", F.when(F.col("chained"), F.concat(F.lit("child_proc→"), "child_resource", F.lit(" [C2] [PARENT_CHAIN]"))))
    timed = (F.col("hits") >= least) & F.col("comm").isin(*attack_comms)
    name = F.coalesce("first_attack", F.when(F.col("c2"), "c2_detected").when(F.col("malware"), "malware_detected").otherwise(""))
    return out.withColumn("malicious", timed | F.col("c2") | F.col("malware")).withColumn("name", F.when(F.col("malicious"), name).otherwise("")).drop("first_attack", "chained")


def stratified_sample(labelled: DataFrame, attacks: int, benign: int, hard_fraction: float = 0.0) -> DataFrame:
    """The first ``attacks`` attack windows by kind (c2, malware, others) and the first ``benign`` others, in the order of pid and window.

    With ``hard_fraction`` that share of the attacks comes from windows without a mark.
    """
    kind = F.when(F.col("name") == "c2_detected", 0).when(F.col("name") == "malware_detected", 1).otherwise(3)
    rows = labelled.withColumn("kind", kind)
    hard = int(attacks * hard_fraction)
    bad, marked = F.col("malicious"), F.col("kind") <= 2
    strata = {"benign": (~bad, benign)}
    strata |= {"easy": (bad & marked, attacks - hard), "hard": (bad & ~marked, hard)} if hard else {"attack": (bad, attacks)}
    # a limit over an order for each, which takes the first rows of every task before any meet
    parts = [rows.where(c).withColumn("stratum", F.lit(name)).orderBy("kind", "pid", "wid").limit(room) for name, (c, room) in strata.items()]
    return reduce(DataFrame.unionByName, parts).drop("kind")


def confusion(results: DataFrame, *by: str) -> DataFrame:
    """tp, fp, tn, fn and the rates over ``malicious`` (truth) and ``flagged`` (prediction), per ``by`` if given."""
    t, p = F.col("malicious"), F.col("flagged")
    counts = results.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    ratio = lambda a, b: F.round(a / F.greatest(b, F.lit(1)), 6)
    return counts.select("*", ratio(tp, tp + fn).alias("tpr"), ratio(fp, fp + tn).alias("fpr"), ratio(tp, tp + fp).alias("precision"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"))


def bootstrap_interval(results: DataFrame, resamples: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Percentile intervals of tpr, fpr, precision, f1 and accuracy over resamples of the rows, drawn with replacement.

    A resample of n rows is a multinomial draw of n over the four cells, so only the cells (one row) are resampled and the work
    doesn't grow with the rows. Each resample has its own generator, so the result is the same on any partitioning.
    """
    cells = confusion(results).select("tp", "fp", "tn", "fn")

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, *counts in batch[["id", "tp", "fp", "tn", "fn"]].itertuples(index=False):
                n = sum(counts)
                rows.append((i, *np.random.default_rng([seed, i]).multinomial(n, [c / n for c in counts] if n else [0.25] * 4)))
            yield pd.DataFrame(rows, columns=["id", "tp", "fp", "tn", "fn"])

    # one row against a fixed number of resamples
    ids = results.sparkSession.range(resamples).join(F.broadcast(cells))
    rates = with_rates(ids.mapInPandas(drawn, "id long, tp long, fp long, tn long, fn long"))
    long = rates.unpivot(["id"], ["tpr", "fpr", "precision", "f1", "accuracy"], "metric", "value")
    tail = (1 - level) / 2
    return long.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.percentile("value", tail).alias("low"), F.percentile("value", 1 - tail).alias("high"))


def reliability(results: DataFrame) -> DataFrame:
    """Ten bins of ``confidence`` against ``correct``; empty bins are there, with nulls."""
    bins = results.withColumn("bin", F.least(F.floor(F.round(F.col("confidence") * 10, 6)), F.lit(9)).cast("long"))
    by = bins.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("acc"), F.round(F.avg("confidence"), 6).alias("conf"))
    out = results.sparkSession.range(10).withColumnRenamed("id", "bin").join(by, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("gap", F.round(F.abs(F.col("acc") - F.col("conf")), 6)).withColumn("overconfident", F.col("conf") > F.col("acc"))


def calibration_error(results: DataFrame) -> DataFrame:
    bins = reliability(results)
    ece = F.round(F.sum(F.col("n") * F.coalesce("gap", F.lit(0.0))) / F.sum("n"), 6)
    sure = results.where((F.col("confidence") > 0.80) & ~F.col("correct")).agg(F.count("*").alias("sure_errors"))
    verdict = F.when(F.col("ece") < 0.05, "well calibrated").when(F.col("ece") < 0.10, "acceptable").when(F.col("ece") < 0.20, "poor").otherwise("unreliable")
    return bins.agg(ece.alias("ece")).withColumn("verdict", verdict).join(F.broadcast(sure))


def _log_gamma(x: Column) -> Column:
    """log of gamma(x) for x >= 1: Stirling's series eight further on, less the logs in between."""
    y = x + 8.0
    series = 1 / (12.0 * y) - 1 / (360.0 * F.pow(y, F.lit(3))) + 1 / (1260.0 * F.pow(y, F.lit(5))) - 1 / (1680.0 * F.pow(y, F.lit(7)))
    shifted = (y - 0.5) * F.log(y) - y + 0.5 * F.log(F.lit(2.0) * F.pi()) + series
    return shifted - reduce(lambda u, v: u + v, [F.log(x + float(j)) for j in range(8)])


def binomial_tail(k: Column, n: Column) -> Column:
    """Chance of at most ``k`` of ``n`` fair throws, k <= n / 2.

    Terms fall from the k-th down, each i / (n - i + 1) of the one above, so those more than 20 roots of n (and 60) below are nothing beside it: as many are summed, however large n is.
    """
    wide = n.cast("double")
    top = F.exp(_log_gamma(wide + 1) - _log_gamma(k + 1.0) - _log_gamma(wide - k + 1.0) - wide * F.log(F.lit(2.0)))
    steps = F.sequence(F.lit(1), F.least(k, F.ceil(20 * F.sqrt(wide)) + 60).cast("int"))
    begin = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, j: Column) -> Column:
        i = (k - j + 1).cast("double")
        term = acc["term"] * i / (wide - i + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    return top * F.when(k > 0, F.aggregate(steps, begin, add)["sum"]).otherwise(1.0)


def mcnemar(paired: DataFrame, first: str = "first_correct", second: str = "second_correct") -> DataFrame:
    """Discordant counts ``b`` and ``c`` and the exact two-sided binomial ``p`` (1 without any)."""
    counts = paired.agg(F.count_if(F.col(first) & ~F.col(second)).alias("b"), F.count_if(~F.col(first) & F.col(second)).alias("c"))
    n, k = F.col("b") + F.col("c"), F.least("b", "c")
    return counts.withColumn("p", F.round(F.when(n == 0, 1.0).otherwise(F.least(2 * binomial_tail(k, n), F.lit(1.0))), 6))


def cohens_d(rows: DataFrame, value: str, group: Column) -> DataFrame:
    """Effect size between rows where ``group`` is true and false; NaN where it is undefined."""
    by = rows.agg(*(f(F.when(c, F.col(value))).alias(n) for c, g in ((group, "a"), (~group, "b")) for f, n in ((F.avg, f"m{g}"), (F.var_samp, f"v{g}"), (F.count, f"n{g}"))))
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    ok = (F.col("na") > 1) & (F.col("nb") > 1) & (pooled > 0)
    return by.select(F.round(F.when(ok, (F.col("ma") - F.col("mb")) / pooled).otherwise(float("nan")), 6).alias("d"))


def ranked(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """``by``, ``value``, ``r`` (place of the value in its group, from 0) and ``n`` (values of the group), nulls left out.

    Places come from the order of the whole table, so a group is sorted by as many tasks as its size asks for.
    """
    placed = in_whole_order(rows.where(F.col(value).isNotNull()).select(*by, value), *by, value, out="r")
    groups = placed.groupBy(*by).agg(F.min("r").alias("__first"), F.count("*").alias("n"))
    on = F.lit(True)
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    met = placed.join(groups.select(*(F.col(c).alias(f"__{c}") for c in by), "__first", "n"), on)
    return met.select(*by, value, (F.col("r") - F.col("__first")).alias("r"), "n")


PERCENTS = (50, 95, 99)


def latency_summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, extremes, deviation and percentiles (50, 95, 99) by linear interpolation."""
    at = lambda p: (F.col("n") - 1) * (p / 100)
    low, high = lambda p: F.col("r") == F.floor(at(p)), lambda p: F.col("r") == F.ceil(at(p))
    between = lambda p: F.max(F.when(low(p), F.col(value))) * (1 - F.max(at(p) - F.floor(at(p)))) + F.max(F.when(high(p), F.col(value))) * F.max(at(p) - F.floor(at(p)))
    return ranked(rows, value, *by).groupBy(*by).agg(
        F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.stddev_samp(value), 4).alias("sd"),
        *(F.round(between(p), 4).alias(f"p{p}") for p in PERCENTS),
    )


def nth_percentiles(rows: DataFrame, value: str, by: str) -> DataFrame:
    """The other convention: the sorted values at index int(n p / 100) - 1, at least 0."""
    at = lambda p: F.greatest(F.floor(F.col("n") * p / 100), F.lit(1)) - 1
    return ranked(rows, value, by).groupBy(by).agg(*(F.max(F.when(F.col("r") == at(p), F.col(value))).alias(f"p{p}") for p in PERCENTS))


def area_under_curve(scored: DataFrame) -> DataFrame:
    """One row: ``auc`` of ``score`` (rounded to six places, so its values are bounded in number) against ``malicious``; null where one class is missing."""
    by = scored.groupBy(F.round("score", 6).alias("v")).agg(F.count_if("malicious").alias("bad"), F.count_if(~F.col("malicious")).alias("good"))
    below = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    wins = by.withColumn("under", F.coalesce(F.sum("good").over(below), F.lit(0))).agg(F.sum(F.col("bad") * (F.col("under") + F.col("good") / 2)).alias("w"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    return wins.select(F.round(F.try_divide("w", F.col("bad") * F.col("good")), 6).alias("auc"))


def entropy_sweep(results: DataFrame, thresholds: tuple[float, ...] = (1.2, 1.5, 2.0)) -> DataFrame:
    """Confusion per threshold: below it a trace is skipped and counts as benign. ``results``: malicious, flagged, max_entropy."""
    swept = results.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    skipped = F.col("max_entropy") < F.col("threshold")
    rates = confusion(swept.withColumn("flagged", F.col("flagged") & ~skipped), "threshold")
    return rates.join(swept.groupBy("threshold").agg(F.count_if(skipped).alias("skipped")), "threshold")


def error_breakdown(results: DataFrame) -> DataFrame:
    """False alarms by workload and misses by attack family. ``results``: scenario, malicious, flagged."""
    s = F.col("scenario")
    wrong = results.where(F.col("malicious") != F.col("flagged"))
    return wrong.groupBy(F.when(F.col("flagged"), "false_alarm").otherwise("miss").alias("kind"), F.when(F.col("flagged"), workload_type(s)).otherwise(attack_family(s)).alias("group")).agg(F.count("*").alias("n"))


def worst_scenarios(results: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` scenarios with the most errors: a top-k report."""
    by = results.groupBy("scenario").agg(F.count("*").alias("windows"), F.count_if(F.col("malicious") != F.col("flagged")).alias("errors"))
    return by.orderBy(F.desc("errors"), "scenario").limit(n)


def ablation(rows: DataFrame) -> DataFrame:
    """Five modes side by side: confusion and outside calls per mode.

    ``rows``: malicious, score (graph), label (outside decision), n_violations, hallucination_rate.
    """
    s, outside = F.round(F.col("score"), 6), F.col("label") == "MALICIOUS"
    gray = (s < 0.55) & (s > 0.15)
    hybrid = F.when(s >= 0.55, True).when(s <= 0.15, False).otherwise(outside)
    ruled = hybrid | (F.col("n_violations") > 0)
    modes = {
        "llm_only": (outside, F.lit(True)), "graph_only": (s >= 0.5, F.lit(False)), "hybrid": (hybrid, gray), "hybrid_ltl": (ruled, gray),
        "full": (ruled & ~(gray & (F.col("hallucination_rate") > 0.10)), gray),
    }
    each = rows.select("malicious", F.explode(F.array(*(F.struct(F.lit(n).alias("mode"), p.alias("flagged"), c.alias("called")) for n, (p, c) in modes.items()))).alias("m")).select("malicious", "m.*")
    return confusion(each, "mode").join(each.groupBy("mode").agg(F.count_if("called").alias("calls")), "mode")


def layered(rows: DataFrame) -> DataFrame:
    """Which layers find the malicious windows: outside decision, rules, call sites (0.4 or more), any; and each alone."""
    a, b, c = F.col("label") == "MALICIOUS", F.col("n_violations") > 0, F.col("callsite_score") >= 0.40
    return rows.where("malicious").agg(
        F.count("*").alias("attacks"), F.count_if(a | b | c).alias("found"), F.count_if(a & ~b & ~c).alias("model_only"), F.count_if(b & ~a & ~c).alias("rules_only"), F.count_if(c & ~a & ~b).alias("callsite_only"),
    )


def compared(results: dict[str, DataFrame], truth: DataFrame) -> DataFrame:
    """Classifiers side by side. Each table has pid, wid and label; ``truth`` has malicious."""
    long = reduce(DataFrame.unionByName, [t.select(*KEY, F.lit(n).alias("classifier"), (F.col("label") == "MALICIOUS").alias("flagged")) for n, t in results.items()])
    return confusion(long.join(truth.select(*KEY, "malicious"), KEY), "classifier")


def reconciled(expected: DataFrame, metrics: DataFrame) -> DataFrame:
    """Stated values against computed ones, after rounding. ``expected``: metric, value, digits; ``metrics``: metric, value."""
    both = expected.join(metrics.withColumnRenamed("value", "found"), "metric", "left")
    scale = F.pow(F.lit(10.0), F.col("digits"))
    same = F.floor(F.col("found") * scale + 0.5) == F.floor(F.col("value") * scale + 0.5)
    return both.select("metric", "value", "found", F.coalesce(same, F.lit(False)).alias("passed"))


def corpus_summary(traces: DataFrame) -> DataFrame:
    """Traces, processes and events by label and technique."""
    return traces.groupBy("workload", "malicious").agg(F.count("*").alias("windows"), F.count_distinct("pid").alias("processes"))
