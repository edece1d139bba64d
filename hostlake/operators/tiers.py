"""Response tiers (0 LOG_ONLY, 1 PAUSE, 2 KILL, 3 QUARANTINE, 4 ISOLATE) and their calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlake.operators.scores import conformal_quantile

KEY = ["pid", "wid"]


def tier_of(confidence: Column, label: Column, callsite: Column | None = None, most: int = 4) -> Column:
    """The tier of a decision; benign ones get 0 unless the call-site score is 0.4 or more."""
    c = F.round(confidence, 6)
    band = F.when(c < 0.30, 0).when(c < 0.50, 1).when(c < 0.70, 2).when(c < 0.85, 3).otherwise(4)
    counts = (label == "MALICIOUS") if callsite is None else (label == "MALICIOUS") | (F.round(callsite, 6) >= 0.40)
    return F.least(F.when(counts, band).otherwise(0), F.lit(most))


def escalation_score(rows: DataFrame) -> DataFrame:
    """``escalation`` from label, confidence, hallucination_rate (null: no report), n_critical, n_edges, n_nodes and entropy."""
    signed = F.when(F.col("label") == "MALICIOUS", F.col("confidence")).otherwise(1 - F.col("confidence"))
    value = (
        0.40 * signed
        + 0.25 * signed * (1 - F.coalesce("hallucination_rate", F.lit(0.0)))
        + 0.20 * F.least(0.25 * F.col("n_critical"), F.lit(1.0))
        + 0.10 * F.least(F.col("n_edges") / F.greatest("n_nodes", F.lit(1)) / 5.0, F.lit(1.0))
        + 0.05 * F.least(F.col("entropy") / 4.0, F.lit(1.0))
    )
    return rows.withColumn("escalation", F.round(F.greatest(F.lit(0.0), F.least(value, F.lit(1.0))), 6))


def calibrated_caps(scored: DataFrame, benign_scores: DataFrame, alpha: float = 0.10) -> DataFrame:
    """``cap``: PAUSE for escalations within the conformal quantile of benign ones, ISOLATE above, LOG_ONLY without enough of them."""
    q = conformal_quantile(benign_scores, "escalation", alpha)
    both = scored.join(F.broadcast(q.select("q")))
    return both.withColumn("cap", F.when(F.col("q").isNull(), 0).when(F.col("escalation") <= F.col("q"), 1).otherwise(4)).drop("q")


def conformal_pvalues(scored: DataFrame, calibration: DataFrame, score: str = "escalation", keys: tuple[str, ...] = ("pid", "wid")) -> DataFrame:
    """``p``: (calibration scores at or above + 1) / (n + 1). Both sides meet in one running count over distinct values."""
    cal = calibration.groupBy(F.col(score).alias("v")).agg(F.count("*").alias("c"))
    asked = scored.select(F.col(score).alias("v")).distinct().withColumn("c", F.lit(0).cast("long"))
    by_value = cal.unionByName(asked).groupBy("v").agg(F.sum("c").alias("c"))
    above = by_value.withColumn("above", F.sum("c").over(Window.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)))
    n = calibration.agg(F.count("*").alias("n"))
    ps = above.join(F.broadcast(n)).select(F.col("v").alias(score), F.round((F.col("above") + 1) / (F.col("n") + 1), 6).alias("p"))
    return scored.select(*keys, score).join(ps, score)


def gates(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``cove_cap``, ``floor`` and the resulting ``tier`` with what ``capped_by`` it.

    ``rows``: label, hallucination_rate (null: no report), n_evidence, n_critical, tier0 (from confidence), cap (from calibration).
    """
    unreliable = F.coalesce(F.col("hallucination_rate") > threshold, F.lit(False))
    reported = F.col("hallucination_rate").isNotNull() & (F.col("label") == "MALICIOUS")
    out = rows.withColumn("cove_cap", F.when(reported & unreliable, 0).when(reported & (F.col("n_evidence") == 0), 1).otherwise(4))
    out = out.withColumn("floor", F.when((F.col("n_critical") > 0) & ~unreliable, 1).otherwise(0))
    first = F.least("tier0", "cove_cap")
    raised = F.greatest(first, "floor")
    last = F.least(raised, "cap")
    by = F.when(last < raised, "calibration").when(raised > first, "ltl").when(first < F.col("tier0"), "cove")
    return out.withColumn("tier", last).withColumn("capped_by", by)


def tempered(confidence: Column, t: float | Column) -> Column:
    """Confidence after dividing its log odds by a temperature."""
    p = F.least(F.greatest(confidence, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.round(1 / (1 + F.exp(-F.log(p / (1 - p)) / t)), 4)


def fitted_temperature(rows: DataFrame) -> DataFrame:
    """The temperature of 0.5, 0.6, ... 3.0 with the least calibration error (the first of equals). ``rows``: confidence, correct."""
    grid = F.explode(F.transform(F.sequence(F.lit(5), F.lit(30)), lambda i: i / 10.0)).alias("t")
    at = rows.select("confidence", "correct", grid).withColumn("c", tempered(F.col("confidence"), F.col("t")))
    bins = at.withColumn("bin", F.least(F.floor(F.round(F.col("c") * 10, 6)), F.lit(9)))
    by = bins.groupBy("t", "bin").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("acc"), F.avg("c").alias("conf"))
    total = Window.partitionBy("t")
    ece = by.withColumn("w", F.col("n") / F.sum("n").over(total)).groupBy("t").agg(F.round(F.sum(F.col("w") * F.abs(F.col("acc") - F.col("conf"))), 6).alias("ece"))
    return ece.agg(F.min(F.struct("ece", "t")).alias("m")).select("m.t", "m.ece")
