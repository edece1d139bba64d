"""Checking the claims behind a decision against the events of its window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlake.functions import constants as C

KEY = ["pid", "wid"]
PATH, ADDRESS = r"/[\w./-]+", r"[\d.]+:\d+|[\w.]+:\d{2,5}"


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def claimed_resource(text: Column) -> Column:
    """The path, address or word after a keyword that a description names; empty if none."""
    words = [_nonempty(F.regexp_replace(F.regexp_extract(text, rf"(?i){w}\s+([^\s,;.]+)", 1), r"^['\"]+|['\"]+$", "")) for w in C.CLAIM_WORDS]
    return F.coalesce(_nonempty(F.regexp_extract(text, PATH, 0)), _nonempty(F.regexp_extract(text, ADDRESS, 0)), *words, F.lit(""))


def claimed_class(text: Column) -> Column:
    """The event class that the first alias found in the description hints at, or null."""
    low, out = F.lower(F.trim(text)), F
    for alias, code in C.CLAIM_CLASSES:
        out = out.when(F.contains(low, F.lit(alias)), code)
    return out.otherwise(F.lit(None).cast("int"))


def matched_claims(claims: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds ``matched_idx`` and ``matched_id`` (null if no event backs the claim) and ``verified``.

    First the earliest event whose class and resource fit (either may be unnamed; one resource contains the other), else the
    earliest whose resource contains the named one. ``claims``: pid, wid, claim_id, event_desc.
    """
    hinted = claims.withColumn("hint", F.lower(claimed_resource(F.col("event_desc")))).withColumn("hint_class", claimed_class(F.col("event_desc")))
    rows = windows.select(*KEY, "idx", F.col("event_id").alias("matched_id"), "sc_type", F.lower("resource").alias("low"))
    both = hinted.select(*KEY, "claim_id", "hint", "hint_class").join(rows, KEY)
    holds = F.contains("low", F.col("hint"))
    fits = (F.col("hint") == "") | holds | F.contains("hint", F.col("low"))
    exact = (F.col("hint_class").isNull() | (F.col("hint_class") == F.col("sc_type"))) & fits
    loose = (F.col("hint") != "") & holds
    found = both.where(exact | loose).groupBy(*KEY, "claim_id").agg(F.min(F.struct((~exact).alias("loose"), "idx", "matched_id")).alias("m"))
    out = claims.join(found, [*KEY, "claim_id"], "left")
    return out.withColumn("matched_idx", F.col("m.idx")).withColumn("matched_id", F.col("m.matched_id")).withColumn("verified", F.col("m").isNotNull()).drop("m")


def reasoning_claims(decisions: DataFrame, most: int = 8) -> DataFrame:
    """Claims from free text: its resources (the first ``most``), each with the technique at its place (the last repeats) and its share of confidence."""
    found = F.regexp_extract_all("reasoning", F.lit(r"(/[\w./\-]{3,}|\d{1,3}\.\d{1,3}\.[\d.]+:\d+|:\d{2,5})"), F.lit(1))
    named = F.regexp_extract_all("reasoning", F.lit(r"T\d{4}(?:\.\d{3})?"), F.lit(0))
    some = decisions.withColumn("__found", found).withColumn("__ttps", F.when(F.size(named) > 0, named).when(F.size("ttps") > 0, F.col("ttps")).otherwise(F.array(F.lit(""))))
    out = some.select(*KEY, "__ttps", F.size("__found").alias("n"), F.size("ttps").alias("m"), F.posexplode(F.slice("__found", 1, most)).alias("claim_id", "event_desc"))
    share = F.round((1.0 / F.greatest("m", F.lit(1))) / F.greatest("n", F.lit(1)), 4)
    return out.select(*KEY, "claim_id", "event_desc", F.element_at("__ttps", F.least(F.col("claim_id") + 1, F.size("__ttps"))).alias("supports"), share.alias("contribution"))


def evidence_report(matched: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per decision: claims, verified and unverified ones, ``hallucination_rate``, ``verified_confidence``, ``verdict`` and ``trustworthy``."""
    by = matched.groupBy(*KEY).agg(F.count("*").alias("total"), F.count_if("verified").alias("verified"), F.sum(F.when(~F.col("verified"), F.col("contribution")).otherwise(0.0)).alias("lost"))
    out = decisions.select(*KEY, "label", "confidence").join(by, KEY, "left").na.fill(0, ["total", "verified", "lost"])
    rate = (F.col("total") - F.col("verified")) / F.greatest("total", F.lit(1))
    verdict = F.when(F.col("total") == 0, "NO_CLAIMS").when(rate == 0, "CLEAN").when(rate < 0.5, "PARTIAL").otherwise("HALLUCINATED")
    kept = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.col("confidence") - F.col("lost"), 6)))
    return out.select(
        *KEY, "label", "confidence", "total", "verified", (F.col("total") - F.col("verified")).alias("unverified"), F.round(rate, 4).alias("hallucination_rate"),
        F.round(F.when(F.col("total") == 0, F.col("confidence")).otherwise(kept), 4).alias("verified_confidence"), verdict.alias("verdict"), (F.round(rate, 4) < 0.10).alias("trustworthy"),
    )


def verification_report(matched: DataFrame, report: DataFrame, threshold: float = 0.5, iterations: int = 1) -> DataFrame:
    """The label stays; confidence falls to the verified one, and to 0.29 for a malicious verdict with too many unbacked claims.

    Adds ``explainability``, the ids of the backing events and the texts that were retracted.
    """
    texts = matched.groupBy(*KEY).agg(
        F.array_join(F.array_sort(F.collect_set("matched_id")), ",").alias("evidence_ids"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("verified"), F.col("event_desc")))), ";").alias("retracted"),
    )
    capped = F.when((F.col("label") == "MALICIOUS") & (F.col("hallucination_rate") > threshold), F.least("verified_confidence", F.lit(0.29))).otherwise(F.col("verified_confidence"))
    again = (F.lit(iterations) >= 1) & (F.col("hallucination_rate") > 0) & (F.col("verified") > 0)
    return report.join(texts, KEY, "left").select(
        *KEY, "label", F.round(capped, 4).alias("final_confidence"), F.round(F.col("verified") / F.greatest("total", F.lit(1)), 4).alias("explainability"),
        F.coalesce("evidence_ids", F.lit("")).alias("evidence_ids"), F.coalesce("retracted", F.lit("")).alias("retracted"), again.cast("int").alias("iterations"), "hallucination_rate",
    )


def entity_audit(decisions: DataFrame, windows: DataFrame) -> DataFrame:
    """Every path and address in the reasoning must occur in a resource of the window (a path may end in a process name); else BENIGN at 0."""
    entities = F.array_distinct(F.concat(F.regexp_extract_all("reasoning", F.lit(r"/[\w./\-]+"), F.lit(0)), F.regexp_extract_all("reasoning", F.lit(r"\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?"), F.lit(0))))
    seen = windows.groupBy(*KEY).agg(F.collect_set("resource").alias("resources"), F.collect_set("comm").alias("comms"))
    both = decisions.withColumn("entities", entities).join(seen, KEY)
    known = lambda x: F.exists("resources", lambda r: F.contains(r, x)) | F.exists("comms", lambda c: F.startswith(x, F.lit("/")) & F.endswith(x, c))
    missing = F.filter("entities", lambda x: ~known(x))
    ok = (F.col("label") == "BENIGN") | (F.size(missing) == 0)
    return both.select(*KEY, F.when(ok, F.col("label")).otherwise("BENIGN").alias("label"), F.when(ok, F.col("confidence")).otherwise(0.0).alias("confidence"), F.size("entities").alias("entities"), F.size(missing).alias("missing"))


def explainability(report: DataFrame, summary: DataFrame) -> DataFrame:
    """Share of verified claims, halved where no rule was violated (``summary``: pid, wid, n_violations)."""
    both = report.join(summary, KEY, "left").na.fill(0, ["n_violations"])
    weight = F.when(F.col("n_violations") > 0, 1.0).otherwise(0.5)
    return both.select(*KEY, F.round(F.col("verified") / F.greatest("total", F.lit(1)) * weight, 4).alias("explainability"))


def window_claims(windows: DataFrame) -> DataFrame:
    """Three claims per window: two from its first events with a resource, and one about a file that doesn't exist."""
    first = Window.partitionBy(*KEY).orderBy("idx")
    real = windows.where(F.col("resource") != "").withColumn("claim_id", F.row_number().over(first)).where(F.col("claim_id") <= 2)
    word = F.when(F.col("sc_type") == 3, "connect").when(F.col("sc_type") == 0, "execve").when(F.col("sc_type") == 2, "openat(W)").otherwise("openat(R)")
    real = real.select(*KEY, "claim_id", F.concat_ws(" ", word, "resource").alias("event_desc"), F.lit(0.2).alias("contribution"))
    false = windows.select(*KEY).distinct().select(*KEY, F.lit(3).alias("claim_id"), F.concat(F.lit("openat(R) /nonexistent/"), "pid").alias("event_desc"), F.lit(0.3).alias("contribution"))
    return real.unionByName(false)
