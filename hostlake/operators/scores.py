"""Scores, classifications and routing of windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlake.functions import constants as C
from hostlake.functions.events import any_of, contains_any, resource_category
from hostlake.staging import staged

KEY = ["pid", "wid"]


def heuristic(texts: DataFrame) -> DataFrame:
    """Adds ``label``, ``confidence``, ``score`` and ``ttps`` from the words of a window's description."""
    t = F.lower("text")
    has = lambda *parts: contains_any(t, parts)
    times = lambda part: (F.length(t) - F.length(F.replace(t, F.lit(part), F.lit("")))) / len(part)
    h = C.HEURISTIC
    signals = (
        ("T1003", 0.55, has(*h["credential"])),
        ("T1059", 0.45, has(*h["staged"])),
        ("T1071", 0.50, has(*h["c2"])),
        ("T1210", 0.25, times("connect") >= 2),
        ("T1105", 0.45, has("openat(w)") & has("execve") & has("rtype: net")),
        ("T1068", 0.65, has("setuid")),
        ("T1055", 0.70, has("ptrace")),
        ("T1562", 0.40, has(*h["logs"])),
        ("T1041", 0.45, (times("openat(r)") >= 2) & has("connect") & has("sensitive: true")),
    )
    total = reduce(lambda a, b: a + b, [F.when(c, w).otherwise(0.0) for _, w, c in signals])
    total -= F.when(has(*h["daemons"]) & ~has(*h["undaemonlike"]), 0.30).otherwise(0.0)
    total -= F.when(has(*h["packages"]), 0.20).otherwise(0.0)
    score = F.round(F.greatest(F.lit(0.0), F.least(total, F.lit(0.99))), 6)
    bad = F.col("score") >= 0.30
    ttps = F.slice(F.array_compact(F.array(*(F.when(c, t) for t, _, c in signals))), 1, 4)
    return texts.withColumn("score", score).withColumn("label", F.when(bad, "MALICIOUS").otherwise("BENIGN")).withColumn("confidence", F.round(F.when(bad, F.col("score")).otherwise(F.least(1 - F.col("score"), F.lit(0.08))), 2)).withColumn("ttps", ttps)


def routed(scored: DataFrame, decisions: DataFrame | None = None, mode: str = "hybrid", high: float = 0.55, low: float = 0.15) -> DataFrame:
    """``label``, ``confidence`` and ``route`` of windows with a graph ``score``.

    hybrid: clear scores decide, the gray ones take the outside decision; graph_only: 0.5 decides; llm_only: outside decisions throughout.
    ``decisions``: pid, wid, label, confidence. A gray window without one stays BENIGN at 0.5. Only gray windows are joined.
    """
    s = F.round(F.col("score"), 6)
    if mode == "graph_only":
        return scored.select(*KEY, F.when(s >= 0.5, "MALICIOUS").otherwise("BENIGN").alias("label"), F.round(F.when(s >= 0.5, s).otherwise(1 - s), 4).alias("confidence"), F.lit("graph").alias("route"))
    clear = (s >= high) | (s <= low) if mode == "hybrid" else F.lit(False)
    sure = scored.where(clear).select(*KEY, F.when(s >= high, "MALICIOUS").otherwise("BENIGN").alias("label"), F.round(F.when(s >= high, s).otherwise(1 - s), 4).alias("confidence"), F.lit("graph").alias("route"))
    gray = scored.where(~clear).select(*KEY).join(decisions.select(*KEY, "label", "confidence"), KEY, "left")
    return sure.unionByName(gray.select(*KEY, F.coalesce("label", F.lit("BENIGN")).alias("label"), F.round(F.coalesce("confidence", F.lit(0.5)), 4).alias("confidence"), F.lit("model").alias("route")))


def conformal_quantile(scores: DataFrame, score: str, alpha: float = 0.10, least: int = 10) -> DataFrame:
    """One row: ``n``, the conformal order statistic ``q`` (null below ``least`` rows) and the ``bound`` on the error rate.

    k = min(ceil((n + 1)(1 - alpha)), n). The k-th smallest is found from counts per value, not by sorting rows.
    """
    by_value = scores.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("v")).agg(F.count("*").alias("c"))
    total = by_value.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    ranked = by_value.withColumn("upto", F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    k = F.least(F.ceil((F.col("n") + 1) * (1 - alpha)), F.col("n"))
    q = ranked.join(F.broadcast(total)).where(F.col("upto") >= k).agg(F.min("v").alias("q"))
    return total.join(F.broadcast(q)).select("n", F.when(F.col("n") >= least, F.col("q")).alias("q"), F.round(alpha + 1 / (F.col("n") + 1), 6).alias("bound"))


def fast_path_scores(draft: DataFrame, truth: DataFrame) -> DataFrame:
    """Confidences of drafts that said BENIGN where the truth is malicious: what a fast path must exceed."""
    return draft.join(truth.where("malicious"), KEY).where(F.col("label") == "BENIGN").select("confidence")


def dual_tier(draft: DataFrame, full: DataFrame, entropies: DataFrame, accept: Column, config_high: float = 3.8) -> DataFrame:
    """The draft's decision where the window's entropy is low, it says BENIGN and ``accept`` holds, else the full one."""
    both = draft.join(full.select(*KEY, F.col("label").alias("full_label"), F.col("confidence").alias("full_confidence")), KEY).join(entropies, KEY)
    quick = (F.col("entropy") < config_high) & (F.col("label") == "BENIGN") & accept
    return both.select(*KEY, F.when(quick, F.col("label")).otherwise(F.col("full_label")).alias("label"), F.when(quick, F.col("confidence")).otherwise(F.col("full_confidence")).alias("confidence"), F.when(quick, "draft").otherwise("full").alias("tier"))


def reduction(decided: DataFrame) -> DataFrame:
    return decided.agg(F.count_if(F.col("tier") == "draft").alias("draft"), F.count_if(F.col("tier") == "full").alias("full"), F.round(F.count_if(F.col("tier") == "draft") / F.count("*"), 6).alias("reduction"))


def tiers_by_scenario(decided: DataFrame, full: DataFrame, truth: DataFrame, names: DataFrame) -> DataFrame:
    """Per scenario: windows, how many of them the two tiers and the full model alone get right, which tier answered and the share of calls saved (percent).

    ``decided``: pid, wid, label, tier (see dual_tier); ``full``: label of the full model; ``truth``: malicious; ``names``: scenario of a window.
    """
    met = decided.join(full.select(*KEY, F.col("label").alias("full_label")), KEY).join(truth.select(*KEY, "malicious"), KEY).join(names.select(*KEY, "scenario"), KEY)
    right = lambda c: F.count_if((F.col(c) == "MALICIOUS") == F.col("malicious"))
    draft = F.count_if(F.col("tier") == "draft")
    return met.groupBy("scenario").agg(F.count("*").alias("windows"), right("label").alias("dual_correct"), right("full_label").alias("full_correct"), draft.alias("draft"), F.count_if(F.col("tier") == "full").alias("full"), F.round(100 * draft / F.count("*"), 1).alias("saved"))


def requests(texts: DataFrame, system: str = "Classify the process graph.", shots: tuple[tuple[str, str], ...] = (), gray: DataFrame | None = None) -> DataFrame:
    """Chat requests for an outside classifier, as JSON in ``messages``: the system's words, ``shots`` (a text and the answer to it) and the window's text.

    Only windows of ``gray`` (pid, wid) are asked about, if that is given: the others are decided by their graph.
    """
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    shown = [message(role, F.lit(said)) for shot in shots for role, said in zip(("user", "assistant"), shot, strict=True)]
    asked = texts if gray is None else texts.join(gray.select(*KEY), KEY, "left_semi")
    return asked.select(*KEY, F.to_json(F.array(message("system", F.lit(system)), *shown, message("user", F.col("text")))).alias("messages"))


def parsed_responses(responses: DataFrame) -> DataFrame:
    """Decisions from JSON answers: missing or malformed parts get BENIGN, 0.5 and no techniques."""
    made = F.from_json("response", "label string, confidence double, mitre_ttps array<string>")
    label = F.upper(made["label"])
    return responses.select(*KEY, F.when(label == "MALICIOUS", label).otherwise("BENIGN").alias("label"), F.when(made["confidence"].isNull(), 0.5).otherwise(F.least(F.greatest(made["confidence"], F.lit(0.0)), F.lit(1.0))).alias("confidence"), F.coalesce(made["mitre_ttps"], F.array().cast("array<string>")).alias("ttps"))


def call_site_score(windows_with_sites: DataFrame, divergence: DataFrame | None = None) -> DataFrame:
    """Per window: ``static`` (1: some captured address lies outside the known sites) and ``score``.

    ``divergence`` (pid, wid, ``ai``: how far behaviour is from what is known to be good, 0 to 1) goes into a blend of 0.4 and 0.6; a window without one counts as 0.
    An address outside keeps the score at 0.55 at least, however low the divergence.
    """
    by = windows_with_sites.groupBy(*KEY).agg(F.max(((F.col("ip") != 0) & ~F.col("inside")).cast("int")).alias("static"))
    if divergence is None:
        return by.withColumn("score", F.greatest(0.4 * F.col("static"), 0.55 * F.col("static")))
    met = by.join(divergence.select(*KEY, F.col("ai")), KEY, "left").withColumn("ai", F.coalesce("ai", F.lit(0.0)))
    return met.withColumn("score", F.round(F.greatest(0.4 * F.col("static") + 0.6 * F.col("ai"), 0.55 * F.col("static")), 6))


def behaviour_vectors(windows_with_sites: DataFrame) -> DataFrame:
    """Mean over a window's events of class, log distance to a known call site and resource category, all scaled."""
    return windows_with_sites.groupBy(*KEY).agg(
        F.round(F.avg((F.col("sc_type") % 16) / 16), 6).alias("v1"),
        F.round(F.avg(F.log(F.col("distance") + 1.0) / 30), 6).alias("v2"),
        F.round(F.avg(resource_category(F.col("sc_type"), F.col("resource")) / 8), 6).alias("v3"),
    )


def centroid_divergence(vectors: DataFrame, vector: str, inside: Column) -> DataFrame:
    """Adds ``divergence``: distance to the centroid of ``inside`` rows over the sum of the distances to both centroids."""
    at = vectors.withColumn("__in", inside).select("__in", F.posexplode(vector).alias("i", "x"))
    means = at.groupBy("__in", "i").agg(F.avg("x").alias("m")).groupBy("__in").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))
    flat = means.agg(F.max_by("c", F.col("__in").cast("int")).alias("c_in"), F.min_by("c", F.col("__in").cast("int")).alias("c_out"))
    gap = lambda c: F.sqrt(F.aggregate(F.zip_with(vector, c, lambda x, m: (x - m["m"]) * (x - m["m"])), F.lit(0.0), lambda a, b: a + b))
    both = vectors.join(F.broadcast(flat)).withColumn("__i", gap("c_in")).withColumn("__o", gap("c_out"))
    total = F.col("__i") + F.col("__o")
    return both.withColumn("divergence", F.when(total > 0, F.col("__i") / total).otherwise(0.5)).drop("c_in", "c_out", "__i", "__o")


def call_site_evaluation(events_with_sites: DataFrame, attack: Column) -> DataFrame:
    """Per class: events with an address, share inside, mean and largest distance of the others; and whether the class is an attack.

    Distances are summed as decimals: those of mapped addresses, about 1.4e14 each, pass a long at 66,000 events.
    """
    some = events_with_sites.where(F.col("ip") != 0)
    return some.groupBy("sc_type", attack.alias("attack")).agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("inside").cast("double")), 6).alias("inside_rate"),
        F.expr("sum(CAST(distance AS DECIMAL(28, 0))) FILTER (WHERE NOT inside) div count_if(NOT inside)").alias("mean_distance"), F.max(F.when(~F.col("inside"), F.col("distance"))).alias("max_distance"),
    )


def fused(rows: DataFrame) -> DataFrame:
    """``fused`` and ``fused_label`` from graph_score, callsite_score, severity, label, confidence and cove_cap (null: none)."""
    base = F.greatest("graph_score", "callsite_score")
    base = F.when(F.col("severity") >= 0.7, F.greatest(base, "severity")).otherwise(base)
    base = F.when(F.col("label") == "MALICIOUS", F.greatest(base, "confidence")).otherwise(base)
    value = F.round(F.least(base, F.coalesce("cove_cap", F.lit(1e9))), 6)
    return rows.withColumn("fused", value).withColumn("fused_label", F.when(F.col("fused") >= 0.5, "MALICIOUS").otherwise("BENIGN"))


def audit_adjusted(rows: DataFrame) -> DataFrame:
    """``adjusted`` confidence: the verified one, raised by rule violations for malicious verdicts; and ``cove_cap``."""
    raised = F.col("verified_confidence") + F.when(F.col("label") == "MALICIOUS", F.least(0.10 * F.col("n_violations"), F.lit(0.20))).otherwise(0.0)
    return rows.withColumn("adjusted", F.round(F.least(raised, F.lit(1.0)), 6)).withColumn("cove_cap", F.when(F.col("hallucination_rate") > 0.5, 0.29))


def window_rules(windows: DataFrame) -> DataFrame:
    """Pattern rules over whole windows: ``score``, ``label``, ``confidence``, ``ttps`` (first four)."""
    some = lambda c: F.bool_or(c)
    flags = {}
    for name, _, _, parts, classes in C.WINDOW_RULES:
        found = F.lit(True)
        if parts:
            found &= some(contains_any(F.col("resource"), parts))
        for c in classes:
            found &= some(F.col("sc_type") == c)
        flags[name] = found
    by = windows.groupBy(*KEY).agg(
        *(c.alias(n) for n, c in flags.items()),
        (some(contains_any(F.col("resource"), C.EXFILTRATED)) & some(F.col("sc_type") == C.NET_CON)).alias("exfiltration"),
        (F.count_distinct(F.when(F.col("sc_type") == C.NET_CON, F.col("resource"))) >= 2).alias("lateral"),
        some(contains_any(F.col("resource"), C.BENIGN_MARKERS) | contains_any(F.col("comm"), C.BENIGN_MARKERS)).alias("marked"),
    )
    scored = [(n, t, s) for n, t, s, _, _ in C.WINDOW_RULES] + [("exfiltration", "T1041", C.EXFILTRATION), ("lateral", "T1210", C.LATERAL)]
    raw = F.round(reduce(lambda a, b: a + b, [F.when(F.col(n), s).otherwise(0.0) for n, _, s in scored]), 6)
    damped = F.least(F.when(F.col("marked") & (raw < 0.5), raw * 0.3).otherwise(raw), F.lit(0.99))
    ttps = F.slice(F.array_distinct(F.array_compact(F.array(*(F.when(F.col(n), t) for n, t, _ in scored)))), 1, 4)
    out = by.withColumn("score", F.round(damped, 6)).withColumn("ttps", F.array_join(ttps, ","))
    bad = F.col("score") >= 0.30
    return out.select(*KEY, "score", F.when(bad, "MALICIOUS").otherwise("BENIGN").alias("label"), F.round(F.when(bad, F.col("score")).otherwise(F.greatest(F.lit(0.01), 1 - F.col("score"))), 4).alias("confidence"), "ttps")


def event_signatures(events: DataFrame) -> DataFrame:
    """One alert row per event and signature that fits."""
    sc, res = F.col("sc_type"), F.col("resource")
    host, port = F.substring_index("resource", ":", 1), F.when(F.contains(res, F.lit(":")), F.substring_index("resource", ":", -1)).otherwise("0")
    rules = (
        ("TRC-2", (sc == C.PTRACE) & (res != "") & (res != "PTRACE_TRACEME")),
        ("TRC-3", (sc == C.FILE_W) & F.contains(res, F.lit("/proc/")) & F.contains(res, F.lit("/mem"))),
        ("TRC-5", (sc == C.EXEC) & F.contains(res, F.lit("/."))),
        ("TRC-15", (sc == C.FILE_W) & F.contains(res, F.lit("/sys/fs/cgroup/release_agent"))),
        ("TRC-16", sc.isin(C.FILE_R, C.FILE_W) & res.isin("/dev/mem", "/proc/self/mem")),
        ("KEY-READ", (sc == C.FILE_R) & contains_any(res, C.SSH_KEYS)),
        ("C2", (sc == C.NET_CON) & (host.isin(*C.C2_HOSTS) | port.isin(*C.C2_PORTS))),
    )
    hits = F.array_compact(F.array(*(F.when(c, n) for n, c in rules)))
    return events.where(any_of([c for _, c in rules])).withColumn("rule", F.explode(hits))


def ngram_counts(windows: DataFrame) -> DataFrame:
    """Counts of single classes and of pairs in a row, per window: ``gram``, ``n``."""
    before = F.lag("sc_type").over(Window.partitionBy(*KEY).orderBy("idx"))
    paired = windows.withColumn("prev", before)
    grams = F.array_compact(F.array(F.col("sc_type").cast("string"), F.when(F.col("prev").isNotNull(), F.concat_ws(" ", F.col("prev").cast("string"), F.col("sc_type").cast("string")))))
    return paired.select(*KEY, F.explode(grams).alias("gram")).groupBy(*KEY, "gram").agg(F.count("*").alias("n"))


def _cross_fitted(rows: DataFrame, pipeline, folds: int) -> DataFrame:
    """``rows`` (with ``y``) scored by models that haven't learnt from the row's process: ``score`` and ``fold``. A fold whose others have one class only gets 0.0."""
    from pyspark.ml.functions import vector_to_array

    held = staged(rows.withColumn("fold", F.pmod(F.xxhash64("pid"), F.lit(folds)).cast("int")))
    out = None
    for fold in range(folds):
        learn, told = held.where(F.col("fold") != fold), held.where(F.col("fold") == fold)
        if learn.agg(F.count_distinct("y")).first()[0] < 2:
            part = told.withColumn("score", F.lit(0.0))
        else:
            part = pipeline(learn).fit(learn).transform(told).withColumn("score", F.round(vector_to_array("probability")[1], 6))
        part = part.select(*KEY, "score", "fold")
        out = part if out is None else out.unionByName(part)
    return out


def _gram_rows(windows: DataFrame, truth: DataFrame) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "sc_type"))), lambda e: e["sc_type"].cast("string"))
    single = windows.groupBy(*KEY).agg(ordered.alias("one"))
    pairs = F.zip_with(F.slice("one", 1, F.size("one") - 1), F.slice("one", 2, F.size("one") - 1), lambda a, b: F.concat_ws(" ", a, b))
    return single.withColumn("grams", F.concat("one", pairs)).join(truth.select(*KEY, F.col("malicious").cast("double").alias("y")), KEY)


def ngram_scores(windows: DataFrame, truth: DataFrame, folds: int = 3) -> DataFrame:
    """``score``, ``label`` and ``fold``: a balanced logistic regression over unigrams and bigrams of classes, fitted out of fold by process."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, SQLTransformer

    def pipeline(learn: DataFrame) -> Pipeline:
        share = learn.agg(F.avg("y")).first()[0]
        balance = SQLTransformer(statement=f"SELECT *, IF(y > 0, {0.5 / max(share, 1e-9)}, {0.5 / max(1 - share, 1e-9)}) AS weight FROM __THIS__")
        return Pipeline(stages=[balance, CountVectorizer(inputCol="grams", outputCol="counts", vocabSize=400), LogisticRegression(featuresCol="counts", labelCol="y", weightCol="weight", maxIter=50)])

    out = _cross_fitted(_gram_rows(windows, truth), pipeline, folds)
    return out.select(*KEY, "score", F.when(F.col("score") >= 0.5, "MALICIOUS").otherwise("BENIGN").alias("label"), "fold")


def _boosting(names: list[str]):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), GBTClassifier(labelCol="y", maxIter=10, maxDepth=4, seed=7)])


def _labelled(features: DataFrame, truth: DataFrame) -> DataFrame:
    return features.join(truth.select(*KEY, F.col("malicious").cast("double").alias("y")), KEY)


def boosted_scores(features: DataFrame, truth: DataFrame, folds: int = 3) -> DataFrame:
    """``score`` and ``fold``: boosted-tree probabilities over the window features, fitted out of fold by process."""
    names = [c for c in features.columns if c not in KEY]
    return _cross_fitted(_labelled(features, truth), lambda _: _boosting(names), folds)


def store_boosted(features: DataFrame, truth: DataFrame, path: str) -> None:
    """Fit boosted trees to all labelled windows and write the model to ``path``."""
    _boosting([c for c in features.columns if c not in KEY]).fit(_labelled(features, truth)).write().overwrite().save(path)


def stored_scores(features: DataFrame, path: str) -> DataFrame:
    """``score`` of the model at ``path``; 0.0 throughout where there is none."""
    from pyspark.errors import AnalysisException
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array
    from py4j.protocol import Py4JJavaError

    try:
        model = PipelineModel.load(path)
    except (AnalysisException, Py4JJavaError) as missing:
        if "does not exist" not in str(missing) and "PATH_NOT_FOUND" not in str(missing):
            raise
        return features.select(*KEY, F.lit(0.0).alias("score"))
    return model.transform(features).select(*KEY, F.round(vector_to_array("probability")[1], 6).alias("score"))
