"""One query per operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlake.functions import events as E
from hostlake.functions import constants as C
from hostlake.operators import evaluate, evidence, flagging, graph, joins, rollups, rules, scores, sequence, tiers, windows
from hostlake.plans import rendered
from hostlake.sources import provenance, readers
from hostlake.sources.adapter import attack_windows, kernel_events, threat_ips, valid_call_sites
from hostlake.staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def over_events(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(kernel_events(spark, sf_dir))


def over_windows(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    over_events(name, lambda e: f(windows.tumbling_windows(e)))


over_events("s014_tumbling_windows", lambda e: windows.tumbling_windows(e).select("event_id", "pid", "wid", "idx"))
over_events("s015_windows_with_tail", lambda e: windows.tumbling_windows(e, by=("trace_id",), min_len=2).select("event_id", "trace_id", "wid", "idx"))
over_events("s016_sliding_last", lambda e: windows.sliding_last(e).select("event_id", "filled", F.array_join(F.transform("recent", lambda r: r["sc_type"].cast("string")), ",").alias("recent")))
over_events("s017_last_per_trace", lambda e: windows.last_per_trace(e).select("event_id", "trace_id"))
over_events("s018_stitched_parents", lambda e: windows.stitch_parents(windows.tumbling_windows(e), e).select("pid", "wid", "idx", "event_id", "from_parent"))
over_events("s019_drop_unresolved", lambda e: windows.drop_unresolved(e).select("event_id"))
over_events("s020_sliding_max_entropy", sequence.sliding_max_entropy)
over_events("s021_rtype", lambda e: e.groupBy(E.rtype(F.col("sc_type")).alias("rtype"), "sc_type").agg(F.count("*").alias("n")))
over_events("s022_syscall_label", lambda e: e.groupBy(E.syscall_label(F.col("sc_type")).alias("label"), "sc_type").agg(F.count("*").alias("n")))
over_events("s023_external_routable", lambda e: e.groupBy("resource").agg(F.count("*").alias("n")).withColumn("external", E.is_external_routable(F.col("resource"))))
over_events("s024_sensitive", lambda e: e.where(E.is_sensitive(F.col("resource"))).select("event_id"))
over_events("s025_hard_trigger", lambda e: e.where(E.is_hard_trigger(F.col("resource"), F.col("sc_type"))).select("event_id", (F.col("sc_type") == 10).alias("renamed")))
over_events("s026_semantic", lambda e: e.select("event_id", E.semantic(F.col("sc_type"), F.col("resource")).alias("s")).select("event_id", "s.label", F.array_join("s.ttps", ",").alias("ttps"), "s.risk", "s.benign"))
over_events("s027_semantic_compact", lambda e: e.groupBy(E.semantic_compact(E.semantic(F.col("sc_type"), F.col("resource"))).alias("line")).agg(F.count("*").alias("n")))
over_events("s028_resource_category", lambda e: e.select("event_id", E.resource_category(F.col("sc_type"), F.col("resource")).alias("category")))
over_events("s029_ip_region", lambda e: e.groupBy("ip").agg(F.count("*").alias("n")).withColumn("region", E.ip_region(F.col("ip"), 4194304, 1000)))
over_events(
    "s030_predicates",
    lambda e: e.select(
        "event_id", E.comm_is("nginx").alias("is_nginx"), E.comm_matches("py|ba").alias("script"), E.execve("/bin/").alias("exec_bin"), E.file_read("/etc/").alias("reads_etc"), E.file_write("/tmp/").alias("writes_tmp"),
        E.connects().alias("connects"), E.setuid_to_root().alias("to_root"), E.prctl_rename().alias("renames"), E.suspicious_shadow_read().alias("shadow"),
    ),
)


def scenario() -> Column:
    """A scenario name per process, for operators that read such names."""
    pid = F.col("pid")
    return (
        F.when(pid % 4 == 0, F.concat(F.lit("attack_T10"), 10 + pid % 7, F.lit("_x")))
        .when(pid % 4 == 1, F.concat(F.lit("benign_ext_"), "comm"))
        .when(pid % 4 == 2, F.concat(F.lit("benign_"), "comm", F.lit("_"), "pid"))
        .otherwise(F.col("comm"))
    )


over_events("s031_workload", lambda e: e.select(scenario().alias("scenario")).distinct().select("scenario", E.workload_type(F.col("scenario")).alias("workload"), E.attack_family(F.col("scenario")).alias("family")))
over_events("s032_marginal_entropy", lambda e: sequence.marginal_entropy(e).select("event_id", "entropy"))
over_events("s033_markov_entropy", lambda e: sequence.markov_entropy(e).select("event_id", "markov_entropy"))
over_events("s034_bigrams", sequence.bigram_table)
over_events("s035_first_seen", lambda e: sequence.first_seen(e, ["comm", "sc_type"], "novel_edge").select("event_id", "novel_edge"))
over_events("s036_triage", lambda e: sequence.triage(e).select("event_id", "entropy", "markov_entropy", "novel_edge", "novel_transition", "trigger"))
over_events("s037_gate_stats", lambda e: sequence.gate_stats(sequence.triage(e)))
over_events("s038_flagged_lineage", lambda e: sequence.flagged_lineage(e, e.where(F.col("sc_type") == 9).select("pid", "ts_us"), 7200).select("event_id"))
over_events("s039_lineage", sequence.lineage)
over_events("s040_parent_map", sequence.parent_map)
over_windows("s041_structural_entropy", lambda w: graph.structural_entropy(graph.edges(w)))
over_windows("s042_nodes", graph.nodes)
over_windows("s043_edges", lambda w: graph.edges(w).drop("semantic", "external", "src_idx", "pair_idx"))
over_windows("s044_edge_hints", lambda w: graph.edges(w).groupBy("semantic").agg(F.count("*").alias("n")))
over_windows("s045_meta", graph.meta)
over_windows("s046_serialized", graph.serialized)
over_windows("s046b_serialized_arrows", graph.serialized_arrows)
over_windows("s047_tls_edges", lambda w: graph.tls_edges(w, w.where(F.col("sc_type") == 3).select("pid", "wid", "comm", F.concat(F.lit("intent "), "resource").alias("payload")).distinct()).drop("dst_rtype", "label", "sensitive"))
over_windows("s048_fingerprints", lambda w: graph.fingerprints(graph.edges(w)).groupBy("fingerprint").agg(F.count("*").alias("windows")))
over_windows("s049_features", graph.features)
over_windows("s050_compression", graph.compression)
over_windows("s052_insights", lambda w: graph.insights(graph.serialized(w)).withColumn("insights", F.array_join("insights", ";")))
over_windows("s053_window_semantics", graph.window_semantics)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored windows with their true label: the flagship."""
    w = windows.tumbling_windows(kernel_events(spark, sf_dir))
    found = graph.provenance_score(w)
    return found.join(joins.window_truth(w, attack_windows(spark)), graph.KEY)


QUERIES["s051_label_matrix"] = lambda spark, sf_dir: graph.label_matrix(scored(spark, sf_dir).drop("malicious"), scored(spark, sf_dir).select("pid", "wid", "malicious"))
QUERIES["s075_provenance_score"] = lambda spark, sf_dir: scored(spark, sf_dir).select("pid", "wid", "score")


def simple(e: DataFrame) -> DataFrame:
    found = [rules.forbidden_sequences(e, r) for r in rules.default_rules()]
    return found[0].unionByName(found[1]).unionByName(found[2])


over_events("s069_runtime_monitor", simple)
over_events("s070_default_axioms", lambda e: simple(e).groupBy("axiom").agg(F.count("*").alias("n")))
over_events("s071_staged_execution", rules.staged_execution)
over_events("s072_sequels", lambda e: rules.sequels(e, rules.default_sequels()[0]).unionByName(rules.sequels(e, rules.default_sequels()[1])))
over_events("s073_unfollowed_reads", lambda e: rules.sequels(e, rules.Sequel("x", "MEDIUM", E.suspicious_shadow_read(), E.connects(), 0, False)).select("trace_id", "pid", "g"))
over_events("s074_violation_summary", lambda e: rules.violation_summary(rules.violations(e)))
over_events("s074b_violations_by_rule", lambda e: rules.violations_by_rule(rules.violations(e), e))


# scores, evidence, tiers and evaluation share one chain: windows, graph, score, decision


def kept(make: Callable) -> Callable:
    """A table of the chain that is staged when it is first asked for, so that what is derived from it doesn't compute it again."""

    def get(self: Chain) -> DataFrame:
        if make.__name__ not in self.tables:
            self.tables[make.__name__] = staged(make(self))
        return self.tables[make.__name__]

    return get


class Chain:
    """Tables over one sf_dir that several queries use."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.events = kernel_events(spark, sf_dir)

    @property
    @kept
    def windows(self) -> DataFrame:
        return windows.tumbling_windows(self.events)

    @property
    def sites(self) -> DataFrame:
        return joins.call_sites(self.windows, valid_call_sites(self.spark))

    @kept
    def scored(self) -> DataFrame:
        return graph.provenance_score(self.windows)

    @kept
    def texts(self) -> DataFrame:
        return graph.serialized(self.windows)

    def full(self) -> DataFrame:
        return scores.heuristic(self.texts())

    def draft(self) -> DataFrame:
        """The heuristic with its confidence disturbed a little per process."""
        return self.full().select("pid", "wid", "label", F.round(F.greatest(F.lit(0.0), 1 - F.col("score") - (F.col("pid") % 7) / 100.0), 6).alias("confidence"))

    def truth(self) -> DataFrame:
        return joins.window_truth(self.windows, attack_windows(self.spark))

    def routed(self) -> DataFrame:
        return scores.routed(self.scored(), self.full())

    def looped(self) -> DataFrame:
        return flagging.flagging_loop(self.events, self.windows, self.routed(), 7200)

    def decided(self) -> DataFrame:
        """Windows with truth, prediction, confidence and whether it is correct."""
        both = self.routed().join(self.truth(), graph.KEY).withColumn("flagged", F.col("label") == "MALICIOUS")
        return both.withColumn("correct", F.col("flagged") == F.col("malicious"))

    @kept
    def matched(self) -> DataFrame:
        return evidence.matched_claims(evidence.window_claims(self.windows), self.windows)

    def report(self) -> DataFrame:
        return evidence.evidence_report(self.matched(), self.routed())

    @kept
    def hits(self) -> DataFrame:
        """Rule violations of the window that holds the trigger."""
        found = rules.violations(self.events).select("pid", "g", "severity", "trace_id")
        at = windows.in_trace_order(self.windows.select("*")).select("pid", "wid", "event_id")
        placed = windows.in_trace_order(self.events).select("trace_id", "g", "event_id").join(found, ["trace_id", "g"])
        return at.join(placed.drop("pid"), "event_id").groupBy("pid", "wid").agg(F.count("*").alias("n_violations"), F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"), F.max(F.when(F.col("severity") == "CRITICAL", 0.95).when(F.col("severity") == "HIGH", 0.85).otherwise(0.65)).alias("severity"))

    @kept
    def facts(self) -> DataFrame:
        """Everything that tiers are computed from, one row per window."""
        out = self.report().join(self.scored().select("pid", "wid", "n_nodes", "n_edges", F.col("score").alias("graph_score")), graph.KEY)
        out = out.join(self.hits(), graph.KEY, "left").na.fill(0, ["n_violations", "n_critical", "severity"])
        out = out.join(scores.call_site_score(self.sites).select("pid", "wid", F.col("score").alias("callsite_score")), graph.KEY)
        last = sequence.marginal_entropy(self.events).select("event_id", "entropy")
        ends = self.windows.where(F.col("idx") == 19).select("pid", "wid", "event_id", "ts_us").join(last, "event_id").drop("event_id")
        return tiers.escalation_score(out.join(ends, graph.KEY)).withColumn("n_evidence", F.col("verified"))

    def audit(self) -> DataFrame:
        """Decision records with tier and techniques."""
        said = self.full().select("pid", "wid", "ttps")
        return self.facts().withColumn("tier", tiers.tier_of(F.col("confidence"), F.col("label"), F.col("callsite_score"))).join(said, graph.KEY)


def over_chain(name: str, f: Callable[[Chain], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(Chain(spark, sf_dir))


over_events("s004_annotate_ti", lambda e: joins.annotated(e, threat_ips(e.sparkSession), C.MALWARE_PATHS).groupBy("resource").agg(F.count("*").alias("n")))
over_events("s005_strip_annotations", lambda e: joins.stripped(joins.annotated(e, threat_ips(e.sparkSession), C.MALWARE_PATHS)).groupBy("resource").agg(F.count("*").alias("n")))
over_chain("s055_attack_intervals", lambda c: c.truth())
over_events("s056_ancestors", lambda e: joins.ancestors(e.where(F.col("sc_type") == 9).groupBy("pid").agg(F.min_by("event_id", F.struct("ts_us", "event_id")).cast("string").alias("resource"), F.min(F.struct("ts_us", "event_id")).alias("flag_order")), sequence.parent_map(e, 0)))
over_events("s057_call_sites", lambda e: joins.call_sites(e, valid_call_sites(e.sparkSession)).select("event_id", "inside", "distance"))
over_chain("s058_claim_matches", lambda c: c.matched().select("pid", "wid", "claim_id", "matched_idx"))
over_chain("s059_label_join", lambda c: c.scored().join(c.truth(), graph.KEY).groupBy("malicious").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score")))
over_chain("s060_skipped_anti_join", lambda c: c.events.join(sequence.triage(c.events).where(F.col("trigger") != "skip"), "event_id", "left_anti").groupBy("comm").agg(F.count("*").alias("skipped")))
over_events("s061_missed_resolutions", lambda e: joins.missed_resolutions(e.where(F.col("sc_type").isin(1, 2)).select("pid", "ts_us", "event_id", F.when(F.col("k") % 2 == 0, "raw").otherwise("resolved").alias("kind"), F.col("resource").alias("path")), "/lib").groupBy("missed").agg(F.count("*").alias("n")))
over_chain("s062_match_claims", lambda c: c.matched().select("pid", "wid", "claim_id", "verified", "matched_id"))
QUERIES["s063_claimed_resource"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", evidence.claimed_resource(F.col("text")).alias("resource"))


def reason() -> Column:
    """What a model might have said about a window."""
    return F.concat(F.lit("reads "), F.lit("/etc/shadow and "), F.lit("/tmp/stage"), F.col("pid"), F.lit(" then 185.220.101."), F.col("pid") % 20, F.lit(":4444 (T1003, T1071.001)"))


def reasoned(c: Chain) -> DataFrame:
    return c.full().withColumn("reasoning", reason())


over_chain("s064_reasoning_claims", lambda c: evidence.reasoning_claims(reasoned(c)))
over_chain("s065_evidence_report", lambda c: c.report())
over_chain("s066_verification_report", lambda c: evidence.verification_report(c.matched(), c.report()))
over_chain("s067_entity_audit", lambda c: evidence.entity_audit(reasoned(c), c.windows))
over_chain("s068_explainability", lambda c: evidence.explainability(c.report(), c.hits()))
over_chain("s076_heuristic", lambda c: c.full().select("pid", "wid", "score", "label", "confidence", F.array_join("ttps", ",").alias("ttps")))
over_chain("s077_graph_route", lambda c: c.routed())


def two_tier(c: Chain) -> DataFrame:
    entropies = graph.structural_entropy(graph.edges(c.windows)).withColumnRenamed("structural_entropy", "entropy")
    return scores.dual_tier(c.draft(), c.full(), entropies, F.col("confidence") >= 0.90)


over_chain("s078_dual_tier", two_tier)
over_chain("s079_conformal_fast_path", lambda c: scores.conformal_quantile(scores.fast_path_scores(c.draft(), c.truth()), "confidence"))
over_chain("s080_requests", lambda c: scores.requests(c.texts()).select("pid", "wid", F.length("messages").alias("size"), F.get_json_object("messages", "$[1].content").alias("content")))
over_chain("s080b_responses", lambda c: scores.parsed_responses(c.full().select("pid", "wid", F.when(F.col("pid") % 5 == 0, "{broken").otherwise(F.concat(F.lit('{"label": "'), F.lower("label"), F.lit('", "confidence": '), "score", F.lit("}"))).alias("response"))).drop("ttps"))
over_chain("s081_call_site_score", lambda c: scores.call_site_score(c.sites))
over_chain("s082_behaviour_vectors", lambda c: scores.behaviour_vectors(c.sites))
QUERIES["s083_centroid_divergence"] = lambda spark, sf_dir: scores.centroid_divergence(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", F.col("label") == 1).select("vec_id", F.round("divergence", 6).alias("divergence"))
over_chain("s084_call_site_evaluation", lambda c: scores.call_site_evaluation(joins.call_sites(c.events, valid_call_sites(c.spark)), F.col("sc_type") == 9))
over_chain("s085_fused", lambda c: scores.fused(scores.audit_adjusted(c.facts())).select("pid", "wid", "fused", "fused_label"))
over_chain("s086_audit_adjust", lambda c: scores.audit_adjusted(c.facts()).select("pid", "wid", "adjusted", "cove_cap"))
over_chain("s087_tiers", lambda c: c.facts().select("pid", "wid", tiers.tier_of(F.col("confidence"), F.col("label"), F.col("callsite_score")).alias("tier")))
over_chain("s088_escalation", lambda c: c.facts().select("pid", "wid", "escalation"))


def benign_escalations(c: Chain) -> DataFrame:
    return c.facts().join(c.truth().where(~F.col("malicious")), graph.KEY, "left_semi").select("escalation")


over_chain("s089_calibrated_caps", lambda c: tiers.calibrated_caps(c.facts(), benign_escalations(c)).select("pid", "wid", "cap"))
over_chain("s090_pvalues", lambda c: tiers.conformal_pvalues(c.facts(), benign_escalations(c)).select("pid", "wid", "p"))
over_chain("s091_gates", lambda c: tiers.gates(tiers.calibrated_caps(c.facts(), benign_escalations(c)).withColumn("tier0", tiers.tier_of(F.col("confidence"), F.col("label")))).select("pid", "wid", "cove_cap", "floor", "tier", "capped_by"))
over_chain("s092_tempered", lambda c: c.decided().select("pid", "wid", tiers.tempered(F.col("confidence"), 1.5).alias("confidence")))
over_chain("s093_fitted_temperature", lambda c: tiers.fitted_temperature(c.decided()))
over_chain("s094_window_rules", lambda c: scores.window_rules(c.windows))
over_events("s095_event_signatures", lambda e: scores.event_signatures(e).select("event_id", "rule"))
over_windows("s096_ngrams", scores.ngram_counts)
over_chain("s097_ngram_lr", lambda c: scores.ngram_scores(c.windows, c.truth()))
over_chain("s098_boosted", lambda c: scores.boosted_scores(graph.features(c.windows), c.truth()))
ATTACK_COMMS = ("nginx", "vugefal")


def labelled(c: Chain) -> DataFrame:
    marked = joins.annotated(c.events, threat_ips(c.spark).where("ip LIKE '%.4' OR ip LIKE '%.7'"), C.MALWARE_PATHS)
    return evaluate.labelled_windows(windows.tumbling_windows(marked), attack_windows(c.spark), ATTACK_COMMS, sequence.parent_map(c.events, 0))


over_chain("s099_label_windows", lambda c: labelled(c).drop("child_resource"))
over_chain("s100_stratified_sample", lambda c: evaluate.stratified_sample(labelled(c), 50, 50).select("pid", "wid", "malicious", "name"))
over_chain("s101_confusion", lambda c: evaluate.confusion(c.decided()))
over_chain("s102_bootstrap", lambda c: evaluate.bootstrap_interval(c.decided()))
over_chain("s103_reliability", lambda c: evaluate.reliability(c.decided()))
over_chain("s103b_calibration_error", lambda c: evaluate.calibration_error(c.decided()))
over_chain("s104_mcnemar", lambda c: evaluate.mcnemar(c.decided().select("pid", "wid", F.col("correct").alias("first_correct")).join(scores.window_rules(c.windows).join(c.truth(), graph.KEY).select("pid", "wid", ((F.col("label") == "MALICIOUS") == F.col("malicious")).alias("second_correct")), graph.KEY)))
QUERIES["s105_cohens_d"] = lambda spark, sf_dir: evaluate.cohens_d(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_totalprice").cast("double").alias("v"), (F.col("o_orderstatus") == "F").alias("g")), "v", F.col("g"))
QUERIES["s106_latency"] = lambda spark, sf_dir: evaluate.latency_summary(spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("v", F.col("o_totalprice").cast("double")), "v", "o_orderstatus")
QUERIES["s106b_nth_percentiles"] = lambda spark, sf_dir: evaluate.nth_percentiles(spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("v", F.col("o_totalprice").cast("double")), "v", "o_orderstatus")


def traces(c: Chain) -> DataFrame:
    """Per trace: whether a window of it is an attack or flagged, and its largest entropy."""
    by = c.decided().join(c.windows.select("pid", "wid", "trace_id").distinct(), graph.KEY).groupBy("trace_id").agg(F.bool_or("malicious").alias("malicious"), F.bool_or("flagged").alias("flagged"))
    return by.join(sequence.sliding_max_entropy(c.events), "trace_id")


over_chain("s107_entropy_sweep", lambda c: evaluate.entropy_sweep(traces(c)))
over_chain("s108_error_breakdown", lambda c: evaluate.error_breakdown(c.decided().join(c.windows.select("pid", "wid", scenario().alias("scenario")).distinct(), graph.KEY)))
over_chain("s108b_worst_scenarios", lambda c: evaluate.worst_scenarios(c.decided().join(c.windows.select("pid", "wid", scenario().alias("scenario")).distinct(), graph.KEY)))


def ablated(c: Chain) -> DataFrame:
    rows = c.scored().select("pid", "wid", "score").join(c.full().select("pid", "wid", "label"), graph.KEY).join(c.truth(), graph.KEY)
    return rows.join(c.hits().select("pid", "wid", "n_violations"), graph.KEY, "left").na.fill(0, ["n_violations"]).join(c.report().select("pid", "wid", "hallucination_rate"), graph.KEY)


over_chain("s109_ablation", lambda c: evaluate.ablation(ablated(c)))
over_chain("s110_layered", lambda c: evaluate.layered(ablated(c).join(scores.call_site_score(c.sites).select("pid", "wid", F.col("score").alias("callsite_score")), graph.KEY)))
over_chain("s111_baselines", lambda c: evaluate.compared({"window_rules": scores.window_rules(c.windows), "heuristic": c.full(), "graph": scores.routed(c.scored(), mode="graph_only")}, c.truth()))
over_chain("s112_dual_tier_eval", lambda c: scores.reduction(two_tier(c)))


def stated(c: Chain) -> DataFrame:
    """Figures of :func:`confusion` as (metric, value) rows."""
    return evaluate.confusion(c.decided()).select(F.expr("stack(3, 'tpr', tpr, 'fpr', fpr, 'accuracy', accuracy) AS (metric, value)"))


over_chain("s113_reconciled", lambda c: evaluate.reconciled(evaluate.confusion(c.decided()).select(F.expr("stack(4, 'tpr', round(tpr, 3), 3, 'fpr', fpr + 0.2, 3, 'accuracy', round(accuracy, 2), 2, 'other', 0.5D, 2) AS (metric, value, digits)")), stated(c)))
over_chain("s114_corpus_summary", lambda c: evaluate.corpus_summary(c.truth().join(c.windows.select("pid", "wid", E.workload_type(scenario()).alias("workload")).distinct(), graph.KEY)))
over_events("s115_event_rates", rollups.event_rates)
over_chain("s115b_threat_rates", lambda c: rollups.threat_rates(c.audit()))
over_events("s116_activity", rollups.activity)
over_chain("s116b_tier_usage", lambda c: rollups.tier_usage(c.audit()))
over_events("s117_value_histogram", lambda e: rollups.value_histogram(e, "value", (10.0, 50.0, 100.0, 500.0)))
over_events("s117b_latency", lambda e: evaluate.latency_summary(e, "value", "comm"))
over_chain("s118_recent", lambda c: rollups.recent(c.audit()).select("pid", "wid", "label", "tier", "ts_us"))
over_chain("s118b_status", lambda c: rollups.status(c.audit()))


def strace_lines(e: DataFrame) -> DataFrame:
    """Call-trace lines rendered from events: what read_strace reads."""
    us = F.pmod("ts_us", F.lit(86_400_000_000))
    clock = F.format_string("%02d:%02d:%02d.%06d", F.floor(us / 3_600_000_000), F.floor(us / 60_000_000) % 60, F.floor(us / 1_000_000) % 60, us % 1_000_000)
    host, port = F.substring_index("resource", ":", 1), F.substring_index("resource", ":", -1)
    call = (
        F.when(F.col("sc_type") == 0, F.concat(F.lit('execve("'), "resource", F.lit('", [], 0) = 0')))
        .when(F.col("sc_type") == 1, F.concat(F.lit('openat(AT_FDCWD, "'), "resource", F.lit('", O_RDONLY) = '), F.when(F.col("k") % 10 == 9, "-1 ENOENT").otherwise("3")))
        .when(F.col("sc_type") == 2, F.concat(F.lit('openat(AT_FDCWD, "'), "resource", F.lit('", O_WRONLY|O_CREAT) = 4')))
        .when(F.col("sc_type") == 3, F.concat(F.lit("connect(3, {sin_port=htons("), port, F.lit('), sin_addr=inet_addr("'), host, F.lit('")}, 16) = 0')))
        .when(F.col("sc_type") == 9, "ptrace(PTRACE_ATTACH) = 0")
        .otherwise("getpid() = 7")
    )
    return e.select(F.col("trace_id").alias("trace"), F.concat_ws(" ", "pid", clock, call).alias("value"), F.struct("ts_us", "event_id").alias("seq"))


over_events("s001_strace", lambda e: readers.strace_events(strace_lines(e)).groupBy("trace", "pid", "sc_type", "resource").agg(F.count("*").alias("n")))
over_events("s002_exec_names", lambda e: readers.strace_events(strace_lines(e)).groupBy("pid", "comm").agg(F.count("*").alias("n")))

QUERIES["s038b_flagging_loop"] = lambda spark, sf_dir: Chain(spark, sf_dir).looped().select("event_id", "trigger", "verdict")

#: Event types that count as an attack. fixed values
ATTACK_TYPES = ("SHELL-COMMAND", "PROCESS-CREATE", "FILE-WRITE", "NETWORK-CONNECT", "PRIVILEGE-ESCALATE", "CREDENTIAL-ACCESS")

over_events("s003_provenance_events", lambda e: provenance.provenance_events(rendered.provenance_lines(e)))
over_events("s006_whole_windows", lambda e: windows.whole_windows(provenance.lite_provenance_events(rendered.provenance_lines(e)), "seq").drop("ts_us", "ppid"))
over_events("s007_call_numbers", lambda e: readers.call_numbers(rendered.call_number_lines(e)).drop("path"))
over_events("s008_call_number_summary", lambda e: readers.call_number_summary(readers.call_numbers(rendered.call_number_lines(e))))
over_events("s010_file_end_windows", lambda e: provenance.file_end_windows(rendered.file_acts(e), ATTACK_TYPES))

over_events("s014b_windows_of_large_pids", lambda e: windows.tumbling_in_blocks(e).select("event_id", "pid", "wid", "idx"))
over_events("s036b_triage_in_blocks", lambda e: sequence.triage(e, block=4096).select("event_id", "entropy", "markov_entropy", "novel_edge", "novel_transition", "trigger"))
over_chain("s097b_held_out", lambda c: evaluate.area_under_curve(scores.ngram_scores(c.windows, c.truth()).join(c.truth(), graph.KEY)))
over_events(
    "s013_manifest",
    lambda e: readers.artifact_facts(rendered.artifacts(e)).select("name", "bytes", "sha256", F.array_join(F.transform(F.array_sort(F.map_entries("headline")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("headline"), F.array_join("flags", ";").alias("flags"), "error"),
)


def blended(c: Chain) -> DataFrame:
    """Call-site scores with the divergence of behaviour from that of windows whose addresses are all known."""
    sites = staged(c.sites)
    known = scores.call_site_score(sites).select("pid", "wid", "static")
    vectors = scores.behaviour_vectors(sites).join(known, graph.KEY).withColumn("vector", F.array("v1", "v2", "v3"))
    apart = scores.centroid_divergence(staged(vectors), "vector", F.col("static") == 0)
    return scores.call_site_score(sites, apart.select("pid", "wid", F.col("divergence").alias("ai"))).withColumn("ai", F.round("ai", 6))


over_chain("s081b_call_site_blend", blended)
over_chain("s112b_tiers_by_scenario", lambda c: scores.tiers_by_scenario(two_tier(c), c.full(), c.truth(), c.windows.select("pid", "wid", scenario().alias("scenario")).distinct()))

#: Worked examples that go before a window's text.
SHOTS = (("graph of a shell that reads /etc/shadow and connects out", '{"label": "malicious", "confidence": 0.9}'), ("graph of a package update", '{"label": "benign", "confidence": 0.9}'))
over_chain("s080c_gray_requests", lambda c: scores.requests(c.texts(), shots=SHOTS, gray=c.scored().where((F.col("score") > 0.15) & (F.col("score") < 0.55))).select("pid", "wid", *(F.get_json_object("messages", f"$[{i}].content").alias(f"m{i}") for i in (1, 4, 5)), F.get_json_object("messages", "$[5].role").alias("role")))
