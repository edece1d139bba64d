"""Temporal rules over the event order of a trace, in closed form: no state is carried.

``g`` is an event's place in its whole trace, all processes together (see windows.in_trace_order).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlake.functions import constants as C
from hostlake.functions import events as E
from hostlake.operators.windows import in_trace_order


@dataclass(frozen=True)
class Forbidden:
    """After ``trigger`` the process must not do ``forbidden`` within ``window`` events of the trace (0: ever)."""

    name: str
    severity: str
    trigger: Column
    forbidden: Column
    window: int = 0


@dataclass(frozen=True)
class Sequel:
    """``trigger`` and whether the process does ``sequel`` later in the trace. With ``negate`` doing so violates the rule, else
    not doing so once more than ``window`` events have followed."""

    name: str
    severity: str
    trigger: Column
    sequel: Column
    window: int
    negate: bool


def default_rules() -> list[Forbidden]:
    return [
        Forbidden("AX-1", "CRITICAL", E.comm_is("nginx"), E.execve("/bin/bash"), 50),
        Forbidden("AX-3", "CRITICAL", E.prctl_rename(), E.file_read("/etc/shadow"), 0),
        Forbidden("AX-5", "CRITICAL", E.setuid_to_root(), E.connects(), 5),
    ]


def default_sequels() -> list[Sequel]:
    return [
        Sequel("AX-2", "CRITICAL", E.suspicious_shadow_read(), E.connects(), 10, True),
        Sequel("AX-2b", "MEDIUM", E.suspicious_shadow_read(), E.connects(), 50, False),
    ]


def staged_hit() -> Column:
    """Execution from a place where anyone may write."""
    return E.execve("/tmp/") | E.execve("/dev/shm/")


OUT = ["trace_id", "pid", "g", "at_g", "axiom", "severity"]


def _found(events: DataFrame, forbidden: list[Forbidden] = (), following: list[Sequel] = (), staged: bool = False, strict: bool = False) -> DataFrame:
    """Violations of any rules in one pass: events are put in order once, later ones first, so that every frame only grows."""
    later = Window.partitionBy("trace_id", "pid").orderBy(F.desc("g"))
    after = later.rowsBetween(Window.unboundedPreceding, -1)
    seen, found = in_trace_order(events), []
    names: dict[str, Column] = {}

    def violation(rule: str, severity: str, g: Column, at_g: Column) -> Column:
        return F.struct(g.alias("g"), at_g.alias("at_g"), F.lit(rule).alias("axiom"), F.lit(severity).alias("severity"))

    for i, rule in enumerate(forbidden):
        names[f"__f{i}"] = F.min(F.when(rule.forbidden, F.col("g"))).over(after)
        at = F.col(f"__f{i}")
        near = at.isNotNull() if rule.window == 0 else at - F.col("g") <= rule.window
        found.append(F.when(rule.trigger & near, F.array(violation(rule.name, rule.severity, F.col("g"), at))))
    for i, rule in enumerate(following):
        names[f"__s{i}"] = F.min(F.when(rule.sequel, F.col("g"))).over(after)
        at = F.col(f"__s{i}")
        if rule.negate:
            bad = at.isNotNull() & ((at - F.col("g") <= rule.window) if strict else F.lit(True))
        else:
            bad = at.isNull() & (F.col("trace_len") - F.col("g") + 1 > rule.window)
        found.append(F.when(rule.trigger & bad, F.array(violation(rule.name, rule.severity, F.col("g"), at))))
    if staged:
        hit = staged_hit()
        # of later events first, the next row is the one before
        names["__again"] = F.coalesce((F.lead("g").over(later) == F.col("g") - 1) & ~F.lead(hit).over(later), F.lit(False))
        once = violation("AX-4", "HIGH", F.col("g"), F.col("g"))
        both = F.array(once) if strict else F.when(F.col("__again"), F.array(once, violation("AX-4", "HIGH", F.col("g") - 1, F.col("g")))).otherwise(F.array(once))
        found.append(F.when(hit, both))
    rows = seen.withColumns(names).select("trace_id", "pid", F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("v"))
    return rows.select("trace_id", "pid", "v.*").select(*OUT)


def forbidden_sequences(events: DataFrame, rule: Forbidden) -> DataFrame:
    """Violations: ``g`` of the trigger and ``at_g``, the g of the first later forbidden event of the same process, if near enough."""
    return _found(events, [rule])


def staged_execution(events: DataFrame, strict: bool = False) -> DataFrame:
    """AX-4: execution under /tmp/ or /dev/shm/. An event counts again if the trace's event just before is of the same
    process and isn't such an execution itself; ``strict`` counts it once."""
    return _found(events, staged=True, strict=strict)


def sequels(events: DataFrame, rule: Sequel, strict: bool = False) -> DataFrame:
    """Violations of a sequel rule; ``at_g`` is null where nothing followed. ``strict`` heeds the window of negated rules, too."""
    return _found(events, following=[rule], strict=strict)


def violations(events: DataFrame) -> DataFrame:
    """All default rules of either kind."""
    return _found(events, default_rules(), default_sequels(), staged=True)


def violation_summary(found: DataFrame) -> DataFrame:
    """Per trace: how many violations, of which rules, and the greatest severity as a number."""
    weight = F.when(F.col("severity") == "CRITICAL", C.SEVERITY["CRITICAL"]).when(F.col("severity") == "HIGH", C.SEVERITY["HIGH"]).otherwise(C.SEVERITY["MEDIUM"])
    return found.groupBy("trace_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("axiom")), ",").alias("axioms"), F.max(weight).alias("severity"), F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"))


def violations_by_rule(found: DataFrame, traces: DataFrame) -> DataFrame:
    """Violations and traces hit per rule, and the share of all ``traces`` (trace_id) that it hits."""
    total = traces.select("trace_id").distinct().agg(F.count("*").alias("total"))
    by = found.groupBy("axiom").agg(F.count("*").alias("n"), F.count_distinct("trace_id").alias("traces"))
    return by.join(F.broadcast(total)).withColumn("rate", F.round(F.col("traces") / F.col("total"), 6)).drop("total")
