"""Order-aware statistics of event classes, and the gate built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostlake.config import DEFAULT
from hostlake.functions import constants as C
from hostlake.functions.events import entropy, is_hard_trigger
from hostlake.operators.windows import ORDER, in_blocks


def _by_pid(by: tuple[str, ...] = ("pid",)):
    return Window.partitionBy(*by).orderBy(*ORDER)


def marginal_entropy(events: DataFrame, w: int = 64, by: tuple[str, ...] = ("pid",)) -> DataFrame:
    """Adds ``entropy``: bits of the class over the pid's last ``w`` events. One window specification, twelve running counts."""
    frame = _by_pid(by).rowsBetween(-(w - 1), 0)
    names = [f"__c{c}" for c in C.CLASSES]
    counted = events.select("*", *(F.sum((F.col("sc_type") == c).cast("int")).over(frame).alias(n) for c, n in zip(C.CLASSES, names, strict=True)), F.count("*").over(frame).alias("__n"))
    return counted.withColumn("entropy", F.round(entropy([F.col(n) for n in names], F.col("__n")), 6) + 0.0).drop(*names, "__n")


def markov_entropy(events: DataFrame, w: int = 64, by: tuple[str, ...] = ("pid",)) -> DataFrame:
    """Adds ``markov_entropy``: the entropy rate of the pid's last ``w`` transitions, ``prev`` and ``transition`` (prev * 16 + class).

    The frame holds at most ``w`` small integers; one fold over its sorted values gives pair and row totals.
    """
    frame = _by_pid(by).rowsBetween(-(w - 1), 0)
    paired = events.withColumn("prev", F.lag("sc_type").over(_by_pid(by))).withColumn("transition", F.col("prev") * 16 + F.col("sc_type"))
    held = paired.withColumn("__codes", F.array_sort(F.collect_list("transition").over(frame)))
    xlogx = lambda n: n * F.log(2.0, n)
    row = lambda c: F.floor(c / 16)

    def step(acc, x):
        """Equal transitions adjoin, and so do those from one class: count both runs and settle a run where it ends."""
        same, same_row = x == acc["code"], row(x) == row(acc["code"])
        return F.struct(
            x.alias("code"),
            F.when(same, acc["n"] + 1.0).otherwise(1.0).alias("n"),
            F.when(same_row, acc["m"] + 1.0).otherwise(1.0).alias("m"),
            (acc["sum"] - F.when(same, 0.0).otherwise(xlogx(acc["n"])) + F.when(same_row, 0.0).otherwise(xlogx(acc["m"]))).alias("sum"),
        )

    # -sum p(i,j) log p(j given i) = (sum of m log m over classes - sum of n log n over transitions) / total
    begin = F.struct(F.try_element_at("__codes", F.lit(1)).alias("code"), F.lit(1.0).alias("n"), F.lit(1.0).alias("m"), F.lit(0.0).alias("sum"))
    rate = F.aggregate(F.slice("__codes", 2, 1_000_000), begin, step, lambda acc: acc["sum"] - xlogx(acc["n"]) + xlogx(acc["m"])) / F.size("__codes")
    value = F.when(F.size("__codes") > 0, F.round(rate, 6)).otherwise(0.0)
    return held.withColumn("markov_entropy", value + 0.0).drop("__codes")


def bigram_table(events: DataFrame) -> DataFrame:
    """Transitions by process name: ``comm``, ``prev``, ``cur``, ``n``."""
    prev = events.withColumn("prev", F.lag("sc_type").over(_by_pid())).where(F.col("prev").isNotNull())
    return prev.groupBy("comm", "prev", F.col("sc_type").alias("cur")).agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Adds ``out``: whether an event is the first of all with its keys. The minimum per key is pre-aggregated, so a common key isn't gathered."""
    first = events.groupBy(*keys).agg(F.min(F.struct(*ORDER)).alias("__first"))
    renamed = first.select(*(F.col(k).alias(f"__{k}") for k in keys), "__first")
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return events.join(renamed, on).withColumn(out, F.struct(*ORDER) == F.col("__first")).drop("__first", *(f"__{k}" for k in keys))


def early_trigger(bad_site, flagged):
    """What speaks for an event before its process's window is looked at, or null."""
    return F.when(bad_site, "callsite").when(is_hard_trigger(F.col("resource")), "hard_trigger").when(flagged, "flagged_parent")


def late_trigger(config=DEFAULT):
    """What entropies and novelty say of an event that reaches them."""
    low = F.col("entropy") < config.entropy_low
    quiet = low & (F.col("markov_entropy") < config.entropy_low) & ~F.col("novel_edge") & ~F.col("novel_transition")
    return F.when(quiet, "skip").when(F.col("novel_transition"), "novel_transition").when(F.col("novel_edge"), "novel_edge").when(low, "markov").otherwise("entropy")


def gate_inputs(events: DataFrame, config=DEFAULT, block: int | None = None) -> DataFrame:
    """What the gate knows of an event whatever earlier stages say: ``entropy``, ``markov_entropy``, ``prev``, ``filled``.

    With ``block`` pids are cut into blocks of so many events, each with the events before that its frames reach back to, so that no task has to sort
    a whole pid; it costs one more exchange.
    """
    by, back = ("pid",), config.entropy_window + 1
    columns = events.columns
    if block is not None:
        events, by = in_blocks(events, back, block), ("pid", "block")
    seen = marginal_entropy(markov_entropy(events, config.entropy_window, by), config.entropy_window, by)
    seen = seen.withColumn("filled", F.count("*").over(_by_pid(by).rowsBetween(-(config.window - 1), 0)))
    return seen if block is None else seen.where("NOT halo").select(*columns, "prev", "transition", "entropy", "markov_entropy", "filled")


def gated(seen: DataFrame, flagged: DataFrame | None = None, bad_sites: DataFrame | None = None, config=DEFAULT, legacy: bool = False) -> DataFrame:
    """The gate over gate_inputs."""
    for table, name in ((flagged, "flagged"), (bad_sites, "bad_site")):
        if table is None:
            seen = seen.withColumn(name, F.lit(False))
        else:
            seen = seen.join(table.select("event_id", F.lit(True).alias(name)).distinct(), "event_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    early = F.coalesce(early_trigger(F.col("bad_site"), F.col("flagged")), F.when(F.col("filled") < config.window, "skip"))
    seen = seen.withColumn("early", early)
    reached = seen.where(F.col("early").isNull())
    novel = first_seen(first_seen(reached, ["comm", "sc_type"], "novel_edge"), ["comm", "prev", "sc_type"], "novel_transition").select("event_id", "novel_edge", "novel_transition")
    both = seen.join(novel, "event_id", "left").na.fill(False, ["novel_edge", "novel_transition"])
    late = F.when(F.col("entropy") < config.entropy_low, "skip").otherwise("entropy") if legacy else late_trigger(config)
    return both.withColumn("trigger", F.coalesce("early", late)).drop("early", "filled", "flagged", "bad_site", "transition")


def triage(events: DataFrame, flagged: DataFrame | None = None, bad_sites: DataFrame | None = None, config=DEFAULT, legacy: bool = False, block: int | None = None) -> DataFrame:
    """The gate: adds ``entropy``, ``markov_entropy``, ``novel_edge``, ``novel_transition`` and ``trigger`` ('skip' where nothing speaks for the event).

    Precedence: call site outside the known ones, hard trigger, flagged parent, incomplete window, then entropy and novelty.
    ``flagged`` and ``bad_sites`` hold the ``event_id`` s that earlier stages marked. Only events that
    reach the entropy layer count for novelty. ``legacy`` knows marginal entropy only. ``block``: see gate_inputs.
    """
    return gated(gate_inputs(events, config, block), flagged, bad_sites, config, legacy)


def gate_stats(triaged: DataFrame) -> DataFrame:
    """Events by ``trigger``, and the total with the rate of signals under the name 'total'."""
    by = triaged.groupBy("trigger").agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("trigger") != "skip", F.col("n")).otherwise(0)).alias("signals"))
    return by.select("trigger", "n", F.lit(None).cast("double").alias("signal_rate")).unionByName(total.select(F.lit("total").alias("trigger"), "n", F.round(F.col("signals") / F.col("n"), 6).alias("signal_rate")))


def sliding_max_entropy(events: DataFrame, n: int = 20) -> DataFrame:
    """``max_entropy`` per trace over all windows of ``n`` consecutive events; a shorter trace is one window."""
    order = Window.partitionBy("trace_id").orderBy(*ORDER)
    frame = order.rowsBetween(-(n - 1), 0)
    counted = events.select("trace_id", F.row_number().over(order).alias("r"), F.count("*").over(Window.partitionBy("trace_id")).alias("len"), *(F.sum((F.col("sc_type") == c).cast("int")).over(frame).alias(f"c{c}") for c in C.CLASSES))
    bits = entropy([F.col(f"c{c}") for c in C.CLASSES], F.least("r", F.lit(n)))
    return counted.withColumn("h", bits).where(F.col("r") >= F.least("len", F.lit(n))).groupBy("trace_id").agg((F.round(F.max("h"), 6) + 0.0).alias("max_entropy"))


def flagged_lineage(events: DataFrame, verdicts: DataFrame, seconds: int = 120) -> DataFrame:
    """Events of a pid, or of a child of one, that had a MALICIOUS verdict in the ``seconds`` before.

    ``verdicts``: ``pid``, ``ts_us``. The join is on pid or parent pid and a bucket of time, so that it stays an equality.
    """
    span = seconds * 1_000_000
    bad = verdicts.select(F.col("pid").alias("bad_pid"), F.col("ts_us").alias("bad_us"), F.explode(F.array(F.floor(F.col("ts_us") / span), F.floor(F.col("ts_us") / span) + 1)).alias("bucket"))
    who = events.select("event_id", "ts_us", F.explode(F.array_distinct(F.array("pid", "ppid"))).alias("bad_pid"), F.floor(F.col("ts_us") / span).alias("bucket"))
    met = who.join(bad, ["bad_pid", "bucket"]).where((F.col("ts_us") > F.col("bad_us")) & (F.col("ts_us") <= F.col("bad_us") + span))
    return events.join(met.select("event_id").distinct(), "event_id", "left_semi")


def lineage(events: DataFrame) -> DataFrame:
    """First and latest names, first exec path, first time, renames and the last of them, per pid."""
    order = F.struct(*ORDER)
    exec_order = F.when(F.col("sc_type") == C.EXEC, order)
    return events.groupBy("pid").agg(
        F.min_by("comm", order).alias("original_comm"),
        F.max_by("comm", order).alias("current_comm"),
        F.min_by("resource", exec_order).alias("exec_path"),
        F.min("ts_us").alias("first_seen_us"),
        F.count_if(F.col("sc_type") == C.PRCTL).alias("renames"),
        F.max(F.when(F.col("sc_type") == C.PRCTL, F.col("ts_us"))).alias("last_rename_us"),
        F.max_by("ppid", order).alias("ppid"),
    )


def parent_map(events: DataFrame, least: int = 1) -> DataFrame:
    """The last parent of every pid, of parents above ``least`` only."""
    return events.where((F.col("ppid") > least) & (F.col("pid") != 0)).groupBy("pid").agg(F.max_by("ppid", F.struct(*ORDER)).alias("ppid"))
