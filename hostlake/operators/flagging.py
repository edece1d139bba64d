"""The closed loop of flags: verdicts on windows flag processes, flagged processes pass the gate, and what passes brings more verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlake.config import DEFAULT
from hostlake.operators.sequence import flagged_lineage, gate_inputs, gated
from hostlake.staging import staged


def flagging_loop(events: DataFrame, windows: DataFrame, decided: DataFrame, seconds: int = DEFAULT.flag_seconds, rounds: int = 8, config=DEFAULT) -> DataFrame:
    """Events with their ``trigger`` once flags and verdicts agree, ``wid`` (null outside whole windows), ``verdict`` (whether the event's window was found malicious) and ``rounds``.

    A window is looked at if any of its events passes the gate; one that is looked at and that ``decided`` (pid, wid, label) calls
    MALICIOUS flags its process when it ends. For ``seconds`` from then on, events of that process and of its children pass as
    'flagged_parent', which may bring their windows to be looked at. Flags act forward in time, so each round settles one
    more link of such chains; the loop ends with the round that changes no verdict, after ``rounds`` at the latest.

    What doesn't depend on flags is computed once and staged, and so is each round's verdicts: a round's plan is the same whatever its number.
    """
    ends = windows.groupBy("pid", "wid").agg(F.max("ts_us").alias("ts_us"))
    bad = staged(ends.join(decided.where("label = 'MALICIOUS'").select("pid", "wid"), ["pid", "wid"]))
    inputs = staged(gate_inputs(events, config).join(windows.select("event_id", "wid"), "event_id", "left"))
    verdicts = bad.limit(0)
    told, done = None, 0
    while True:
        flags = flagged_lineage(inputs, verdicts, seconds).select("event_id")
        passed = gated(inputs, flags, None, config)
        seen = passed.where((F.col("trigger") != "skip") & F.col("wid").isNotNull()).select("pid", "wid").distinct()
        found = staged(bad.join(seen, ["pid", "wid"], "left_semi"))
        mark = tuple(found.agg(F.count("*"), F.bit_xor(F.xxhash64("pid", "wid"))).first())
        done += 1
        if mark == told or done == rounds:
            break
        verdicts, told = found, mark
    marked = verdicts.select("pid", "wid", F.lit(True).alias("verdict"))
    return passed.join(marked, ["pid", "wid"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(False))).withColumn("rounds", F.lit(done))
