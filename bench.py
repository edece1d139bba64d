"""Times the headline queries after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

from hostlake.operators import graph, rules, sequence, windows
from hostlake.sources.adapter import kernel_events

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    events = kernel_events(spark, SF_DIR).cache()
    n_events = events.count()
    cut = windows.tumbling_windows(events).cache()
    n_windows = cut.count() // 20

    plans = {
        "triage": lambda: sequence.triage(events),
        "marginal_entropy": lambda: sequence.marginal_entropy(events),
        "markov_entropy": lambda: sequence.markov_entropy(events),
        "graph_edges": lambda: graph.edges(cut),
        "graph_score": lambda: graph.provenance_score(cut),
        "runtime_monitor": lambda: rules.violations(events),
    }
    # a sum over a fixed range tells how fast the machine is
    calibration = lambda: spark.range(200_000_000).selectExpr("sum(id % 7)")
    seconds, times = {}, {}
    for name, plan in {**plans, "calibration": calibration}.items():
        plan().write.format("noop").mode("overwrite").save()
        runs = []
        for _ in range(5):  # the median of five runs after a first one
            began = time.time()
            plan().write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        times[name] = round(median(runs), 3)
    calibrated = times.pop("calibration")
    seconds |= times
    total = round(sum(seconds.values()), 3)
    rates = {"events": n_events, "windows": n_windows, "triage_events_per_s": round(n_events / seconds["triage"]), "calibration_s": calibrated, "graph_windows_per_s": round(n_windows / seconds["graph_score"])}
    print(json.dumps({"metric": "headline_queries", "value": total, "unit": "sec", "queries": seconds, "sf": SF_DIR.rstrip("/").rpartition("sf")[2], **rates}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
