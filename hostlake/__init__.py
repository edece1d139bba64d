"""Host-event analytics on Spark: windows, sequence statistics, provenance graphs, rules, scores and their evaluation."""
