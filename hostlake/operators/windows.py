"""Count-based windows over the events of a process or a trace. Order is (ts_us, event_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostlake.staging import staged

ORDER = ("ts_us", "event_id")


def tumbling_windows(events: DataFrame, n: int = 20, by: tuple[str, ...] = ("pid",), min_len: int | None = None) -> DataFrame:
    """Consecutive windows of ``n`` events: adds ``wid`` (window number, from 0) and ``idx`` (place inside, from 0).

    An incomplete last window is dropped; with ``min_len`` it stays if it has so many events.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*ORDER)) - 1
    cut = events.withColumn("__i", place).withColumn("wid", F.floor(F.col("__i") / n)).withColumn("idx", (F.col("__i") % n).cast("int"))
    size = F.count("*").over(Window.partitionBy(*by, "wid"))
    return cut.withColumn("__n", size).where(F.col("__n") >= (n if min_len is None else min_len)).drop("__i", "__n")


def in_whole_order(rows: DataFrame, *order: str, out: str = "place") -> DataFrame:
    """Adds ``out``, the row's place (from 0) in the whole table by ``order``, without bringing the table together.

    Ranges of ``order`` are sorted in tasks and staged; a range's rows are numbered from how many come before it, one count per range. Rows that agree in ``order`` keep together.
    """
    at = F.monotonically_increasing_id()
    ranged = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at))
    part = F.shiftright("__at", 33)
    counts = sorted((r["part"], r["n"]) for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # as many as there are ranges
    offsets, before = [], 0
    for p, n in counts:
        offsets.append((p, before))
        before += n
    held = rows.sparkSession.createDataFrame(offsets, "__part long, __before long")
    met = ranged.withColumn("__part", part).join(F.broadcast(held), "__part")
    return met.withColumn(out, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).select(*rows.columns, out)


def whole_windows(rows: DataFrame, *order: str, n: int = 20) -> DataFrame:
    """Windows of ``n`` consecutive rows of the whole table: ``wid`` and ``idx``; the last one may be shorter."""
    placed = in_whole_order(rows, *order, out="__place")
    return placed.withColumn("wid", F.floor(F.col("__place") / n)).withColumn("idx", (F.col("__place") % n).cast("int")).drop("__place")


def in_blocks(events: DataFrame, halo: int, size: int = 4096, span_us: int = 3_600_000_000) -> DataFrame:
    """Events of each pid cut into blocks of ``size``, so that a pid of any size is spread: adds ``block``, ``place`` (in the pid, from 0), ``pid_len`` and ``halo``.

    A block also has the last ``halo`` events of the one before, marked, so that frames of up to ``halo`` rows back are whole inside it.
    Places come from counts per span of time; only those counts are added up over a pid.
    """
    placed = _placed(events, "pid", span_us).withColumn("place", F.col("__place") - 1).drop("__place").withColumnRenamed("__len", "pid_len")
    own = F.floor(F.col("place") / size)
    near_end = (F.col("place") % size >= size - halo) & (F.col("place") < F.floor((F.col("pid_len") - 1) / size) * size)
    copies = F.when(near_end, F.array(F.struct(own.alias("block"), F.lit(False).alias("halo")), F.struct((own + 1).alias("block"), F.lit(True).alias("halo")))).otherwise(F.array(F.struct(own.alias("block"), F.lit(False).alias("halo"))))
    return placed.withColumn("__at", F.explode(copies)).select("*", "__at.*").drop("__at")


def tumbling_in_blocks(events: DataFrame, n: int = 20) -> DataFrame:
    """tumbling_windows of pids of any size: a place in the pid says which window an event is in, and the pid's length which windows are whole."""
    placed = _placed(events, "pid", 3_600_000_000)
    cut = placed.withColumn("wid", F.floor((F.col("__place") - 1) / n)).withColumn("idx", ((F.col("__place") - 1) % n).cast("int"))
    return cut.where((F.col("wid") + 1) * n <= F.col("__len")).drop("__place", "__len")


def sliding_last(events: DataFrame, n: int = 20, keep=None) -> DataFrame:
    """The last ``n`` events of the pid up to each event: ``filled`` (how many) and ``recent`` (array of class and resource).

    ``keep`` is a condition on the events whose windows are wanted; others aren't returned.
    """
    frame = Window.partitionBy("pid").orderBy(*ORDER).rowsBetween(-(n - 1), 0)
    out = events.withColumn("filled", F.count("*").over(frame)).withColumn("recent", F.collect_list(F.struct("sc_type", "resource")).over(frame))
    return out if keep is None else out.where(keep)


def last_per_trace(events: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` events of every trace."""
    back = Window.partitionBy("trace_id").orderBy(*(F.desc(c) for c in ORDER))
    return events.withColumn("__r", F.row_number().over(back)).where(F.col("__r") <= n).drop("__r")


def stitch_parents(windows: DataFrame, events: DataFrame, max_parent: int = 5) -> DataFrame:
    """Up to ``max_parent`` of the parent's latest events not after the end of a window, put before it.

    Returns window rows with ``from_parent``; ``idx`` of parent events is negative. By event time: a parent's
    events are known once they have happened.
    """
    by = ["pid", "wid"]
    ends = windows.groupBy(*by).agg(F.min_by("ppid", "idx").alias("parent"), F.max("ts_us").alias("end_us")).where(F.col("parent") != F.col("pid"))
    # ends of windows take their place among the parent's events, each after the events of its time
    seen = events.join(ends.select(F.col("parent").alias("pid")).distinct(), "pid", "left_semi")
    told = F.struct("event_id", "sc_type", "resource")
    none = F.lit(None)
    rows = seen.select(F.col("pid").alias("parent"), F.col("ts_us").alias("t"), F.lit(0).alias("is_end"), F.col("event_id").alias("o"), told.alias("e"), none.cast("long").alias("child"), none.cast("long").alias("wid"))
    marks = ends.select("parent", F.col("end_us").alias("t"), F.lit(1).alias("is_end"), F.lit(0).cast("long").alias("o"), none.cast(rows.schema["e"].dataType).alias("e"), F.col("pid").cast("long").alias("child"), F.col("wid").cast("long").alias("wid"))
    order = Window.partitionBy("parent").orderBy("t", "is_end", "o")
    # every event is numbered; a mark holds the number of the last one before it
    numbered = rows.unionByName(marks).withColumn("n", F.sum(1 - F.col("is_end")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    wanted = numbered.where("is_end = 1").select("parent", "child", "wid", F.explode(F.sequence(F.lit(1), F.lit(max_parent).cast("long"))).alias("r"), F.col("n").alias("upto"))
    wanted = wanted.where(F.col("upto") >= F.col("r")).withColumn("n", F.col("upto") - F.col("r") + 1)
    added = wanted.join(numbered.where("is_end = 0").select("parent", "n", "e"), ["parent", "n"])
    kinds = dict(windows.dtypes)
    added = added.select(F.col("child").cast(kinds["pid"]).alias("pid"), F.col("wid").cast(kinds["wid"]).alias("wid"), (-F.col("r")).cast("int").alias("idx"), "e.event_id", "e.sc_type", "e.resource", F.lit(True).alias("from_parent"))
    return windows.select(*by, "idx", "event_id", "sc_type", "resource", F.lit(False).alias("from_parent")).unionByName(added)


def drop_unresolved(events: DataFrame) -> DataFrame:
    return events.where(F.col("pid") != 0)


def in_trace_order(events: DataFrame, span_us: int = 3_600_000_000) -> DataFrame:
    """Adds ``g``, the place of an event in its whole trace (from 1), and ``trace_len``.

    A trace may be a whole host, so its events are ordered within spans of time; only the counts of the spans are
    added up over the trace.
    """
    return _placed(events, "trace_id", span_us).withColumnsRenamed({"__place": "g", "__len": "trace_len"})


def _placed(events: DataFrame, by: str, span_us: int) -> DataFrame:
    """Adds ``__place`` of an event among all of ``by`` (from 1) and ``__len``, how many there are."""
    span = F.expr(f"ts_us div {span_us}")
    counts = events.groupBy(F.col(by).alias("__by"), span.alias("__of")).agg(F.count("*").alias("__n"))
    order = Window.partitionBy("__by").orderBy("__of")
    before = F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__by", "__of", before.alias("__before"), F.sum("__n").over(Window.partitionBy("__by")).alias("__len"))
    local = F.row_number().over(Window.partitionBy(by, "__span").orderBy(*ORDER))
    both = events.withColumn("__span", span).withColumn("__local", local)
    met = both.join(offsets, F.col(by).eqNullSafe(F.col("__by")) & F.col("__span").eqNullSafe(F.col("__of")))
    return met.withColumn("__place", F.col("__before") + F.col("__local")).select(*events.columns, "__place", "__len")
