"""Streams that keep state per process: events in order, the gate, windows and rules, whatever batches the events come in.

All processors here run in transformWithState, whose state lies in RocksDB; ``durable_state`` chooses that store for the session.
Events carry ``ts_us`` and ``event_id``, and ``ts`` (timestamp) under a watermark set by the caller. Out-of-order events are
held until the watermark has passed them, then taken in the order (ts_us, event_id); so results are those of the batch operators for any
split into batches. What arrives behind the watermark is handed on with ``late`` set and touches no state.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hostlake.config import DEFAULT
from hostlake.operators import graph, scores, tiers
from hostlake.operators.rules import Forbidden, Sequel, staged_hit
from hostlake.operators.sequence import early_trigger, late_trigger

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def durable_state(spark: SparkSession) -> None:
    """State of this session's streams lies in RocksDB, as transformWithState asks."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _ms(idle: str) -> int:
    return int(pd.Timedelta(idle).total_seconds() * 1000)


class Ordered(StatefulProcessor):
    """Holds a key's events until the watermark has passed them and gives them to ``follow`` in order.

    ``fields`` are the columns (name, type) of an event, among them ts_us and event_id. Subclasses say what state they keep
    (``begin``), what becomes of an event (``follow``: a list of rows to give out) and which columns they add to late ones.
    Once a key has had no event for ``idle``, its state goes (``end``).
    """

    def __init__(self, fields: list[tuple[str, str]], out: list[str], idle: str | None) -> None:
        self.names = [n for n, _ in fields]
        self.schema = ", ".join(f"{n} {t}" for n, t in fields)
        self.out, self.idle_ms = out, None if idle is None else _ms(idle)
        self.at, self.by = self.names.index("ts_us"), self.names.index("event_id")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)
        self.marks = handle.getValueState("marks", "earliest long, latest long")
        self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> None: ...

    def follow(self, key: tuple, events: list[tuple]) -> list[tuple]:
        raise NotImplementedError

    def end(self) -> None: ...

    def close(self) -> None: ...

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        came = [tuple(None if v is pd.NA or v != v else v for v in r) for df in rows for r in df[self.names].astype(object).itertuples(index=False, name=None)]
        late = [r for r in came if r[self.at] // 1000 <= mark]
        good = [r for r in came if r[self.at] // 1000 > mark]
        if late:
            yield self.frame(key, [self.passed(r) for r in late], True)
        earliest, latest = self.marks.get() if self.marks.exists() else (None, 0)
        if good:
            self.held.appendList(good)
            first = min(r[self.at] for r in good)
            if earliest is None or first < earliest:
                self.handle.registerTimer(first // 1000)
                earliest = first
            latest = max(latest, max(r[self.at] for r in good))
            self.marks.update((earliest, latest))
        yield from self.released(key, earliest, latest, mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        if self.marks.exists():
            earliest, latest = self.marks.get()
            yield from self.released(key, earliest, latest, mark)
            if self.idle_ms is not None and not self.held.exists() and latest // 1000 + self.idle_ms <= mark:
                self.marks.clear()
                rows = self.end()
                if rows:
                    yield self.frame(key, rows, False)

    def released(self, key, earliest: int | None, latest: int, mark: int) -> Iterator[pd.DataFrame]:
        if earliest is None or earliest // 1000 > mark:
            return
        rows = list(self.held.get())
        ready = sorted((r for r in rows if r[self.at] // 1000 <= mark), key=lambda r: (r[self.at], r[self.by]))
        rest = [r for r in rows if r[self.at] // 1000 > mark]
        if rest:
            self.held.put(rest)
            earliest = min(r[self.at] for r in rest)
            self.handle.registerTimer(earliest // 1000)
        else:
            self.held.clear()
            earliest = None
            if self.idle_ms is not None:
                self.handle.registerTimer(latest // 1000 + self.idle_ms)
        self.marks.update((earliest, latest))
        out = self.follow(key, ready)
        if out:
            yield self.frame(key, out, False)

    def passed(self, row: tuple) -> tuple:
        """A late row as it is given out: its own columns, then nulls."""
        own = dict(zip(self.names, row, strict=True))
        return tuple(own.get(n) for n in self.out)

    def frame(self, key: tuple, rows: list[tuple], late: bool) -> pd.DataFrame:
        out = pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(self.out, zip(*rows, strict=True), strict=True)})
        out.insert(0, "pid", key[0])
        out["late"] = late
        return out


def _run(events: DataFrame, keys: list[str], columns: list[str], processor, schema: str, mode: str = "EventTime") -> DataFrame:
    """``events`` through a processor. Only plain columns go in: Spark itself would drop late rows by the column that has the watermark."""
    durable_state(events.sparkSession)
    return events.select(*dict.fromkeys([*keys, *columns])).groupBy(*keys).transformWithStateInPandas(processor, schema, "append", mode)


class _Running:
    """The last ``w`` classes and transitions of a process, with sums from which entropies follow; each event changes a few terms."""

    def __init__(self, recent: list[int], w: int) -> None:
        self.w, self.recent = w, []
        self.n: dict = {}
        self.sums = [0.0, 0.0, 0.0]  # of x log x over classes, transitions, and first classes of transitions
        for c in recent:
            self.add(c)

    def _change(self, which: int, key, by: int) -> None:
        x = self.n.get((which, key), 0)
        y = x + by
        self.sums[which] += (y * log2(y) if y else 0.0) - (x * log2(x) if x else 0.0)
        if y:
            self.n[which, key] = y
        else:
            del self.n[which, key]

    def add(self, c: int) -> None:
        if self.recent:
            self._change(1, (self.recent[-1], c), 1)
            self._change(2, self.recent[-1], 1)
        self.recent.append(c)
        self._change(0, c, 1)
        if len(self.recent) > self.w:
            self._change(0, self.recent[-self.w - 1], -1)
        if len(self.recent) > self.w + 1:
            a, b = self.recent[0], self.recent[1]
            self._change(1, (a, b), -1)
            self._change(2, a, -1)
            del self.recent[0]

    def values(self) -> tuple[int | None, float, float]:
        """Class before, bits of the class, entropy rate."""
        n, pairs = min(len(self.recent), self.w), len(self.recent) - 1
        bits = log2(n) - self.sums[0] / n
        rate = (self.sums[2] - self.sums[1]) / pairs if pairs else 0.0
        return (self.recent[-2] if pairs else None), round(bits, 6) + 0.0, round(rate, 6) + 0.0


class Gate(Ordered):
    """Entropies and filled windows per process; keeps its last ``w`` + 1 classes."""

    def __init__(self, w: int, window: int, idle: str | None) -> None:
        super().__init__([("event_id", "long"), ("ts_us", "long"), ("comm", "string"), ("sc_type", "int"), ("hint", "string")], ["event_id", "ts_us", "comm", "sc_type", "hint", "prev", "entropy", "markov_entropy", "filled"], idle)
        self.w, self.window = w, window

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "classes array<int>, seen int")

    def follow(self, key: tuple, events: list[tuple]) -> list[tuple]:
        classes, seen = self.recent.get() if self.recent.exists() else ([], 0)
        now, out = _Running(list(classes), self.w), []
        for event_id, ts_us, comm, sc_type, hint in events:
            now.add(int(sc_type))
            seen = min(seen + 1, self.window)
            out.append((event_id, ts_us, comm, sc_type, hint, *now.values(), seen))
        self.recent.update((now.recent, seen))
        return out

    def end(self) -> None:
        self.recent.clear()


class Novelty(StatefulProcessor):
    """Whether an event is the first of its (comm, class), and of its (comm, class before, class). Nothing is ever forgotten: a name has at most 16 x 16 entries."""

    OUT = ("event_id", "pid", "ts_us", "prev", "entropy", "markov_entropy", "early", "late")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.edge = handle.getValueState("edge", "seen boolean")
        self.before = handle.getMapState("before", "prev int", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows)).sort_values(["ts_us", "event_id"])
        edges, transitions = [], []
        met = self.edge.exists()
        for early, late, prev in zip(came["early"], came["late"], came["prev"], strict=True):
            edge = transition = False
            if not late and (early is None or early != early):
                edge, met = not met, True
                place = (-1 if prev is None or prev != prev else int(prev),)
                transition = not self.before.containsKey(place)
                if transition:
                    self.before.updateValue(place, (True,))
            edges.append(edge)
            transitions.append(transition)
        if met:
            self.edge.update((True,))
        out = came[list(self.OUT)].copy()
        out["prev"] = out["prev"].astype("Int32")
        out.insert(0, "sc_type", key[1])
        out.insert(0, "comm", key[0])
        out["novel_edge"], out["novel_transition"] = edges, transitions
        yield out

    def close(self) -> None: ...


def triage(events: DataFrame, hint: Column | None = None, idle: str | None = "1 hour", config=DEFAULT) -> DataFrame:
    """The gate of sequence.triage over a stream: ``entropy``, ``markov_entropy``, ``prev``, ``novel_edge``, ``novel_transition``, ``trigger``, ``late`` per event.

    ``hint`` is 'callsite' or 'flagged_parent' where an earlier stage has marked the event; a hard trigger is found here. Two
    chained stages: by process, then by name and class. A process that had no event for ``idle`` (null: never) begins anew. Late events have no values and trigger 'late'.
    """
    hint = F.lit(None).cast("string") if hint is None else hint
    marked = events.withColumn("hint", early_trigger(hint == "callsite", hint == "flagged_parent"))
    kept = "pid long, event_id long, ts_us long, comm string, sc_type int, hint string, prev int, entropy double, markov_entropy double, filled int, late boolean"
    seen = _run(marked, ["pid"], ["event_id", "ts_us", "comm", "sc_type", "hint"], Gate(config.entropy_window, config.window, idle), kept)
    seen = seen.withColumn("early", F.coalesce("hint", F.when(F.col("filled") < config.window, "skip")))
    out = "comm string, sc_type int, event_id long, pid long, ts_us long, prev int, entropy double, markov_entropy double, early string, late boolean, novel_edge boolean, novel_transition boolean"
    both = _run(seen, ["comm", "sc_type"], list(Novelty.OUT), Novelty(), out, "None")
    return both.withColumn("trigger", F.when(F.col("late"), "late").otherwise(F.coalesce("early", late_trigger(config)))).drop("early")


class Windows(Ordered):
    """Cuts a process's events into windows of ``n``; keeps the open window and its number."""

    def __init__(self, fields: list[tuple[str, str]], n: int, idle: str | None) -> None:
        super().__init__(fields, [*(f for f, _ in fields), "wid", "idx"], idle)
        self.n = n

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", self.schema)
        self.number = handle.getValueState("number", "wid long")

    def follow(self, key: tuple, events: list[tuple]) -> list[tuple]:
        wid = self.number.get()[0] if self.number.exists() else 0
        rows = [*self.open.get(), *events] if self.open.exists() else events
        whole = len(rows) // self.n * self.n
        out = [(*r, wid + i // self.n, i % self.n) for i, r in enumerate(rows[:whole])]
        if rows[whole:]:
            self.open.put(rows[whole:])
        else:
            self.open.clear()
        self.number.update((wid + whole // self.n,))
        return out

    def end(self) -> None:
        """The events of an open window go; numbers stay, so that no two windows of a process share one."""
        self.open.clear()


def windowed(events: DataFrame, columns: tuple[str, ...], n: int = 20, idle: str | None = None) -> DataFrame:
    """Rows of complete windows of ``n`` events per process: ``pid``, ``columns``, ``wid``, ``idx`` as windows.tumbling_windows numbers them, and ``late`` rows with neither.

    A window is given out whole once its last event is in order, however many batches it took. ``columns`` must hold ts_us and event_id.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    fields = [(c, kinds[c]) for c in columns]
    schema = f"pid {kinds['pid']}, " + ", ".join(f"{c} {t}" for c, t in fields) + ", wid long, idx int, late boolean"
    return _run(events, ["pid"], list(columns), Windows(fields, n, idle), schema)


#: What windows are decided by.
DECIDED_BY = ("event_id", "ts_us", "ppid", "uid", "comm", "sc_type", "resource", "ip", "trace_id")


def decisions(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """A query that cuts events into windows, scores, classifies and routes them.

    It writes decisions with their tier under ``path``/decisions and late events under ``path``/late, each batch once (its number is
    in the path). A window may reach over any number of batches.
    """
    columns = tuple(c for c in DECIDED_BY if c in events.columns)
    cut = windowed(events, columns)

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        held.where("late").drop("wid", "idx", "late").write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        whole = held.where("NOT late").drop("late")
        if whole.isEmpty():
            held.unpersist()
            return
        scored = graph.provenance_score(whole)
        decided = scores.routed(scored, scores.heuristic(graph.serialized(whole)))
        tier = tiers.tier_of(F.col("confidence"), F.col("label"))
        decided.withColumn("tier", tier).write.mode("overwrite").json(f"{path}/decisions/batch={batch_id}")
        held.unpersist()

    return cut.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def split_late(rows: DataFrame, path: str, late_path: str, checkpoint: str, trigger: dict | None = None):
    """A query that writes ``rows`` to ``path`` and those that came behind the watermark (``late``) to ``late_path``, each batch once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        held.where("NOT late").drop("late").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        held.where("late").drop("late").write.mode("overwrite").parquet(f"{late_path}/batch={batch_id}")
        held.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Watch(StatefulProcessor):
    """Rules over the events of one process of a trace, by ``g``, their place in the trace.

    Waiting triggers of a rule lie in a list that is only read when an event ends their waiting; those out of their rule's span are
    dropped then, too, and by a timer when the process has been idle. What must be followed and wasn't is told at that time.
    """

    def __init__(self, spans: list[int | None], names: list[str], staged: bool, idle: str) -> None:
        # a span of None: violated by what doesn't follow
        self.spans, self.rules, self.staged, self.idle_ms = spans, names, staged, _ms(idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = [handle.getListState(f"waiting{i}", "g long") for i in range(len(self.spans))]
        self.last = handle.getValueState("last", "g long, hit boolean, timer long, sizes array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows)).sort_values("g")
        before, hit_before, timer, sizes = self.last.get() if self.last.exists() else (-1, True, None, [0] * len(self.spans))
        sizes = list(sizes)
        found: list[tuple] = []
        fresh: list[list[int]] = [[] for _ in self.spans]
        for g, starts, ends, hit in zip(came["g"].tolist(), came["starts"], came["ends"], came["hit"], strict=True):
            for i, span in enumerate(self.spans):
                if ends[i] and (sizes[i] or fresh[i]):
                    held = [r[0] for r in self.waiting[i].get()] if sizes[i] else []
                    if sizes[i]:
                        self.waiting[i].clear()
                        sizes[i] = 0
                    if span is not None:
                        found += [("found", at, g, i) for at in (*held, *fresh[i]) if not span or g - at <= span]
                    fresh[i] = []
                if starts[i]:
                    fresh[i].append(g)
            if self.staged:
                if hit:
                    found.append(("found", g, g, -1))
                    if before == g - 1 and not hit_before:
                        found.append(("found", g - 1, g, -1))
                before, hit_before = g, bool(hit)
            else:
                before = g
        for i, span in enumerate(self.spans):
            keep = [g for g in fresh[i] if not span or before - g < span]
            if sizes[i] and span:  # no more than a span of triggers is ever held
                held = [(r[0],) for r in self.waiting[i].get() if before - r[0] < span]
                self.waiting[i].put(held) if held else self.waiting[i].clear()
                sizes[i] = len(held)
            if keep:
                self.waiting[i].appendList([(g,) for g in keep])
                sizes[i] += len(keep)
        expiry = max(int(came["ts_ms"].max()), timerValues.getCurrentWatermarkInMs()) + self.idle_ms
        if timer is not None and timer != expiry:
            self.handle.deleteTimer(timer)
        if timer != expiry:
            self.handle.registerTimer(expiry)
        self.last.update((before, hit_before, expiry, sizes))
        yield self.frame(key, [*found, ("progress", before, None, -2)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        for i, span in enumerate(self.spans):
            if span is None and self.waiting[i].exists():
                out += [("absent", r[0], None, i) for r in self.waiting[i].get()]
            self.waiting[i].clear()
        self.last.clear()
        if out:
            yield self.frame(key, out)

    def frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        what, g, at_g, rule = zip(*rows, strict=True)
        return pd.DataFrame({"trace_id": key[0], "pid": key[1], "what": what, "g": g, "at_g": pd.array(at_g, "Int64"), "rule": rule})

    def close(self) -> None: ...


class Absence(StatefulProcessor):
    """Per trace: gives out what didn't follow once the trace has gone on for more than the rule's window; violations pass."""

    def __init__(self, windows: list[int]) -> None:
        self.windows = windows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.length = handle.getValueState("length", "g long")
        self.absent = handle.getListState("absent", "pid long, g long, rule int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows))
        length = self.length.get()[0] if self.length.exists() else 0
        progress = came.loc[came["what"] == "progress", "g"]
        if len(progress):
            length = max(length, int(progress.max()))
            self.length.update((length,))
        found = came.loc[came["what"] == "found", ["pid", "g", "at_g", "rule"]]
        waiting = list(self.absent.get()) if self.absent.exists() else []
        waiting += list(came.loc[came["what"] == "absent", ["pid", "g", "rule"]].itertuples(index=False, name=None))
        told = [w for w in waiting if length - w[1] + 1 > self.windows[w[2]]]
        rest = [tuple(map(int, w)) for w in waiting if length - w[1] + 1 <= self.windows[w[2]]]
        self.absent.put(rest) if rest else self.absent.clear()
        pid, g, rule = zip(*told, strict=True) if told else ((), (), ())
        absent = pd.DataFrame({"pid": pd.array(pid, "int64"), "g": pd.array(g, "int64"), "at_g": pd.array([None] * len(told), "Int64"), "rule": pd.array(rule, "int64")})
        out = pd.concat([found.astype({"at_g": "Int64"}), absent])
        out.insert(0, "trace_id", key[0])
        yield out

    def close(self) -> None: ...


def violations(events: DataFrame, forbidden: list[Forbidden] = (), following: list[Sequel] = (), staged: bool = False, idle: str = "1 hour") -> DataFrame:
    """Violations of any rules over a stream: ``trace_id``, ``pid``, ``g``, ``at_g``, ``axiom``, ``severity``, as rules.violations finds them in whole traces.

    ``events`` has ``g``, the event's place in its trace, given by its source; a process's events arrive in that order from batch to batch
    (within one they are sorted). Violations by what happens are told in the batch in which it does. That something never
    followed is told when the process has been idle (event time) and its trace has gone on for more than the rule's window. A process that
    comes back after that begins anew.
    """
    spans = [r.window for r in forbidden] + [0 if r.negate else None for r in following]
    rules = [*forbidden, *following]
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    ends = [r.forbidden for r in forbidden] + [r.sequel for r in following]
    none = F.array().cast("array<int>")
    marked = events.select(
        "trace_id", "pid", "g", F.unix_millis("ts").alias("ts_ms"),
        F.array(*(flag(r.trigger) for r in rules)).alias("starts") if rules else none.alias("starts"),
        F.array(*map(flag, ends)).alias("ends") if rules else none.alias("ends"),
        (flag(staged_hit()) if staged else F.lit(0)).alias("hit"),
    )
    if not staged and None not in spans:  # the others don't matter then
        marked = marked.where(F.array_contains("starts", 1) | F.array_contains("ends", 1))
    kind = events.schema["trace_id"].dataType.simpleString()
    names = [r.name for r in rules]
    watched = _run(marked, ["trace_id", "pid"], ["g", "ts_ms", "starts", "ends", "hit"], Watch(spans, names, staged, idle), f"trace_id {kind}, pid long, what string, g long, at_g long, rule int")
    if None in spans:
        found = _run(watched, ["trace_id"], ["pid", "what", "g", "at_g", "rule"], Absence([getattr(r, "window", 0) for r in rules]), f"trace_id {kind}, pid long, g long, at_g long, rule int", "None")
    else:
        found = watched.where("what = 'found'").drop("what")
    labels = F.array(*map(F.lit, [*names, "AX-4"]))
    grades = F.array(*map(F.lit, [*(r.severity for r in rules), "HIGH"]))
    at = F.when(F.col("rule") < 0, len(names)).otherwise(F.col("rule"))
    return found.select("trace_id", "pid", "g", "at_g", F.get(labels, at).alias("axiom"), F.get(grades, at).alias("severity"))
