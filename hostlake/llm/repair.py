"""Conversation structure repair: the cheapest edits that bring a conversation's turns into order, by parallel Viterbi.

A repaired conversation has role initials ``(s?(ua)+)?``; what has been read of it is one of four states (START, after s,
after u, after a). Rows are kept, rerolled or deleted, turns inserted. The cost of what follows, as a vector over the
states, is computed backwards, chunk by chunk and all chunks at once: each starts from a guess at the vector that its successor hands
on, and fix-up passes run it again, from the vector that the successor has by now, until both runs' vectors
differ only by a constant, from where on the earlier run stays right. Costs fix, for each state in
which a chunk may be entered, which edits follow; the entries are stitched in the order of the chunks.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlake.llm.runtime import small_batches, staged, table

#: Rows of a chunk; a row of it is one character.
CHUNK = 1 << 18
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = "sua"  # kinds of rows by the initial of their role; 3 is any other
FINE, CUT, BLANK, AGAIN = range(4)  # faults of a row; the character of a row is 'a' + kind + 4 * fault
NEXT = (2, 2, 3, 2)  # the state after a user or assistant turn that fits
KEPT = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None,) * 4)  # by kind, then state
NAMES = (None, "system", "user", "assistant")
CLOSING = ("", "II", "I", "")  # edits that end a conversation in this state
#: Costs of what follows the last row, and the guess of a chunk that has a successor.
AT_END, GUESS = (0, 4, 2, 0), (0, 0, 0, 0)
FAR = 1 << 30
BLANKS = " \t\n\x0b\x0c\r"


class Costs:
    """Cost vectors up to a constant, numbered as they turn up (they are few, as edits bound their differences), and where rows take them."""

    def __init__(self) -> None:
        self.vectors: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.choices: dict[tuple[int, str], list[tuple[str, int]]] = {}

    def number(self, vector: tuple) -> int:
        low = min(vector)
        vector = tuple(v - low for v in vector)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.moves.append({})
        return self.numbers[vector]

    def before(self, after: int, row: str) -> int:
        """The vector before a row, given the one after it."""
        found = self.moves[after].get(row)
        if found is None:
            found = self.moves[after][row] = self._met(after, row)
        return found

    def _met(self, after: int, row: str) -> int:
        then = self.vectors[after]
        fault, kind = divmod(ord(row) - 97, 4)
        late = TRUNCATED if fault == CUT else 0
        doomed = fault in (BLANK, AGAIN)
        to = [KEPT[kind][s] for s in range(4)]
        ways = [[("D", DELETE + then[s], s), ("K", FAR if doomed or to[s] is None else KEEP + late + then[to[s]], to[s]), ("R", FAR if doomed else REROLE + late + then[NEXT[s]], NEXT[s])] for s in range(4)]
        best = [min(cost for _, cost, _ in w) for w in ways]
        best[2], best[3] = min(best[2], INSERT + best[3]), min(best[3], INSERT + best[2])
        best[0], best[1] = min(best[0], INSERT + best[2]), min(best[1], INSERT + best[2])
        # of the cheapest edits those with the least letters, D before I before K before R
        picks: list[tuple[str, int]] = []
        for s in range(4):
            letters, at = "", s
            while True:
                cheapest = [(letter, to) for letter, cost, to in ways[at] if cost == best[at]]
                if cheapest and cheapest[0][0] == "D":
                    break
                if INSERT + best[NEXT[at]] == best[at]:
                    letters, at = letters + "I", NEXT[at]
                    continue
                break
            picks.append((letters + cheapest[0][0], cheapest[0][1]))
        self.choices[after, row] = picks
        return self.number(tuple(best))

    def begin(self, rows: str, end: int) -> int:
        for row in reversed(rows):
            end = self.before(end, row)
        return end

    def fixed(self, rows: str, guessed: int, end: int, begin: int) -> int:
        """The vector before ``rows`` when ``end`` follows them, given the one (``begin``) that was found for ``guessed``."""
        for row in reversed(rows):
            if guessed == end:
                return begin
            guessed, end = self.before(guessed, row), self.before(end, row)
        return end

    def traced(self, rows: str, end: int, entries: range) -> list[tuple[str, int]]:
        """Edits and last state for each state in which ``rows`` are entered."""
        after = [end]
        for row in reversed(rows[1:]):
            after.append(self.before(after[-1], row))
        for a, row in zip(reversed(after), rows, strict=True):
            self.before(a, row)
        out = []
        for state in entries:
            letters = []
            for row, a in zip(rows, reversed(after), strict=True):
                part, state = self.choices[a, row][state]
                letters.append(part)
            out.append(("".join(letters), state))
        return out


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as the query damages them: ``conv_id``, ``turn``, ``role``, ``text`` (null: one space) and ``gone`` (dropped rows, with no text)."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy"))
    return rows.drop("copy")


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def _kind(role: Column) -> Column:
    initial = F.substring(role, 1, 1)
    return F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)


def chunks_of(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows of each conversation in order (turn, nulls first, then role and digest), in chunks of at most ``size``.

    Rows that agree in everything are counted first, so that one that is repeated a great many times is one row here. Ranges of
    (conv_id, turn, role, digest) go to tasks, so a long conversation is spread. Returns the chunk's first key, ``at`` (its place), ``rows``
    (a character each), and what counts need: ``illegal`` within it, its first and last kind, its turns.
    """
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(CUT)
    key = ["conv_id", "turn", "role", "digest"]
    light = rows.select("conv_id", "turn", "role", _digest("text").alias("digest"), fault.alias("fault"))
    light = light.groupBy(*key).agg(F.count("*").alias("n"), F.min("fault").alias("fault"))
    # the first turn of words that occur in several turns
    firsts = light.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    firsts = firsts.select(*(F.col(c).alias(f"{c}_of") for c in ("conv_id", "role", "digest")), "first")
    met = light.join(firsts, F.col("conv_id").eqNullSafe(F.col("conv_id_of")) & (F.col("role") == F.col("role_of")) & (F.col("digest") == F.col("digest_of")), "left")
    later = F.col("first").isNotNull() & (F.struct("turn") > F.col("first"))
    fault = F.when(F.col("fault") == BLANK, BLANK).when(later, AGAIN).otherwise(F.col("fault"))
    marked = met.select(*key, "n", fault.alias("fault"), _kind(F.col("role")).alias("kind"))
    ordered = marked.repartitionByRange(*key).sortWithinPartitions(*key)
    kind_of = marked.schema["conv_id"].dataType
    names = [*key, "at", "rows", "illegal", "first_kind", "last_kind", "turns", "last_turn"]
    legal = {(0, 1), (1, 2), (2, 1)}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        conv, open_ = None, None

        def done() -> list:
            nonlocal at
            text = "".join(open_["rows"])
            kinds = [(ord(c) - 97) % 4 for c in text]
            illegal = sum(n for pair, n in Counter(zip(kinds, kinds[1:], strict=False)).items() if pair not in legal)
            at += 1
            return [*open_["key"], at, text, illegal, kinds[0], kinds[-1], open_["turns"], open_["last_turn"]]

        for batch in batches:
            out = []
            for its, turn, role, digest, n, fault, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left, first = n, True
                while left:
                    if open_ is not None and (its != conv or open_["size"] >= size):
                        out.append(done())
                        open_ = None
                    if open_ is None:
                        conv, open_ = its, {"key": [its, turn, role, digest], "rows": [], "size": 0, "turns": 0, "last_turn": None}
                    # what follows the first of equal rows is a repetition
                    some = 1 if first else min(left, size - open_["size"])
                    open_["rows"].append(chr(97 + kind + 4 * (fault if first or fault == BLANK else AGAIN)) * some)
                    open_["size"] += some
                    if turn is not None and turn != open_["last_turn"]:
                        open_["turns"] += 1
                        open_["last_turn"] = turn
                    left, first = left - some, False
            if out:
                yield _batch(out, names, kind_of)
        if open_ is not None:
            yield _batch([done()], names, kind_of)

    schema = f"conv_id {kind_of.simpleString()}, turn long, role string, digest binary, at long, rows string, illegal long, first_kind int, last_kind int, turns long, last_turn long"
    made = ordered.select(*key, "n", "fault", "kind").mapInArrow(each, schema)
    order = Window.partitionBy("conv_id").orderBy("at")
    return made.withColumns({
        "k": F.row_number().over(order),
        "chunks": F.count("*").over(Window.partitionBy("conv_id")),
        "kind_before": F.lag("last_kind").over(order),
        "turn_before": F.lag("last_turn").over(order),
    })


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _batch(rows: list[list], names: list[str], conv_kind) -> pa.RecordBatch:
    kinds = {"conv_id": _arrow(conv_kind), "turn": pa.int64(), "role": pa.string(), "digest": pa.binary(), "at": pa.int64(), "rows": pa.string(), "illegal": pa.int64(), "first_kind": pa.int32(), "last_kind": pa.int32(), "turns": pa.int64(), "last_turn": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names=names)


def with_costs(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``end``, the cost vector (up to a constant) of what follows each chunk.

    Conversations of one chunk have it at once. Of longer ones every chunk runs from a guess, then those whose successor now begins with
    another vector than they ended with run again, until there are none. A pass mostly ends within a few rows of a chunk, where both runs agree.
    """
    alone = chunks.where("chunks = 1").withColumn("end", F.array(*map(F.lit, AT_END)))
    many = chunks.where("chunks > 1")
    if many.isEmpty():
        return alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = Costs()
        for batch in batches:
            rows, old, new, begin = (batch.column(c).to_pylist() for c in ("rows", "end", "wanted", "begin"))
            out = []
            for text, was, end, start in zip(rows, old, new, begin, strict=True):
                number = costs.number(tuple(end))
                found = costs.begin(text, number) if start is None else costs.fixed(text, costs.number(tuple(was)), number, costs.number(tuple(start)))
                out.append(list(costs.vectors[found]))
            kind = pa.list_(pa.int32())
            keep = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(new, kind), pa.array(out, kind)], names=[*names, "end", "begin"])

    names = chunks.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema) + ", end array<int>, begin array<int>"
    last = F.col("k") == F.col("chunks")
    none = F.lit(None).cast("array<int>")
    first = many.withColumns({"end": none, "begin": none, "wanted": F.when(last, F.array(*map(F.lit, AT_END))).otherwise(F.array(*map(F.lit, GUESS)))})
    order = Window.partitionBy("conv_id").orderBy("k")
    now = staged(first.mapInArrow(run, schema))
    while True:
        asked = now.withColumn("wanted", F.when(last, F.col("end")).otherwise(F.lead("begin").over(order)))
        if asked.where("wanted <> end").isEmpty():
            return alone.unionByName(now.select(*names, "end"))
        now = staged(asked.mapInArrow(run, schema))


def repaired(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per conversation of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``, ``gone``): counts of faults, ``cost``, ``audit`` and ``repaired_sha256``.

    Rows are taken by turn, nulls first; those of one turn by role, then by the SHA-256 of their text, both ascending. Rows that are ``gone``
    only keep their conversation in the result. A null conv_id is a conversation like any other. An empty table gives no rows.
    A conversation without rows has zeros, an empty audit and the hash of the empty string.

    The texts of a conversation pass through one task in order, since a SHA-256 goes from its begin to its end, but only one batch of them is held at a time.
    """
    small_batches(rows.sparkSession)
    kind_of = rows.schema["conv_id"].dataType
    chunks = with_costs(staged(chunks_of(rows.where("NOT gone"), chunk)))
    names = chunks.columns

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = Costs()
        for batch in batches:
            letters, exits = [], []
            for text, end, k in zip(*(batch.column(c).to_pylist() for c in ("rows", "end", "k")), strict=True):
                found = costs.traced(text, costs.number(tuple(end)), range(1 if k == 1 else 4))
                letters.append([part for part, _ in found])
                exits.append([state for _, state in found])
            keep = [batch.column(names.index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(letters, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32()))], names=[*names, "letters", "exits"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema) + ", letters array<string>, exits array<int>"
    traced = chunks.mapInArrow(trace, schema)
    count = lambda fault: (F.length("rows") - F.length(F.translate("rows", "".join(chr(97 + kind + 4 * fault) for kind in range(4)), ""))).cast("long")
    joint = F.when(F.col("kind_before").isNull() | F.concat_ws(",", "kind_before", "first_kind").isin("0,1", "1,2", "2,1"), 0).otherwise(1)
    same_turn = F.coalesce(F.col("turn") == F.col("turn_before"), F.lit(False)).cast("long")
    stats = F.array(count(BLANK), count(AGAIN), count(CUT), F.col("illegal") + joint, F.col("turns") - same_turn)
    order = ["conv_id", "turn", "role", "digest", "kind", "at"]
    edits = traced.select("conv_id", "turn", "role", "digest", F.lit(0).alias("kind"), "at", "rows", "letters", "exits", stats.alias("stats"), F.lit(None).cast("string").alias("text"))
    none = {"rows": "string", "letters": "array<string>", "exits": "array<int>", "stats": "array<bigint>"}
    texts = rows.select("conv_id", "turn", "role", _digest("text").alias("digest"), F.when(F.col("gone"), 2).otherwise(1).alias("kind"), F.lit(0).cast("long").alias("at"), *(F.lit(None).cast(t).alias(c) for c, t in none.items()), "text")
    both = edits.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order)
    out_names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [_arrow(kind_of), *[pa.int64()] * 6, pa.string(), pa.string()]

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now = None, None
        for batch in batches:
            done = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "kind", "rows", "letters", "exits", "stats", "text"))
            for its, turn, role, kind, codes, letters, exits, stats, text in zip(*columns, strict=True):
                if now is None or its != conv:
                    if now is not None:
                        done.append([conv, *now.result()])
                    conv, now = its, _Repair()
                if kind == 0:
                    now.chunk(codes, letters, exits, stats)
                elif kind == 1:
                    now.row(turn, role, text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=out_names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([conv, *now.result()], kinds, strict=True)], names=out_names)

    fields = f"conv_id {kind_of.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return both.mapInArrow(follow, fields)


class _Repair:
    """A conversation as its chunks and rows come by in order; a chunk comes before its rows."""

    def __init__(self) -> None:
        self.entry, self.state = 0, 0
        self.letters: list[str] = []
        self.which, self.place = 0, 0
        self.stats = [0] * 5
        self.low: int | None = None
        self.high: int | None = None
        self.cut = 0
        self.hash, self.empty = hashlib.sha256(), True

    def chunk(self, codes: str, letters: list[str], exits: list[int], stats: list[int]) -> None:
        chosen = letters[self.entry]
        self.letters.append(chosen)
        edits = chosen.replace("I", "") if "I" in chosen else chosen
        if "D" in edits:
            self.cut += sum(1 for c, e in zip(codes, edits, strict=True) if e != "D" and 97 + 4 * CUT <= ord(c) < 101 + 4 * CUT)
        else:
            self.cut += stats[2]
        self.entry = exits[self.entry]
        self.stats = [a + b for a, b in zip(self.stats, stats, strict=True)]

    def put(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def step(self) -> None:
        self.state = NEXT[self.state]

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.high = turn
        while True:
            while self.place == len(self.letters[self.which]):
                self.which, self.place = self.which + 1, 0
            letter = self.letters[self.which][self.place]
            self.place += 1
            if letter == "I":
                self.step()
                self.put(NAMES[self.state], "")
                continue
            if letter == "R":
                self.step()
                self.put(NAMES[self.state], text)
            elif letter == "K":
                self.state = KEPT[ROLES.index(role[0])][self.state]
                self.put(role, text)
            return

    def result(self) -> list:
        closing = CLOSING[self.state]
        for _ in closing:
            self.step()
            self.put(NAMES[self.state], "")
        audit = "".join(self.letters) + closing
        cost = DELETE * audit.count("D") + REROLE * audit.count("R") + INSERT * audit.count("I") + TRUNCATED * self.cut
        blank, again, cut, illegal, turns = self.stats
        gaps = 0 if self.low is None else self.high - self.low + 1 - turns
        return [min(gaps, (1 << 63) - 1), blank, again, cut, illegal, cost, audit, self.hash.hexdigest()]


def op11_repair(spark, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))


QUERIES = {"op11_repair": op11_repair}
