from __future__ import annotations

import random
import re

from hostlake.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, body string, rid int"


def parsed(text):
    """(depth, passage) of the runs and lines of a text, and its own lines."""
    out, run, own = [], None, []
    lines = [] if text is None else text.split("\n")

    def close():
        nonlocal run
        if run:
            out.append((run[0], " ".join(run[1])))
            if len(run[1]) > 1:
                out.extend((run[0], b) for b in run[1])
        run = None

    for line in lines:
        m = re.match(quotes.MARKS, line)
        depth = m.group(0).count(">") if m else 0
        body = " ".join(line[m.end() if m else 0 :].lower().split())
        if re.match(quotes.ANNOUNCED, line) or not any(c.isalnum() for c in body):
            close()
        else:
            if run and run[0] != depth:
                close()
            run = run or (depth, [])
            run[1].append(body)
        if not m and not re.match(quotes.ANNOUNCED, line):
            own.append(line)
    close()
    return out, None if text is None else re.sub(r"\s+\Z", "", re.sub(r"\A(?:[ \t\r]*\n)+", "", "\n".join(own)))


def slow(rows):
    got = {}
    by_conv = {}
    for c, t, _, text in rows:
        by_conv.setdefault(c, []).append((t, *parsed(text)))
    for c, messages in by_conv.items():
        messages.sort()
        parent, root, depth = {}, {}, {}
        for t, found, body in messages:
            votes, quoted, linked = {}, 0, 0
            for d, p in found:
                if not d:
                    continue
                quoted += 1
                origin = max((u for u, f, _ in messages if u < t and (0, p) in f), default=None)
                if origin is not None:
                    linked += 1
                    votes[d, origin] = votes.get((d, origin), 0) + 1
            best = min(((d, -n, -u) for (d, u), n in votes.items()), default=None)
            parent[t] = None if best is None else -best[2]
            root[t], depth[t] = (t, 0) if best is None else (root[parent[t]], depth[parent[t]] + 1)
            got[c, t] = [body, parent[t], root[t], depth[t], quoted, linked, None]
        for n, t in enumerate(sorted(parent, key=lambda t: (root[t], t))):
            got[c, t][6] = n
    return {k: tuple(v) for k, v in got.items()}


def run(spark, rows):
    df = spark.createDataFrame([(*r, "b", 1) for r in rows], SCHEMA)
    return {(r.conv_id, r.turn): (r.body, r.parent_turn, r.root_turn, r.reply_depth, r.n_quotes, r.n_linked, r.position) for r in quotes.linked_conversations(df).collect()}


def test_thread(spark):
    rows = [
        (1, 0, "user", "How do I sort?\nA long list."),
        (1, 1, "user", "Unrelated."),
        (1, 2, "assistant", "On Monday, X wrote:\n> how do I  SORT?\n> A long list.\n\nUse sorted.\n"),
        (1, 3, "user", ">> How do I sort?\n> Use sorted.\nThanks"),
        (1, 4, "user", "> nobody said this\nHm"),
        (2, 0, "user", "> Use sorted.\nother conversation"),
    ]
    got = run(spark, rows)
    assert got == slow(rows)
    assert got[1, 2][:4] == ("Use sorted.", 0, 0, 1) and got[1, 3][:4] == ("Thanks", 2, 0, 2)
    assert [k for k in sorted(got, key=lambda k: got[k][6]) if k[0] == 1] == [(1, 0), (1, 2), (1, 3), (1, 1), (1, 4)]


def test_matches_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for c in range(6):
        said = []
        for t in range(40 if c else 300):
            lines = []
            for _ in range(rng.randrange(3)):
                if said and rng.random() < 0.7:
                    lines += [">" * rng.randrange(1, 4) + rng.choice(("", " ")) + x for x in rng.choice(said).split("\n")]
            own = "\n".join(f"w{rng.randrange(60)} said" for _ in range(rng.randrange(1, 4)))
            said.append(own)
            rows.append((c, t, "user", "\n".join([*lines, own])))
    assert run(spark, rows) == slow(rows)


def test_many_marks_and_long_lines(spark):
    many = ">" * 100_000 + " deep words"
    rows = [("c", 1, "u", "deep words"), ("c", 2, "u", many), ("c", 3, "u", "> " * 50_000), ("c", None, "u", "x " * 200_000)]
    got = {r.turn: r for r in quotes.linked_conversations(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()}
    assert got[2].parent_turn == 1 and got[2].n_linked == 1 and got[3].n_quotes == 0 and len(got) == 4


def test_long_threads_and_repeated_turns(spark, monkeypatch):
    """Positions and origins with runs of three turns, against an ordering of everything at once."""
    monkeypatch.setattr(quotes, "RUN", 3)
    rows = [("c", t, "u", f"line {t % 4}" if t % 3 else f"> line {t % 4}\nown {t}") for t in range(20)] + [("c", 5, "u", f"again {i}") for i in range(6)] + [("d", None, "u", str(i)) for i in range(5)]
    got = quotes.linked_conversations(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()
    for c in "cd":
        own = sorted((r for r in got if r.conv_id == c), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        key = [(r.root_turn if r.root_turn is not None else -1, r.turn if r.turn is not None else -1) for r in own]
        assert key == sorted(key)
    for r in got:
        if r.conv_id == "c" and r.turn % 3 == 0:
            before = [t for t in range(r.turn) if t % 3 and t % 4 == r.turn % 4]
            assert r.parent_turn == (before[-1] if before else None)


def test_edges(spark):
    assert run(spark, []) == {}
    got = run(spark, [(1, 0, None, None), (None, 0, "user", "> x\ny"), (1, 5, "user", ""), (2, 1, "user", "> z\n" * 20_000)])
    assert got[1, 0][0] is None and got[None, 0][:2] == ("y", None) and got[1, 5][0] == "" and got[2, 1][4] == 20_001
    df = spark.createDataFrame([(1, 3, "user", "a"), (1, 3, "user", "a"), (1, None, "user", "> a"), (1, 4, "user", "> a")], "conv_id long, turn long, role string, text string")
    rows = quotes.linked_conversations(df).collect()
    assert sorted(r.position for r in rows) == [0, 1, 2, 3] and [r.parent_turn for r in rows if r.turn == 4] == [3]
    assert [r.n_linked for r in rows if r.turn is None] == [0]


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {(r.conv_id, r.turn): (r.body, r.parent_turn, r.root_turn, r.reply_depth, r.n_quotes, r.n_linked, r.position) for r in quotes.op4_quotes(spark, sf).collect()}
    assert got == slow(rows)
