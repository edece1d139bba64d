from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import pytest
from hostlake.llm import repair
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def after_damage(rows):
    """Rows of each conversation in order, by the rule itself."""
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if n == 0:
            continue
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        mine += [(turn, "user" if n == 4 else role, text)] * (2 if n == 3 else 1)
    for mine in convs.values():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    return convs


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Least (cost, letters) with the roles and texts that stay, by recursion over rows and the initials so far."""

    @lru_cache(None)
    def best(i, last, empty, inserted):
        out = [(0, "", ())] if i == len(rows) and (empty or last == "a") else []
        for role in ("user", "assistant"):
            if fits(last, role[0]) and inserted < 3:
                c, letters, kept = best(i, role[0], False, inserted + 1)
                out.append((c + 2, "I" + letters, ((role, ""), *kept)))
        if i < len(rows):
            _, role, text = rows[i]
            c, letters, kept = best(i + 1, last, empty, 0)
            out.append((c + 3, "D" + letters, kept))
            if marks[i] not in ("blank", "duplicate"):
                for letter, price, name in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
                    if fits(last, name[:1]):
                        c, letters, kept = best(i + 1, name[:1], False, 0)
                        out.append((c + price + (marks[i] == "truncated"), letter + letters, ((name, text), *kept)))
        return min(out, default=(10**9, "", ()))

    def fits(last, initial):
        return initial != "" and last + initial in ("s", "u", "su", "ua", "au")

    return best(0, "", True, 0)


def slow(rows):
    out = []
    for conv, mine in after_damage(rows).items():
        marks = faults(mine)
        initials = [r[1][:1] for r in mine]
        cost, audit, kept = cheapest(tuple(mine), tuple(marks))
        turns = {r[0] for r in mine if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((conv, gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=str)


def run(spark, rows, chunk=repair.CHUNK, order=1):
    df = spark.createDataFrame(rows[::order], SCHEMA)
    df = df.withColumns({c: F.lit("x") for c in ("kind", "digest", "at", "k", "rows", "gone", "copy", "end")})
    return sorted((tuple(r) for r in repair.repaired(repair.damaged(df), chunk).collect()), key=str)


def conversations(n, longest, seed=1):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        plain = rng.random() < 0.4
        for turn in range(rng.randint(1, longest)):
            role = ("user", "assistant")[turn % 2] if plain else rng.choice(["user", "assistant", "system", "system", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "no", "well!  ", None, "", " \n", "a. b", f"t{turn}?", "é.", "é "])
            rows.append((conv * 7, rng.choice([turn, turn, turn, turn, turn * 3, None, 2]), role, text))
    return rows


@pytest.mark.parametrize("chunk", [repair.CHUNK, 2, 5])
def test_matches_recursion(spark, chunk):
    rows = conversations(80, 12)
    assert run(spark, rows, chunk, order=-1) == slow(rows)


def test_long_conversations_in_chunks(spark):
    rows = conversations(3, 120, seed=9) + [(1000, t, "system", f"s{t}.") for t in range(90)] + [(1001, t, "user", "same") for t in range(60)]
    want = slow(rows)
    assert run(spark, rows, 7) == want
    assert run(spark, rows) == want


def test_recursion_against_every_edit():
    """The recursion of these tests holds against all edits of very short conversations."""
    rng = random.Random(4)
    gaps = [g for k in range(3) for g in product("ua", repeat=k)]
    for _ in range(40):
        rows = [(t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["x.", "y", "", "x."])) for t in range(rng.randint(0, 2))]
        marks = faults(rows)
        found = []
        choices = [[("D", 3, "")] + ([("K", 0, r[1][0]), ("R", 2, "u"), ("R", 2, "a")] if m in ("", "truncated") else []) for r, m in zip(rows, marks, strict=True)]
        for edits in product(*choices):
            for inserted in product(gaps, repeat=len(rows) + 1):
                roles, letters, cost = "".join(inserted[0]), "I" * len(inserted[0]), 2 * len(inserted[0])
                for (letter, price, role), mark, more in zip(edits, marks, inserted[1:], strict=True):
                    roles, letters = roles + role + "".join(more), letters + letter + "I" * len(more)
                    cost += price + 2 * len(more) + (mark == "truncated" and letter != "D")
                if re.fullmatch("(s?(ua)+)?", roles):
                    found.append((cost, letters))
        assert min(found) == cheapest(tuple(rows), tuple(marks))[:2]


def test_edges(spark):
    assert run(spark, []) == []
    none = hashlib.sha256(b"").hexdigest()
    dropped = next(t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert run(spark, [(5, dropped, "user", "Hi.")]) == [(5, 0, 0, 0, 0, 0, 0, "", none)]
    rows = [(None, None, None, None), (None, 3, "user", "q?"), (6, -(2**62), "user", "q?"), (6, 2**62, "assistant", "a" * 300_000 + "."), (7, None, "user", "x."), (7, None, "user", "x.")]
    assert run(spark, rows, 1) == slow(rows)


def test_a_row_that_is_repeated_many_times(spark):
    rows = [(1, 4, "user", "again.")] * 500 + [(1, 5, "assistant", "so.")]
    got = run(spark, rows, 64)
    assert got == run(spark, rows) and got[0][7].count("D") >= 499


def test_costs_stop_where_vectors_agree():
    costs = repair.Costs()
    rows = "".join(random.Random(2).choice("bcbcbcdgfi") for _ in range(5000))
    end, guess = costs.number(repair.AT_END), costs.number(repair.GUESS)
    begin = costs.begin(rows, guess)
    assert costs.fixed(rows, guess, end, begin) == costs.begin(rows, end)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in repair.op11_repair(spark, sf).collect()), key=str) == slow(rows)
