from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hostlake.llm import divergence
from hostlake.llm.transducer import Transducer, build

SCHEMA = "doc_id long, text string, lang string, source string"


def slow(rows, least, ranks):
    """The rule by dictionaries."""
    df, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        df[lang].update(set(terms))
        count[lang, source].update(terms)
    out = []
    for lang, source in groups:
        kept = {t for t, n in df[lang].items() if n >= least}

        def shares(counters, kept=kept):
            total = Counter()
            for c in counters:
                total.update({t: n for t, n in c.items() if t in kept})
            whole = sum(total.values())
            return {t: 1 + 10**9 * (total[t] + 5) // (whole + 5 * len(kept)) for t in kept}

        others = [s for its, s in groups if its == lang]
        p, q = shares([count[lang, source]]), shares([count[lang, s] for s in others])
        pairs = []
        for s in others:
            if s != source:
                r = shares([count[lang, s]])
                pairs.append((-sum(abs(p[t] - r[t]) for t in kept), s.encode(), s))
        terms = [(q[t] - p[t], t.encode(), t) for t in kept if count[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
            out += [(lang, source, part, item, -value, i) for i, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    got = divergence.source_audit(df.withColumns({c: df["doc_id"] for c in ("n", "p", "ordinal", "__amount", "kinds")}), **options)
    return sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect())


def documents(n, seed=3):
    rng = random.Random(seed)
    letters = "abcDEé漢𝄞ÉǅZz"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["internationalisation", "internationals", "internationalis"]
    out = []
    for i in range(n):
        k = rng.randint(0, 30)
        text = "".join(rng.choice(words) + rng.choice([" ", "\n", "7", "_", "[", "\x7f", "\x00"]) for _ in range(k))
        out.append((i, rng.choice([text, text, text, None, ""]), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", None, "z" * 3, "solo"])))
    return out


@pytest.mark.parametrize(("run_size", "pack"), [(100_000, 64 << 20), (20, 16_000), (1, 1 << 20)])
def test_matches_dictionaries(spark, run_size, pack):
    rows = documents(120)
    assert run(spark, rows, least=4, ranks=5, run=run_size, pack=pack) == slow(rows, 4, 5)


def test_tiles_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 2)
    monkeypatch.setattr(divergence, "LEAST_BLOCK", 64)
    rows = [(i, " ".join(chr(97 + j % 26) + chr(97 + (i * j) % 26) for j in range(200)), "en", f"s{i % 5}") for i in range(40)]
    assert run(spark, rows, least=2) == slow(rows, 2, 50)


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, None, None)]) == []
    rows = [(1, "a", "en", "x"), (1, "a", "en", "x"), (None, "b" * 300_000, "en", "y"), (2, None, "de", "y"), (2, "", "de", "x")]
    assert run(spark, rows) == slow(rows, 30, 50) == [("de", "x", "pair", "y", 0, 1), ("de", "y", "pair", "x", 0, 1), ("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert run(spark, rows, least=1) == slow(rows, 1, 50)


def test_texts_are_cut_between_terms(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 10)
    assert b"".join(divergence.slices(b"ab cdefghijklmnop q" * 9)) == b"ab cdefghijklmnop q" * 9
    assert max(p.count(b"cdefghijklmnop") for p in divergence.slices("ab cdefghijklmnop qé".encode() * 9, 10)) == 1
    rows = documents(60)
    assert run(spark, rows, least=3) == slow(rows, 3, 50)


def test_transducer_is_minimal_and_ordered():
    rng = random.Random(5)
    strings = sorted({bytes(rng.choice(b"abc\xc3\xff") for _ in range(rng.randint(0, 6))) for _ in range(2000)})
    machine = Transducer.unpacked(build(strings).packed())
    data = np.frombuffer(b"".join(strings) + b"\0", np.uint8)
    ends = np.cumsum([len(s) for s in strings])
    starts = ends - [len(s) for s in strings]
    assert machine.ordinals(data, starts, ends).tolist() == list(range(len(strings)))
    absent = sorted({bytes(rng.choice(b"abc\xc3\xffd") for _ in range(rng.randint(0, 9))) for _ in range(2000)} - set(strings))
    ends = np.cumsum([len(s) for s in absent])
    assert set(machine.ordinals(np.frombuffer(b"".join(absent) + b"\0", np.uint8), ends - [len(s) for s in absent], ends)) == {-1}
    # as many states as there are different sets of endings
    endings = defaultdict(set)
    for s in strings:
        for k in range(len(s) + 1):
            endings[s[:k]].add(s[k:])
    assert len(machine.base) == len({frozenset(e) for e in endings.values()})
    with pytest.raises(ValueError, match="ascend"):
        build([b"b", b"a"])


def test_matches_sql_on_a_whole_table(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cursor = con.execute(divergence.ORACLE_SQL["op12_divergence"])
    names = [d[0] for d in cursor.description]
    got = divergence.op12_divergence(spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(cursor.fetchall())
