from __future__ import annotations

import random

from hostlake.llm import substring


def prose(rng, n):
    return " ".join(rng.choice("abcdefgh") + str(rng.randrange(10_000)) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed string")
    return substring.repeats_removed(df).collect()


def slow_kept(rows):
    """Brute force: units of all documents in order of id; the first of each digest stays."""
    first, out = {}, {}
    for i, t in sorted(rows):
        for d in substring.units(t.encode()).digest:
            first.setdefault(d, i)
    for i, t in rows:
        out[i] = {d for d in substring.units(t.encode()).digest if first[d] != i}
    return out


def test_lines_and_passages(spark):
    rng = random.Random(1)
    line, passage = prose(rng, 12), prose(rng, 60) + "."
    own = [prose(rng, 80) + "." for _ in range(4)]
    rows = [
        (5, own[0] + "\n" + line + "\n" + own[1], "x"),
        (7, line.upper().replace(" ", "  ") + "\n" + own[2] + " " + passage + " Tail é of it.", "x"),
        (9, "Head " * 3 + "of it. " + passage + " " + own[3], "x"),
        (11, line, "x"),
        (12, "short line\nshort line", "x"),
    ]
    got = {r.doc_id: r for r in run(spark, rows)}
    assert got[5].text == rows[0][1] and got[5].removed_spans == []
    assert got[7].text == rows[1][1].split("\n")[1]
    assert got[9].text == "Head Head Head of it.  " + own[3]
    assert got[11].text == "" and got[11].n_removed == 1
    assert got[12].text == rows[4][1]
    for i, t, _ in rows:
        kept, at = "", 0
        for s in got[i].removed_spans:
            kept, at = kept + t[at : s.start], s.end
        assert (kept + t[at:]).split() == got[i].text.split()


def test_matches_brute_force(spark):
    rng = random.Random(2)
    pool = [prose(rng, rng.choice((5, 9, 30, 70))) for _ in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) + (" " + prose(rng, 3) if rng.random() < 0.4 else "") for _ in range(6)), None) for i in range(60)]
    want = slow_kept([(i, t) for i, t, _ in rows])
    for r in run(spark, rows):
        text = dict((i, t) for i, t, _ in rows)[r.doc_id]
        spans, n, gone = substring.repeated_spans(text.encode(), want[r.doc_id])
        assert (r.n_units, r.n_removed) == (n, gone)
        assert [(s.start, s.end) for s in r.removed_spans] == spans  # ASCII: bytes are characters
        assert r.text.encode() == (substring._without(text.encode(), spans))


def test_names_that_clash(spark):
    line = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, line, "e", "s", 7), (2, line + "\nmore", "f", None, 8)], "doc_id long, text string, earlier string, removed_spans string, id int")
    got = {r.doc_id: r for r in substring.repeats_applied(docs).collect()}
    assert [got[i].text for i in (1, 2)] == [line, "more"] and [got[i].earlier for i in (1, 2)] == ["e", "f"]
    assert got[1].removed_spans == "s" and got[2].id == 8
    assert substring.repeats_removed(docs).columns[-3:] == ["removed_spans", "n_units", "n_removed"]


def test_edges(spark):
    long = "word " * 50_000
    line = "one two three four five six seven eight nine"
    rows = [(1, None, "x"), (2, "", None), (None, line, None), (3, line, None), (3, line, None), (4, long, None), (6, line + "\n" + line, None)]
    got = [(r.doc_id, r.text) for r in run(spark, rows)]
    assert sorted(got, key=str)[:1] and len(got) == 7
    assert got.count((3, line)) == 2 and (None, line) in got and (1, None) in got and (6, "") in got
    assert len(dict(got)[4]) < len(long) / 100
    assert run(spark, []) == []


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = slow_kept(rows)
    got = {r.doc_id: r for r in substring.op9_substring(spark, sf).collect()}
    assert all(got[i].n_removed == substring.repeated_spans(t.encode(), want[i])[2] for i, t in rows)


def test_short_lines_of_earlier_documents_go(spark):
    licence = "Licensed under the Apache License, Version 2.0."
    verse = "\n".join(f"line {i} of it" for i in range(20))
    rows = [(1, f"own one\n{licence}\n{licence}", None), (2, f"own two\n  licensed under the apache  license, version 2.0.\nEnd", None), (3, verse, None), (4, f"A head\n{verse}\nend", None)]
    got = {r.doc_id: r for r in run(spark, rows)}
    assert got[1].text == rows[0][1] and got[3].text == verse
    assert got[2].text == "own two\nEnd" and got[2].n_removed >= 1
    assert got[4].text == "A head\n"


def test_passages_go_whole_wherever_they_sit(spark):
    """Brute force over words: a shared span of 50 words loses every word, whatever the line breaks."""
    rng = random.Random(5)
    passages = [prose(rng, rng.randrange(50, 90)).split() for _ in range(12)]
    rows = []
    for i in range(40):
        words = []
        for p in rng.sample(passages, 2):
            words += prose(rng, rng.randrange(0, 40)).split() + p
        words += prose(rng, 10).split()
        rows.append((i, "".join(w + ("\n" if rng.random() < 0.15 else " ") for w in words), None))
    got = {r.doc_id: r for r in run(spark, rows)}
    windows, lines = {}, {}
    for i, t, _ in rows:
        words = t.lower().split()
        for a in range(len(words) - substring.RUN_WORDS + 1):
            windows.setdefault(tuple(words[a : a + substring.RUN_WORDS]), i)
        for line in t.lower().split("\n"):
            lines.setdefault(tuple(line.split()), i)
    for i, t, _ in rows:
        words = t.lower().split()
        gone = {a + j for a in range(len(words) - substring.RUN_WORDS + 1) if windows[tuple(words[a : a + substring.RUN_WORDS])] < i for j in range(substring.RUN_WORDS)}
        at = 0
        for line in t.lower().split("\n"):
            if line.split() and lines[tuple(line.split())] < i:
                gone |= set(range(at, at + len(line.split())))
            at += len(line.split())
        assert got[i].text.split() == [w for a, w in enumerate(t.split()) if a not in gone]
    assert sum(len(got[i].removed_spans) for i in got) > 50
