"""The pipeline against a brute-force version of every stage."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import sentencepiece
from hostlake.llm import language, mixing, pieces, simhash, substring
from pyspark.sql import functions as F


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    model = language.fit_languages(docs, F.lit(True))
    kept = {i: r.text for i, r in rows.items() if next(iter(language.infer(model, r.text).values()), 0) >= 0.5}

    shingles = {i: {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} for i, t in kept.items() for w in [t.encode().lower().split()]}
    comp = {i: i for i in shingles}
    near = [(a, b) for a in shingles for b in shingles if a < b and 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b])]
    for _ in shingles:
        before = dict(comp)
        for a, b in near:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == before:
            break
    want_gone = {i for i in kept if comp[i] != i}
    stage = simhash.near_duplicates_removed(spark.createDataFrame(list(kept.items()), "doc_id long, text string"))
    left = {r.doc_id for r in stage.collect()}
    gone = set(kept) - left
    # candidates come from sampled tables: nothing goes that brute force keeps, and few stay that it drops
    assert gone <= want_gone and len(gone) >= 0.9 * len(want_gone) > 0
    kept = {i: t for i, t in kept.items() if i in left}

    first: dict[int, int] = {}
    for i in sorted(kept):
        for d in substring.units(kept[i].encode()).digest:
            first.setdefault(d, i)
    clean = {}
    for i, t in kept.items():
        earlier = {d for d in substring.units(t.encode()).digest if first[d] != i}
        clean[i] = substring._without(t.encode(), substring.repeated_spans(t.encode(), earlier)[0]).decode()

    # the mix: each source's documents in the order of their hashes, twice at most, up to its target
    hashes = {r.i: r.h for r in spark.createDataFrame([(i,) for i in clean], "i long").select("i", F.xxhash64(F.lit(17), "i").alias("h")).collect()}
    size = {i: len(t.encode().split()) for i, t in clean.items()}
    sizes = Counter()
    for i in clean:
        sizes[rows[i].source] += size[i]
    goal = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = []
    for s in sizes:
        order, at, end = sorted((i for i in clean if rows[i].source == s), key=lambda i: (hashes[i], i)), 0, int(goal[s] + 0.5)
        for i in order:
            taken = sum(max(0, min(at + turn * sizes[s] + size[i], end) - (at + turn * sizes[s])) for turn in (0, 1))
            want += [i] * (1 if not size[i] else -(-taken // size[i]))
            at += size[i]

    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in got) == Counter(want)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for r in got:
        assert (r.text, r.source, r.lang, r.n_chars) == (clean[r.doc_id], rows[r.doc_id].source, rows[r.doc_id].lang, len(clean[r.doc_id]))
        assert r.ids == library.encode(r.text) and r.n_tokens == len(r.ids) and r.round_trip


def test_stages_keep_columns_and_take_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (None, "The cat sat on the mat and the dog sat too.", "en", None, 3), (2, "", "en", "a", 0), (3, "The dog. " * 3000, None, "a", 9), (3, "The dog. " * 3000, None, "a", 9)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
        assert {r.doc_id for r in out} <= {1, 2, 3, None}
