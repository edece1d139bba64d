from __future__ import annotations

import numpy as np
import xxhash
from hostlake.llm import simhash


def slow_fingerprint(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    fps = {i: slow_fingerprint(t) for i, t in rows}
    comp = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return fps, comp


def query(spark, rows, tmp_path, extra=""):
    df = spark.createDataFrame(rows, f"doc_id long, text string{extra}")
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return simhash.op1_simhash(spark, str(tmp_path)).collect()


def test_matches_brute_force(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(900))
    rows = [(1, base), (9, base), (5, base.replace("w500", "x")), (3, None), (4, ""), (7, "A b"), (8, "a B"), (10, "a b c d"), (11, "é " * 50)]
    rows += [(20 + i, base.replace(f"w{i} ", f"y{i} ")) for i in range(30)]
    got = query(spark, rows, tmp_path)
    fps, comp = slow_components(rows)
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == comp
    assert all(len(r.fingerprint) == 16 for r in got)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.op1_simhash(spark, sf).collect()}
    fps, comp = slow_components(rows)
    assert got == {i: (fps[i], comp[i]) for i in fps}


def test_edge_cases(spark, tmp_path):
    assert query(spark, [], tmp_path) == []
    got = query(spark, [(None, "a b c"), (2, "a b c"), (2, "a b c"), (1, None)], tmp_path)
    assert sorted((r.doc_id or -1, r.component_id) for r in got if r.doc_id) == [(1, 1), (2, 2), (2, 2)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_bucket_forest_finds_all_links():
    rng = np.random.default_rng(1)
    for radius in (2, 5, 38):
        rows = rng.integers(0, 2, (400, 128)).astype(np.uint8)
        rows[200:] = rows[:200]
        flip = rng.integers(0, 128, (200, radius + 1))
        rows[np.arange(200)[:, None] + 200, flip] ^= 1
        bucket = np.arange(400) % 200 // 20
        order = np.argsort(bucket, kind="stable")
        bucket, rows = bucket[order], rows[order]
        child, root = simhash.bucket_forest(bucket, rows, radius)
        label = np.arange(400)
        label[child] = root
        near = (rows[:, None] != rows[None]).sum(2) <= radius
        near &= bucket[:, None] == bucket[None]
        comp = np.arange(400)
        for _ in range(400):
            comp = np.where(near, comp[None], 400).min(1)
        assert (comp[label] == comp).all() and len(set(label)) == len(set(comp))


def test_pipeline_stage_drops_near_copies_only(spark):
    words = [f"w{i}" for i in range(400)]
    edit = lambda k: " ".join("zz" if i % (400 // k) == 0 else w for i, w in enumerate(words))
    rows = [(1, " ".join(words)), (2, edit(2)), (3, edit(80)), (4, " ".join(reversed(words))), (None, "x"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.near_duplicates_removed(docs).collect()} == {1, 3, 4, None, 6}


def test_large_buckets_are_split(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, 8).astype(np.uint8)
    rows = []
    for i in range(120):
        fp = base.copy()
        fp[rng.integers(0, 8, 2)] ^= 1 << rng.integers(0, 8, 2).astype(np.uint8)
        rows.append((i, bytes(fp)))
    rows = [(i, f) for f, i in {f: i for i, f in rows}.items()]
    df = spark.createDataFrame(rows, "node long, fp binary")
    want = None
    for lanes in (1 << 13, 8):
        monkeypatch.setattr(simhash, "LANES", lanes)
        edges = simhash.similar_fingerprints(df, 2, simhash.exact_tables(64, 2), 64)
        comps = {r.node: r.component for r in simhash.connected_components(edges, "a", "b").collect()}
        want = want or comps
        assert comps == want and len(comps) > 50


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_pipeline_stage_links_by_exact_similarity(spark):
    """Pairs around 0.8: a fingerprint radius alone takes some below it and misses some above."""
    rng = np.random.default_rng(3)
    rows, want = [], set()
    for i in range(150):
        words = [f"w{x}" for x in rng.integers(0, 100_000, 300)]
        other = list(words)
        for x in rng.choice(300, rng.integers(5, 16), replace=False):
            other[x] = f"x{i}"
        a, b = " ".join(words), " ".join(other)
        rows += [(i, a), (1000 + i, b)]
        if len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b)):
            want.add(1000 + i)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {i for i, _ in rows} - {r.doc_id for r in simhash.near_duplicates_removed(docs).collect()}
    assert 20 < len(want) < 130
    assert gone <= want and len(gone) >= 0.97 * len(want)


def test_jaccard_forest_matches_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = [[f"w{x}" for x in rng.integers(0, 5000, 120)] for _ in range(6)]
    texts = []
    for i in range(90):
        words = list(base[i % 6])
        for x in rng.choice(120, rng.integers(0, 5), replace=False):
            words[x] = f"x{rng.integers(0, 50)}"
        texts.append(" ".join(words[rng.integers(0, 12) :]))
    comp = {i: i for i in range(90)}
    near = [(a, b) for a in comp for b in range(a) if len(shingles(texts[a]) & shingles(texts[b])) >= 0.8 * len(shingles(texts[a]) | shingles(texts[b]))]
    for _ in comp:
        for a, b in near:
            comp[a] = comp[b] = min(comp[a], comp[b])
    members = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "component long, node long, text string")
    for limit in (1 << 12, 16):
        monkeypatch.setattr(simhash, "MEMBERS", limit)
        got = {r.node: r.component for r in simhash.connected_components(simhash.similar_texts(members, 5), "a", "b").collect()}
        assert {i: got.get(i, i) for i in comp} == comp and len(set(comp.values())) > 6


def test_pipeline_stage_matches_exact_similarity_on_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: frozenset(simhash.shingle_hashes(r.text.encode(), 5).tolist()) for r in docs.collect()}
    comp = {i: i for i in sets}
    near = [(a, b) for a in sets for b in sets if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in near:
        for a, b in near:
            comp[a] = comp[b] = min(comp[a], comp[b])
    left = {r.doc_id for r in simhash.near_duplicates_removed(docs).collect()}
    assert left == {i for i in sets if comp[i] == i} and len(left) < len(sets)


def test_repeated_id_loses_only_the_copied_text(spark):
    text, other = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    docs = spark.createDataFrame([(1, text), (2, text), (2, other), (2, other)], "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.near_duplicates_removed(docs).collect()) == [(1, text), (2, other), (2, other)]
