from __future__ import annotations

import math

import duckdb
import numpy as np
from hostlake.llm import pstable


def brute(rows):
    ok = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            continue
        ok[i] = (label, np.array(v, float))
    link = {i: set() for i, _, _ in rows}
    for i, (la, x) in ok.items():
        for j, (lb, y) in ok.items():
            if i != j and la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                link[i].add(j)
    comp = {i: i for i in link}
    for _ in link:
        for i in link:
            for j in link[i]:
                comp[i] = min(comp[i], comp[j])
    return {i: (len(link[i]), comp[i]) for i in link}


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return pstable.vector_links(df).collect()


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        base = rng.standard_normal(32)
        for k in range(40 if c == 0 else 6):
            rows.append((len(rows) * 3 + 1, (base + rng.standard_normal(32) * 0.1).tolist(), c % 3))
    rows += [(5000, None, 1), (5001, [], 1), (5002, [0.0] * 32, 1), (5003, [float("nan")] * 32, 1), (5004, [None] + [1.0] * 31, 1), (5005, rows[0][1], None), (5006, [1.0, 2.0], 0), (5007, [2.0, 4.0], 0)]
    for tile in (2048, 8):
        monkeypatch.setattr(pstable, "TILE", tile)
        got = {r.vec_id: (r.n_links, r.component_id) for r in run(spark, rows)}
        want = brute([(i, np.float32(v).tolist() if v and None not in v else v, c) for i, v, c in rows])
        assert set(got) == set(want)
        assert sum(got[i][0] for i in got) >= 0.99 * sum(want[i][0] for i in want)
        assert all(got[i][0] <= want[i][0] for i in got)
        assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}


def test_names_that_clash(spark):
    rows = [(i, [1.0, 0.001 * i], "a", i, 0.5) for i in range(5)]
    docs = spark.createDataFrame(rows, "id long, embedding array<double>, label string, component_id long, n_links double")
    got = {r.id: r for r in pstable.vector_links(docs, id_col="id").collect()}
    assert len(got) == 5 and all(r.component_id == 0 and r.n_links == 4 for r in got.values())


def test_edge_cases(spark):
    assert run(spark, []) == []
    v = [1.0, 0.5, 0.25]
    got = run(spark, [(None, v, 1), (7, v, 1), (7, v, 1), (9, [2.0, 1.0, 0.5], 1)])
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True), (7, 2, 7, True), (7, 2, 7, True), (9, 2, 7, False)]


def test_whole_table_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = {r[0]: r[1:] for r in con.execute(pstable.ORACLE_SQL["op5_vector_links"]).fetchall()}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pstable.op5_vector_links(spark, sf).collect()}
    assert got == want
