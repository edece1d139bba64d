"""Embedding near-duplicates by p-stable hashing of normalised vectors, with exact cosine checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlake.llm.components import connected_components
from hostlake.llm.runtime import staged, table

#: Vectors of a large bucket that one task holds from either side.
TILE = 2048


def projections(dim: int, tables: int, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gaussian directions, offsets (in units of the bin) and odd multipliers that join the bins of a table."""
    rng = np.random.default_rng([seed, dim])
    a, b = rng.standard_normal((dim, tables * width)), rng.random(tables * width)
    return a, b, rng.integers(1, 2**62, (tables, width)) * 2 + 1


def hashed(x: np.ndarray, tables: int, width: int, bin_width: float, seed: int) -> np.ndarray:
    """One 64-bit key per vector and table: floor((a.v) / w + b) for ``width`` directions, mixed."""
    a, b, m = projections(x.shape[1], tables, width, seed)
    q = np.floor(x @ a / bin_width + b).astype(np.int64).reshape(len(x), tables, width)
    with np.errstate(over="ignore"):
        h = (q * m).sum(2)
        return (h ^ (h >> 29)) * np.int64(0x5851F42D4C957F2D)


def _unit(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors (double precision) of the usable rows, one dimension at a time."""
    ids, labels, vectors = batch.columns
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    known = (ids.is_valid().to_numpy(zero_copy_only=False)) & (labels.is_valid().to_numpy(zero_copy_only=False))
    for dim in np.unique(size[known & (size > 0)]):
        rows = np.flatnonzero(known & (size == dim))
        x = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        x = x[good] / np.abs(x[good]).max(1, keepdims=True)
        yield rows[good], x / np.linalg.norm(x, axis=1, keepdims=True)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that hold whole groups of rows with equal first ``keys`` columns, and where each begins (and the end)."""

    def cut(t: pa.Table) -> np.ndarray:
        new = np.zeros(max(t.num_rows - 1, 0), bool)
        for i in range(keys):
            c = t.column(i).to_numpy()
            new |= c[1:] != c[:-1]
        return np.concatenate([[0], np.flatnonzero(new) + 1, [t.num_rows]])

    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        at = cut(t)
        if len(at) > 2:
            yield t.slice(0, at[-2]), at[:-1]
        rest = t.slice(at[-2])
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def _forest(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` (each row's root) after joining rows a[i] and b[i]."""
    while (new := parent[a] != parent[b]).any():
        a, b = a[new], b[new]
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        parent[high] = low
        while ((up := parent[parent]) != parent).any():
            parent = up
    return parent


def vector_links(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = 0.98,
    tables: int = 24,
    width: int = 16,
    bin_width: float = 2.0,
    seed: int = 11,
) -> DataFrame:
    """Links and components of near-equal vectors with one label.

    Returns one row per input row: the id, ``n_links`` (other rows linked directly),
    ``component_id`` (smallest id reachable) and ``kept`` (id = component_id).

    A bin of width 2 holds two unit vectors at cosine 0.98 (distance 0.2) with probability
    0.92, and unrelated ones (distance 1.4) with 0.49. 24 tables of 16 bins find a pair at
    0.98 with probability 0.9993, closer ones more surely, while an unrelated pair meets in
    a table with probability 1e-5. Every meeting is checked in double precision.

    Rows whose vector is null, empty, zero or has null or non-finite components, or whose
    label or id is null, link with nothing (component: their own id). Vectors of different
    length never link. Repeated rows count as separate vectors and link with one another;
    equal vectors are compared once, with their number. An empty table gives an empty result.

    Keys are dealt with ids alone; vectors follow only into buckets of two or more. A bucket
    larger than ``TILE`` is split into pairs of parts; a pair of vectors is counted only in
    the first table that holds both, and buckets return counts and a spanning forest, not pairs.
    """

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _unit(batch):
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array([v.tobytes() for v in x], pa.binary())],
                    names=["id", "label", "vec"],
                )

    def unpack(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        raw = column.to_pylist()
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        return [(rows, np.frombuffer(b"".join(raw[i] for i in rows)).reshape(len(rows), -1)) for n in np.unique(size) for rows in [np.flatnonzero(size == n)]]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in unpack(batch.column(2)):
                keys = hashed(x, tables, width, bin_width, seed) ^ batch.column(3).to_numpy()[rows][:, None]
                at = pa.array(rows)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), t, np.int32)), pa.array(keys[:, t].copy()), batch.column(0).take(at), batch.column(1).take(at)],
                        names=["t", "key", "node", "gid"],
                    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _groups(batches, 3):
            table_no, node, part, n = (t.column(c).to_numpy() for c in ("t", "node", "part", "n"))
            label_of = t.column("label").to_numpy()
            raw = t.column("vec").to_pylist()
            out: list[tuple[np.ndarray, ...]] = []
            for start, end in zip(at[:-1], at[1:], strict=True):
                if len({len(v) for v in raw[start:end]}) > 1:
                    continue  # two dimensions under one key; their keys differ but for a collision
                x = np.frombuffer(b"".join(raw[start:end])).reshape(end - start, -1)
                hit = np.triu(x @ x.T >= threshold, 1)
                own, lab = part[start:end], label_of[start:end]
                if (lab != lab[0]).any():
                    hit &= lab[:, None] == lab[None]
                if own[0] != own[-1] or (own != own[0]).any():
                    hit &= own[:, None] != own[None]
                a, b = np.nonzero(hit)
                if not len(a):
                    continue
                keys = hashed(x, tables, width, bin_width, seed)
                first = np.concatenate([(keys[a[i : i + 65536]] == keys[b[i : i + 65536]]).argmax(1) for i in range(0, len(a), 65536)])
                now = first == table_no[start]
                count = np.bincount(a[now], n[start:end][b[now]], end - start) + np.bincount(b[now], n[start:end][a[now]], end - start)
                parent = _forest(np.arange(end - start), a, b)
                linked = np.unique(np.concatenate([a, b]))
                out.append((node[start:end][linked], count[linked].astype(np.int64), node[start:end][parent[linked]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["node", "links", "root"])

    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    rows = staged(source.mapInArrow(unit, "id long, label string, vec binary"))
    groups = staged(
        rows.groupBy("label", "vec").agg(F.min("id").alias("node"), F.count("*").alias("n")).select("node", F.xxhash64("label", "vec").alias("gid"), "vec", F.xxhash64("label").alias("lh"), "label", "n")
    )
    keyed = staged(groups.select("node", "gid", "vec", "lh").mapInArrow(deal, "t int, key long, node long, gid long"))
    # keys are counted before anything meets; the join can be split where a key is common, and its bucket is cut into parts, every two of which share a tile
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("many")).where(F.col("many") > 1)
    dealt = keyed.join(staged(shared), ["t", "key"]).withColumn("parts", F.expr(f"(many + {TILE - 1}) div {TILE}")).withColumn("part", F.pmod(F.xxhash64("node", "gid"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = dealt.withColumn("tile", F.greatest("part", "other") * F.col("parts") + F.least("part", "other"))
    whole = met.join(groups.select("node", "gid", "vec", "label", "n"), ["node", "gid"])
    found = staged(
        whole.select("t", "key", "tile", "node", "part", "n", "label", "vec")
        .repartition("t", "key", "tile")
        .sortWithinPartitions("t", "key", "tile", "part", "node")
        .mapInArrow(compare, "node long, links long, root long")
    )
    comps = connected_components(found, "node", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    by_group = (
        groups.select("label", "vec", "node", "n")
        .join(links, "node", "left")
        .join(comps, "node", "left")
        .select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    by_row = rows.join(by_group, ["label", "vec"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    own = F.col(id_col).cast("long")
    out = vectors.select(id_col).join(by_row.withColumnRenamed("id", "__id"), own == F.col("__id"), "left")
    component = F.coalesce("component_id", own)
    return out.select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), own.eqNullSafe(component).alias("kept"))


def op5_vector_links(spark, sf_dir: str) -> DataFrame:
    return vector_links(table(spark, sf_dir, "embeddings"))


#: The links by brute force over all pairs of one label; reachability by a recursive walk.
ORACLE_SQL = {
    "op5_vector_links": """
WITH RECURSIVE u AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
w(a, b) AS (SELECT a, b FROM l UNION SELECT w.a, l.b FROM w JOIN l ON w.b = l.a),
r AS (SELECT a, min(b) AS m FROM w GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(r.m, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(r.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN r ON e.vec_id = r.a LEFT JOIN n ON e.vec_id = n.a
"""
}

QUERIES = {"op5_vector_links": op5_vector_links}
