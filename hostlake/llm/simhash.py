"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints of whole texts are grouped by value first, so copies cost nothing
later. Distinct fingerprints are dealt to tables keyed on some of their bits;
within the buckets of a table they are stored vertically, one big integer per bit
position, and all distances between lanes ``i`` and ``i + d`` are counted at once
with carry-save counters. A block is left as soon as every lane is over the radius.
Each bucket yields a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlake.llm.components import connected_components, hooked
from hostlake.llm.runtime import staged, table

#: Seed of the shingle hash.
SEED = 42
#: Shingles whose bits are counted at a time.
SLICE = 1 << 16
#: Lanes of a block of small buckets, and of either part of a bucket that is split.
LANES = 1 << 13
#: Similarity of near-copies, as a fraction, and members of either part of a group whose similarities are checked in tiles.
NEAR, MEMBERS = (4, 5), 1 << 12


def shingle_hashes(data: bytes, k: int) -> np.ndarray:
    """XXH64 of the k-word shingles of a text; of the whole sequence if it is shorter."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(words) - k + 1)


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Further 64 hash bits from a hash (a splitmix64 step per lane); lane 0 is the hash itself."""
    if not lane:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(lane)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(data: bytes, k: int, bits: int) -> bytes:
    """Majority bits of the shingle hashes, most significant first; zero for a text without words."""
    return _majority(shingle_hashes(data, k), bits)


def _majority(h: np.ndarray, bits: int) -> bytes:
    counts = np.zeros(bits, np.int64)
    for at in range(0, len(h), SLICE):
        for lane in range(bits // 64):
            part = _mixed(h[at : at + SLICE], lane).astype(">u8").view(np.uint8).reshape(-1, 8)
            counts[lane * 64 : lane * 64 + 64] += np.add.reduce(np.unpackbits(part, axis=1), axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(h)).tobytes()


def with_fingerprints(docs: DataFrame, text: str = "text", k: int = 3, bits: int = 64, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``fp``, the binary fingerprint of the whole text (null: empty)."""
    schema = docs.select(*keep, F.lit(b"").alias("fp")).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.binary())
            fps = pa.array([fingerprint(t.as_py() or b"", k, bits) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], fps], names=[*keep, "fp"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(each, schema)


def exact_tables(bits: int, radius: int, spare: int = 3) -> list[np.ndarray]:
    """Bit positions of the tables of an exact search.

    The bits fall into ``radius + spare`` blocks; fingerprints within the radius agree
    on some ``spare`` whole blocks, so one table per choice of ``spare`` blocks finds
    every pair. At 64 bits and radius 2 that makes 10 tables keyed on 38 or more bits.
    """
    blocks = np.array_split(np.arange(bits), radius + spare)
    return [np.concatenate(c) for c in combinations(blocks, spare)]


def sampled_tables(bits: int, tables: int, width: int, seed: int = 7) -> list[np.ndarray]:
    """Random bit positions for radii too wide for an exact search (bit sampling)."""
    rng = np.random.default_rng(seed)
    return [np.sort(rng.choice(bits, width, replace=False)) for _ in range(tables)]


def _planes(rows: np.ndarray) -> list[int]:
    """One big integer per bit position; bit i of it is that bit of lane i."""
    packed = np.packbits(rows.T, axis=1, bitorder="little")
    return [int.from_bytes(p.tobytes(), "little") for p in packed]


def _lanes(mask: int, n: int) -> np.ndarray:
    raw = np.frombuffer(mask.to_bytes((n + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, count=n, bitorder="little"))


def _within(planes: list[int], d: int, valid: int, radius: int) -> int:
    """Lanes i of ``valid`` whose distance to lane i + d is at most the radius."""
    digits = [0] * radius.bit_length()
    over = 0  # once a count leaves its digits the lane is over for good
    for at in range(0, len(planes), 8):
        for plane in planes[at : at + 8]:
            carry = plane ^ (plane >> d)
            for j, digit in enumerate(digits):
                digits[j], carry = digit ^ carry, digit & carry
            over |= carry
        equal = valid
        for j in reversed(range(len(digits))):
            if radius >> j & 1:
                equal &= digits[j]
            else:
                over |= equal & digits[j]
                equal &= ~digits[j]
        if not valid & ~over:
            return 0
    return valid & ~over


def bucket_forest(bucket: np.ndarray, rows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside buckets.

    ``bucket`` numbers the bucket of each row (equal numbers adjoin), ``rows`` holds its
    bits, one byte each. Returns the rows that are not the root of their tree, and the roots.
    """
    _, first, size = np.unique(bucket, return_index=True, return_counts=True)
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 1]
    child: list[np.ndarray] = []
    root: list[np.ndarray] = []
    at = 0
    while at < len(order):
        end, lanes = at, 0
        while end < len(order) and (end == at or lanes + size[order[end]] <= LANES):
            lanes += size[order[end]]
            end += 1
        own = order[at:end]
        index = np.concatenate([np.arange(first[b], first[b] + size[b]) for b in own])
        part, planes = bucket[index], _planes(rows[index])
        parent = np.arange(len(index))
        for d in range(1, int(size[own].max())):
            same = np.packbits(part[d:] == part[:-d], bitorder="little")
            hits = _lanes(_within(planes, d, int.from_bytes(same.tobytes(), "little"), radius), len(index))
            a, b = parent[hits], parent[hits + d]
            new = a != b
            while new.any():
                low, high = np.minimum(a[new], b[new]), np.maximum(a[new], b[new])
                parent[high] = low  # of several new parents of a root one wins; the rest come again
                while (up := parent[parent]).tolist() != parent.tolist():
                    parent = up
                a, b = parent[hits], parent[hits + d]
                new = a != b
        moved = np.flatnonzero(parent != np.arange(len(index)))
        child.append(index[moved])
        root.append(index[parent[moved]])
        at = end
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *child]), np.concatenate([empty, *root])


def similar_fingerprints(fps: DataFrame, radius: int, tables: list[np.ndarray], bits: int) -> DataFrame:
    """Links between distinct fingerprints at ``radius`` or fewer differing bits.

    ``fps`` has ``node`` (long, not null) and ``fp`` (binary), one row per fingerprint.
    Returns ``a`` and ``b``: edges whose components are those of all links found.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, bits // 8)
            spread = np.unpackbits(raw, axis=1)
            for t, where in enumerate(tables):
                key = np.zeros((n, 8), np.uint8)
                part = np.packbits(spread[:, where], axis=1)
                key[:, : part.shape[1]] = part
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, t, np.int32)), pa.array(key.view(np.int64).ravel()), batch.column(0), batch.column(1)],
                    names=["t", "key", "node", "fp"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _tail(batches):
            if batch:
                got = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
                got.append(np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, bits // 8))
                rest = got if rest is None else [np.concatenate(x) for x in zip(rest, got, strict=True)]
            if rest is None:
                continue
            t, key, tile, node, raw = rest
            change = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1
            end = len(t) if batch is None else (change[-1] if len(change) else 0)
            if end:
                bucket = np.zeros(end, np.int64)
                bucket[change[change < end]] = 1
                child, root = bucket_forest(np.cumsum(bucket), np.unpackbits(raw[:end], axis=1), radius)
                yield pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[root])], names=["a", "b"])
            rest = [x[end:] for x in rest]

    def met(rows: DataFrame) -> DataFrame:
        return rows.repartition("t", "key", "tile").sortWithinPartitions("t", "key", "tile").mapInArrow(compare, "a long, b long")

    dealt = fps.select("node", "fp").mapInArrow(deal, "t int, key long, node long, fp binary")
    # a bucket above the limit is cut into parts, and every two parts meet in a tile of their own
    hot = staged(dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > 2 * LANES))
    columns = ["t", "key", "tile", "node", "fp"]
    if hot.isEmpty():
        return met(dealt.select("t", "key", F.lit(0).cast("long").alias("tile"), "node", "fp"))
    parts = F.expr(f"(n + {LANES - 1}) div {LANES}")
    large = dealt.join(hot, ["t", "key"]).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    large = large.withColumn("tile", F.greatest("part", "other") * F.col("parts") + F.least("part", "other"))
    small = dealt.join(hot, ["t", "key"], "left_anti").withColumn("tile", F.lit(0).cast("long"))
    return met(small.select(columns)).unionByName(met(large.select(columns)))


def _tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, and None as the sign of their end."""
    yield from batches
    yield None


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    k: int = 3,
    bits: int = 64,
    radius: int = 2,
    tables: list[np.ndarray] | None = None,
) -> DataFrame:
    """Near-duplicate components of ``docs`` by SimHash.

    Returns one row per input row: the id, ``fp`` (binary fingerprint) and ``component_id``,
    the smallest id reachable over links of at most ``radius`` differing bits.

    Null texts count as empty; texts without words have fingerprint zero and link like any
    other. Rows with equal ids or texts stay separate rows of one component. A row without an
    id is returned with its fingerprint and a null component, and links nothing. An empty
    table gives an empty result; further columns are ignored. Without ``tables`` the search
    is exact.
    """
    tables = exact_tables(bits, radius) if tables is None else tables
    marked = staged(with_fingerprints(docs, text, k, bits, (id_col,)))
    reps = marked.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(F.col(id_col).cast("long")).alias("node"))
    comps = connected_components(similar_fingerprints(reps, radius, tables, bits), "a", "b")
    by_fp = reps.join(comps, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = marked.join(by_fp, "fp", "left")
    return out.select(id_col, "fp", F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))


def jaccard_forest(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the pairs of sets whose Jaccard similarity is ``NEAR`` or more.

    Sets that similar share one of their rarest elements (prefix filter), so these find the
    candidates; each is then counted whole. Returns the sets that aren't the root of their tree, and the roots.
    """
    p, q = NEAR
    size = np.array([len(s) for s in sets], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(sets)), size)
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    token = token[np.lexsort((token, often[token], owner))]
    prefix = (np.arange(len(token)) - begin[owner]) < (size - -(-p * size // q) + 1)[owner]
    order = np.argsort(token[prefix], kind="stable")
    posted, holder = token[prefix][order], owner[prefix][order]
    left, mark = np.ones(len(sets), bool), np.zeros(len(often), bool)
    child: list[int] = []
    root: list[int] = []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue:
            x = queue.pop()
            own = token[begin[x] : begin[x + 1]]
            rare = own[prefix[begin[x] : begin[x + 1]]]
            lo, hi = np.searchsorted(posted, rare), np.searchsorted(posted, rare, "right")
            met = np.unique(np.concatenate([holder[:0], *(holder[i:j] for i, j in zip(lo, hi, strict=True))]))
            met = met[left[met]]
            met = met[p * np.maximum(size[met], size[x]) <= q * np.minimum(size[met], size[x])]
            mark[own] = True
            both = np.array([np.count_nonzero(mark[token[begin[y] : begin[y + 1]]]) for y in met], np.int64)
            mark[own] = False
            met = met[(p + q) * both >= p * (size[met] + size[x])]
            left[met] = False
            queue += met.tolist()
            child += met.tolist()
            root += [first] * len(met)
    return np.array(child, np.int64), np.array(root, np.int64)


def similar_texts(members: DataFrame, k: int) -> DataFrame:
    """Links between texts of one group whose ``k``-word shingle sets have a Jaccard similarity of ``NEAR`` or more.

    ``members`` has ``component`` and ``node`` (longs) and ``text``. Returns ``a`` and ``b``: edges whose
    components are those of all such pairs of a group. Large groups are cut into parts, and every two parts meet.
    """
    n = members.groupBy("component").agg((F.count("*") + MEMBERS - 1).alias("n"))
    dealt = members.join(n.select("component", F.expr(f"n div {MEMBERS}").alias("parts")), "component")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    tile = F.greatest("part", "other") * F.col("parts") + F.least("part", "other")
    dealt = dealt.select("component", tile.alias("tile"), "node", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, sets = None, [], []
        for batch in _tail(batches):
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3).cast(pa.binary()), strict=True) if batch else [(None,) * 4]
            for component, tile, node, text in rows:
                if (component, tile) != at:
                    if len(sets) > 1:
                        child, root = jaccard_forest(sets)
                        own = np.array(nodes, np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(own[child]), pa.array(own[root])], names=["a", "b"])
                    at, nodes, sets = (component, tile), [], []
                if node is not None:
                    nodes.append(node)
                    sets.append(np.unique(shingle_hashes(text.as_py() or b"", k)))

    return dealt.repartition("component", "tile").sortWithinPartitions("component", "tile").mapInArrow(check, "a long, b long")


def with_sets(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """Of each row ``doc_id``, ``content`` (a hash of its text), ``fp`` as in :func:`with_fingerprints` and ``node``, a hash of its shingle set."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, nodes = [], []
            for t in batch.column(2).cast(pa.binary()):
                h = shingle_hashes(t.as_py() or b"", k)
                fps.append(_majority(h, bits))
                nodes.append(xxhash.xxh64_intdigest(np.unique(h).tobytes(), SEED) - (1 << 63))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps, pa.binary()), pa.array(nodes, pa.int64())], names=["doc_id", "content", "fp", "node"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("content"), "text")
    return rows.mapInArrow(each, rows.select("doc_id", "content", F.lit(b"").alias("fp"), F.lit(0).cast("long").alias("node")).schema)


def near_duplicates_removed(docs: DataFrame) -> DataFrame:
    """``docs`` without near-copies: of each component the row with the smallest id stays.

    Rows link at a Jaccard similarity of 0.8 or more between their sets of five-word shingles, which is
    counted exactly; rows of one set are copies. Fingerprints only find the candidates: with f the share of
    differing bits, the cosine of two shingle multisets is cos(pi f) and equals 2 J / (1 + J) for sets of one
    size, so J = 0.8 is f = 0.151, 38.7 of 256 bits with a standard deviation of 5.7. The radius of 60 lies 3.7
    deviations above. 128 tables of 16 bits find a pair at 38 bits with probability 0.9999, at 50 with 0.98 and
    at 60 with 0.85. Within groups of candidates every pair counts. Rows without an id stay. Rows that
    repeat an id are judged by their own texts: one goes only if its text is a copy of a row with a smaller id.
    """
    marked = staged(with_sets(docs.select("doc_id", "text"), 5, 256))
    row = F.struct(F.col("doc_id").cast("long").alias("id"), "content", "fp")
    reps = staged(marked.where(F.col("doc_id").isNotNull()).groupBy("node").agg(F.min(row).alias("row")).select("node", "row.*"))
    groups = connected_components(hooked(similar_fingerprints(reps, 60, sampled_tables(256, 128, 16), 256), "a", "b"), "u", "v")
    members = reps.join(groups, "node").select("node", "component", "id", "content")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("content"), "text")
    members = members.join(texts, ["id", "content"]).groupBy("component", "node").agg(F.first("text").alias("text"))
    links = connected_components(similar_texts(members, 5), "a", "b")
    known = reps.join(links, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component"))
    keeps = known.join(known.groupBy("component").agg(F.min("id").alias("keep")), "component").select("node", "keep")
    copies = marked.join(keeps, "node").where(F.col("doc_id") != F.col("keep")).select("doc_id", F.col("content").alias("__content")).distinct()
    return docs.withColumn("__content", F.xxhash64("text")).join(copies, ["doc_id", "__content"], "left_anti").select(*docs.columns)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
