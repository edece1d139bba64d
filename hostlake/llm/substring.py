"""Substring dedup by hashing lines and windows of words.

Units are normalised and hashed; over all documents the occurrence in the document with the
smallest id is kept and the others are removed, with their offsets in the original text. A whole
line is one unit. So that a passage is found wherever it sits, every window of ``RUN_WORDS`` words of
the whole word sequence is a unit too, whatever lines it lies in; a repeated passage of so many
words or more goes from its first word to its last.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlake.llm.runtime import small_batches, table

#: Words that a line must have to go where only its own document has it before, and words of a window.
LINE_WORDS, RUN_WORDS = 8, 25
#: Digests are dealt to so many buckets or more, one for about every ``DOCS`` documents, and sent in blocks of so many.
BUCKETS, DOCS, BLOCK = 1 << 8, 1 << 13, 1 << 20
#: Multiplier of the windows' polynomial, modulo 2^64.
STEP = np.uint64(0x9E3779B97F4A7C15)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Units(NamedTuple):
    """Units of a text: its lines, then its windows; their digests, first and last word + 1, and how many are lines."""

    digest: np.ndarray
    first: np.ndarray
    last: np.ndarray
    lines: int


def units(data: bytes) -> Units:
    words: list[bytes] = []
    digest, first, last = [], [], []
    for line in data.lower().split(b"\n"):
        own = line.split()
        if own:
            digest.append(xxhash.xxh64_intdigest(b" ".join(own), 1))
            first.append(len(words))
            words += own
            last.append(len(words))
    n = max(len(words) - RUN_WORDS + 1, 0)
    windows = np.zeros(n, np.uint64)
    if n:
        h = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(2)), np.uint64, len(words))
        for j in range(RUN_WORDS):
            windows *= STEP
            windows += h[j : j + n]
        windows ^= windows >> np.uint64(32)  # the upper bits choose the bucket
        windows *= STEP
    at = np.arange(n)
    return Units(
        np.concatenate([np.array(digest, np.uint64), windows]).view(np.int64),
        np.concatenate([np.array(first, np.int64), at]),
        np.concatenate([np.array(last, np.int64), at + RUN_WORDS]),
        len(digest),
    )


def offsets(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the begin and end of every word."""
    space = np.concatenate([[True], _SPACE[np.frombuffer(data, np.uint8)], [True]])
    turn = np.flatnonzero(space[1:] != space[:-1])
    return turn[::2], turn[1::2]


def repeated_spans(data: bytes, earlier: Collection[int]) -> tuple[list[tuple[int, int]], int, int]:
    """Byte spans to remove, given the digests that occur in earlier documents; how many units there are and go.

    Within the text itself the first occurrence of a unit counts as the earliest; a window repeats it only where the
    two don't overlap. Lines of fewer than ``LINE_WORDS`` words that repeat only within the text stay, as refrains
    and brackets do. No span crosses a line end.
    """
    found = units(data)
    n = len(found.digest)
    _, index, inverse = np.unique(found.digest, return_index=True, return_inverse=True)
    own = index[inverse]
    again = np.where(np.arange(n) < found.lines, (own < np.arange(n)) & (found.last - found.first >= LINE_WORDS), found.first >= found.last[own])
    if len(earlier):
        again |= np.isin(found.digest, np.fromiter(earlier, np.int64, len(earlier)))
    if not again.any():
        return [], n, 0
    begin, end = offsets(data)
    change = np.zeros(len(begin) + 1, np.int64)
    np.add.at(change, found.first[again], 1)
    np.add.at(change, found.last[again], -1)
    gone = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
    head = np.zeros(len(begin) + 1, bool)
    head[found.first[: found.lines]] = True
    starts = np.flatnonzero(gone[1:-1] & (head[:-1] | ~gone[:-2]))
    stops = np.flatnonzero(gone[1:-1] & (np.append(head[1:-1], True) | ~gone[2:]))
    return list(zip(begin[starts].tolist(), end[stops].tolist(), strict=True)), n, int(again.sum())


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``data`` less its spans; a line that loses all its words goes with its line break."""
    out, at = [], 0
    for a, b in spans:
        begin = data.rfind(b"\n", 0, a) + 1
        stop = data.find(b"\n", b)
        stop = len(data) if stop < 0 else stop
        if not data[begin:a].strip() and not data[b:stop].strip():
            a, b = begin, min(stop + 1, len(data))
        out.append(data[at : max(a, at)])
        at = max(b, at)
    return b"".join([*out, data[at:]])


def earlier_units(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Digests of each document's units that an earlier document has: the id and ``earlier`` (array<long>, may repeat).

    Digests travel once, packed by bucket: the ids of a block, how many digests each has, and their lower 7 bytes;
    the bucket holds the upper one.
    """
    known = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    bits = max(BUCKETS, docs.count() // DOCS).bit_length() - 1
    kind = known.schema["id"].dataType
    packed = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("counts", T.BinaryType()), T.StructField("digests", T.BinaryType())])
    found = T.StructType([known.schema["id"], T.StructField("digest", T.LongType())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own, size = [], [], 0
        for batch in _tail(batches):
            for i, t in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True) if batch else [(None, None)]:
                if i is not None:
                    ids.append(i)
                    own.append(np.unique(units(t.as_py()).digest))
                    size += len(own[-1])
                if not size or (i is not None and size < BLOCK):
                    continue
                digest = np.concatenate(own).view(np.uint64)
                owner = np.repeat(np.arange(len(own)), [len(o) for o in own])
                bucket = (digest >> np.uint64(64 - bits)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                digest, owner, bucket = digest[order], owner[order], bucket[order]
                of = pa.array([x.as_py() for x in ids], ids[0].type)
                edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                for at in range(0, len(edge) - 1, 64):
                    part = edge[at : at + 65]
                    lists, counts, raw = [], [], []
                    for a, b in zip(part[:-1], part[1:], strict=True):
                        who, many = np.unique(owner[a:b], return_counts=True)
                        lists.append(who)
                        counts.append(many.astype(np.int32).tobytes())
                        raw.append(digest[a:b].view(np.uint8).reshape(-1, 8)[:, :7].tobytes())
                    ends = np.cumsum([0, *(len(x) for x in lists)]).astype(np.int32)
                    nested = pa.ListArray.from_arrays(pa.array(ends), of.take(pa.array(np.concatenate(lists))))
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[part[:-1]].astype(np.int32)), nested, pa.array(counts, pa.binary()), pa.array(raw, pa.binary())], names=packed.names)
                ids, own, size = [], [], 0

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in _tail(batches):
            for i in range(batch.num_rows if batch else 1):
                bucket = batch.column(0)[i].as_py() if batch else None
                if bucket != at and rows:
                    ids, digest = _later(rows, at >> (bits - 8))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(digest)], names=found.names)
                    rows = []
                at = bucket
                if batch:
                    # copies, or the whole batch would live as long as its last row
                    rows.append((pa.array(batch.column(1)[i].as_py(), batch.column(1).type.value_type), batch.column(2)[i].as_py(), batch.column(3)[i].as_py()))

    small_batches(docs.sparkSession)
    dealt = known.mapInArrow(blocks, packed).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(meet, found).groupBy("id").agg(F.collect_list("digest").alias("earlier"))


def _tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, and None as the sign of their end."""
    yield from batches
    yield None


def _later(rows: list[tuple[pa.Array, bytes, bytes]], upper: int) -> tuple[pa.Array, np.ndarray]:
    """Of a bucket's blocks, ids and digests of all occurrences after the one with the smallest id."""
    ids = pa.concat_arrays([r[0] for r in rows])
    rank = pc.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(ids)), np.frombuffer(b"".join(r[1] for r in rows), np.int32))
    parts = np.full((len(owner), 8), upper, np.uint8)
    parts[:, :7] = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, 7)
    digest = parts.view(np.int64).ravel()
    order = np.lexsort((rank[owner], digest))
    digest, owner = digest[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], digest[1:] != digest[:-1]]))
    least = np.repeat(rank[owner[start]], np.diff(np.append(start, len(digest))))
    later = rank[owner] > least
    return ids.take(pa.array(owner[later])), digest[later]


def repeats_removed(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All columns of ``docs``, with ``text`` less its repeated units, and what was done.

    Adds ``removed_spans`` (array of ``start`` and ``end``: character offsets in the original text, end exclusive),
    ``n_units`` and ``n_removed`` (lines and windows). Units of equal digest rank by document id and place in the text; the earliest
    stays. Units compare after lower-casing A-Z and joining words by single spaces; a 64-bit digest stands for them.

    A null text stays null. Rows without an id are neither changed nor counted. Rows that repeat an id are one
    document for the ranking: neither is earlier. Empty tables give empty results; added columns replace ones of the same name.
    """
    names = ("removed_spans", "n_units", "n_removed")
    base = docs.drop(*names)
    keyed = base.join(earlier_units(docs, text, id_col).select(F.col("id").alias("__id"), F.col("earlier").alias("__earlier")), F.col(id_col) == F.col("__id"), "left").drop("__id")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*base.schema.fields, T.StructField(names[0], span), T.StructField(names[1], T.IntegerType()), T.StructField(names[2], T.IntegerType())])
    at_text, at_id = base.columns.index(text), base.columns.index(id_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts, all_spans, counts, gone = [], [], [], []
                for i, t, earlier in zip(part.column(at_id), part.column(at_text).cast(pa.binary()), part.column(part.num_columns - 1), strict=True):
                    data = t.as_py()
                    spans, n, k = ([], 0, 0) if data is None or not i.is_valid else repeated_spans(data, earlier.values.to_numpy() if earlier.is_valid else ())
                    texts.append(_without(data, spans) if spans else data)
                    if spans:
                        where = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                        spans = [{"start": int(where[a]) - 1, "end": int(where[b - 1])} for a, b in spans]
                    all_spans.append(spans)
                    counts.append(n)
                    gone.append(k)
                columns = list(part.columns[:-1])
                columns[at_text] = pa.array(texts, pa.binary()).cast(pa.string())
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(all_spans, kind), pa.array(counts, pa.int32()), pa.array(gone, pa.int32())], names=schema.names)

    return keyed.select(*base.columns, "__earlier").mapInArrow(each, schema)


def repeats_applied(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeats gone from ``text`` and ``n_chars``, where there is one, brought up to date; rows and columns stay.

    Nulls, repeated ids and empty tables as in :func:`repeats_removed`; columns that have the names it adds stay as they are.
    """
    short = [c for c in docs.columns if c not in ("removed_spans", "n_units", "n_removed")]
    done = repeats_removed(docs.select(*short, *(F.col(c).alias(f"__{c}") for c in docs.columns if c not in short)))
    done = done.select(*(F.col(c if c in short else f"__{c}").alias(c) for c in docs.columns))
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def op9_substring(spark, sf_dir: str) -> DataFrame:
    return repeats_removed(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op9_substring": op9_substring}
