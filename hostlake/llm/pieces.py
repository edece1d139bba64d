"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut wherever no piece can cross: between characters that no piece has side by side. The distinct words that
this gives are exploded into substrings of bounded length, joined to the piece table and grouped by word, and a Spark
higher-order aggregate folds the edges of a word into its Viterbi path.

Two kinds of model differ only in what a path is worth. ``unigram`` adds the scores of its pieces. ``bpe`` ranks
paths by their merges: every piece stands for the merges that built it, and of two paths the better one is that whose
ascending list of merges (best score first, then leftmost) is the smaller, a longer list going before its own beginning.
That order doesn't change when the same merges are added on both sides, so Viterbi may use it; and its best path is what
merging greedily gives, as the greedy choice is the first entry of the best list, again and again. It needs a
vocabulary in which pieces are built from earlier ones, which is checked. Both kinds give the library's ids.

Documents meet the words again in chunks of bounded size, each with a dictionary of its own words. A word
travels once per chunk, however often it occurs, so no word has more than one in some 100,000 of the rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlake.llm.runtime import grouped_in_memory, small_batches, table

#: Where the public vocabularies are.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Stands for a space in pieces.
SPACE = "▁"
#: Bytes of text of a chunk and of a part of it that is handled at once (a longer text is a chunk of its own), and bytes that are cut at a time.
CHUNK_BYTES, PART_BYTES, SLICE = 32 << 20, 2 << 20, 1 << 20
#: The longest word that goes through the lattice (at most 127), and the most merges that a word may have there (at most 63).
LATTICE, MERGES = 120, 62
#: Rows of words that are packed together.
PACKED = 1 << 17
#: Words of one task whose edges are gathered in memory; of more they are sorted.
GROUPS = 1 << 16
#: Characters that a prefix has, by which the lengths of the pieces that begin with it are known.
PREFIX = 4


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores and ids; the id of byte 0 (bytes follow one another) or -1; the id of unknown text."""

    kind: str
    scores: dict[str, float]
    ids: dict[str, int]
    byte_base: int
    unknown: int

    @property
    def longest(self) -> int:
        return max(map(len, self.scores), default=1)

    @property
    def floor(self) -> float:
        """The score of a character that isn't a piece."""
        return min(self.scores.values(), default=0.0) - 10.0

    def spelling(self, char: str) -> list[int]:
        """Ids of a single character: its own, or those of its bytes, or the one of unknown text."""
        if char in self.ids:
            return [self.ids[char]]
        return [self.unknown] if self.byte_base < 0 else [self.byte_base + b for b in char.encode()]

    def spelled(self) -> list[bytes]:
        """The bytes that each id stands for."""
        size = max([self.unknown, self.byte_base + 255, *self.ids.values()]) + 1
        out = [b""] * size
        for piece, i in self.ids.items():
            out[i] = piece.encode()
        if self.byte_base >= 0:
            for b in range(256):
                out[self.byte_base + b] = bytes([b])
        return out

    def halves(self) -> dict[str, tuple[int, int]]:
        """Of each piece that merges build, the length of the left one of the two that are merged last, and when it is their turn.

        Merges take turns by score, then place. As a rule a piece's place is its begin, but one whose right half has the same score can't be
        merged before that; its place is that of the half (given relative to its begin). Pieces that merges don't build
        can't occur in a result and are left out. A half with a lower score than its piece would spoil the order of merges and is refused.
        """
        out = {}
        for piece in self.scores:
            if len(piece) > 1:
                place: dict[tuple[int, int], tuple[float, int]] = {}
                for s, m, e in merged(piece, self):
                    score = self.scores[piece[s:e]]
                    left, right = place.get((s, m), (np.inf, s)), place.get((m, e), (np.inf, s))
                    if min(left[0], right[0]) < score or (left[0] == score and left[1] != s):
                        raise ValueError(f"a half of {piece[s:e]!r} is merged after it")
                    place[s, e] = score, right[1] if right[0] == score else s
                if (0, len(piece)) in place:
                    out[piece] = m, place[0, len(piece)][1]
        return out


def load_vocabulary(path: str = MODEL, kind: str = "bpe") -> Vocabulary:
    """Pieces of a model file (read by the driver; a vocabulary is bounded by its size). ``kind`` is that of the model."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return Vocabulary(kind, {sp.id_to_piece(i): sp.get_score(i) for i in plain}, {sp.id_to_piece(i): i for i in plain}, next((i for i in range(sp.get_piece_size()) if sp.is_byte(i)), -1), sp.unk_id())


def merged(word: str, vocabulary: Vocabulary) -> Iterator[tuple[int, int, int]]:
    """The merges of a word in their order: begin, middle and end of each; the best score first, then the leftmost."""
    scores, n = vocabulary.scores, len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[float, int, int, int]] = []

    def offer(s: int, m: int) -> None:
        if s >= 0 and m < n and (score := scores.get(word[s : after[m]])) is not None:
            heapq.heappush(heap, (-score, s, m, after[m]))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, s, m, e = heapq.heappop(heap)
        if not (alive[s] and alive[m] and after[s] == m and after[m] == e):
            continue
        alive[m] = False
        after[s] = e
        if e < n:
            before[e] = s
        yield s, m, e
        offer(before[s], s)
        offer(s, e)


def segment_long(word: str, vocabulary: Vocabulary) -> list[int]:
    """Ids of one word by a heap of merges (bpe) or a forward pass (unigram); for words too long for the lattice."""
    n = len(word)
    if vocabulary.kind == "unigram":
        scores, floor = vocabulary.scores, vocabulary.floor
        best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
        for e in range(1, n + 1):
            for s in range(max(0, e - vocabulary.longest), e):
                gain = scores.get(word[s:e], floor if e - s == 1 else None)
                if gain is not None and best[s] + gain > best[e]:
                    best[e], back[e] = best[s] + gain, s
        cuts = [n]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        cuts.reverse()
    else:
        gone = {m for _, m, _ in merged(word, vocabulary)}
        cuts = [i for i in range(n + 1) if i not in gone]
    parts = [word[s:e] for s, e in zip(cuts, cuts[1:], strict=False)]
    return [i for p in parts for i in ([vocabulary.ids[p]] if len(p) > 1 else vocabulary.spelling(p))]


def cutter(vocabulary: Vocabulary) -> Callable[[pa.Array], tuple[pa.Array, np.ndarray]]:
    """A function that cuts texts into words: all words in their order, and where each text's words end.

    Texts are normalised as the given models do: a space becomes U+2581, one more is put in front, nothing else changes; the
    empty text (and null) stays empty. Two neighbouring characters are parted unless some piece has them side by side.
    """
    chars = sorted({c for p in vocabulary.scores for c in p})
    kind = np.zeros(0x110000, np.int32)
    kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
    width = len(chars) + 1
    whole = np.int32 if width * width < 1 << 31 else np.int64
    joint = np.zeros((width * width + 7) // 8, np.uint8)
    pairs = {(a, b) for p in vocabulary.scores for a, b in zip(p, p[1:], strict=False)}
    key = np.array([int(kind[ord(a)]) * width + int(kind[ord(b)]) for a, b in pairs], np.int64)
    np.bitwise_or.at(joint, key >> 3, (1 << (key & 7)).astype(np.uint8))

    def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        body = pa.array([SPACE + t.replace(" ", SPACE) if t else "" for t in texts.to_pylist()], pa.large_string())
        _, offsets, data = body.buffers()
        edge = np.frombuffer(offsets, np.int64, len(body) + 1)
        raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        base, end = int(edge[0]), int(edge[-1])
        found, last = [], 0
        while base < end:
            stop = min(base + SLICE, end)
            while stop < end and raw[stop] & 0xC0 == 0x80:
                stop += 1
            part = raw[base:stop]
            starts = np.flatnonzero((part & 0xC0) != 0x80)
            code = kind[np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)].astype(whole, copy=False)
            both = code * whole(width)
            both[1:] = both[:-1] + code[1:]
            both[0] = last * width + code[0]
            apart = ((joint[both >> 3] >> (both & 7).astype(np.uint8)) & 1) == 0
            inside = edge[np.searchsorted(edge, base) : np.searchsorted(edge, stop)] - base
            apart[np.searchsorted(starts, inside)] = True
            found.append(starts[apart] + base)
            base, last = stop, int(code[-1])
        at = np.concatenate([*found, edge[-1:]])
        words = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), data])
        return words, np.searchsorted(at, edge[1:])

    return cut


def lattice(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``word`` and its ``edges``: all substrings that are pieces.

    ``words`` has distinct, non-null ``word``s of at most LATTICE characters. An edge goes from character ``s`` to ``e``. For unigram
    all single characters have an edge, too, and an edge has its ``gain``. For bpe the array is in the order of merges, ``m`` is where the
    two halves of a piece meet, and words without pieces of two characters or more, or with more than MERGES, are left out.
    """
    spark = words.sparkSession
    bpe = vocabulary.kind == "bpe"
    if bpe and (vocabulary.longest > 31 or len(vocabulary.scores) >= 1 << 18 or max(vocabulary.ids.values(), default=0) >= 1 << 18):
        raise ValueError("pieces of more than 31 characters or more than 2^18 pieces don't fit an edge")
    halves = vocabulary.halves() if bpe else {}
    rank = {c: i for i, c in enumerate(sorted({-s for s in vocabulary.scores.values()}))}
    pieces = [(p, vocabulary.ids[p], float(s), rank[-s], *halves.get(p, (0, 0))) for p, s in vocabulary.scores.items() if not bpe or p in halves]
    lengths: dict[str, set[int]] = {}
    for p, *_ in pieces:
        if len(p) >= PREFIX:
            lengths.setdefault(p[:PREFIX], set()).add(len(p))
    # both are bounded by the size of the vocabulary
    piece_table = F.broadcast(spark.createDataFrame(pieces, "piece string, id int, score double, rank long, half long, place long"))
    prefixes = F.broadcast(spark.createDataFrame([(p, sorted(n)) for p, n in lengths.items()], "prefix string, lengths array<int>"))
    shortest = 2 if bpe else 1
    left = F.char_length("word") - F.col("s")
    starts = words.where(F.char_length("word") >= shortest).select("word", F.explode(F.sequence(F.lit(0), F.char_length("word") - shortest)).alias("s"))
    known = starts.withColumn("prefix", F.substring("word", F.col("s") + 1, F.lit(PREFIX))).join(prefixes, "prefix", "left")
    some = F.concat(F.array(*(F.lit(i) for i in range(shortest, PREFIX))), F.coalesce("lengths", F.array().cast("array<int>")))
    spans = known.select("word", "s", F.explode(some).alias("n")).where(F.col("n") <= left)
    named = spans.withColumn("piece", F.substring("word", F.col("s") + 1, F.col("n")))
    if not bpe:
        met = named.join(piece_table, "piece", "left").where(F.col("id").isNotNull() | (F.col("n") == 1))
        unknown = -F.ascii("piece") - 1
        edge = F.struct((F.col("s") + F.col("n")).alias("e"), "s", F.coalesce("score", F.lit(vocabulary.floor)).alias("gain"), F.coalesce("id", unknown).alias("id"))
        return met.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    # an edge travels as one long, in the order of merges: rank (19 bits), place (7), end (7), begin from behind (7), length of the left half (5), id (18)
    packed = F.expr("shiftleft(rank, 44) + shiftleft(s + place, 37) + shiftleft(CAST(s + n AS BIGINT), 30) + shiftleft(127L - s, 23) + shiftleft(half, 18) + id")
    held = named.join(piece_table, "piece").groupBy("word").agg(F.sort_array(F.collect_list(packed)).alias("packed")).where(F.size("packed") <= MERGES)
    begin = "CAST(127 - (shiftright(x, 23) & 127) AS INT)"
    fields = f"""transform(packed, x -> named_struct('s', {begin}, 'e', CAST(shiftright(x, 30) & 127 AS INT),
        'm', {begin} + CAST(shiftright(x, 18) & 31 AS INT), 'id', CAST(x & 262143 AS INT)))"""
    return held.select("word", F.expr(fields).alias("edges"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used: as the variable of a function over a one-element array."""
    return F.transform(F.array(value), use)[0]


def _with_gains(edges: Column) -> Column:
    """Edges of a bpe lattice (MERGES at most) with ``gain``: a bit for each merge that builds the piece, the first merge the highest."""

    none = F.lit(0).cast("long")

    def built(keys: Column) -> Column:
        half = lambda done, s, e: F.coalesce(F.try_element_at(done, F.nullif(F.array_position(keys, s * 128 + e).cast("int"), F.lit(0))), none)
        bit = lambda done: F.call_function("shiftleft", F.lit(1).cast("long"), MERGES - 1 - F.size(done))
        whole = lambda done, x: F.when(x["e"] - x["s"] == 2, bit(done)).otherwise(bit(done) + half(done, x["s"], x["m"]) + half(done, x["m"], x["e"]))
        return F.aggregate(edges, F.array().cast("array<bigint>"), lambda done, x: F.array_append(done, whole(done, x)))

    gains = _once(F.transform(edges, lambda x: x["s"] * 128 + x["e"]), built)
    return F.zip_with(edges, gains, lambda x, g: F.struct(x["e"].alias("e"), x["s"].alias("s"), g.alias("gain"), x["id"].alias("id")))


def _viterbi(edges: Column, zero: Column) -> Column:
    """Ids along the path with the greatest gain; of equal ones that with the longer last piece.

    ``edges`` has every single character and is ordered by end, then begin. The state holds, for every end reached, the gain and the ids of its best path.
    """
    start = F.array(F.struct(zero.alias("gain"), F.array().cast("array<int>").alias("ids")))

    def step(state: Column, x: Column) -> Column:
        before = F.element_at(state, x["s"] + 1)
        gain = before["gain"] + x["gain"]
        new = F.struct(gain.alias("gain"), F.array_append(before["ids"], x["id"]).alias("ids"))
        better = F.when(gain > F.element_at(state, -1)["gain"], F.array_append(F.slice(state, 1, x["e"]), new)).otherwise(state)
        return F.when(x["e"] == F.size(state), F.array_append(state, new)).otherwise(better)

    return F.element_at(F.aggregate(edges, start, step), -1)["ids"]


def segmented(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``word`` and ``ids`` (array<int>): the segmentation of each distinct word, which must not be null or empty.

    A single character that bpe leaves alone, or that isn't a piece, has its code point, negated, less one, in place of an
    id; :func:`resolved` puts ids there. Words of bpe without a merge or with more than MERGES possible ones are left out.
    """
    cut = lattice(words, vocabulary)
    if vocabulary.kind == "unigram":
        return cut.select("word", _viterbi(F.col("edges"), F.lit(0.0)).alias("ids"))
    point = lambda e: -F.ascii(F.substring(F.col("word"), e, F.lit(1))) - 1
    single = F.transform(F.sequence(F.lit(1), F.char_length("word")), lambda e: F.struct(e.alias("e"), (e - 1).alias("s"), F.lit(0).cast("long").alias("gain"), point(e).alias("id")))
    every = F.sort_array(F.concat(single, _once(F.col("edges"), _with_gains)))
    return cut.select("word", _viterbi(every, F.lit(0).cast("long")).alias("ids"))


def resolved(ids: pa.ListArray, vocabulary: Vocabulary) -> pa.ListArray:
    """Lists of ids with the ids (or bytes) of single characters where :func:`segmented` left code points."""
    flat = ids.values.to_numpy()
    at = np.flatnonzero(flat < 0)
    if not len(at):
        return ids
    points, back = np.unique(-flat[at] - 1, return_inverse=True)
    chars = [vocabulary.spelling(chr(c)) for c in points.tolist()]
    size = np.ones(len(flat), np.int64)
    size[at] = np.array([len(c) for c in chars], np.int64)[back]
    out = np.repeat(flat, size)
    end = np.concatenate([[0], np.cumsum(size)])
    for k, c in enumerate(chars):
        for j, i in enumerate(c):
            out[end[at[back == k]] + j] = i
    return pa.ListArray.from_arrays(pa.array(end[ids.offsets.to_numpy()].astype(np.int32)), pa.array(out, pa.int32()))


def _parts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows in parts of about PART_BYTES of text (column ``at``), each with its chunk: a run of parts of one task with about CHUNK_BYTES."""
    chunk, held = TaskContext.get().partitionId() << 24, 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
        start = size = 0
        for i, n in enumerate([*sizes, 0], 1):
            if i <= len(sizes) and not (size + n > PART_BYTES and size):
                size += n
                continue
            if i - 1 > start:
                yield chunk, batch.slice(start, i - 1 - start)
                held += size
                if held > CHUNK_BYTES:
                    chunk, held = chunk + 1, 0
            start, size = i - 1, n


def _packed(rows: pa.RecordBatch) -> bytes:
    """Rows as a compressed Arrow stream, so that texts travel small."""
    sink = pa.BufferOutputStream()
    whole = pa.Table.from_batches([rows]).combine_chunks()
    with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(whole)
    return sink.getvalue().to_pybytes()


def _pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of chunk, word and ids become blobs of one chunk each: packed together, a word costs a few bytes."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        chunk = rows.column(0).to_numpy()
        for c in np.unique(chunk):
            part = rows.filter(pa.array(chunk == c))
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([_packed(part.select(["word", "ids"]))], pa.binary())], names=["chunk", "blob"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= PACKED:
            yield from flush()
    if held:
        yield from flush()


class _Dictionary:
    """Words of one chunk with their ids; words that it doesn't have are cut where they are met."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.words: list[pa.Array] = []
        self.ids: list[pa.Array] = []

    def add(self, words: pa.Array, ids: pa.ListArray) -> None:
        self.words.append(words.cast(pa.large_string()))
        self.ids.append(ids)

    def encode(self, words: pa.Array, ends: np.ndarray) -> pa.ListArray:
        """Ids of texts given by their words and where each text's words end."""
        known = pa.chunked_array(self.words, pa.large_string()).combine_chunks()
        lists = pa.chunked_array(self.ids, pa.list_(pa.int32())).combine_chunks()
        self.words, self.ids = [known], [lists]
        own = words.dictionary_encode()
        place = pc.index_in(own.dictionary, value_set=known)
        if place.null_count:
            new = own.dictionary.filter(place.is_null())
            ids = [self.vocabulary.spelling(w) if len(w) == 1 else segment_long(w, self.vocabulary) for w in new.to_pylist()]
            self.add(new, pa.array(ids, pa.list_(pa.int32())))
            return self.encode(words, ends)
        code = place.to_numpy()[own.indices.to_numpy()]
        offset, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        start, n = offset[code].astype(np.int64), (offset[1:] - offset[:-1])[code].astype(np.int64)
        upto = np.cumsum(n)
        out = flat[np.arange(upto[-1] if len(upto) else 0) + np.repeat(start - (upto - n), n)]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto])[np.concatenate([[0], ends])].astype(np.int32)), pa.array(out, pa.int32()))


def spell(ids: list[int], spelled: list[bytes]) -> str:
    """The text of some ids. Bytes that aren't UTF-8 become U+FFFD; ids outside the vocabulary spell nothing."""
    return b"".join([spelled[i] for i in ids if 0 <= i < len(spelled)]).decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ")


def encoded(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: tuple[str, ...] = ("doc_id",), verify: bool = False) -> DataFrame:
    """``keep`` and ``ids`` (array<int>) of every whole text, as the library encodes it.

    With ``verify`` also ``round_trip``: whether the ids, decoded again, spell the text (U+2581 decodes to a space, as it does in the library).

    Null and empty texts have no ids. Ids of documents may repeat or be null, rows too; further columns are ignored; an
    empty table gives an empty result. Words that the lattice leaves out, of one character, or of more than ``LATTICE`` characters or
    ``MERGES`` possible merges (in practice one character over and over), get the same ids from :func:`segment_long`. Texts of any length are read whole.
    """
    small_batches(docs.sparkSession)
    grouped_in_memory(docs.sparkSession, GROUPS)
    columns = list(dict.fromkeys([*keep, text]))
    base = docs.select(*columns)
    at = columns.index(text)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen, now = cutter(vocabulary), [], None
        for chunk, part in _parts(batches, 0):
            if chunk != now:
                yield from rows(now, seen)
                seen, now = [], chunk
            seen.append(cut(part.column(0))[0].unique())
        yield from rows(now, seen)

    def rows(chunk: int | None, seen: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        if seen:
            every = pa.chunked_array(seen).unique()
            size = pc.utf8_length(every)
            short = every.filter(pc.and_(pc.greater(size, 1), pc.less_equal(size, LATTICE))).cast(pa.string())
            for first in range(0, len(short), 10_000):
                part = short.slice(first, 10_000)
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(part), pa.int64()), part], names=["chunk", "word"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, part in _parts(batches, at):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([_packed(part)], pa.binary())], names=["chunk", "blob"])

    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("round_trip", T.BooleanType())] if verify else [])])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, spelled = cutter(vocabulary), vocabulary.spelled()
        now, known = None, _Dictionary(vocabulary)
        for batch in batches:
            for chunk, is_text, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if chunk != now:
                    now, known = chunk, _Dictionary(vocabulary)
                part = pa.ipc.open_stream(blob.as_buffer()).read_all().to_batches()[0]
                if not is_text:
                    known.add(part.column(0), resolved(part.column(1), vocabulary))
                    continue
                texts = part.column(text)
                words, ends = cut(texts)
                ids = known.encode(words, ends)
                same = [pa.array(_same(words, ids, texts, spelled), pa.bool_())] if verify else []
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), ids, *same], names=schema.names)

    # the aggregate keeps both columns, so that it and the join below share one exchange
    pairs = base.select(text).mapInArrow(words_of, "chunk long, word string").repartition(2 * partitions, "word")
    ids = segmented(pairs.groupBy("word").agg(F.min("chunk").alias("any")).where(F.col("any").isNotNull()).select("word"), vocabulary)
    lookup = pairs.join(ids, "word").select("chunk", "word", "ids").mapInArrow(_pack_words, "chunk long, blob binary")
    texts = base.mapInArrow(pack, "chunk long, blob binary")
    # texts come first in the union, so that their tasks have the numbers, and their chunks the names, that they have when their words are read
    both = texts.withColumn("is_text", F.lit(True)).unionByName(lookup.withColumn("is_text", F.lit(False)))
    return both.select("chunk", "is_text", "blob").repartition("chunk").sortWithinPartitions("chunk", "is_text").mapInArrow(apply, schema)


def _same(words: pa.Array, ids: pa.ListArray, texts: pa.Array, spelled: list[bytes]) -> list[bool]:
    """Of each text, whether its ids spell it; mostly one look at all of them is enough."""
    _, offsets, data = words.buffers()
    edge = np.frombuffer(offsets, np.int64)
    flat, size = ids.values.to_numpy(), np.array([len(x) for x in spelled], np.int64)
    n = size[flat]
    at = np.repeat((np.cumsum(size) - size)[flat] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    if np.array_equal(np.frombuffer(b"".join(spelled), np.uint8)[at], np.frombuffer(data or b"", np.uint8)[edge[0] : edge[len(words)]]):
        return [True] * len(texts)
    return [spell(i, spelled) == (t or "").replace(SPACE, " ") for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)]


def decoded(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the text that the ids spell (see :func:`spell`); null ids give null."""
    spelled = vocabulary.spelled()
    base = df.drop(out)
    at = base.columns.index(ids)
    schema = T.StructType([*base.schema.fields, T.StructField(out, T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [spell(r.as_py(), spelled) if r.is_valid else None for r in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return base.mapInArrow(each, schema)


def tokenised(docs: DataFrame) -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens`` and ``round_trip``; columns of these names are replaced."""
    keep = tuple(c for c in docs.columns if c not in ("ids", "n_tokens", "round_trip"))
    done = encoded(docs.select(*keep), load_vocabulary(), keep=keep, verify=True)
    return done.select(*keep, "ids", F.size("ids").alias("n_tokens"), "round_trip")


def op6_pieces(spark, sf_dir: str) -> DataFrame:
    return tokenised(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES = {"op6_pieces": op6_pieces}
