"""Source divergence audit: how the word frequencies of each source differ from those of other sources and of its language.

Terms that enough documents of a language have are put into minimal acyclic transducers (see ``transducer``), each over
a bounded run of the sorted terms. A term's ordinal, its place among the kept terms of its language, names it from then
on: texts stream through the transducers and are recounted by ordinal, and ties go by ordinal, which is UTF-8 order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlake.llm.runtime import small_batches, staged, table
from hostlake.llm.transducer import Transducer, build

#: Documents of a language that a kept term is in, at least; added to each count; ranks of terms that are reported.
LEAST, SMOOTH, RANKS = 30, 5, 50
#: Terms of one transducer; bytes of the transducers that are sent to tasks at a time (more take further passes over the texts).
RUN, PACK = 100_000, 64 << 20
#: Bytes of text that are counted at once; sums that a task holds before it hands them on; least terms of a block; cells (sources by terms) compared at once; sources of a tile.
SLICE, HELD, LEAST_BLOCK, CELLS, TILE = 4 << 20, 400_000, 512, 1 << 20, 128

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_LETTER = np.array([not (b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F) for b in range(256)])
_LOWER = np.array([b | 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def slices(text: bytes, size: int = SLICE) -> Iterator[bytes]:
    """``text`` in parts of about ``size`` bytes; no term is cut."""
    at = 0
    while at < len(text):
        stop = min(at + size, len(text))
        while stop < len(text) and _LETTER[text[stop]]:
            stop += 1
        yield text[at:stop]
        at = stop


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``lang``, ``term``, ``n`` (documents that have it). Tasks add up what they can hold before it is shuffled."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, dict[bytes, int]] = {}
        size = 0

        def handed() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                for at in range(0, len(counts), 50_000):
                    terms = list(counts)[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.binary()).cast(pa.string()), pa.array(terms, pa.binary()), pa.array([counts[t] for t in terms], pa.int64())], names=["lang", "term", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).cast(pa.binary()), batch.column(1).cast(pa.binary()), strict=True):
                counts = held.setdefault(lang.as_py(), {})
                before = len(counts)
                for term in set(chain.from_iterable(TERM.findall(part.lower()) for part in slices(text.as_py()))):
                    counts[term] = counts.get(term, 0) + 1
                size += len(counts) - before
                if size >= HELD:
                    yield from handed()
                    held, size = {}, 0
        yield from handed()

    parts = docs.select("lang", "text").mapInArrow(each, "lang string, term binary, n long")
    return parts.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def vocabulary(kept: DataFrame, run: int = RUN) -> DataFrame:
    """Transducers over runs of at most ``run`` ascending terms of each language, staged: ``lang``, ``shard``, ``offset`` (ordinal of the first term), ``n``, ``first``, ``terms`` and the arrays."""
    fields = Transducer.FIELDS
    names = ["lang", "first", "n", "terms", *fields]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, terms = None, []

        def done() -> pa.RecordBatch:
            arrays = [pa.array([p], pa.binary()) for p in build(terms).packed()]
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([terms[0]], pa.binary()), pa.array([len(terms)], pa.int64()), pa.array([terms], pa.list_(pa.binary())), *arrays], names=names)

        for batch in batches:
            for its, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if terms and (its != lang or len(terms) == run):
                    yield done()
                    terms = []
                lang = its
                terms.append(term)
        if terms:
            yield done()

    ordered = kept.select("lang", "term").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    made = staged(ordered.mapInArrow(each, "lang string, first binary, n long, terms array<binary>, " + ", ".join(f"{f} binary" for f in fields)))
    # the numbers of a few runs per language; their arrays stay where they are
    order = Window.partitionBy("lang").orderBy("first")
    places = made.select("lang", "first", (F.row_number().over(order) - 1).alias("shard"), F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return staged(made.join(places, ["lang", "first"]))


def _leading(term: bytes) -> int:
    return int.from_bytes(term[:8].ljust(8, b"\0"), "big")


class Pack:
    """Transducers of some runs of terms, by language."""

    def __init__(self, rows: list) -> None:
        self.runs: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: (r["lang"], r["shard"])):
            self.runs.setdefault(r["lang"], []).append((_leading(r["first"]), r["offset"], Transducer.unpacked(r[f] for f in Transducer.FIELDS)))

    def count(self, lang: str, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ordinals of the kept terms in ``text``, ascending, and how often each occurs."""
        raw = np.frombuffer(text, np.uint8)
        edge = np.diff(_LETTER[raw].astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        data = np.append(_LOWER[raw], np.uint8(0))
        runs = self.runs[lang]
        if len(runs) == 1:
            _, offset, machine = runs[0]
            found = machine.ordinals(data, starts, ends)
            return np.unique(found[found >= 0] + offset, return_counts=True)
        # runs whose first term has the same leading bytes may hold it; so may the one before them
        wide = np.append(data, np.zeros(8, np.uint8))[starts[:, None] + np.arange(8)]
        wide[np.arange(8) >= (ends - starts)[:, None]] = 0
        lead = wide.copy().view(">u8").ravel()
        firsts = np.array([f for f, _, _ in runs], np.uint64)
        low, high = np.searchsorted(firsts, lead, "left") - 1, np.searchsorted(firsts, lead, "right") - 1
        parts = []
        for k, (_, offset, machine) in enumerate(runs):
            some = np.flatnonzero((low <= k) & (k <= high))
            found = machine.ordinals(data, starts[some], ends[some])
            parts.append(found[found >= 0] + offset)
        return np.unique(np.concatenate(parts), return_counts=True)


def recounted(docs: DataFrame, words: DataFrame, pack: int = PACK) -> DataFrame:
    """``lang``, ``source``, ``ordinal``, ``n``: occurrences of each kept term, summed per task. Texts stream through at most ``pack`` bytes of transducers per pass."""
    spark = docs.sparkSession
    size = sum((F.length(f) for f in Transducer.FIELDS), F.lit(0))
    sizes = sorted((r["lang"], r["shard"], r["size"]) for r in words.select("lang", "shard", size.alias("size")).collect())  # one short row per run of terms
    packs: list[list[tuple[str, int]]] = []
    room = 0
    for lang, shard, much in sizes:
        if not packs or much > room:
            packs.append([])
            room = pack
        packs[-1].append((lang, shard))
        room -= much
    out = spark.createDataFrame([], "lang string, source string, ordinal long, n long")
    for chosen in packs:
        lo, hi = chosen[0], chosen[-1]
        within = (F.struct("lang", "shard") >= F.struct(F.lit(lo[0]), F.lit(lo[1]))) & (F.struct("lang", "shard") <= F.struct(F.lit(hi[0]), F.lit(hi[1])))
        rows = words.where(within).select("lang", "shard", "offset", "first", *Transducer.FIELDS).collect()
        sent = spark.sparkContext.broadcast([r.asDict() for r in rows])
        langs = sorted({r["lang"] for r in rows})

        def each(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            machines = Pack(sent.value)
            keys: dict[tuple, int] = {}
            held: list[tuple[int, np.ndarray, np.ndarray]] = []
            size = 0

            def handed() -> Iterator[pa.RecordBatch]:
                by: dict[int, list] = {}
                for g, ordinals, counts in held:
                    by.setdefault(g, []).append((ordinals, counts))
                names = list(keys)
                for g, parts in by.items():
                    ordinals, where = np.unique(np.concatenate([o for o, _ in parts]), return_inverse=True)
                    counts = np.zeros(len(ordinals), np.int64)
                    np.add.at(counts, where, np.concatenate([c for _, c in parts]))
                    lang, source = (pa.array([v] * len(ordinals), pa.string()) for v in names[g])
                    yield pa.RecordBatch.from_arrays([lang, source, pa.array(ordinals, pa.int64()), pa.array(counts)], names=["lang", "source", "ordinal", "n"])

            for batch in batches:
                joined: dict[int, list[bytes]] = {}
                room = SLICE
                for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                    g = keys.setdefault((lang, source), len(keys))
                    for part in slices(text.as_py()):
                        joined.setdefault(g, []).append(part)
                        room -= len(part)
                        if room <= 0:
                            for name, texts in joined.items():
                                held.append((name, *machines.count(list(keys)[name][0], b"\n".join(texts))))
                                size += len(held[-1][1])
                            joined, room = {}, SLICE
                for name, texts in joined.items():
                    held.append((name, *machines.count(list(keys)[name][0], b"\n".join(texts))))
                    size += len(held[-1][1])
                if size >= HELD:
                    yield from handed()
                    held, size = [], 0
            yield from handed()

        out = out.unionByName(docs.where(F.col("lang").isin(langs)).mapInArrow(each, "lang string, source string, ordinal long, n long"))
    return out


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(1000000000 * (count + 5) / (total + 5 * kinds)), in whole numbers of up to 38 digits."""
    above = (count.cast("decimal(20,0)") + F.lit(SMOOTH).cast("decimal(2,0)")) * F.lit(1_000_000_000).cast("decimal(10,0)")
    below = total.cast("decimal(20,0)") + kinds.cast("decimal(12,0)") * F.lit(SMOOTH).cast("decimal(2,0)")
    return F.call_function("div", above, below) + 1


def distances(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value``: for each two sources of a language, the sum over all kept terms of the difference of their shares.

    ``shares``: ``lang``, ``source``, ``ordinal``, ``p`` of terms that occur; ``groups``: ``lang``, ``source``, ``kinds`` and ``p0``, the share of a term that doesn't.
    Both have ``sources``, the number of sources of the language.
    A block of ordinals of one language meets in a task as a bounded matrix; rows are compared with a tile of rows at a time.
    """
    size = F.greatest(F.lit(LEAST_BLOCK), F.least(F.col("sources"), F.floor(F.lit(CELLS) / F.col("sources")))).alias("block_size")
    tiles = F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / TILE))).alias("tile")
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("no")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("kinds") - 1) / F.col("block_size"))))).alias("block")
    members = groups.select("*", size, place).select("*", blocks).select("*", tiles)
    members = members.select("lang", "block", "tile", "source", "no", "kinds", "block_size", F.lit(-1).cast("long").alias("ordinal"), F.col("p0").alias("p"))
    cells = shares.select("*", size).withColumn("block", F.floor(F.col("ordinal") / F.col("block_size"))).select("*", tiles)
    none = F.lit(None).cast("long")
    cells = cells.select("lang", "block", "tile", "source", none.alias("no"), none.alias("kinds"), "block_size", "ordinal", "p")

    def compared(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        is_member = rows["ordinal"] < 0
        their = rows[is_member].sort_values("no")
        names = their["source"].to_numpy()
        row_of = {s: i for i, s in enumerate(names)}
        size = int(their["block_size"].iloc[0])
        width = int(min(size, max(0, their["kinds"].iloc[0] - key[1] * size)))
        matrix = np.repeat(their["p"].to_numpy(np.int64)[:, None], width, 1)
        own = rows[~is_member]
        matrix[own["source"].map(row_of).to_numpy(np.int64), own["ordinal"].to_numpy(np.int64) - key[1] * size] = own["p"].to_numpy(np.int64)
        mine = range(key[2] * TILE, min(len(names), (key[2] + 1) * TILE))
        value = np.concatenate([np.abs(matrix - matrix[i]).sum(1) for i in mine])
        out = pd.DataFrame({"lang": key[0], "source": np.repeat(names[list(mine)], len(names)), "item": np.tile(names, len(mine)), "value": value})
        return out[np.repeat(list(mine), len(names)) != np.tile(np.arange(len(names)), len(mine))]

    both = members.unionByName(cells)
    parts = both.groupBy("lang", "block", "tile").applyInPandas(compared, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_audit(docs: DataFrame, least: int = LEAST, ranks: int = RANKS, run: int = RUN, pack: int = PACK) -> DataFrame:
    """Rows of part ``pair`` (distance to each other source of the language) and ``term`` (terms that a source uses more than its language does).

    Returns ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank`` (per group and part; value descending, item ascending in UTF-8).
    Null text, lang and source are empty strings. Repeated rows count each time. Groups without a kept term still have their
    pairs: at distance 0 in a language that keeps none. A language with one source has no pairs. An empty table gives no rows.
    Other columns are ignored. Ids aren't read.
    """
    small_batches(docs.sparkSession)
    clean = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = document_frequencies(clean).where(F.col("n") >= least)
    words = vocabulary(kept, run)
    # one exchange: sums of (lang, ordinal, source) and of (lang, ordinal) both stay where the key is
    parts = recounted(clean, words, pack).repartition("lang", "ordinal")
    counts = parts.groupBy("lang", "ordinal", "source").agg(F.sum("n").alias("n"))
    counts = staged(counts.withColumn("n_lang", F.sum("n").over(Window.partitionBy("lang", "ordinal"))))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kinds = words.groupBy("lang").agg(F.sum("n").alias("kinds"))
    groups = clean.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kinds, "lang", "left").na.fill(0, ["total", "kinds"])
    of_lang = Window.partitionBy("lang")
    groups = staged(groups.withColumn("total_lang", F.sum("total").over(of_lang)).withColumn("sources", F.count("*").over(of_lang)))
    p0 = F.when(F.col("kinds") > 0, share(F.lit(0), F.col("total"), F.col("kinds"))).otherwise(0)
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kinds")))
    order = Window.partitionBy("lang", "source")
    pairs = distances(shares.select("lang", "source", "ordinal", "p", "sources"), groups.withColumn("p0", p0))
    pairs = pairs.withColumn("rank", F.row_number().over(order.orderBy(F.desc("value"), "item"))).withColumn("part", F.lit("pair"))
    above = shares.withColumn("value", F.col("p") - share(F.col("n_lang"), F.col("total_lang"), F.col("kinds"))).where("n > 0 AND value > 0").select("lang", "source", "ordinal", "value")
    top = above.withColumn("rank", F.row_number().over(order.orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= ranks)
    spelled = words.select("lang", F.posexplode("terms").alias("at", "term"), "offset").select("lang", (F.col("offset") + F.col("at")).alias("ordinal"), F.col("term").cast("string").alias("item"))
    terms = top.join(spelled, ["lang", "ordinal"]).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(terms.select(columns))


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return source_audit(table(spark, sf_dir, "documents"))


QUERIES = {"op12_divergence": op12_divergence}

ORACLE_SQL = {
    "op12_divergence": f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
occurrences AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM occurrences GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST}),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM occurrences JOIN kept USING (lang, term) GROUP BY ALL),
kinds AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, k.term) AS n_lang, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang) AS total_lang
  FROM groups g JOIN kept k USING (lang) JOIN kinds USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n::HUGEINT + {SMOOTH})) // (total::HUGEINT + {SMOOTH} * v) AS p,
    1 + (1000000000::HUGEINT * (n_lang::HUGEINT + {SMOOTH})) // (total_lang::HUGEINT + {SMOOTH} * v) AS q FROM cells),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
ranked AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS place FROM ranked)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(place AS INTEGER) AS rank FROM numbered WHERE part = 'pair' OR place <= {RANKS}
"""
}
