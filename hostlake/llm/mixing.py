"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

DataFrame functions only. Slot i of the schedule is the van der Corput point of i, mapped
through the cumulative targets of the sources; the slots of a source are ranked, and slot
number r of a source takes block r of that source's documents in shuffled order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlake.llm.ranking import running
from hostlake.llm.runtime import staged, table

#: Words of a block. A source's last block is cut where its target ends.
BLOCK = 4096
#: Weights of the sources in the order of their names, over and over.
WEIGHTS = (5.0, 2.0, 1.0)
#: Share of all words to take, times that a document may be taken, slots of a run, cells of the lookup.
SHARE, REPEATS, RUN, CELLS = 1.5, 2, 1 << 14, 4096


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def van_der_corput(i: Column) -> Column:
    """The bits of a non-negative long mirrored about the binary point: a double in [0, 1) from the first 52 of them."""
    x = i
    for shift, mask in (
        (1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F),
        (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF),
    ):
        x = F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask)), shift))
    return F.shiftrightunsigned(x, 12) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``target`` (double) per source from ``source`` and ``source_size``.

    Sources in the order of their code points, null last, weigh ``weights`` in turn and share ``share`` of all
    words. A target stops at ``repeats`` times its source, and what that leaves over goes to the others by weight
    until none is above: sources reach the cap in the order of cap per weight, so one running sum finds the rest.
    The table has one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (nth + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(repeats))
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    below = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    level = weighed.withColumn("level", left / F.sum("w").over(onward))
    free = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(whole)["level"]
    return level.select("source", "source_size", F.coalesce(F.least(free * F.col("w"), F.col("cap")), F.col("cap")).alias("target"))


def schedule(spark, plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """Slots of the mix: ``slot`` (their order), ``source_no`` and ``rank``, the number of the source's block.

    ``plan`` has ``source_no``, ``lo``, ``hi`` (longs: the source's part of all words to take) and ``total``.
    A source gets as many slots as it has blocks. The points of a low-discrepancy sequence leave a source at
    most a few blocks short of its share; such slots follow at the end.
    """
    total = plan.agg(F.max("total")).first()[0] or 0
    count = -(-total // block)
    width = max(-(-total // CELLS), 1)
    cells = plan.where(F.col("hi") > F.col("lo")).select(
        "source_no", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))).alias("cell")
    )
    slots = spark.range(count).select(F.col("id").alias("slot"), F.floor(van_der_corput(F.col("id")) * total).cast("long").alias("point"))
    placed = slots.withColumn("cell", F.expr(f"point div {width}")).join(cells, "cell").where((F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi")))
    ranked = staged(running(placed.select("slot", "source_no"), ["source_no"], [F.expr(f"slot div {RUN}")], [F.col("slot")], F.lit(1).cast("long"), "rank"))
    need = plan.select("source_no", F.expr(f"(hi - lo + {block - 1}) div {block}").alias("blocks"))
    timely = ranked.join(need, "source_no").where(F.col("rank") < F.col("blocks")).select("slot", "source_no", "rank")
    have = ranked.groupBy("source_no").agg(F.count("*").alias("have"))
    late = need.join(have, "source_no", "left").withColumn("have", F.coalesce("have", F.lit(0))).where(F.col("blocks") > F.col("have"))
    late = late.select("source_no", F.explode(F.sequence(F.col("have"), F.col("blocks") - 1)).alias("rank"))
    return timely.unionByName(late.select((F.col("rank") * 0 + count).alias("slot"), "source_no", "rank"))


def mix_slots(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", block: int = BLOCK, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The mix in its order, and what it is made from.

    The first table has ``slot`` (the place in the mix), ``source_no``, ``rank`` (the source's block that fills it), and what the block
    takes from one row: ``begin`` (which names the row within its source), ``turn`` (0: the first time that the mix
    reads it), ``first`` and ``words`` (the words from that on). The second has the rows: ``id``, ``source_no``, ``begin`` (null without words), ``size``,
    ``source_size`` and ``target``. See :func:`mixed` for the rules.
    """
    spark = docs.sparkSession
    rows = staged(
        docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), words(text).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"), F.xxhash64(text).alias("t"))
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    up_to = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plan = staged(
        targets(sizes)
        .withColumn("quota", F.round("target").cast("long"))
        .withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
        .withColumn("hi", F.sum("quota").over(up_to))
        .withColumn("lo", F.col("hi") - F.col("quota"))
        .withColumn("total", F.sum("quota").over(whole))
    )
    named = rows.join(plan.select(F.col("source").alias("own"), "source_no", "source_size", "target", "quota"), F.col("source").eqNullSafe(F.col("own"))).drop("own")
    # the upper bits of a hash cut a source into even runs of its shuffled order
    placed = running(named.where(F.col("size") > 0), ["source_no"], [F.shiftright("h", 50)], [F.col("h"), F.col("id"), F.col("t")], F.col("size"), "begin")
    columns = ["id", "source_no", "begin", "size", "source_size", "target"]
    # in one plan, the windows and joins of all steps would start at once and fill the driver
    placed = staged(placed.select(*columns, "quota"))
    turns = placed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    spans = turns.withColumn("from", F.col("begin") + F.col("turn") * F.col("source_size")).withColumn("to", F.least(F.col("from") + F.col("size"), F.col("quota")))
    pieces = spans.where(F.col("to") > F.col("from")).withColumn("rank", F.explode(F.sequence(F.expr(f"`from` div {block}"), F.expr(f"(`to` - 1) div {block}"))))
    start = F.greatest("from", F.col("rank") * block)
    slots = staged(
        pieces.join(schedule(spark, plan, block), ["source_no", "rank"]).select(
            "slot", "source_no", "rank", "begin", "turn", (start - F.col("from")).alias("first"), (F.least("to", (F.col("rank") + 1) * block) - start).alias("words")
        )
    )
    empty = named.where(F.col("size") == 0).withColumn("begin", F.lit(None).cast("long"))
    return slots, placed.select(columns).unionByName(empty.select(columns))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", block: int = BLOCK, seed: int = 17) -> DataFrame:
    """How many words of every document a mix takes.

    Returns one row per row of ``docs``: the id, ``size`` (words; null text: 0), ``source_size``, ``target``,
    ``taken`` (repeats counted, at most twice the size) and ``slot``, the place in the mix where its words come first (null: taken 0). The words taken from a source are its target, rounded;
    they are the first so many words of the source's shuffled documents, begun again after the last.

    The shuffle is a hash of the id, so reruns agree; rows that repeat an id follow one another and share
    what falls to them in an order set by their text. A null source is a source of its own, the last one. An empty
    table gives an empty result; other columns are ignored.
    """
    slots, rows = mix_slots(docs, text, source, id_col, block, seed)
    taken = slots.groupBy("source_no", "begin").agg(F.sum("words").alias("taken"), F.min("slot").alias("slot"))
    out = rows.join(taken, ["source_no", "begin"], "left").select("id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "slot")
    return out.withColumnRenamed("id", id_col)


def mixture_applied(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix reads them, in its order: a row as often as the mix begins it anew (0, 1 or 2 times).

    A document that is taken in part counts whole; its place is the slot where the mix begins it. Documents without words take no part in
    a mix and stay, at its end, as do rows without an id. Of rows that repeat an id each comes as often, and where, as the first of them.
    """
    slots, rows = mix_slots(docs)
    begun = slots.groupBy("source_no", "begin", "turn").agg(F.min("slot").alias("__slot"))
    known = rows.where(F.col("id").isNotNull())
    read = known.join(begun, ["source_no", "begin"]).groupBy("id", "turn").agg(F.min("__slot").alias("__slot"))
    none = known.groupBy("id").agg(F.max("size").alias("most")).where(F.col("most") == 0).select("id", F.lit(0).alias("turn"), F.lit(None).cast("long").alias("__slot"))
    again = staged(read.unionByName(none).select(F.col("id").alias("__id"), "__slot"))
    named = docs.where(F.col("doc_id").isNotNull()).join(again, F.col("doc_id") == F.col("__id"))
    rest = docs.where(F.col("doc_id").isNull()).withColumn("__slot", F.lit(None).cast("long"))
    return named.select(*docs.columns, "__slot").unionByName(rest).orderBy(F.col("__slot").asc_nulls_last(), "doc_id").select(*docs.columns)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


QUERIES = {"op8_mixing": op8_mixing}
