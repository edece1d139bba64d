"""Quotation linking: who quotes whom, and conversations in reply order without the quotes.

DataFrame functions only. A line that begins with ``>`` marks is quoted, as deep as it has marks.
Runs of lines of one depth are passages; passages and single lines are hashed after normalising and meet
the earlier messages of the conversation that have them unquoted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlake.llm.ranking import running
from hostlake.llm.runtime import staged, table

#: Quote marks in front of a line, and the line that announces a quotation.
MARKS = r"^[ \t]*+(?:>[ \t]?+)++"
ANNOUNCED = r"(?i)^[ \t]*on .{1,200} wrote:[ \t\r]*$"
#: Turns whose order is found together.
RUN = 1024


def depth_of(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def unquoted(text: str) -> Column:
    """The message's own lines, less announcements and blank lines at either end; null stays null."""
    own = F.filter(F.split(F.col(text), "\n"), lambda x: ~x.rlike(MARKS) & ~x.rlike(ANNOUNCED))
    return F.regexp_replace(F.regexp_replace(F.array_join(own, "\n"), r"\A(?:[ \t\r]*\n)+", ""), r"\s+\z", "")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """Passages of every message: ``rid``, ``depth`` (0: its own words), ``begin`` (first line) and ``hash`` (64 bits).

    Runs of lines of one depth (an empty line ends a run) give one passage, and each of their lines one more
    unless it is the whole run. Passages without letters or digits are left out.
    """
    lines = messages.select("rid", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    lines = lines.withColumn("depth", depth_of(F.col("raw"))).withColumn("body", normalised(F.regexp_replace("raw", MARKS, "")))
    lines = lines.where(F.col("body").rlike(r"[\p{L}\p{N}]") & ~F.col("raw").rlike(ANNOUNCED))
    run = F.col("pos") - F.row_number().over(Window.partitionBy("rid", "depth").orderBy("pos"))
    runs = lines.withColumn("run", run).groupBy("rid", "depth", "run").agg(F.min("pos").alias("begin"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("parts"))
    whole = runs.select("rid", "depth", "begin", F.xxhash64(F.array_join(F.transform("parts", lambda p: p["body"]), " ")).alias("hash"))
    single = runs.where(F.col("n") > 1).select("rid", "depth", F.explode("parts").alias("p")).select("rid", "depth", F.col("p.pos").alias("begin"), F.xxhash64("p.body").alias("hash"))
    return whole.unionByName(single)


def quote_links(messages: DataFrame) -> DataFrame:
    """Quoted passages and the message each was taken from.

    ``messages`` has ``rid`` (unique), ``conv_id``, ``turn``, ``text``. Returns ``rid``, ``depth``, ``begin``, ``hash``
    and ``origin`` (the rid of the latest earlier message that has the passage in its own words, or null).
    The windows run over ``RUN`` turns of one passage of one conversation; earlier runs come in by their latest message only.
    """
    found = passages(messages).join(messages.select("rid", "conv_id", "turn"), "rid")
    found = found.where(F.col("turn").isNotNull()).withColumn("run", F.expr(f"turn div {RUN}")).withColumn("own", F.when(F.col("depth") == 0, F.struct("turn", "rid")))
    before = Window.partitionBy("conv_id", "hash", "run").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv_id", "hash").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    latest = found.groupBy("conv_id", "hash", "run").agg(F.max("own").alias("last")).withColumn("last", F.max("last").over(earlier))
    latest = latest.where(F.col("last").isNotNull()).select(F.col("conv_id").alias("c"), F.col("hash").alias("h"), F.col("run").alias("r"), "last")
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("hash") == F.col("h")) & (F.col("run") == F.col("r"))
    both = found.withColumn("near", F.max("own").over(before)).where(F.col("depth") > 0).join(latest, on, "left")
    return both.select("rid", "depth", "begin", "hash", F.coalesce("near", "last")["rid"].alias("origin"))


def linked_conversations(conversations: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Messages without quotes, in reply order.

    Returns, per row of ``conversations`` (conv_id, turn, role, text): conv_id, turn, role, ``body``, ``parent_turn``
    (of the earlier message whose words make up most of its shallowest linked quotes; of equals the latest),
    ``root_turn`` and ``reply_depth`` in its reply tree, ``n_quotes`` (quoted passages and lines), ``n_linked``
    (those with an origin) and ``position``, from 0: threads in the order of their roots, each in the order of turns,
    so that no reply comes before its parent.

    A message that quotes nothing known begins a thread. Null text: null body, no quotes. Rows without a turn have
    no links and come first; rows without conv_id form one conversation. Rows that repeat a turn are separate
    messages; the one with the smaller hash is the first. An empty table gives an empty result.
    """
    base = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = staged(base.withColumn("rid", F.monotonically_increasing_id()))
    links = staged(quote_links(rows))
    tally = links.groupBy("rid").agg(F.count("*").alias("n_quotes"), F.count("origin").alias("n_linked"))
    at = rows.select(F.col("rid").alias("origin"), F.col("turn").alias("at"))
    votes = links.where(F.col("origin").isNotNull()).groupBy("rid", "depth", "origin").agg(F.count("*").alias("votes")).join(at, "origin")
    parents = votes.groupBy("rid").agg(F.min(F.struct("depth", -F.col("votes"), -F.col("at"), "origin"))["origin"].alias("up"))
    # the ancestor that each message has reached and the steps up to it; every round doubles the steps
    reach = staged(parents.select("rid", "up", F.lit(1).cast("long").alias("steps")))
    open_now = reach.count()
    for _ in range(max_rounds):
        if not open_now:
            break
        higher = reach.select(F.col("rid").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        joined = reach.join(higher, "up", "left")
        new = staged(joined.select("rid", F.coalesce("next", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved")))
        moved = new.where("moved").limit(1).count()
        reach = new.drop("moved")
        if not moved:
            break
    else:
        raise RuntimeError("reply chains did not settle")
    turn_of = rows.select("rid", F.col("turn").alias("t"))
    full = (
        rows.join(tally, "rid", "left")
        .join(parents.join(turn_of.withColumnRenamed("rid", "up"), "up").select("rid", F.col("t").alias("parent_turn")), "rid", "left")
        .join(reach.join(turn_of.withColumnRenamed("rid", "up"), "up").select("rid", F.col("t").alias("root"), "steps"), "rid", "left")
        .select(
            "conv_id", "turn", "role", unquoted("text").alias("body"), "parent_turn", F.coalesce("root", "turn").alias("root_turn"),
            F.coalesce("steps", F.lit(0)).cast("long").alias("reply_depth"), F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
            F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.xxhash64("role", "text").alias("tie"), "rid",
        )
    )
    # threads of many roots, one thread of many turns, and turns that many rows share are all cut
    chunks = [F.coalesce(F.expr(f"root_turn div {RUN}"), F.lit(-(1 << 62))), F.struct(F.coalesce("root_turn", F.lit(-(1 << 62))).alias("root"), F.coalesce(F.expr(f"turn div {RUN}"), F.lit(-(1 << 62))).alias("run"))]
    chunks.append(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), F.shiftright("tie", 54).alias("part")))
    placed = running(full, ["conv_id"], chunks, [F.col("root_turn"), F.col("turn"), F.col("tie"), F.col("rid")], F.lit(1).cast("long"), "position")
    return placed.drop("tie", "rid")


def op4_quotes(spark, sf_dir: str) -> DataFrame:
    return linked_conversations(table(spark, sf_dir, "conversations"))


QUERIES = {"op4_quotes": op4_quotes}
