"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostlake.llm.runtime import staged


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def hooked(edges: DataFrame, child: str, root: str) -> DataFrame:
    """Edges ``u``, ``v`` with the same components as those of many forests, in which a node is a child of one root per forest.

    A child stays with the smallest of its roots, and the others are tied to that one. Children of a large group have
    much the same few roots, so what is left is about an edge per child; no key has more rows than there are forests.
    """
    low = F.min(root).over(Window.partitionBy(child))
    tied = staged(edges.select(F.col(child).alias("c"), F.col(root).alias("r"), low.alias("m")))
    return tied.select(F.col("c").alias("u"), F.col("m").alias("v")).unionByName(tied.where(F.col("r") != F.col("m")).select(F.col("r").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Component of every node that has an edge.

    ``edges`` holds pairs of longs in columns ``a`` and ``b``. Returns ``node`` and
    ``component`` (the smallest node reachable). Loops, repeats and null ends are
    ignored; an empty table gives an empty result. Each round is two joins on the
    node, so neither a long chain nor a hub gathers a component in one task: minima
    are combined before the shuffle, and the joins can be split by adaptive execution.
    """
    current = staged(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    seen = _mark(current)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(lowest, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .unionByName(lowest.select("u", F.col("m").alias("v")))
            .distinct()
        )
        current = staged(small)
        mark = _mark(current)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
