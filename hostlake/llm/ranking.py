"""Positions inside large groups without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, group: list[str], chunks: list[Column], order: list[Column], amount: Column, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``amount`` over the rows of ``group`` that come before.

    ``chunks``, coarse to fine, cut each group into runs that follow one another in ``order``: sorted by the chunks first, rows stay in
    their order. Only the rows of a finest chunk are ordered among themselves; of chunks only their sums are, chunk by
    coarser chunk. Groups may be null; ``amount`` and chunks must not be.
    """
    names = [f"__chunk{i}" for i in range(len(chunks))]
    keyed = df.withColumns({**dict(zip(names, chunks, strict=True)), "__amount": amount})
    local = Window.partitionBy(*group, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("__local", F.coalesce(F.sum("__amount").over(local), F.lit(0)))
    if not chunks:
        return placed.withColumn(out, F.col("__local")).select(*df.columns, out)
    sums = keyed.groupBy(*group, *names).agg(F.sum("__amount").alias("__sum"))
    at = [F.col(n) for n in names]
    offsets = running(sums, group, at[:-1], at, F.col("__sum"), "__offset")
    renamed = offsets.select(*(F.col(c).alias(f"{c}_of") for c in (*group, *names)), "__offset")
    on = F.lit(True)
    for c in group:
        on &= F.col(c).eqNullSafe(F.col(f"{c}_of"))
    for c in names:
        on &= F.col(c) == F.col(f"{c}_of")
    return placed.join(renamed, on).withColumn(out, F.col("__offset") + F.col("__local")).select(*df.columns, out)
