"""Ranks and running totals inside a group, in pieces, so that no group is one task's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, group: str, piece: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the group's rows before this one, by (piece, order).

    Each (group, piece) is summed first; the pieces' totals, of which a group has a bounded number, are then summed in
    order. group and piece must not be null.
    """
    sized = df.withColumn("_v", value.cast("long"))
    pieces = sized.groupBy(group, piece).agg(F.sum("_v").alias("_n"))
    before = Window.partitionBy(group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(group, piece, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sized.join(offsets, [group, piece])
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .drop("_v", "_offset")
    )
