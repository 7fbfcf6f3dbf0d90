"""Generators of lattices, windows and tile jobs, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid_centers(spark: SparkSession, left: float, right: float, bottom: float, top: float, tile: float, stride: float, margin: float = 0.0) -> DataFrame:
    """(iy, ix, x, y) of squares that fit the bounds: centres are index times stride from the first, rows from below."""
    count = lambda a, b: max(0, int((b - a - tile - 2 * margin + 1e-6) // stride) + 1)
    nx, ny = count(left, right), count(bottom, top)
    cells = spark.range(nx * ny).select(F.floor(F.col("id") / max(nx, 1)).alias("iy"), (F.col("id") % max(nx, 1)).alias("ix"))
    first = margin + tile / 2
    return cells.select("iy", "ix", (F.lit(left + first) + F.col("ix") * stride).alias("x"), (F.lit(bottom + first) + F.col("iy") * stride).alias("y"))


def windows(cells: DataFrame, radius: float, step: float) -> DataFrame:
    """Each cell's window centres within a square of this half side, on the lattice of the step; cells: id, x, y."""
    n = int(radius // step)
    off = F.sequence(F.lit(-n), F.lit(n))
    rows = cells.withColumn("_i", F.explode(off)).withColumn("_j", F.explode(off))
    snap = lambda v: F.rint(v / step) * step
    return rows.select(*cells.columns, snap(F.col("x") + F.col("_i") * step).alias("wx"), snap(F.col("y") + F.col("_j") * step).alias("wy"))


def needed(cells: DataFrame, radius: float, step: float) -> DataFrame:
    """(query, wx, wy, first): the different windows of each query's cells, with the least rank that needs it.

    Cells that snap to one centre count once, with their least rank. cells: query, rank, x, y.
    """
    snap = lambda c: F.rint(F.col(c) / step) * step
    unique = cells.groupBy("query", snap("x").alias("x"), snap("y").alias("y")).agg(F.min("rank").alias("rank"))
    return windows(unique, radius, step).groupBy("query", "wx", "wy").agg(F.min("rank").alias("first"))


def pyramid(tiles: DataFrame, levels: int, base: float, shrink: float) -> DataFrame:
    """Each tile's concentric levels from its base, and the margin that keeps them inside it."""
    rows = tiles.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    size = F.lit(base) - F.col("level") * shrink
    return rows.withColumn("window_m", size).withColumn("margin_m", (F.lit(base) - size) / 2)


def microbatches(spark: SparkSession, logical: int, physical: int) -> DataFrame:
    """(begin, stop) of the physical parts of a logical batch."""
    return spark.range(0, logical, physical).select(F.col("id").alias("begin"), F.least(F.col("id") + physical, F.lit(logical)).alias("stop"))


def keypoints(spark: SparkSession, height: int, width: int) -> DataFrame:
    """(i, x, y): the centres of a grid's cells, row by row."""
    i = F.col("id")
    return spark.range(height * width).select(i, (i % width + 0.5).alias("x"), (F.floor(i / width) + 0.5).alias("y"))


def central(place: Column, n: int, level: float, side: float) -> Column:
    """Whether a cell's centre lies in the middle part of n cells, level / side of their length wide, borders included."""
    return F.abs(place + 0.5 - n / 2) <= n * level / side / 2


def pyramid_sizes(base: int, apex: int, step: int) -> list[int]:
    """base, base - step ... down to the apex."""
    if step <= 0:
        raise ValueError("a pyramid's step must be positive")
    return list(range(base, apex - 1, -step))


def geometric_scales(low: float, high: float, ratio: float) -> list[float]:
    """low, low * ratio ... below 0.999 * high, and high."""
    out, v = [], low
    while v < 0.999 * high:
        out.append(round(v, 3))
        v *= ratio
    return [*out, round(high, 3)]
