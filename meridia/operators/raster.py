"""Masks and mosaics as relations of pixels (image, r, c, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decode_runs(runs: DataFrame, by: list[str], height: int, width: int) -> DataFrame:
    """(by, r, c) of set pixels. runs: by, pos, length; runs alternate from unset, down the columns; pixels beyond the image
    are dropped."""
    order = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = runs.withColumn("_from", F.coalesce(F.sum("length").over(order), F.lit(0))).filter("pos % 2 = 1 AND length > 0")
    end = F.least(F.col("_from") + F.col("length"), F.lit(height * width)) - 1
    pixels = rows.filter(F.col("_from") < height * width).select(*by, F.explode(F.sequence("_from", end)).alias("_p"))
    return pixels.select(*by, (F.col("_p") % height).alias("r"), F.floor(F.col("_p") / height).alias("c"))


def box_pixels(boxes: DataFrame, by: list[str], height: int, width: int) -> DataFrame:
    """(by, r, c) of pixels in boxes (x, y, w, h): corners are rounded half to even and clipped."""
    edge = lambda v, top: F.greatest(F.lit(0), F.least(F.rint(v).cast("long"), F.lit(top)))
    rows = boxes.select(*by, edge(F.col("y"), height).alias("_r0"), edge(F.col("y") + F.col("h"), height).alias("_r1"), edge(F.col("x"), width).alias("_c0"), edge(F.col("x") + F.col("w"), width).alias("_c1"))
    rows = rows.filter("_r1 > _r0 AND _c1 > _c0").withColumn("r", F.explode(F.sequence(F.col("_r0"), F.col("_r1") - 1)))
    return rows.select(*by, "r", F.explode(F.sequence(F.col("_c0"), F.col("_c1") - 1)).alias("c"))


def polygon_pixels(edges: DataFrame, by: list[str], height: int, width: int) -> DataFrame:
    """(by, r, c) of pixels whose centre lies in a polygon, by the even-odd rule. edges: by, x0, y0, x1, y1.

    An edge meets only the pixel rows that it crosses; crossings are paired in order along the row.
    """
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = edges.filter("y0 <> y1").withColumn("r", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil(low - 0.5)), F.least(F.lit(height), F.ceil(high - 0.5)))))
    at = F.col("r") + 0.5
    rows = rows.filter((at >= low) & (at < high) & (F.col("r") < height))
    cut = F.col("x0") + (at - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    order = Window.partitionBy(*by, "r").orderBy("x")
    rows = rows.select(*by, "r", cut.alias("x")).withColumn("n", F.row_number().over(order)).withColumn("end", F.lead("x").over(order)).filter("n % 2 = 1")
    spans = rows.select(*by, "r", F.greatest(F.lit(0), F.ceil(F.col("x") - 0.5)).alias("a"), F.least(F.lit(width), F.ceil(F.col("end") - 0.5)).alias("b")).filter("b > a")
    return spans.select(*by, "r", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("c"))


def block_of(position: Column, n: int, g: int) -> Column:
    """The block of g that position of n falls into; the first n % g blocks are one longer."""
    short, longer = n // g, n % g
    cut = longer * (short + 1)
    return F.when(position < cut, F.floor(position / (short + 1))).otherwise(longer + F.floor((position - cut) / max(short, 1))).cast("long")


def block_share(pixels: DataFrame, by: list[str], value: Column, height: int, width: int, g: int) -> DataFrame:
    """(by, br, bc, share) of g x g blocks."""
    return pixels.groupBy(*by, block_of(F.col("r"), height, g).alias("br"), block_of(F.col("c"), width, g).alias("bc")).agg(F.avg(value).alias("share"))


def mosaic(pixels: DataFrame, layer: str = "layer", nodata: int = 0) -> DataFrame:
    """(r, c, layer, v): of each pixel the first layer that has data."""
    return pixels.filter(F.col("v") != nodata).groupBy("r", "c").agg(F.min(F.struct(layer, "v")).alias("m")).select("r", "c", "m.*")


def resolved(frames: DataFrame, backends: list[DataFrame], key: str, value: str) -> DataFrame:
    """(key, value, backend): the first backend that has the frame; that none has it is an error."""
    out = frames.select(key)
    for i, b in enumerate(backends):
        out = out.join(b.select(key, F.col(value).alias(f"_v{i}")), key, "left")
    names = [F.col(f"_v{i}") for i in range(len(backends))]
    which = F.coalesce(*[F.when(c.isNotNull(), F.lit(i)) for i, c in enumerate(names)], F.raise_error(F.concat(F.lit("no backend has frame "), F.col(key).cast("string"))).cast("int"))
    return out.select(key, F.coalesce(*names).alias(value), which.alias("backend"))


def latest(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both by key; of one key the highest version stays."""
    order = Window.partitionBy(key).orderBy(F.col(version).desc())
    return old.unionByName(new).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
