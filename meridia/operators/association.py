"""Which tiles a frame of uncertain size covers: overlaps expected under the weights of its sizes, and what they make of a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions import geo
from meridia.operators.box_join import box_join


def pair_status(cq: Column, ct: Column, iou: Column, refused: Column, strong_cq: float = 0.7, strong_ct: float = 0.3, partial_iou: float = 0.05) -> Column:
    """(status, weight): strong, partial or negative; a refused frame gives undetermined or negative pairs, without weight."""
    strong, partial = (cq >= strong_cq) & (ct >= strong_ct), iou >= partial_iou
    sure = F.when(strong, "strong").when(partial, "partial").otherwise("negative")
    status = F.when(refused, F.when(iou > 0, "undetermined").otherwise("negative")).otherwise(sure)
    weight = F.when(refused, 0.0).when(strong, F.greatest(cq, iou)).when(partial, iou).otherwise(0.0)
    return F.struct(status.alias("status"), weight.alias("weight"))


def associated(frames: DataFrame, levels: DataFrame, tiles: DataFrame, fallback: float = 1000.0, **limits: float) -> DataFrame:
    """(frame_id, tile_id, cq, ct, iou, status, weight) of frames and the tiles that one of their sizes touches.

    frames: frame_id, x, y, refused. levels: frame_id, scale_m, weight; weights are scaled to a sum of 1, and a frame whose
    weights sum to nothing has none. tiles: tile_id, x, y, size_m. All other pairs are negative, with nothing shared.
    """
    totals = levels.filter("weight > 0").groupBy("frame_id").agg(F.sum("weight").alias("_sum"), F.max("scale_m").alias("_top"))
    known = frames.join(totals, "frame_id")
    top = known.agg(F.max("_top")).first()[0] or 0.0
    side = tiles.agg(F.max(geo.side(F.col("size_m"), fallback))).first()[0] or fallback
    pairs = box_join(known.select("frame_id", "x", "y", "refused", "_sum"), tiles.select("tile_id", "x", "y", "size_m"), (top + side) / 2)
    rows = pairs.join(levels.filter("weight > 0"), "frame_id")
    t = geo.side(F.col("r_size_m"), fallback)
    shared = geo.square_intersection(F.col("x"), F.col("y"), F.col("scale_m"), F.col("r_x"), F.col("r_y"), t)
    q, w = F.col("scale_m") * F.col("scale_m"), F.col("weight") / F.col("_sum")
    expected = [F.sum(w * shared / area).alias(n) for n, area in (("cq", q), ("ct", t * t), ("iou", q + t * t - shared))]
    out = rows.groupBy("frame_id", F.col("r_tile_id").alias("tile_id"), "refused").agg(*expected).filter("iou > 0")
    return out.withColumn("_s", pair_status(F.col("cq"), F.col("ct"), F.col("iou"), F.col("refused"), **limits)).select("frame_id", "tile_id", "cq", "ct", "iou", "_s.status", "_s.weight")
