"""Joins by position: boxes around points, nearest centres.

Spark has no two-dimensional range join; a condition on differences alone becomes a nested loop over all pairs. Here the
plane is cut into square buckets twice as wide as the reach. A row of the right side lies in one bucket; a row of the left
side is copied to the buckets that its reach touches, at most four; the sides meet by an equi-join on the bucket, and the
exact condition is left to each pair. No pair is made twice, so there is nothing to remove afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import geo
from meridia.sources.scratch import written

#: Height of a band of extent_join in degrees, about 2.2 km.
BAND = 0.02


def _bucket(v: Column, width: float) -> Column:
    return F.floor(v / width).cast("long")


def box_join(left: DataFrame, right: DataFrame, reach: float, keys: list[str] | None = None, x: str = "x", y: str = "y", rx: str = "x", ry: str = "y") -> DataFrame:
    """Pairs with |x - rx| <= reach and |y - ry| <= reach and equal keys.

    The right side's columns have the prefix `r_`. Rows without a position or with a null key match nothing.
    """
    keys, width = keys or [], 2 * max(reach, 1e-9)
    to = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    to = to.withColumn("_bx", _bucket(F.col(f"r_{rx}"), width)).withColumn("_by", _bucket(F.col(f"r_{ry}"), width))
    of = left.withColumn("_bx", F.explode(F.sequence(_bucket(F.col(x) - reach, width), _bucket(F.col(x) + reach, width))))
    of = of.withColumn("_by", F.explode(F.sequence(_bucket(F.col(y) - reach, width), _bucket(F.col(y) + reach, width))))
    on = (of["_bx"] == to["_bx"]) & (of["_by"] == to["_by"])
    for k in keys:
        on &= of[k] == to[f"r_{k}"]
    near = (F.abs(F.col(x) - F.col(f"r_{rx}")) <= reach) & (F.abs(F.col(y) - F.col(f"r_{ry}")) <= reach)
    return of.join(to, on).filter(near).select(*left.columns, *[f"r_{c}" for c in right.columns])


def extent_join(left: DataFrame, right: DataFrame, half: Column, r_half: Column, keys: list[str] | None = None) -> DataFrame:
    """Pairs (lat, x, y) with equal keys whose squares of half sides `half` and `r_half` (a column of the right side under its own
    names) meet: |x - r_x| and |y - r_y| are at most the sum of both halves.

    Sides in grid units grow without bound towards the poles, so one reach for all would compare everything with everything.
    The plane is cut by latitude instead, where squares of true metres have about one height. A square lies in all the bands
    that it touches; a pair counts in the first that both touch. In each band the reach along x is that of its own largest
    squares. The right side's columns have the prefix `r_`. Rows without a finite position and half match nothing.
    """
    keys = keys or []

    def banded(df: DataFrame, h: Column, at: str) -> DataFrame:
        finite = [F.abs(F.col(c)) < float("inf") for c in ("x", "y")]
        rows = df.withColumn(f"_h{at}", h).filter(finite[0] & finite[1] & (F.col(f"_h{at}") < float("inf")) & (F.col(f"_h{at}") >= 0))
        # widened by far more than the rounding of a latitude there and back
        low, high = (_bucket(geo.inverse_lat(F.col("y") + sign * F.col(f"_h{at}") * (1 + 1e-9)) + sign * 1e-9, BAND) for sign in (-1, 1))
        return rows.withColumn(f"_b{at}", low).withColumn("_band", F.explode(F.sequence(low, high)))

    of, to = banded(left, half, "l"), banded(right, r_half, "r")
    widest = lambda df, at: df.groupBy("_band").agg(F.max(f"_h{at}").alias(f"_w{at}"))
    # a row for each band, of which there are 9,000 at most; a width spans both of the reach's sides
    reach = F.broadcast(widest(of, "l").join(widest(to, "r"), "_band").select("_band", (F.col("_wl") + F.col("_wr")).alias("_reach")))
    width = 2 * F.greatest(F.col("_reach"), F.lit(1e-9))
    cell = lambda v: F.floor(v / width).cast("long")
    of = of.join(reach, "_band").withColumn("_bx", F.explode(F.sequence(cell(F.col("x") - F.col("_reach")), cell(F.col("x") + F.col("_reach"))))).drop("_reach")
    to = to.join(reach, "_band").withColumn("_bx", cell(F.col("x"))).select("_band", "_bx", "_br", "_hr", *[F.col(c).alias(f"r_{c}") for c in right.columns])
    on = ["_band", "_bx", *[f"_k{i}" for i in range(len(keys))]]
    of, to = (df.withColumns({f"_k{i}": F.col(p + k) for i, k in enumerate(keys)}) for df, p in ((of, ""), (to, "r_")))
    near = (F.col("_band") == F.greatest("_bl", "_br")) & (F.abs(F.col("x") - F.col("r_x")) <= F.col("_hl") + F.col("_hr")) & (F.abs(F.col("y") - F.col("r_y")) <= F.col("_hl") + F.col("_hr"))
    return of.join(to, on).filter(near).select(*left.columns, *[f"r_{c}" for c in right.columns])


def self_pairs(df: DataFrame, id_: str, reach: float, keys: list[str] | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """Unordered pairs of different rows within reach, the smaller id on the left."""
    return box_join(df, df, reach, keys, x, y, x, y).filter(F.col(id_) < F.col(f"r_{id_}"))


def nearest(points: DataFrame, tiles: DataFrame, ring: float, point_id: str = "point_id", tile_id: str = "tile_id", keys: list[str] | None = None, apart: bool = False) -> DataFrame:
    """Each point's nearest tile centre: its columns with the prefix `r_`, and `d2`, the squared distance.

    Points look within growing boxes: a hit is final if it is no farther than the box's half side. What finds nothing goes on
    with eight times the reach, until the reach spans all tiles; so points far from all tiles cost a wide box, not a cross
    join of everything. What each round found, and what is left, are written tables, so no round computes an earlier one again.
    Ties go to the smaller tile id; points without a position or tiles with equal keys find nothing. apart: a tile with the
    point's own id doesn't count.
    """
    keys = keys or []
    d2 = F.pow(F.col("x") - F.col("r_x"), 2) + F.pow(F.col("y") - F.col("r_y"), 2)
    both = points.select("x", "y").unionByName(tiles.select("x", "y"))
    lo_x, hi_x, lo_y, hi_y = both.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    span = 0.0 if lo_x is None else max(hi_x - lo_x, hi_y - lo_y)
    best = Window.partitionBy(point_id).orderBy("d2", f"r_{tile_id}")
    rest, out, reach = points.filter("x IS NOT NULL AND y IS NOT NULL"), None, ring
    while True:
        hits = box_join(rest, tiles, reach, keys).withColumn("d2", d2)
        if apart:
            hits = hits.filter(F.col(point_id) != F.col(f"r_{tile_id}"))
        hits = hits.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
        last = reach >= span
        found = written(hits if last else hits.filter(F.col("d2") <= reach * reach))
        out = found if out is None else out.unionByName(found)
        if not last:
            rest = written(rest.join(found.select(point_id), point_id, "left_anti"))
        if last or rest.isEmpty():
            return out
        reach *= 8
