"""Stores of crops: the tokens of each position at each level, made afresh, cut from dense tiles, or both.

Dense tokens: tile_id, r, c, vec, on a grid of n x n tokens whose side is base_m metres. Crops: px, py, level, r, c, vec; the
level is a crop's side in metres.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.operators.positives import nearest_within

#: Makes crops of rows (px, py, lat, level).
Extractor = Callable[[DataFrame], DataFrame]
FIELDS = ("px", "py", "level", "r", "c", "vec")


def centred(place: Column, n: int, share: Column) -> Column:
    """The place in the centred crop of this share of n tokens, or null outside; a crop has n * share tokens, half to even, one
    at least."""
    size = F.greatest(F.lit(1), F.rint(n * share).cast("int"))
    begin = F.floor((n - size) / 2)
    return F.when((place >= begin) & (place < begin + size), (place - begin).cast("int"))


def wanted(positions: DataFrame, levels: list[int]) -> DataFrame:
    """(px, py, lat, level) of all crops: positions (x, y, lat) at each level, positions once each to a hundredth."""
    once = positions.withColumn("_x", F.round(F.col("x") * 100).cast("long")).withColumn("_y", F.round(F.col("y") * 100).cast("long"))
    once = once.groupBy("_x", "_y").agg(F.min(F.struct("x", "y", "lat")).alias("p")).select(F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.col("p.lat").alias("lat"))
    return once.withColumn("level", F.explode(F.array(*map(F.lit, levels))))


def from_dense(crops: DataFrame, tiles: DataFrame, tokens: DataFrame, n: int, base_m: float, within_m: float = 140.0) -> DataFrame:
    """The crops that the nearest dense tile within within_m true metres gives, as the centre of its grid."""
    places = crops.select("px", "py", "lat").distinct().select(F.struct("px", "py").alias("point_id"), F.col("px").alias("x"), F.col("py").alias("y"), "lat")
    at = nearest_within(places, tiles, within_m).select("point_id.px", "point_id.py", "tile_id")
    rows = crops.join(at, ["px", "py"]).filter(F.col("level") <= base_m).join(tokens, "tile_id")
    share = F.col("level") / F.lit(float(base_m))
    rows = rows.withColumn("r", centred(F.col("r"), n, share)).withColumn("c", centred(F.col("c"), n, share))
    return rows.filter("r IS NOT NULL AND c IS NOT NULL").select(*FIELDS)


def crops_of(mode: str, crops: DataFrame, tiles: DataFrame, tokens: DataFrame, extract: Extractor, n: int, base_m: float, within_m: float = 140.0) -> DataFrame:
    """fresh: extract makes all crops; dense: tiles give what they can; hybrid: extract makes those that tiles don't give."""
    if mode == "fresh":
        return extract(crops).select(*FIELDS)
    if mode not in ("dense", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}; there are dense, fresh, hybrid")
    dense = from_dense(crops, tiles, tokens, n, base_m, within_m)
    if mode == "dense":
        return dense
    rest = crops.join(dense.select("px", "py", "level").distinct(), ["px", "py", "level"], "left_anti")
    return dense.unionByName(extract(rest).select(*FIELDS))


def write_store(crops: DataFrame, folder: str) -> None:
    """Parquet by level, so that a query reads the levels it asks for."""
    crops.write.mode("overwrite").partitionBy("level").parquet(folder)
