"""Which tiles are positive for a point: six rules behind one registry, and the snapshot of their matches.

Points: point_id, city, lat, lon, x, y. Tiles: tile_id, city, lat, lon, size_m, x, y. Matches: point_id, tile_id, score.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import geo
from meridia.operators.box_join import box_join, extent_join, nearest

Rule = Callable[[DataFrame, DataFrame, "Params"], DataFrame]
RULES: dict[str, Rule] = {}


@dataclass(frozen=True)
class Params:
    """What rules can be told. Sizes and distances in metres."""

    query_size: float = 250.0
    fallback_size: float = 1000.0
    same_city: bool = True
    min_overlap: float = 0.0
    min_iou: float = 0.15
    top_size: float = 250.0
    max_dist: float | None = None


def params(**given: object) -> Params:
    """Params; a name that no rule knows is an error."""
    unknown = set(given) - set(Params.__dataclass_fields__)
    if unknown:
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    return Params(**given)


def rule(name: str) -> Callable[[Rule], Rule]:
    def add(f: Rule) -> Rule:
        if name in RULES:
            raise ValueError(f"rule {name!r} is registered already")
        RULES[name] = f
        return f

    return add


def positioned(df: DataFrame) -> DataFrame:
    return df.withColumn("x", geo.mercator_x(F.col("lon"))).withColumn("y", geo.mercator_y(F.col("lat")))


def _keys(p: Params) -> list[str]:
    return ["city"] if p.same_city else []


def _size(p: Params) -> Column:
    return geo.side(F.col("r_size_m"), p.fallback_size)


def _reach(tiles: DataFrame, p: Params) -> float:
    """A bound of how far centres can lie apart, in grid units, from one small aggregate."""
    size = tiles.agg(F.max(geo.side(F.col("size_m"), p.fallback_size))).first()[0] or p.fallback_size
    return (size + p.query_size) / 2 + 1e-6


def _meeting(points: DataFrame, tiles: DataFrame, p: Params, size: float | None = None) -> DataFrame:
    """Pairs whose squares of true metres can share an area. Beyond the poles a square has no side."""
    t = geo.side(F.col("size_m"), p.fallback_size) if size is None else F.lit(size)
    return extent_join(points, tiles, geo.to_grid(F.lit(p.query_size), F.col("lat")) / 2, geo.to_grid(t, F.col("lat")) / 2, _keys(p))


def _scored(pairs: DataFrame, score: Column | None = None) -> DataFrame:
    return pairs.select("point_id", F.col("r_tile_id").alias("tile_id"), (F.lit(None) if score is None else score).cast("double").alias("score"))


@rule("current_rule")
def current_rule(points: DataFrame, tiles: DataFrame, p: Params) -> DataFrame:
    """Squares touch: centres no farther apart than half of both sides along each axis, in grid units."""
    half = (_size(p) + p.query_size) / 2
    pairs = box_join(points, tiles, _reach(tiles, p), _keys(p))
    return _scored(pairs.filter((F.abs(F.col("x") - F.col("r_x")) <= half) & (F.abs(F.col("y") - F.col("r_y")) <= half)))


@rule("contains_point")
def contains_point(points: DataFrame, tiles: DataFrame, p: Params) -> DataFrame:
    """The point lies in the tile or on its border, in grid units."""
    half = _size(p) / 2
    pairs = box_join(points, tiles, _reach(tiles, p), _keys(p))
    return _scored(pairs.filter((F.abs(F.col("x") - F.col("r_x")) <= half) & (F.abs(F.col("y") - F.col("r_y")) <= half)))


@rule("nearest_tile")
def nearest_tile(points: DataFrame, tiles: DataFrame, p: Params) -> DataFrame:
    """The nearest centre; the score is minus the distance in true metres at the point."""
    found = nearest(points, tiles, p.fallback_size, keys=_keys(p))
    dist = F.sqrt("d2") * F.cos(F.radians(F.col("lat")))
    out = _scored(found, -dist)
    return out if p.max_dist is None else out.filter(F.col("score") >= -p.max_dist)


def _overlap(p: Params, size: float | None = None) -> tuple[Column, Column, Column]:
    """Shared area of the query's and the tile's squares of true metres, and their areas, in grid units."""
    q = geo.to_grid(F.lit(p.query_size), F.col("lat"))
    t = geo.to_grid(_size(p) if size is None else F.lit(size), F.col("r_lat"))
    return geo.square_intersection(F.col("x"), F.col("y"), q, F.col("r_x"), F.col("r_y"), t), q * q, t * t


@rule("overlap_weighted")
def overlap_weighted(points: DataFrame, tiles: DataFrame, p: Params) -> DataFrame:
    """The score is the share of the query's square that the tile covers; it must exceed min_overlap."""
    shared, q, _ = _overlap(p)
    return _scored(_meeting(points, tiles, p), shared / q).filter(F.col("score") > p.min_overlap)


@rule("tile_iou_1000")
def tile_iou_1000(points: DataFrame, tiles: DataFrame, p: Params) -> DataFrame:
    """The score is the IoU of two 1000 m squares, at least min_iou; a tile of another size is an error."""
    wrong = F.abs(_size(p) - 1000) > 1e-6
    checked = F.when(wrong, F.raise_error(F.lit("a tile isn't 1000 m wide")).cast("double"))
    p = Params(**asdict(p) | {"query_size": 1000.0})
    shared, q, t = _overlap(p)
    pairs = _meeting(points, tiles, p)
    return _scored(pairs, F.coalesce(checked, geo.iou(shared, q, t))).filter(F.col("score") >= p.min_iou)


@rule("pyramid_top_iou_250")
def pyramid_top_iou_250(points: DataFrame, tiles: DataFrame, p: Params) -> DataFrame:
    """The score is the IoU of the query's square and the tile pyramid's top; the base must be 1000 m wide."""
    wrong = F.abs(_size(p) - 1000) > 1e-6
    checked = F.when(wrong, F.raise_error(F.lit("a pyramid's base isn't 1000 m wide")).cast("double"))
    shared, q, t = _overlap(p, p.top_size)
    pairs = _meeting(points, tiles, p, p.top_size)
    return _scored(pairs, F.coalesce(checked, geo.iou(shared, q, t))).filter(F.col("score") >= p.min_iou)


def select(name: str, points: DataFrame, tiles: DataFrame, p: Params | None = None) -> DataFrame:
    """Matches under a rule; an unknown name is an error."""
    if name not in RULES:
        raise ValueError(f"unknown rule {name!r}; there are {', '.join(sorted(RULES))}")
    return RULES[name](points, tiles, p or Params())


def best_matches(matches: DataFrame) -> DataFrame:
    """One row for each point and tile, with the best score; no score is the worst."""
    order = Window.partitionBy("point_id", "tile_id").orderBy(F.col("score").desc_nulls_last())
    return matches.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def without_positive(points: DataFrame, matches: DataFrame) -> DataFrame:
    return points.join(matches, "point_id", "left_anti").select("point_id")


def canonical_pairs(matches: DataFrame, points: DataFrame, tiles: DataFrame) -> DataFrame:
    """(point_id, tile_id, d2): of each point's positives the one whose centre is nearest; ties go to the smaller tile id."""
    at = matches.select("point_id", "tile_id").join(points.select("point_id", "x", "y"), "point_id")
    at = at.join(tiles.select("tile_id", F.col("x").alias("_x"), F.col("y").alias("_y")), "tile_id")
    d2 = F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2)
    return at.groupBy("point_id").agg(F.min(F.struct(d2.alias("d2"), "tile_id")).alias("m")).select("point_id", "m.tile_id", "m.d2")


def nearest_within(points: DataFrame, tiles: DataFrame, metres: float) -> DataFrame:
    """(point_id, tile_id, metres) of points with a tile centre within so many true metres, at the point's latitude; ties go
    to the smaller tile id."""
    import math

    lat = points.agg(F.max(F.abs("lat"))).first()[0] or 0.0  # the farther from the equator, the longer a metre on the grid
    hits = box_join(points.select("point_id", "x", "y", "lat"), tiles.select("tile_id", "x", "y"), metres / math.cos(math.radians(min(lat, 89.0))) + 1e-6)
    d = F.sqrt(F.pow(F.col("x") - F.col("r_x"), 2) + F.pow(F.col("y") - F.col("r_y"), 2)) * F.cos(F.radians("lat"))
    best = hits.withColumn("_d", d).filter(F.col("_d") <= metres).groupBy("point_id").agg(F.min(F.struct(F.col("_d").alias("d"), F.col("r_tile_id").alias("tile_id"))).alias("m"))
    return best.select("point_id", "m.tile_id", F.col("m.d").alias("metres"))


def touching(points: DataFrame, tiles: DataFrame, query_size: float = 1000.0, epsilon: float = 0.0, fallback: float = 1000.0) -> DataFrame:
    """(point_id, tile_id) of tiles that aren't safe negatives: along each axis, half of both sides less the distance of the
    centres, at least 0; the product of both exceeds epsilon."""
    top = tiles.agg(F.max(geo.side(F.col("size_m"), fallback))).first()[0] or fallback
    hits = box_join(points.select("point_id", "x", "y"), tiles.select("tile_id", "x", "y", "size_m"), (top + query_size) / 2)
    half = (geo.side(F.col("r_size_m"), fallback) + query_size) / 2
    left = lambda a, b: F.greatest(F.lit(0.0), half - F.abs(F.col(a) - F.col(b)))
    return hits.filter(left("x", "r_x") * left("y", "r_y") > epsilon).select("point_id", F.col("r_tile_id").alias("tile_id"))


def relevance(points: DataFrame, matches: DataFrame, tiles: DataFrame, **sizes: float) -> DataFrame:
    """(point_id, positives, safe, weight) of points that have a positive: how many positives and safe negatives they have, and
    the sum of the positives' weights, their scores, or 1 for those without.

    Safe is every tile that is neither positive nor touching(); it is what is left of all tiles, so the pairs aren't made.
    """
    n = tiles.count()
    own = best_matches(matches).groupBy("point_id").agg(F.count("*").alias("positives"), F.sum(F.coalesce("score", F.lit(1.0))).alias("weight"))
    out = touching(points, tiles, **sizes).unionByName(matches.select("point_id", "tile_id")).distinct().groupBy("point_id").agg(F.count("*").alias("_n"))
    return points.select("point_id").join(own, "point_id").join(out, "point_id").select("point_id", "positives", (F.lit(n) - F.col("_n")).alias("safe"), "weight")


def match_stats(points: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: points, points with a positive, links, different tiles, mean links of a point that has some."""
    own = matches.groupBy("point_id").agg(F.count("*").alias("n"))
    links = matches.agg(F.count("*").alias("n_links"), F.countDistinct("tile_id").alias("n_tiles"))
    return points.agg(F.count("*").alias("n_points")).crossJoin(own.agg(F.count("*").alias("n_with"), F.avg("n").alias("mean_links"))).crossJoin(links)


def fingerprint(matches: DataFrame) -> DataFrame:
    """One row: a SHA-256 that is equal for equal sets of matches, whatever their order.

    Two 40-bit pieces of each row's own SHA-256 are summed over all rows, and the sums and the number of rows are hashed; so no
    task sees all rows. Scores count with six decimals, and a missing one as -1. It isn't a hash of the rows in a row.
    """
    one = F.sha2(F.concat_ws("|", F.col("point_id").cast("string"), F.col("tile_id").cast("string"), F.format_string("%.6f", F.coalesce("score", F.lit(-1.0)))), 256)
    part = lambda a: F.conv(F.substring(one, a, 10), 16, 10).cast("decimal(38,0)")
    sums = matches.agg(F.count("*").alias("n"), F.sum(part(1)).alias("a"), F.sum(part(11)).alias("b"))
    return sums.select(F.sha2(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("n", "a", "b")]), 256).alias("fingerprint"))
