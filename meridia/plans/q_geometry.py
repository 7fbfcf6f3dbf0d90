"""Queries of geometry, positive rules, overlap graphs, splits and their audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import geo
from meridia.operators import positives as P
from meridia.registry import register
from meridia.sources.carriers import carrier, ctes

R = "6378137e0"


def sql_x(a: str = "") -> str:
    return f"{R} * radians({a}lon)"


def sql_y(a: str = "") -> str:
    return f"{R} * ln(tan(0.7853981633974483e0 + radians({a}lat) / 2))"


POSITIONED = ctes("points", "tiles") + f""",
p AS (SELECT *, {sql_x()} AS x, {sql_y()} AS y FROM points),
t AS (SELECT tile_id, city, lat, lon, {sql_x()} AS x, {sql_y()} AS y, CASE WHEN size_m > 0 THEN size_m ELSE 1000e0 END AS size FROM tiles)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.positioned(carrier(spark, sf_dir, "points"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.positioned(carrier(spark, sf_dir, "tiles"))


@register("SC01_gallery_index", ctes("tiles") + f" SELECT tile_id, city, round({sql_x()}, 3) AS x, round({sql_y()}, 3) AS y, CASE WHEN size_m > 0 THEN size_m ELSE 1000e0 END AS side FROM tiles")
def gallery_index(spark, sf_dir):
    return tiles(spark, sf_dir).select("tile_id", "city", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), geo.side(F.col("size_m"), 1000.0).alias("side"))


@register("SC05_load_tiles", ctes("tiles") + " SELECT tile_id, lat, lon, coalesce(size_m, 1000e0) AS size_m FROM tiles WHERE city = 1")
def load_tiles(spark, sf_dir):
    return carrier(spark, sf_dir, "tiles").where("city = 1").select("tile_id", "lat", "lon", F.coalesce("size_m", F.lit(1000.0)).alias("size_m"))


@register("PJ01_mercator", ctes("points") + f""" SELECT point_id, round({sql_x()}, 4) AS x, round({sql_y()}, 4) AS y,
round(degrees({sql_x()} / {R}), 8) AS back_lon, round(degrees(2 * atan(exp({sql_y()} / {R})) - 1.5707963267948966e0), 8) AS back_lat FROM points""")
def mercator(spark, sf_dir):
    df = points(spark, sf_dir)
    return df.select("point_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(geo.inverse_lon(F.col("x")), 8).alias("back_lon"), F.round(geo.inverse_lat(F.col("y")), 8).alias("back_lat"))


@register("PJ02_true_scale", ctes("points") + " SELECT point_id, round(cos(radians(lat)), 9) AS cos_lat, round(250e0 / cos(radians(lat)), 6) AS grid, round(1e6 * power(cos(radians(lat)), 2), 4) AS area FROM points")
def true_scale(spark, sf_dir):
    """Every row gets its scale; geo.cos_lat() stays for callers that want a latitude beyond 89 degrees to be an error."""
    lat = F.col("lat")
    return carrier(spark, sf_dir, "points").select("point_id", geo.rounded(F.cos(F.radians(lat)), 9).alias("cos_lat"), geo.rounded(geo.to_grid(F.lit(250.0), lat), 6).alias("grid"), geo.rounded(geo.true_area(F.lit(1e6), lat), 4).alias("area"))


@register("PJ05_tile_side", ctes("tiles") + " SELECT tile_id, CASE WHEN size_m > 0 THEN size_m ELSE 640e0 END AS side FROM tiles")
def tile_side(spark, sf_dir):
    return carrier(spark, sf_dir, "tiles").select("tile_id", geo.side(F.col("size_m"), 640.0).alias("side"))


@register("PJ06_bounds", POSITIONED + " SELECT tile_id, round(x - size / 2, 3) AS min_x, round(y - size / 2, 3) AS min_y, round(x + size / 2, 3) AS max_x, round(y + size / 2, 3) AS max_y FROM t")
def bounds(spark, sf_dir):
    half = geo.side(F.col("size_m"), 1000.0) / 2
    return tiles(spark, sf_dir).select("tile_id", *[F.round(F.col(a) + s * half, 3).alias(f"{n}_{a}") for n, s in (("min", -1), ("max", 1)) for a in ("x", "y")])


@register("PJ12_snap", ctes("points") + f""" SELECT point_id, round_even({sql_x()} / 100e0, 0) * 100e0 AS snapped, floor(({sql_x()} - 7e0) / 50e0) * 50e0 + 7e0 AS down, ceil(({sql_x()} - 7e0) / 50e0) * 50e0 + 7e0 AS up FROM points""")
def snap(spark, sf_dir):
    x = F.col("x")
    return points(spark, sf_dir).select("point_id", geo.snap(x, 100.0).alias("snapped"), geo.snap_down(x, 7.0, 50.0).alias("down"), geo.snap_up(x, 7.0, 50.0).alias("up"))


@register("PJ14_haversine", ctes("points") + """ SELECT point_id, round(2 * 6371000e0 * asin(least(1e0, sqrt(power(sin(radians(lat - 48.5e0) / 2), 2) + cos(radians(48.5e0)) * cos(radians(lat)) * power(sin(radians(lon - 37.5e0) / 2), 2)))), 3) AS metres FROM points""")
def haversine(spark, sf_dir):
    return carrier(spark, sf_dir, "points").select("point_id", F.round(geo.haversine(F.lit(48.5), F.lit(37.5), F.col("lat"), F.col("lon")), 3).alias("metres"))


@register("PJ15_grid_to_latlon", ctes("tokens") + """ SELECT tile_id, r, c, round(48.5e0 - (r + 0.5e0 - 2.5e0) * 200e0 / 110540e0, 9) AS lat, round(37.5e0 + (c + 0.5e0 - 2.5e0) * 200e0 / (111320e0 * cos(radians(48.5e0))), 9) AS lon FROM tokens""")
def grid_to_latlon(spark, sf_dir):
    lat = F.lit(48.5) - (F.col("r") + 0.5 - 2.5) * 200 / 110540.0
    lon = F.lit(37.5) + (F.col("c") + 0.5 - 2.5) * 200 / (F.lit(111320.0) * F.cos(F.radians(F.lit(48.5))))
    return carrier(spark, sf_dir, "tokens").select("tile_id", "r", "c", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@register("PJ23_slippy_tile", ctes("points") + """ SELECT point_id, CAST(floor((lon + 180) / 360 * 262144) AS BIGINT) AS tx, CAST(floor((1 - asinh(tan(radians(lat))) / 3.141592653589793e0) / 2 * 262144) AS BIGINT) AS ty FROM points""")
def slippy(spark, sf_dir):
    return carrier(spark, sf_dir, "points").select("point_id", geo.slippy_x(F.col("lon"), 18).alias("tx"), geo.slippy_y(F.col("lat"), 18).alias("ty"))


@register("PJ11_corners", POSITIONED + """ SELECT tile_id, n AS corner, round(x + size / 2 * CASE WHEN n IN (1, 2) THEN 1 ELSE -1 END, 3) AS cx, round(y + size / 2 * CASE WHEN n IN (2, 3) THEN 1 ELSE -1 END, 3) AS cy FROM t, (SELECT unnest([0, 1, 2, 3, 4]) AS n)""")
def corner_rings(spark, sf_dir):
    ring = tiles(spark, sf_dir).select("tile_id", F.posexplode(geo.corners(F.col("x"), F.col("y"), geo.side(F.col("size_m"), 1000.0) / 2)).alias("corner", "at"))
    return ring.select("tile_id", "corner", F.round("at.x", 3).alias("cx"), F.round("at.y", 3).alias("cy"))


def _matches(name: str, **given: object):
    def query(spark, sf_dir):
        found = P.select(name, points(spark, sf_dir), tiles(spark, sf_dir), P.params(**given))
        return found.select("point_id", "tile_id", F.round("score", 3 if name == "nearest_tile" else 6).alias("score"))

    return query


_NEAR = "SELECT point_id, tile_id, CAST(NULL AS DOUBLE) AS score FROM p, t WHERE p.city = t.city AND abs(p.x - t.x) <= {h} AND abs(p.y - t.y) <= {h}"
register("JN02_current_rule", POSITIONED + _NEAR.format(h="(size + 250e0) / 2"))(_matches("current_rule"))
register("JN03_contains_point", POSITIONED + _NEAR.format(h="size / 2"))(_matches("contains_point"))
register("JN02_any_city", POSITIONED + _NEAR.format(h="(size + 250e0) / 2").replace("p.city = t.city AND ", ""))(_matches("current_rule", same_city=False))
_NEAREST = """, d AS (SELECT point_id, tile_id, p.lat, power(p.x - t.x, 2) + power(p.y - t.y, 2) AS d2 FROM p, t WHERE p.city = t.city),
n AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, tile_id) AS k FROM d)
SELECT point_id, tile_id, round(-sqrt(d2) * cos(radians(lat)), 3) AS score FROM n WHERE k = 1"""
register("JN04_nearest_tile", POSITIONED + _NEAREST)(_matches("nearest_tile"))
register("JN04_nearest_within", POSITIONED + _NEAREST + " AND sqrt(d2) * cos(radians(lat)) <= 150")(_matches("nearest_tile", max_dist=150.0))
_OVERLAP = """, o AS (SELECT point_id, tile_id, a, b, greatest(0e0, least(px + a / 2, tx + b / 2) - greatest(px - a / 2, tx - b / 2)) * greatest(0e0, least(py + a / 2, ty + b / 2) - greatest(py - a / 2, ty - b / 2)) AS s
FROM (SELECT point_id, tile_id, p.x AS px, p.y AS py, t.x AS tx, t.y AS ty, {q} / cos(radians(p.lat)) AS a, {t} / cos(radians(t.lat)) AS b FROM p, t WHERE p.city = t.city))
SELECT point_id, tile_id, round({score}, 6) AS score FROM o WHERE {score} {than}"""
register("JN05_overlap_weighted", POSITIONED + _OVERLAP.format(q="250e0", t="size", score="s / (a * a)", than="> 0"))(_matches("overlap_weighted"))
_IOU = "least(1e0, s / (a * a + b * b - s))"
register("JN06_tile_iou_1000", POSITIONED + _OVERLAP.format(q="1000e0", t="size", score=_IOU, than=">= 0.5e0"))(_matches("tile_iou_1000", min_iou=0.5))
register("JN07_pyramid_top_iou", POSITIONED + _OVERLAP.format(q="250e0", t="250e0", score=_IOU, than=">= 0.15e0"))(_matches("pyramid_top_iou_250"))


@register("JN08_no_positive", POSITIONED + " SELECT point_id FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE p.city = t.city AND abs(p.x - t.x) <= (size + 250e0) / 2 AND abs(p.y - t.y) <= (size + 250e0) / 2)")
def no_positive(spark, sf_dir):
    p = points(spark, sf_dir)
    return P.without_positive(p, P.best_matches(P.select("current_rule", p, tiles(spark, sf_dir))))


@register("AG01_match_stats", POSITIONED + ", m AS (" + _NEAR.format(h="(size + 250e0) / 2") + """), o AS (SELECT point_id, count(*) AS n FROM m GROUP BY point_id)
SELECT (SELECT count(*) FROM p) AS n_points, (SELECT count(*) FROM o) AS n_with, round((SELECT avg(n) FROM o), 6) AS mean_links, (SELECT count(*) FROM m) AS n_links, (SELECT count(DISTINCT tile_id) FROM m) AS n_tiles""")
def match_stats(spark, sf_dir):
    p = points(spark, sf_dir)
    return P.match_stats(p, P.best_matches(P.select("current_rule", p, tiles(spark, sf_dir)))).withColumn("mean_links", F.round("mean_links", 6))


@register("AG01_links_histogram", POSITIONED + ", m AS (" + _NEAR.format(h="(size + 250e0) / 2") + ") SELECT n, count(*) AS points FROM (SELECT point_id, count(*) AS n FROM m GROUP BY point_id) GROUP BY n")
def links_histogram(spark, sf_dir):
    m = P.select("current_rule", points(spark, sf_dir), tiles(spark, sf_dir))
    return m.groupBy("point_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("points"))


@register("ST16_fingerprint", POSITIONED + ", m AS (" + _NEAR.format(h="(size + 250e0) / 2") + "), h AS (SELECT sha256(concat_ws('|', point_id, tile_id, '-1.000000')) AS h FROM m) SELECT sha256(concat_ws(':', count(*), sum(('0x' || substr(h, 1, 10))::BIGINT), sum(('0x' || substr(h, 11, 10))::BIGINT))) AS fingerprint FROM h")
def match_fingerprint(spark, sf_dir):
    return P.fingerprint(P.select("current_rule", points(spark, sf_dir), tiles(spark, sf_dir)))
