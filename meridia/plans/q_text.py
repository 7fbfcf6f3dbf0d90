"""Queries of names, paths, identifiers and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import geo
from meridia.functions import text as X
from meridia.operators import osm as O
from meridia.registry import register
from meridia.sources.carriers import carrier, ctes

_N = ctes("names")
_NUM = "list_filter(list_transform({t}, lambda t: try_cast(t AS DOUBLE)), lambda x: x IS NOT NULL)"


def _names(spark, sf_dir):
    return carrier(spark, sf_dir, "names")


def _coordinates(name: str, parse, oracle: str) -> None:
    @register(name, _N + oracle)
    def query(spark, sf_dir):
        return _names(spark, sf_dir).withColumn("at", parse(F.col("stem"))).select("id", F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon"))


_coordinates("ST01_parse_after_first", X.parse_after_first, f", q AS (SELECT id, {_NUM.format(t=chr(39).join(['string_split_regex(stem, ', '[_,]', ')[2:]']))} AS n FROM names) SELECT id, CASE WHEN len(n) >= 2 THEN n[1] END AS lat, CASE WHEN len(n) >= 2 THEN n[2] END AS lon FROM q")
_coordinates("ST02_parse_in_range", X.parse_in_range, """, q AS (SELECT id, list_transform(string_split_regex(stem, '[_,]'), lambda t: try_cast(t AS DOUBLE)) AS n FROM names),
g AS (SELECT id, n, list_filter(generate_series(1, len(n) - 1), lambda i: n[i] BETWEEN 44 AND 53 AND n[i + 1] BETWEEN 20 AND 45)[1] AS i FROM q) SELECT id, n[i] AS lat, n[i + 1] AS lon FROM g""")
_coordinates("ST03_parse_last_two", X.parse_last_two, ", q AS (SELECT id, string_split(stem, '_') AS n FROM names), g AS (SELECT id, try_cast(n[len(n) - 1] AS DOUBLE) AS lat, try_cast(n[len(n)] AS DOUBLE) AS lon FROM q) SELECT id, CASE WHEN lon IS NOT NULL THEN lat END AS lat, CASE WHEN lat IS NOT NULL THEN lon END AS lon FROM g")
_coordinates("ST05_parse_last_numbers", lambda s: X.parse_last_numbers(F.concat(F.lit("city:"), s)), f", q AS (SELECT id, {_NUM.format(t=chr(39).join(['string_split_regex(stem, ', '[_,]', ')']))} AS n FROM names) SELECT id, CASE WHEN len(n) >= 2 THEN n[len(n) - 1] END AS lat, CASE WHEN len(n) >= 2 THEN n[len(n)] END AS lon FROM q")


@register("ST04_parse_id_lat_lon", _N + ", q AS (SELECT id, stem, string_split(stem, '_') AS n FROM names), g AS (SELECT *, try_cast(n[2] AS DOUBLE) AS a, try_cast(n[3] AS DOUBLE) AS b FROM q) SELECT id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN n[1] ELSE stem END AS name, CASE WHEN b IS NOT NULL THEN a END AS lat, CASE WHEN a IS NOT NULL THEN b END AS lon FROM g")
def id_lat_lon(spark, sf_dir):
    rows = _names(spark, sf_dir).withColumn("at", X.parse_id_lat_lon(F.col("stem")))
    return rows.select("id", F.col("at.id").alias("name"), F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon"))


@register("ST06_names", _N + """ SELECT id, regexp_replace(stem, '^\\d+_', '') AS bare, CASE WHEN len(string_split(stem, '_')) >= 3 THEN string_split(stem, '_')[1] || '_night_' || array_to_string(string_split(stem, '_')[2:], '_') ELSE stem END AS night,
regexp_replace(stem, '[^A-Za-z0-9._-]', '_', 'g') AS safe FROM names""")
def names(spark, sf_dir):
    stem = F.col("stem")
    return _names(spark, sf_dir).select("id", X.without_leading_id(stem).alias("bare"), X.with_night(stem).alias("night"), X.safe(stem).alias("safe"))


@register("ST07_key_value", _N + ", q AS (SELECT id, 'gt_c' || folder || '=' || stem AS t FROM names) SELECT id, regexp_replace(split_part(t, '=', 1), '^gt_', '') AS k, split_part(t, '=', 2) AS v FROM q")
def key_value(spark, sf_dir):
    kv = X.key_value(F.concat(F.lit("gt_c"), F.col("folder"), F.lit("="), F.col("stem")))
    return _names(spark, sf_dir).withColumn("kv", kv).select("id", F.col("kv.key").alias("k"), F.col("kv.value").alias("v"))


@register("ST09_name_classes", _N + " SELECT CASE WHEN regexp_matches(stem, '^\\d+$') THEN 'plain' WHEN regexp_matches(stem, '^\\d+_[-\\d.]+,[-\\d.]+$') THEN 'map_shot' ELSE 'other' END AS kind, count(*) AS n FROM names GROUP BY 1")
def name_classes(spark, sf_dir):
    stem = F.col("stem")
    kind = F.when(stem.rlike(r"^\d+$"), "plain").when(stem.rlike(r"^\d+_[-\d.]+,[-\d.]+$"), "map_shot").otherwise("other")
    return _names(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@register("ST10_folders", ctes("objects") + " SELECT event_id, regexp_replace(object_key, '/?[^/]*$', '') AS folder, split_part(object_key, '/', 1) AS bucket FROM objects")
def folders(spark, sf_dir):
    key = F.col("object_key")
    return carrier(spark, sf_dir, "objects").select("event_id", X.folder_of(key).alias("folder"), F.split_part(key, F.lit("/"), F.lit(1)).alias("bucket"))


@register("ST14_human_bytes", ctes("objects") + """, q AS (SELECT event_id, size * 997 AS n FROM objects) SELECT event_id, CASE WHEN n >= 1073741824 THEN printf('%.1f GB', n / 1073741824e0) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576e0)
WHEN n >= 1024 THEN printf('%.1f KB', n / 1024e0) ELSE printf('%d B', n) END AS size FROM q""")
def human_bytes(spark, sf_dir):
    return carrier(spark, sf_dir, "objects").select("event_id", X.human_bytes(F.col("size") * 997).alias("size"))


@register("ST15_city_prefix", _N + " SELECT id, split_part(folder || ':' || stem, ':', 1) AS city FROM names")
def city_prefix(spark, sf_dir):
    return _names(spark, sf_dir).select("id", X.city_of(F.concat_ws(":", "folder", "stem")).alias("city"))


@register("ST17_canonical_weight", "SELECT s_suppkey, CAST('0x' || substr(sha256('7|' || CAST(s_suppkey AS VARCHAR) || '|2'), 1, 10) AS BIGINT) AS weight FROM supplier")
def canonical_weight(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", X.canonical_weight(7, F.col("s_suppkey"), F.lit(2)).alias("weight"))


@register("ST18_derived_seed", _N + " SELECT id, CAST('0x' || substr(sha256(stem), 1, 8) AS BIGINT) AS seed FROM names")
def derived_seed(spark, sf_dir):
    return _names(spark, sf_dir).select("id", X.hash_number(F.col("stem"), 8).alias("seed"))


@register("ST19_error_kinds", "SELECT event_id, event_type || ' 429 Too Many Requests' AS message, event_id % 2 = 0 AS quota FROM events")
def error_kinds(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("message", F.concat("event_type", F.lit(" 429 Too Many Requests")))
    seen = F.when(F.col("event_id") % 2 == 0, F.col("message")).otherwise("timed out")
    return rows.select("event_id", "message", X.is_quota_error(seen).alias("quota"))


@register("ST20_regroup_frames", _N + " SELECT folder, CASE WHEN id % 10 < 7 THEN 'train' WHEN id % 10 < 8 THEN 'val' ELSE 'test' END AS split, list(stem ORDER BY stem) AS frames FROM names GROUP BY 1, 2")
def regroup(spark, sf_dir):
    d = F.col("id") % 10
    return _names(spark, sf_dir).groupBy("folder", F.when(d < 7, "train").when(d < 8, "val").otherwise("test").alias("split")).agg(F.array_sort(F.collect_list("stem")).alias("frames"))


@register("SC02_last_root_wins", _N + " SELECT stem, arg_max(folder, id) AS root FROM names GROUP BY stem")
def last_root(spark, sf_dir):
    return _names(spark, sf_dir).groupBy("stem").agg(F.max_by("folder", "id").alias("root"))


@register("SC03_dedupe_positions", ctes("points") + ", q AS (SELECT point_id, round(lat, 2) AS a, round(lon, 2) AS b FROM points) SELECT min(point_id) AS point_id, a, b FROM q GROUP BY a, b")
def dedupe_positions(spark, sf_dir):
    rows = carrier(spark, sf_dir, "points").select("point_id", geo.rounded(F.col("lat"), 2).alias("a"), geo.rounded(F.col("lon"), 2).alias("b"))
    return rows.groupBy("a", "b").agg(F.min("point_id").alias("point_id"))


@register("FL01_corrupt_latitude", _N + ", h AS (SELECT id, CASE WHEN id % 4 = 0 THEN '8.5901_37.2' WHEN id % 4 = 1 THEN (40 + id % 20) || '.25_30.1' ELSE stem END AS stem FROM names) SELECT id, coalesce(try_cast(split_part(stem, '_', 1) AS DOUBLE) NOT BETWEEN 44 AND 53, false) AS corrupt FROM h")
def corrupt_latitude(spark, sf_dir):
    k = F.col("id") % 4
    stem = F.when(k == 0, "8.5901_37.2").when(k == 1, F.concat((40 + F.col("id") % 20).cast("string"), F.lit(".25_30.1"))).otherwise(F.col("stem"))
    return _names(spark, sf_dir).select("id", X.looks_corrupt(stem).alias("corrupt"))


_WAYS = """WITH w AS (SELECT event_id, event_id % 16 AS k, ['motorway', 'trunk', 'primary', 'secondary', 'tertiary', 'unclassified', 'residential', 'service', 'road', 'track', 'footway', 'steps'][1 + event_id % 12] AS h FROM events)"""


def ways(spark, sf_dir):
    """(event_id, tags): roads of known and other classes, rivers, lakes, buildings, some with several tags."""
    k = F.col("event_id") % 16
    kinds = F.array(*map(F.lit, (*O.ROADS, "footway", "steps")))
    tag = lambda name, value, when: F.when(when, F.struct(F.lit(name).alias("key"), value.alias("value")))
    found = F.array_compact(F.array(tag("highway", F.get(kinds, (F.col("event_id") % 12).cast("int")), k < 8), tag("waterway", F.lit("river"), (k >= 6) & (k < 11)), tag("natural", F.lit("water"), (k == 12) | (k == 0)), tag("natural", F.lit("wood"), k == 13), tag("building", F.lit("yes"), k == 14)))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.map_from_entries(found).alias("tags"))


@register("FL02_classify_way", _WAYS + " SELECT event_id, CASE WHEN k < 8 AND event_id % 12 < 10 THEN h WHEN k >= 6 AND k < 11 THEN 'waterway' WHEN k IN (0, 12) THEN 'natural_water' END AS class FROM w")
def classify_way(spark, sf_dir):
    return ways(spark, sf_dir).select("event_id", O.way_class(F.col("tags")).alias("class"))


@register("FL03_coverage_status", ctes("points") + """, q AS (SELECT point_id, greatest(48.51e0 - lat, lat - 48.55e0, 0e0) AS dy, greatest(37.52e0 - lon, lon - 37.6e0, 0e0) AS dx, least(lat - 48.51e0, 48.55e0 - lat, lon - 37.52e0, 37.6e0 - lon) AS margin FROM points)
SELECT point_id, CASE WHEN dx > 0 OR dy > 0 THEN 'outside' WHEN point_id % 9 = 0 THEN 'nodata' ELSE 'inside' END AS status, round(sqrt(dx * dx + dy * dy), 7) AS dist_out, round(greatest(margin, 0e0), 7) AS margin FROM q""")
def coverage_status(spark, sf_dir):
    lat, lon, zero = F.col("lat"), F.col("lon"), F.lit(0.0)
    dy, dx = F.greatest(48.51 - lat, lat - 48.55, zero), F.greatest(37.52 - lon, lon - 37.6, zero)
    margin = F.least(lat - 48.51, 48.55 - lat, lon - 37.52, 37.6 - lon)
    status = F.when((dx > 0) | (dy > 0), "outside").when(F.col("point_id") % 9 == 0, "nodata").otherwise("inside")
    return carrier(spark, sf_dir, "points").select("point_id", status.alias("status"), F.round(F.sqrt(dx * dx + dy * dy), 7).alias("dist_out"), F.round(F.greatest(margin, zero), 7).alias("margin"))
