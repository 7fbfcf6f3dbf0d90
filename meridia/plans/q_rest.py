"""The rest of section 2 that can be told as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meridia.functions import geo, text
from meridia.operators import components as C
from meridia.operators import losses as L
from meridia.operators import sync as Y
from meridia.operators.box_join import box_join
from meridia.plans.q_geometry import POSITIONED, points, tiles
from meridia.registry import register
from meridia.sources.carriers import carrier, ctes


@register("JN01_candidates_box", POSITIONED + " SELECT point_id, tile_id FROM p, t WHERE p.city = t.city AND abs(p.x - t.x) <= 400e0 AND abs(p.y - t.y) <= 400e0")
def candidates(spark, sf_dir):
    hits = box_join(points(spark, sf_dir).select("point_id", "city", "x", "y"), tiles(spark, sf_dir).select("tile_id", "city", "x", "y"), 400.0, ["city"])
    return hits.select("point_id", F.col("r_tile_id").alias("tile_id"))


@register("PJ04_scaled_pyramid", ctes("points") + " SELECT point_id, round(1000e0 / cos(radians(lat)), 4) AS base, round(250e0 / cos(radians(lat)), 4) AS apex FROM points")
def scaled_pyramid(spark, sf_dir):
    scaled = lambda m, n: F.round(geo.to_grid(F.lit(m), F.col("lat")), 4).alias(n)
    return carrier(spark, sf_dir, "points").select("point_id", scaled(1000.0, "base"), scaled(250.0, "apex"))


@register("PJ08_true_overlap", POSITIONED + " SELECT a.tile_id AS a, b.tile_id AS b, round(greatest(0e0, least(a.x + a.size / 2, b.x + b.size / 2) - greatest(a.x - a.size / 2, b.x - b.size / 2)) * greatest(0e0, least(a.y + a.size / 2, b.y + b.size / 2) - greatest(a.y - a.size / 2, b.y - b.size / 2)) * power(cos(radians((a.lat + b.lat) / 2)), 2), 1) AS area FROM t a JOIN t b ON b.tile_id = a.tile_id + 1")
def true_overlap(spark, sf_dir):
    left = tiles(spark, sf_dir)
    right = left.select((F.col("tile_id") - 1).alias("tile_id"), F.col("tile_id").alias("b"), *[F.col(c).alias(f"r_{c}") for c in ("x", "y", "lat", "size_m")])
    return left.join(right, "tile_id").select(F.col("tile_id").alias("a"), "b", F.round(C.overlap_true_m2(1000.0), 1).alias("area"))


@register("PJ22_validated_numbers", ctes("points") + " SELECT point_id, lat FROM points")
def validated_numbers(spark, sf_dir):
    """Finite numbers; the range of a latitude is the affair of geo.cos_lat()."""
    lat = F.col("lat")
    bad = F.when(lat.isNull() | F.isnan(lat) | (F.abs(lat) == float("inf")), F.raise_error(F.lit("a latitude isn't usable")).cast("double"))
    return carrier(spark, sf_dir, "points").select("point_id", F.coalesce(bad, lat).alias("lat"))


@register("GR01_union_find", "WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey - s_suppkey % 7 AS b FROM supplier), r AS (SELECT a AS v, a AS w FROM e UNION SELECT r.v, CASE WHEN e.a = r.w THEN e.b ELSE e.a END FROM r JOIN e ON e.a = r.w OR e.b = r.w) SELECT v, min(w) AS component FROM r GROUP BY v")
def union_find(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("a"))
    return C.connected(ids.select(F.col("a").alias("v")), ids.withColumn("b", F.col("a") - F.col("a") % 7))


@register("AG26_validated_masks", ctes("batch") + " SELECT q, count(*) FILTER (is_pos) AS positives, count(*) FILTER (is_cand) AS candidates FROM batch GROUP BY q")
def validated_masks(spark, sf_dir):
    n = lambda c: F.count(F.when(F.col(c), 1))
    return L.validated(carrier(spark, sf_dir, "batch")).groupBy("q").agg(n("is_pos").alias("positives"), n("is_cand").alias("candidates"))


@register("GR11_epoch_seeds", ctes("vectors") + " SELECT vec_id % 3 AS shard, count(*) AS pairs FROM vectors GROUP BY 1")
def epoch_seeds(spark, sf_dir):
    """Every pair is in a batch of the epoch."""
    from meridia.plans.q_rank import planned

    return planned(spark, sf_dir).groupBy("shard").agg(F.countDistinct("pair").alias("pairs"))


@register("SC21_frames_by_city", ctes("names") + " SELECT folder AS city, count(*) AS frames, min(stem) AS first FROM names GROUP BY folder")
def frames_by_city(spark, sf_dir):
    return carrier(spark, sf_dir, "names").groupBy(F.col("folder").alias("city")).agg(F.count("*").alias("frames"), F.min("stem").alias("first"))


@register("SC23_split_of_points", ctes("points") + " SELECT point_id, CASE WHEN point_id % 10 = 9 THEN 'excluded' ELSE 'train' END AS split FROM points WHERE NOT (point_id % 10 = 9 AND point_id % 20 = 9)")
def split_of_points(spark, sf_dir):
    """Of the excluded points, those whose whole component is excluded."""
    d = F.col("point_id")
    rows = carrier(spark, sf_dir, "points").select("point_id", F.when(d % 10 == 9, "excluded").otherwise("train").alias("split"), F.when(d % 20 == 9, "no_positive").otherwise("excluded_component").alias("reason"))
    return rows.filter("split <> 'excluded' OR reason = 'excluded_component'").select("point_id", "split")


@register("SK02_city_blocks", ctes("points") + " SELECT city, count(*) AS n, min(point_id) AS first FROM points GROUP BY city")
def city_blocks(spark, sf_dir):
    """The per-city part of a run, written by city and read again."""
    from meridia.sources.scratch import folder

    path = folder(spark)
    carrier(spark, sf_dir, "points").write.partitionBy("city").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("city").cast("long").alias("city")).agg(F.count("*").alias("n"), F.min("point_id").alias("first"))


@register("SK03_index_round_trip", ctes("tiles") + " SELECT tile_id, city, lat, lon, size_m FROM tiles")
def index_round_trip(spark, sf_dir):
    from meridia.sources.scratch import written

    return written(carrier(spark, sf_dir, "tiles"))


@register("SK10_empty_flags", ctes("runs") + " SELECT image_id, count(*) FILTER (skip < 256) = 0 AS empty FROM runs GROUP BY image_id")
def empty_flags(spark, sf_dir):
    return carrier(spark, sf_dir, "runs").groupBy("image_id").agg((F.count(F.when(F.col("skip") < 256, 1)) == 0).alias("empty"))


@register("SK14_versioned_rows", "SELECT r_regionkey, r_name, 1 AS schema_version FROM region")
def versioned(spark, sf_dir):
    from meridia.sources.sinks import SCHEMA_VERSION

    return spark.read.parquet(f"{sf_dir}/region.parquet").withColumn("schema_version", F.lit(SCHEMA_VERSION))


@register("SK16_schema_report", "SELECT 'nation' AS \"table\", (SELECT count(*) FROM nation) AS n_rows, unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS col")
def schema_report(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return df.agg(F.count("*").alias("n_rows")).select(F.lit("nation").alias("table"), "n_rows", F.explode(F.array(*map(F.lit, df.columns))).alias("col"))


@register("SO01_stable_order", ctes("tiles") + " SELECT tile_id, CAST(row_number() OVER (ORDER BY tile_id) - 1 AS INTEGER) AS row FROM tiles")
def stable_order(spark, sf_dir):
    return carrier(spark, sf_dir, "tiles").select("tile_id", (F.row_number().over(Window.orderBy("tile_id")) - 1).alias("row"))


@register("SO03_biggest_first", "SELECT o_custkey AS name, count(*) AS size FROM orders GROUP BY o_custkey ORDER BY size DESC, name LIMIT 25")
def biggest_first(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("name")).agg(F.count("*").alias("size"))
    return rows.orderBy(F.col("size").desc(), "name").limit(25)


@register("ST12_night_names", ctes("names") + " SELECT id, CASE WHEN len(string_split(stem, '_')) >= 3 THEN string_split(stem, '_')[1] || '_night_' || array_to_string(string_split(stem, '_')[2:], '_') ELSE stem END AS name FROM names")
def night_names(spark, sf_dir):
    return carrier(spark, sf_dir, "names").select("id", text.with_night(F.col("stem")).alias("name"))


@register("SY02_validated_commits", ctes("objects") + " SELECT event_id FROM objects WHERE size > 0 AND object_key LIKE '%.jpg' AND event_id % 11 <> 0")
def validated_commits(spark, sf_dir):
    """Only rows that pass validation are committed."""
    rows = carrier(spark, sf_dir, "objects")
    error = F.when(F.col("size") <= 0, "empty").when(~F.col("object_key").endswith(".jpg"), "kind").when(F.col("event_id") % 11 == 0, "corrupt")
    return rows.filter(error.isNull()).select("event_id")


@register("SY05_zoom_parts", ctes("pixels") + ", m AS (SELECT r, c, max(layer) AS layer FROM pixels WHERE v <> 0 GROUP BY r, c) SELECT layer, count(*) AS n FROM m GROUP BY layer")
def zoom_parts(spark, sf_dir):
    """How much of a mosaic each zoom gives, finest first."""
    best = carrier(spark, sf_dir, "pixels").filter("v <> 0").groupBy("r", "c").agg(F.max("layer").alias("layer"))
    return best.groupBy("layer").agg(F.count("*").alias("n"))


@register("SY07_skip_existing_masks", ctes("runs") + " SELECT count(*) AS total, count(*) FILTER (image_id % 3 = 0) AS skipped FROM (SELECT DISTINCT image_id FROM runs)")
def skip_masks(spark, sf_dir):
    ids = carrier(spark, sf_dir, "runs").select("image_id").distinct()
    left = Y.remaining(ids, ids.filter("image_id % 3 = 0"), ["image_id"])
    total = ids.agg(F.count("*").alias("total"))
    return total.crossJoin(left.agg(F.count("*").alias("_left"))).select("total", (F.col("total") - F.col("_left")).alias("skipped"))


@register("VE15_frame_estimates", ctes("scores") + ", r AS (SELECT frame_id, level, row_number() OVER (PARTITION BY frame_id, method ORDER BY score DESC, level) - 1 AS r, max(score) OVER (PARTITION BY frame_id, method) AS m FROM scores), f AS (SELECT frame_id, level, round(sum(1 / (60 + r + 1e0)), 12) AS s FROM r WHERE m > 0 GROUP BY frame_id, level), n AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY s DESC, level) AS n FROM f) SELECT frame_id, level FROM n WHERE n = 1")
def frame_estimates(spark, sf_dir):
    from meridia.operators.rank import reciprocal_rank_fusion

    fused = reciprocal_rank_fusion(carrier(spark, sf_dir, "scores"), "frame_id", "method", "level").withColumn("score", F.round("score", 12))
    order = Window.partitionBy("frame_id").orderBy(F.col("score").desc(), "level")
    return fused.withColumn("n", F.row_number().over(order)).filter("n = 1").select("frame_id", "level")


@register("VE11_soft_assignment", ctes("vectors") + """, s AS (SELECT a.vec_id AS t, b.vec_id % 8 AS k, list_dot_product(a.vec::DOUBLE[], b.vec::DOUBLE[]) / 0.2e0 AS z FROM vectors a, vectors b WHERE b.vec_id >= 400 AND b.vec_id < 408)
SELECT k, round(sum(p), 5) AS mass FROM (SELECT k, exp(z) / sum(exp(z)) OVER (PARTITION BY t) AS p FROM s) GROUP BY k""")
def soft_assignment(spark, sf_dir):
    from meridia.functions import stats, vec

    rows = carrier(spark, sf_dir, "vectors")
    centres = rows.filter("vec_id >= 400 AND vec_id < 408").select((F.col("vec_id") % 8).alias("k"), F.col("vec").alias("b"))
    pairs = rows.select(F.col("vec_id").alias("t"), F.col("vec").alias("a")).crossJoin(centres)
    soft = pairs.withColumn("s", vec.dot(F.col("a"), F.col("b"))).withColumn("p", stats.softmax(F.col("s"), ["t"], 0.2))
    return soft.groupBy("k").agg(F.round(F.sum("p"), 5).alias("mass"))
