"""Further queries of section 2: small scalar operators, audits, reports and composed steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meridia.functions import geo
from meridia.operators import association as A
from meridia.operators import osm as O
from meridia.operators import positives as P
from meridia.operators import rank as K
from meridia.operators.box_join import box_join, nearest
from meridia.plans.q_geometry import POSITIONED, points, tiles
from meridia.plans.q_rank import _S, scores, token_scores
from meridia.registry import register
from meridia.sources.carriers import carrier, ctes

_PAIRS = POSITIONED + ", n AS (SELECT a.tile_id AS a, b.tile_id AS b, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, a.lat AS alat, b.lat AS blat, a.size AS sa, b.size AS sb FROM t a, t b WHERE b.tile_id = a.tile_id + 1), i AS (SELECT *, greatest(0e0, least(ax + sa / 2, bx + sb / 2) - greatest(ax - sa / 2, bx - sb / 2)) * greatest(0e0, least(ay + sa / 2, by_ + sb / 2) - greatest(ay - sa / 2, by_ - sb / 2)) AS s FROM n)"


def _pairs(spark, sf_dir):
    left = tiles(spark, sf_dir).withColumn("size", geo.side(F.col("size_m"), 1000.0))
    right = left.select((F.col("tile_id") - 1).alias("tile_id"), *[F.col(c).alias(f"r_{c}") for c in ("x", "y", "lat", "size")])
    return left.join(right, "tile_id").withColumn("s", geo.square_intersection(F.col("x"), F.col("y"), F.col("size"), F.col("r_x"), F.col("r_y"), F.col("r_size")))


@register("PJ07_intersection_area", _PAIRS + " SELECT a, round(s, 2) AS area, round(s * power(cos(radians((alat + blat) / 2)), 2), 2) AS true_area FROM i")
def intersection_area(spark, sf_dir):
    return _pairs(spark, sf_dir).select(F.col("tile_id").alias("a"), F.round("s", 2).alias("area"), F.round(geo.true_area(F.col("s"), (F.col("lat") + F.col("r_lat")) / 2), 2).alias("true_area"))


@register("PJ09_iou", _PAIRS + " SELECT a, round(least(1e0, s / (sa * sa + sb * sb - s)), 6) AS iou FROM i")
def iou(spark, sf_dir):
    a, b = F.col("size") * F.col("size"), F.col("r_size") * F.col("r_size")
    return _pairs(spark, sf_dir).select(F.col("tile_id").alias("a"), F.round(geo.iou(F.col("s"), a, b), 6).alias("iou"))


@register("PJ10_overlap_metrics", _PAIRS + " SELECT a, round(s / (sa * sa), 6) AS cq, round(s / (sb * sb), 6) AS ct FROM i")
def overlap_metrics(spark, sf_dir):
    return _pairs(spark, sf_dir).select(F.col("tile_id").alias("a"), F.round(F.col("s") / F.pow("size", F.lit(2)), 6).alias("cq"), F.round(F.col("s") / F.pow("r_size", F.lit(2)), 6).alias("ct"))


@register("PJ03_true_distance", _PAIRS + " SELECT a, round(sqrt(power(ax - bx, 2) + power(ay - by_, 2)) * cos(radians(alat)), 3) AS metres FROM i")
def true_distance(spark, sf_dir):
    return _pairs(spark, sf_dir).select(F.col("tile_id").alias("a"), F.round(geo.true_distance(F.col("x") - F.col("r_x"), F.col("y") - F.col("r_y"), F.col("lat")), 3).alias("metres"))


@register("PJ24_long_tokens", ctes("tokens") + " SELECT tile_id, count(*) AS n, round(sum(x), 4) AS total FROM (SELECT tile_id, unnest(vec)::DOUBLE AS x FROM tokens) GROUP BY tile_id")
def long_tokens(spark, sf_dir):
    rows = carrier(spark, sf_dir, "tokens").select("tile_id", F.posexplode("vec").alias("i", "x"))
    return rows.groupBy("tile_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x").cast("double")), 4).alias("total"))


@register("SC04_group_order", "SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END NULLS LAST, p_partkey) AS place FROM part")
def group_order(spark, sf_dir):
    index = F.when(F.col("p_size") % 5 != 0, F.col("p_size"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", index.alias("i"))
    return rows.select("p_partkey", F.row_number().over(Window.orderBy(F.col("i").asc_nulls_last(), "p_partkey")).alias("place"))


@register("SC06_keyed_fetch", ctes("tokens") + " SELECT p_partkey AS want, r, c FROM part JOIN tokens ON tile_id = p_partkey")
def keyed_fetch(spark, sf_dir):
    want = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("tile_id"))
    return carrier(spark, sf_dir, "tokens").join(want, "tile_id").select(F.col("tile_id").alias("want"), "r", "c")


@register("SC07_has_tokens", ctes("points", "tokens") + " SELECT point_id, point_id IN (SELECT tile_id FROM tokens) AS has FROM points")
def has_tokens(spark, sf_dir):
    known = carrier(spark, sf_dir, "tokens").select(F.col("tile_id").alias("point_id")).distinct().withColumn("has", F.lit(True))
    return carrier(spark, sf_dir, "points").select("point_id").join(known, "point_id", "left").select("point_id", F.coalesce("has", F.lit(False)).alias("has"))


@register("SC09_rounded_lookup", POSITIONED + ", k AS (SELECT tile_id, CAST(round(x * 100) AS BIGINT) AS cx, CAST(round(y * 100) AS BIGINT) AS cy FROM t) SELECT a.tile_id AS a, b.tile_id AS b FROM k a JOIN k b ON a.cx = b.cx AND a.cy = b.cy")
def rounded_lookup(spark, sf_dir):
    cent = lambda c: F.round(F.col(c) * 100).cast("long")
    rows = tiles(spark, sf_dir).select("tile_id", cent("x").alias("cx"), cent("y").alias("cy"))
    return rows.withColumnRenamed("tile_id", "a").join(rows.withColumnRenamed("tile_id", "b"), ["cx", "cy"]).select("a", "b")


@register("SC11_first_level_centres", "SELECT l_orderkey AS tile, arg_min(l_partkey, {'l': l_linenumber, 'p': l_partkey}) AS centre FROM lineitem GROUP BY l_orderkey")
def first_level(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("tile")).agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("centre"))


@register("GN10_crop_list", POSITIONED + " SELECT tile_id, l AS level FROM t, (SELECT unnest([250, 500, 1000]) AS l) WHERE l <= size")
def crop_list(spark, sf_dir):
    rows = tiles(spark, sf_dir).withColumn("level", F.explode(F.array(*map(F.lit, (250, 500, 1000)))))
    return rows.filter(F.col("level") <= geo.side(F.col("size_m"), 1000.0)).select("tile_id", "level")


@register("JN14_geometry_relevance", POSITIONED + """, o AS (SELECT point_id, tile_id, greatest(0e0, 1000e0 - abs(p.x - t.x)) * greatest(0e0, 1000e0 - abs(p.y - t.y)) AS s FROM p, t WHERE p.city = t.city)
SELECT point_id, count(*) FILTER (s / (2e6 - s) >= 0.25e0) AS pos, count(*) FILTER (s / (2e6 - s) <= 1e-9) AS safe FROM o GROUP BY point_id""")
def geometry_relevance(spark, sf_dir):
    """Positives share enough with the query; what shares nothing is safe: all tiles of the city less those that touch."""
    ask = points(spark, sf_dir).select("point_id", "city", "x", "y")
    all_ = tiles(spark, sf_dir).select("tile_id", "city", "x", "y")
    hits = box_join(ask, all_, 1000.0, ["city"])
    s = geo.square_intersection(F.col("x"), F.col("y"), F.lit(1000.0), F.col("r_x"), F.col("r_y"), F.lit(1000.0))
    ratio = s / (2e6 - s)
    per = hits.groupBy("point_id").agg(F.count(F.when(ratio >= 0.25, 1)).alias("pos"), F.count(F.when(ratio > 1e-9, 1)).alias("_touch"))
    total = all_.groupBy("city").agg(F.count("*").alias("_n"))
    rows = ask.join(total, "city").join(per, "point_id", "left")
    return rows.select("point_id", F.coalesce("pos", F.lit(0)).alias("pos"), (F.col("_n") - F.coalesce("_touch", F.lit(0))).alias("safe"))


@register("JN15_explicit_relevance", ctes("batch") + " SELECT q, t, 1 + t % 3 AS weight FROM batch WHERE is_pos")
def explicit_relevance(spark, sf_dir):
    rows = carrier(spark, sf_dir, "batch")
    weights = rows.select("t", (1 + F.col("t") % 3).alias("weight")).distinct()
    return rows.filter("is_pos").join(weights, "t").select("q", "t", "weight")


@register("JN17_cross_weights", ctes("batch") + ", m AS (SELECT DISTINCT q FROM batch) SELECT batch.q, t, CASE WHEN is_pos THEN 1 + t % 3 ELSE 0 END AS weight FROM batch JOIN m ON t = m.q")
def cross_weights(spark, sf_dir):
    rows = carrier(spark, sf_dir, "batch")
    members = rows.select(F.col("q").alias("t")).distinct()
    return rows.join(members, "t", "left_semi").select("q", "t", F.when(F.col("is_pos"), 1 + F.col("t") % 3).otherwise(0).alias("weight"))


@register("JN20_nearest_within", POSITIONED + """, d AS (SELECT point_id, tile_id, p.lat, power(p.x - t.x, 2) + power(p.y - t.y, 2) AS d2 FROM p, t), n AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, tile_id) AS k FROM d WHERE sqrt(d2) * cos(radians(lat)) <= 140e0) SELECT point_id, tile_id FROM n WHERE k = 1""")
def nearest_within(spark, sf_dir):
    return P.nearest_within(points(spark, sf_dir), tiles(spark, sf_dir), 140.0).select("point_id", "tile_id")


@register("JN22_known_only", ctes("points", "tiles") + " SELECT point_id FROM points WHERE point_id IN (SELECT tile_id FROM tiles WHERE size_m IS NOT NULL)")
def known_only(spark, sf_dir):
    known = carrier(spark, sf_dir, "tiles").filter("size_m IS NOT NULL").select(F.col("tile_id").alias("point_id"))
    return carrier(spark, sf_dir, "points").join(known, "point_id", "left_semi").select("point_id")


@register("JN27_day_names", ctes("names") + " SELECT id FROM names WHERE NOT list_contains(string_split(stem, '_'), 'night')")
def day_names(spark, sf_dir):
    return carrier(spark, sf_dir, "names").filter(~F.array_contains(F.split("stem", "_"), "night")).select("id")


@register("WN04_ranks", ctes("scores") + " SELECT frame_id, method, level, CAST(row_number() OVER (PARTITION BY frame_id, method ORDER BY score DESC, level) - 1 AS INTEGER) AS rank FROM scores")
def ranks(spark, sf_dir):
    order = Window.partitionBy("frame_id", "method").orderBy(F.col("score").desc(), "level")
    return carrier(spark, sf_dir, "scores").select("frame_id", "method", "level", (F.row_number().over(order) - 1).alias("rank"))


@register("WN05_gap", ctes("scores") + ", r AS (SELECT frame_id, score, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC) AS n FROM scores WHERE method = 'patch') SELECT frame_id, round(max(score) FILTER (n = 1) - max(score) FILTER (n = 2), 6) AS gap FROM r GROUP BY frame_id")
def gap(spark, sf_dir):
    order = Window.partitionBy("frame_id").orderBy(F.col("score").desc())
    rows = carrier(spark, sf_dir, "scores").filter("method = 'patch'").withColumn("n", F.row_number().over(order)).withColumn("next", F.lead("score").over(order))
    return rows.filter("n = 1").select("frame_id", F.round(F.col("score") - F.col("next"), 6).alias("gap"))


@register("WN10_pair_numbers", POSITIONED + " SELECT point_id, CAST(row_number() OVER (ORDER BY point_id) - 1 AS INTEGER) AS pair FROM p WHERE EXISTS (SELECT 1 FROM t WHERE p.city = t.city AND abs(p.x - t.x) <= 500e0 AND abs(p.y - t.y) <= 500e0)")
def pair_numbers(spark, sf_dir):
    hits = box_join(points(spark, sf_dir).select("point_id", "city", "x", "y"), tiles(spark, sf_dir).select("city", "x", "y"), 500.0, ["city"])
    return hits.select("point_id").distinct().select("point_id", (F.row_number().over(Window.orderBy("point_id")) - 1).alias("pair"))


@register("AG08_distance_shares", POSITIONED + """, d AS (SELECT point_id, min(sqrt(power(p.x - t.x, 2) + power(p.y - t.y, 2)) * cos(radians(p.lat))) AS d FROM p, t GROUP BY point_id)
SELECT count(*) AS n, round(avg(CAST(d <= 190 AS INT)), 6) AS near, round(avg(CAST(d <= 380 AS INT)), 6) AS mid, round(quantile_cont(d, 0.5), 2) AS median FROM d""")
def distance_shares(spark, sf_dir):
    per = nearest(points(spark, sf_dir), tiles(spark, sf_dir), 1000.0).select((F.sqrt("d2") * F.cos(F.radians("lat"))).alias("d"))
    share = lambda m, n: F.round(F.avg((F.col("d") <= m).cast("int")), 6).alias(n)
    return per.agg(F.count("*").alias("n"), share(190, "near"), share(380, "mid"), F.round(F.percentile("d", F.lit(0.5)), 2).alias("median"))


@register("AG11_coarse_recall", _S + ", c AS (SELECT q, t % 20 AS cell, max(s) AS s, bool_or(tl = ql) AS pos FROM a GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, cell) AS rank FROM c), f AS (SELECT q, min(rank) FILTER (pos) AS rank FROM r GROUP BY q) SELECT count(*) AS n, round(avg(CAST(rank <= 1 AS INT)), 6) AS r1, round(avg(CAST(rank <= 5 AS INT)), 6) AS r5 FROM f WHERE rank IS NOT NULL")
def coarse_recall(spark, sf_dir):
    cells = scores(spark, sf_dir).groupBy("q", (F.col("t") % 20).alias("t")).agg(F.max("s").alias("s"), F.bool_or(F.col("tl") == F.col("ql")).alias("pos"))
    return K.recall(K.first_positive(cells, F.col("pos"), 20), (1, 5)).select("n", "r1", "r5")


@register("AG15_best_combination", _S + ", d AS (SELECT q % 20 AS combo, q, abs(q - t) AS d FROM k WHERE rank = 1), g AS (SELECT combo, round(avg(CAST(d <= 250 AS INT)), 6) AS share FROM d GROUP BY combo) SELECT combo, share FROM g ORDER BY share DESC, combo LIMIT 1")
def best_combination(spark, sf_dir):
    rows = K.top_k(scores(spark, sf_dir), 1).groupBy((F.col("q") % 20).alias("combo")).agg(F.round(F.avg((F.abs(F.col("q") - F.col("t")) <= 250).cast("int")), 6).alias("share"))
    return rows.agg(F.max_by(F.struct("combo", "share"), F.struct("share", -F.col("combo"))).alias("m")).select("m.*")


@register("AG16_survival", _S + ", c AS (SELECT q, t, row_number() OVER (PARTITION BY q ORDER BY s % 1000 DESC, t) AS place FROM a), w AS (SELECT q, t, rank FROM k WHERE rank <= 5) SELECT b AS budget, round(avg(CAST(place <= b AND rank = 1 AS INT)) * 5, 6) AS winner, round(avg(CAST(place <= b AS INT)), 6) AS top5 FROM w JOIN c USING (q, t), (SELECT unnest([50, 200]) AS b) GROUP BY b")
def survival(spark, sf_dir):
    """How often the exact best, and the five best, are still there after a cheaper score's cut."""
    rows = scores(spark, sf_dir).select("q", "t", "s")
    cheap = rows.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy((F.col("s") % 1000).desc(), "t"))).select("q", "t", "place")
    best = K.top_k(rows, 5).join(cheap, ["q", "t"]).withColumn("budget", F.explode(F.array(F.lit(50), F.lit(200))))
    kept = (F.col("place") <= F.col("budget"))
    return best.groupBy("budget").agg(F.round(F.avg((kept & (F.col("rank") == 1)).cast("int")) * 5, 6).alias("winner"), F.round(F.avg(kept.cast("int")), 6).alias("top5"))


@register("AG36_run_counters", ctes("points", "tokens") + " SELECT CASE WHEN lat > 48.9e0 THEN 'no_coord' WHEN point_id NOT IN (SELECT tile_id FROM tokens) THEN 'no_mask' ELSE 'done' END AS status, count(*) AS n FROM points GROUP BY 1")
def run_counters(spark, sf_dir):
    known = has_tokens(spark, sf_dir)
    rows = carrier(spark, sf_dir, "points").join(known, "point_id")
    return rows.groupBy(F.when(F.col("lat") > 48.9, "no_coord").when(~F.col("has"), "no_mask").otherwise("done").alias("status")).agg(F.count("*").alias("n"))


@register("AG39_group_fingerprints", "SELECT n_nationkey % 5 AS g, sha256(string_agg(n_name, '|' ORDER BY n_name)) AS print FROM nation GROUP BY 1")
def group_fingerprints(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy((F.col("n_nationkey") % 5).alias("g"))
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("n_name")), "|"), 256).alias("print"))


# frames of one to seven possible sizes; every ninth is refused
_ASSOCIATED = POSITIONED + ctes("scores").replace("WITH RECURSIVE ", ",\n") + """, l AS (SELECT frame_id, level * 150e0 AS scale, score AS w FROM scores WHERE method = 'global' AND score > 0),
f AS (SELECT point_id, x, y, point_id % 9 = 0 AS refused FROM p), s AS (SELECT frame_id, scale, w / sum(w) OVER (PARTITION BY frame_id) AS w FROM l),
o AS (SELECT point_id, tile_id, refused, w, scale * scale AS q, size * size AS t, greatest(0e0, least(f.x + scale / 2, t.x + size / 2) - greatest(f.x - scale / 2, t.x - size / 2)) * greatest(0e0, least(f.y + scale / 2, t.y + size / 2) - greatest(f.y - scale / 2, t.y - size / 2)) AS i FROM f JOIN s ON point_id = frame_id, t),
e AS (SELECT point_id, tile_id, refused, sum(w * i / q) AS cq, sum(w * i / t) AS ct, sum(w * i / (q + t - i)) AS iou FROM o GROUP BY ALL HAVING sum(w * i / (q + t - i)) > 0)"""


def associations(spark, sf_dir):
    frames = points(spark, sf_dir).select(F.col("point_id").alias("frame_id"), "x", "y", (F.col("point_id") % 9 == 0).alias("refused"))
    levels = carrier(spark, sf_dir, "scores").filter("method = 'global'").select("frame_id", (F.col("level") * 150.0).alias("scale_m"), F.col("score").alias("weight"))
    return A.associated(frames, levels, tiles(spark, sf_dir))


@register("JN11_expected_overlap", _ASSOCIATED + " SELECT point_id AS frame_id, tile_id, round(cq + 1e-9, 6) AS cq, round(ct + 1e-9, 6) AS ct, round(iou + 1e-9, 6) AS iou FROM e")
def expected_overlap(spark, sf_dir):
    # a little more, so that sums of another order don't round a half the other way
    return associations(spark, sf_dir).select("frame_id", "tile_id", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("cq", "ct", "iou")])


@register("FL04_association_status", _ASSOCIATED + " SELECT status, count(*) AS n, round(sum(weight), 4) AS weight FROM (SELECT CASE WHEN refused THEN 'undetermined' WHEN cq >= 0.7e0 AND ct >= 0.3e0 THEN 'strong' WHEN iou >= 0.05e0 THEN 'partial' ELSE 'negative' END AS status, CASE WHEN refused THEN 0e0 WHEN cq >= 0.7e0 AND ct >= 0.3e0 THEN greatest(cq, iou) WHEN iou >= 0.05e0 THEN iou ELSE 0e0 END AS weight FROM e) GROUP BY status")
def association_status(spark, sf_dir):
    return associations(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@register("FL07_hypotheses", _S + ", f AS (SELECT q, min(rank) AS rank FROM k WHERE tl = ql GROUP BY q), m AS (SELECT avg(CAST(rank <= 10 AS INT)) AS r10, quantile_cont(rank, 0.5) AS med FROM f) SELECT unnest(['overfit', 'labels']) AS hypothesis, unnest([CASE WHEN r10 < 0.1 THEN 'supported' ELSE 'rejected' END, CASE WHEN med > 100 THEN 'open' ELSE 'rejected' END]) AS status FROM m")
def hypotheses(spark, sf_dir):
    m = K.recall(K.first_positive(scores(spark, sf_dir), F.col("tl") == F.col("ql"), 10**6))
    rows = F.array(F.struct(F.lit("overfit").alias("hypothesis"), F.when(F.col("r10") < 0.1, "supported").otherwise("rejected").alias("status")), F.struct(F.lit("labels").alias("hypothesis"), F.when(F.col("median_rank") > 100, "open").otherwise("rejected").alias("status")))
    return m.select(F.inline(rows))


@register("SO04_top_three", ctes("scores") + " SELECT frame_id, method, level FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, method ORDER BY score DESC, level) AS n FROM scores) WHERE n <= 3")
def top_three(spark, sf_dir):
    order = Window.partitionBy("frame_id", "method").orderBy(F.col("score").desc(), "level")
    return carrier(spark, sf_dir, "scores").withColumn("n", F.row_number().over(order)).filter("n <= 3").select("frame_id", "method", "level")


@register("SO05_first_rows", ctes("points") + " SELECT city, list(point_id ORDER BY point_id)[1:20] AS first FROM points GROUP BY city")
def first_rows(spark, sf_dir):
    order = Window.partitionBy("city").orderBy("point_id")
    rows = carrier(spark, sf_dir, "points").withColumn("n", F.row_number().over(order)).filter("n <= 20")
    return rows.groupBy("city").agg(F.array_sort(F.collect_list("point_id")).alias("first"))


@register("SO06_union_of_cities", ctes("tiles") + " SELECT tile_id, city FROM tiles")
def union_of_cities(spark, sf_dir):
    rows = carrier(spark, sf_dir, "tiles").select("tile_id", "city")
    parts = [rows.filter(F.col("city") == c) for c in range(3)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    again = F.count("*").over(Window.partitionBy("tile_id")) > 1
    return whole.withColumn("_x", F.when(again, F.raise_error(F.lit("a tile id stands in two cities")).cast("int"))).filter("_x IS NULL").drop("_x")


@register("SO09_union_of_cells", POSITIONED + " SELECT DISTINCT b.tile_id FROM t a JOIN t b ON abs(a.x - b.x) <= 500e0 AND abs(a.y - b.y) <= 500e0")
def union_of_cells(spark, sf_dir):
    rows = tiles(spark, sf_dir).select("tile_id", "x", "y")
    return box_join(rows, rows, 500.0).select(F.col("r_tile_id").alias("tile_id")).distinct()


# two segments a line item; areas are triangles of their ends and a corner
_BURN = """WITH RECURSIVE s AS (SELECT l_orderkey % 20 AS image, CAST(l_linenumber AS BIGINT) AS band, l_orderkey * 8 + l_linenumber AS id, (l_partkey % 97) / 2e0 AS x0, (l_suppkey % 89) / 2e0 AS y0, (l_orderkey % 83) / 2e0 AS x1, (l_partkey % 71) / 2e0 AS y1 FROM {lineitem}),
e AS (SELECT *, false AS area FROM s WHERE band <> 2 UNION ALL SELECT image, band, id, x0, y0, x1, y1, true FROM s WHERE band = 2 UNION ALL SELECT image, band, id, x1, y1, 47e0, 0e0, true FROM s WHERE band = 2 UNION ALL SELECT image, band, id, 47e0, 0e0, x0, y0, true FROM s WHERE band = 2)"""
_BURNED = _BURN.format(lineitem="lineitem") + """, k AS (SELECT image, band, r, x0, y0, x1, y1, CASE WHEN y0 = y1 THEN x0 ELSE x0 + (greatest(least(y0, y1), least(greatest(y0, y1), r)) - y0) * (x1 - x0) / (y1 - y0) END AS a, CASE WHEN y0 = y1 THEN x1 ELSE x0 + (greatest(least(y0, y1), least(greatest(y0, y1), r + 1)) - y0) * (x1 - x0) / (y1 - y0) END AS b
  FROM e JOIN range(0, 48) q(r) ON r >= floor(least(y0, y1)) AND r <= floor(greatest(y0, y1))),
t AS (SELECT DISTINCT image, band, r, c FROM k JOIN range(0, 48) z(c) ON c >= floor(least(a, b)) AND c <= floor(greatest(a, b))),
i AS (SELECT image, band, r, c FROM e JOIN range(0, 48) q(r) ON area AND (y0 <= r + 0.5e0) <> (y1 <= r + 0.5e0) JOIN range(0, 48) z(c) ON x0 + (r + 0.5e0 - y0) * (x1 - x0) / (y1 - y0) <= c + 0.5e0 GROUP BY id, image, band, r, c HAVING count(*) % 2 = 1)
SELECT band, count(*) AS cells, sum(r * 48 + c)::BIGINT AS places FROM (SELECT * FROM t UNION SELECT * FROM i) GROUP BY band"""


@register("RA05_burned_bands", _BURNED)
def burned(spark, sf_dir):
    """Bands of images of 48 x 48 pixels: lines in six bands, triangles in one."""
    rows = spark.sql("WITH" + _BURN.split("RECURSIVE", 1)[1] + " SELECT * FROM e", lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    areas = rows.filter("area")
    inside = areas.select("image", "band", "id", "x0", "y0", "x1", "y1")
    pixels = O.burned(rows.filter("NOT area").select("image", "band", "id", "x0", "y0", "x1", "y1"), inside, ["image", "band", "id"], 48, 48).select("image", "band", "r", "c").distinct()
    return pixels.groupBy("band").agg(F.count("*").alias("cells"), F.sum(F.col("r") * 48 + F.col("c")).alias("places"))


@register("RA07_sky_keep", ctes("pixels") + " SELECT CAST(floor(r / 8e0) AS BIGINT) AS br, CAST(floor(c / 8e0) AS BIGINT) AS bc, avg(CAST(v = 0 AS INT)) <= 0.2e0 AS keep FROM pixels GROUP BY 1, 2")
def sky_keep(spark, sf_dir):
    from meridia.operators.raster import block_share

    shares = block_share(carrier(spark, sf_dir, "pixels"), [], (F.col("v") == 0).cast("int"), 64, 64, 8)
    return shares.select("br", "bc", (F.col("share") <= 0.2).alias("keep"))


@register("RA09_inverted_masks", ctes("pixels") + " SELECT r, c, v = 0 AS sky, v <> 0 AS keep FROM pixels WHERE layer = 1")
def inverted(spark, sf_dir):
    sky = F.col("v") == 0
    return carrier(spark, sf_dir, "pixels").filter("layer = 1").select("r", "c", sky.alias("sky"), (~sky).alias("keep"))


@register("VE05_ransac_inliers")
def ransac(spark, sf_dir):
    from meridia.operators.verify import verified

    rows = K.mutual_nearest(token_scores(spark, sf_dir), ["u", "w"])
    at = lambda c: ((F.col(c) % 5).cast("double"), F.floor(F.col(c) / 5).cast("double"))
    (ax, ay), (bx, by) = at("q"), at("t")
    return verified(rows.select("u", "w", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by_")), ["u", "w"], "similarity")


@register("VE06_match_share")
def match_share(spark, sf_dir):
    return ransac(spark, sf_dir).select("u", "w", (F.col("inliers") / 25.0).alias("score"))


@register("VE14_level_similarity", _S + " SELECT q, tl, max(s) AS best, round(avg(s), 3) AS mean FROM a GROUP BY q, tl")
def level_similarity(spark, sf_dir):
    return scores(spark, sf_dir).groupBy("q", "tl").agg(F.max("s").alias("best"), F.round(F.avg("s"), 3).alias("mean"))


@register("ST08_city_from_stem", ctes("names") + " SELECT id, regexp_replace(regexp_replace(regexp_replace(stem, '^gt_', ''), '_night.*$', ''), '_[-\\d.]+([_,][-\\d.]+)*$', '') AS city FROM names")
def city_from_stem(spark, sf_dir):
    out = F.col("stem")
    for pattern in ("^gt_", "_night.*$", r"_[-\d.]+([_,][-\d.]+)*$"):
        out = F.regexp_replace(out, pattern, "")
    return carrier(spark, sf_dir, "names").select("id", out.alias("city"))


@register("ST11_safe_class", ctes("names") + " SELECT id, lower(regexp_replace(folder || ' ' || stem, '[^A-Za-z0-9]+', '-', 'g')) AS class FROM names")
def safe_class(spark, sf_dir):
    return carrier(spark, sf_dir, "names").select("id", F.lower(F.regexp_replace(F.concat_ws(" ", "folder", "stem"), "[^A-Za-z0-9]+", "-")).alias("class"))


@register("ST13_area_query", ctes("points") + """, b AS (SELECT city, concat_ws(',', round(min(lat), 3)::VARCHAR, round(min(lon), 3)::VARCHAR, round(max(lat), 3)::VARCHAR, round(max(lon), 3)::VARCHAR) AS b FROM points GROUP BY city)
SELECT city, '[out:json][timeout:120];' || chr(10) || '(' || chr(10) || '  way["highway"~"^(motorway|primary|residential|road|secondary|service|tertiary|track|trunk|unclassified)$"](' || b || ');' || chr(10) || '  way["waterway"](' || b || ');' || chr(10) || '  way["natural"="water"](' || b || ');' || chr(10) || ');' || chr(10) || 'out body;' || chr(10) || '>;' || chr(10) || 'out skel qt;' || chr(10) AS query FROM b""")
def area_query(spark, sf_dir):
    box = [F.round(f(c), 3) for f, c in ((F.min, "lat"), (F.min, "lon"), (F.max, "lat"), (F.max, "lon"))]
    return carrier(spark, sf_dir, "points").groupBy("city").agg(O.query_text(*box).alias("query"))


@register("SK13_union_columns", "SELECT r_regionkey AS k, CAST(NULL AS INTEGER) AS nation, r_name AS region FROM region UNION ALL SELECT n_regionkey, n_nationkey, NULL FROM nation")
def union_columns(spark, sf_dir):
    from meridia.sources.sinks import union_columns as union

    region = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("region"))
    return union([region, spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("nation"))])


@register("SK04_placemarks", ctes("points") + " SELECT '<Placemark><name>' || point_id || '</name><styleUrl>#' || city || '</styleUrl><Point><coordinates>' || printf('%.7f,%.7f,0', lon, lat) || '</coordinates></Point></Placemark>' AS kml FROM points")
def placemarks(spark, sf_dir):
    from meridia.sources.sinks import placemarks as marks

    return marks(carrier(spark, sf_dir, "points"), "point_id", "lat", "lon", "city")


@register("SK05_shortlist", _S + " SELECT q, list(t ORDER BY rank) AS cells FROM k WHERE rank <= 5 GROUP BY q")
def shortlist(spark, sf_dir):
    rows = K.top_k(scores(spark, sf_dir), 5).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "t"))).alias("m"))
    return rows.select("q", F.transform("m", lambda e: e["t"]).alias("cells"))
