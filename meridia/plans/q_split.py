"""Queries of overlap graphs, leakage-free splits and their audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.operators import assign as A
from meridia.operators import components as C
from meridia.operators import exact_split as exact_split_
from meridia.operators import positives as P
from meridia.plans.q_geometry import sql_x, sql_y
from meridia.registry import register
from meridia.sources.carriers import carrier, ctes
from meridia.sources.scratch import written

# a frame a little north of each sparse tile
_SPARSE = ctes("sparse") + f""",
t AS (SELECT tile_id, city, lat, lon, size_m, {sql_x()} AS x, {sql_y()} AS y FROM sparse),
e AS (SELECT a.tile_id AS a, b.tile_id AS b, greatest(0e0, 1000e0 - abs(a.x - b.x)) * greatest(0e0, 1000e0 - abs(a.y - b.y)) * power(cos(radians((a.lat + b.lat) / 2)), 2) AS area
  FROM t a, t b WHERE a.tile_id < b.tile_id AND abs(a.x - b.x) < 1000e0 AND abs(a.y - b.y) < 1000e0),
o AS (SELECT a, b, area FROM e WHERE area > 1e0),
r AS (SELECT tile_id AS v, tile_id AS w FROM t UNION SELECT r.v, CASE WHEN o.a = r.w THEN o.b ELSE o.a END FROM r JOIN o ON o.a = r.w OR o.b = r.w),
k AS (SELECT v AS tile_id, min(w) AS cluster FROM r GROUP BY v),
f AS (SELECT tile_id AS point_id, city, lat + 0.0005e0 AS lat, lon FROM sparse),
p AS (SELECT *, {sql_x()} AS x, {sql_y()} AS y FROM f),
m AS (SELECT point_id, tile_id FROM p JOIN t ON abs(p.x - t.x) <= 625e0 AND abs(p.y - t.y) <= 625e0),
l AS (SELECT DISTINCT point_id, cluster FROM m JOIN k USING (tile_id)),
g AS (SELECT point_id AS v, point_id AS w FROM l UNION SELECT g.v, l2.point_id FROM g JOIN l l1 ON l1.point_id = g.w JOIN l l2 ON l1.cluster = l2.cluster),
c AS (SELECT v AS point_id, min(w) AS name FROM g GROUP BY v)"""


def sparse_tiles(spark, sf_dir):
    return P.positioned(carrier(spark, sf_dir, "sparse"))


def sparse_points(spark, sf_dir):
    rows = carrier(spark, sf_dir, "sparse").select(F.col("tile_id").alias("point_id"), "city", (F.col("lat") + 0.0005).alias("lat"), "lon")
    return P.positioned(rows)


def sparse_matches(spark, sf_dir):
    return written(P.best_matches(P.select("current_rule", sparse_points(spark, sf_dir), sparse_tiles(spark, sf_dir), P.params(same_city=False))))


def sparse_components(spark, sf_dir, matches=None):
    tiles = sparse_tiles(spark, sf_dir)
    return written(C.point_components(matches or sparse_matches(spark, sf_dir), C.tile_clusters(tiles)))


@register("JN09_overlap_pairs", _SPARSE + " SELECT a, b, round(area, 2) AS area FROM o")
def overlap_pairs(spark, sf_dir):
    return C.overlapping(sparse_tiles(spark, sf_dir)).select("a", "b", F.round("area", 2).alias("area"))


@register("GR03_tile_clusters", _SPARSE + " SELECT tile_id, cluster FROM k")
def tile_clusters(spark, sf_dir):
    return C.tile_clusters(sparse_tiles(spark, sf_dir))


@register("GR04_point_components", _SPARSE + " SELECT point_id, name, CAST(dense_rank() OVER (ORDER BY name) - 1 AS INTEGER) AS component_id FROM c")
def point_components(spark, sf_dir):
    return sparse_components(spark, sf_dir)


@register(
    "GR02_connected_components",
    """WITH RECURSIVE e AS (SELECT o_orderkey AS a, CASE WHEN o_orderkey % 50 < 46 THEN o_orderkey + 1 + o_custkey % 3 ELSE o_orderkey END AS b FROM orders),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(v, component) USING KEY (v) AS (SELECT a, a FROM d GROUP BY a UNION (SELECT d.a, min(r.component) FROM r JOIN d ON d.b = r.v JOIN recurring.r AS c ON c.v = d.a WHERE r.component < c.component GROUP BY d.a))
SELECT v, component FROM r""",
)
def connected_components(spark, sf_dir):
    """Chains of orders that skip up to two numbers, in blocks of fifty numbers."""
    k = F.col("o_orderkey")
    edges = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("a"), F.when(k % 50 < 46, k + 1 + F.col("o_custkey") % 3).otherwise(k).alias("b"))
    return C.connected(edges.select(F.col("a").alias("v")).union(edges.select("b")), edges)


@register("AG03_size_histogram", _SPARSE + " SELECT size, count(*) AS components FROM (SELECT name, count(*) AS size FROM c GROUP BY name) GROUP BY size")
def size_histogram(spark, sf_dir):
    return C.sizes(sparse_components(spark, sf_dir)).groupBy("size").agg(F.count("*").alias("components"))


@register("AG05_largest_components", _SPARSE + " SELECT name, count(*) AS size FROM c GROUP BY name ORDER BY size DESC, name LIMIT 10")
def largest(spark, sf_dir):
    return C.sizes(sparse_components(spark, sf_dir)).select("name", "size").orderBy(F.col("size").desc(), "name").limit(10)


@register("GR08_greedy_split")
def greedy_split(spark, sf_dir):
    parts = sparse_components(spark, sf_dir)
    return A.assigned(parts, C.sizes(parts))[0]


@register("GR06_solver_outcome")
def solver_outcome(spark, sf_dir):
    parts = sparse_components(spark, sf_dir)
    return A.outcome_row(spark, A.assigned(parts, C.sizes(parts))[1])


@register("AG02_split_counts")
def split_counts(spark, sf_dir):
    return A.split_counts(greedy_split(spark, sf_dir))


@register("AG04_audit", "SELECT unnest(['partition_complete', 'valid_labels', 'components_atomic', 'tile_id_disjoint', 'geo_disjoint', 'ratios_within_tolerance']) AS \"check\", true AS ok, CAST(0 AS BIGINT) AS n")
def audit(spark, sf_dir):
    matches = sparse_matches(spark, sf_dir)
    parts = sparse_components(spark, sf_dir, matches)
    splits = A.assigned(parts, C.sizes(parts))[0]
    return A.audit(sparse_points(spark, sf_dir), splits.select("point_id", "split"), matches, sparse_tiles(spark, sf_dir), parts)


@register("GR07_exact_split")
def exact_split(spark, sf_dir):
    """The best split where the driver can find it, else the greedy one."""
    parts = sparse_components(spark, sf_dir)
    splits, found = A.assigned(parts, C.sizes(parts), solver=exact_split_.best_or_greedy)
    return splits.withColumn("proven", F.lit(found.proven))


# a split by the parity of ids tears the overlapping pairs apart
_PLANTED = _SPARSE + """, s AS (SELECT point_id, CASE WHEN point_id % 2 = 0 THEN 'train' WHEN point_id % 4 = 1 THEN 'val' ELSE 'test' END AS split FROM p),
ts AS (SELECT DISTINCT tile_id, split FROM m JOIN s USING (point_id))"""


@register("JN10_cross_split_conflicts", _PLANTED + " SELECT o.a, o.b FROM o JOIN ts x ON o.a = x.tile_id JOIN ts y ON o.b = y.tile_id WHERE x.split <> y.split GROUP BY o.a, o.b")
def cross_split(spark, sf_dir):
    id_ = F.col("point_id")
    splits = sparse_points(spark, sf_dir).select("point_id", F.when(id_ % 2 == 0, "train").when(id_ % 4 == 1, "val").otherwise("test").alias("split"))
    of = sparse_matches(spark, sf_dir).join(splits, "point_id").select("tile_id", "split").distinct()
    pairs = C.overlapping(sparse_tiles(spark, sf_dir))
    left, right = (of.select(F.col("tile_id").alias(c), F.col("split").alias(f"s{c}")) for c in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").filter("sa <> sb").select("a", "b").distinct()


@register("AG04_planted_leaks", _PLANTED + """, lb AS (SELECT split FROM s WHERE point_id % 11 <> 0),
sq AS (SELECT count(*) FILTER (split = 'train') / count(*) AS a, count(*) FILTER (split = 'val') / count(*) AS b, count(*) FILTER (split = 'test') / count(*) AS d FROM lb),
tsl AS (SELECT DISTINCT tile_id, split FROM m JOIN s USING (point_id) WHERE point_id % 11 <> 0), shl AS (SELECT tile_id FROM tsl GROUP BY tile_id HAVING count(*) > 1),
crl AS (SELECT o.a, o.b FROM o JOIN tsl x ON o.a = x.tile_id JOIN tsl y ON o.b = y.tile_id WHERE x.split <> y.split GROUP BY o.a, o.b),
tnl AS (SELECT name FROM c LEFT JOIN (SELECT * FROM s WHERE point_id % 11 <> 0) u USING (point_id) GROUP BY name HAVING count(DISTINCT coalesce(split, '?')) > 1),
rr AS (SELECT 'partition_complete' AS "check", (SELECT count(*) FROM p WHERE point_id % 11 = 0) AS n UNION ALL SELECT 'valid_labels', 0 UNION ALL SELECT 'components_atomic', (SELECT count(*) FROM tnl) UNION ALL SELECT 'tile_id_disjoint', (SELECT count(*) FROM shl)
 UNION ALL SELECT 'geo_disjoint', (SELECT count(*) FROM crl) + (SELECT count(*) FROM shl) UNION ALL SELECT 'ratios_within_tolerance', (SELECT CASE WHEN abs(a - 0.7) <= 0.05 AND abs(b - 0.15) <= 0.05 AND abs(d - 0.15) <= 0.05 THEN 0 ELSE 1 END FROM sq))
SELECT "check", n = 0 AS ok, n FROM rr""")
def planted_leaks(spark, sf_dir):
    """The audit of a split by the parity of ids, of which some points have no label."""
    id_ = F.col("point_id")
    matches = sparse_matches(spark, sf_dir)
    splits = sparse_points(spark, sf_dir).filter(id_ % 11 != 0).select("point_id", F.when(id_ % 2 == 0, "train").when(id_ % 4 == 1, "val").otherwise("test").alias("split"))
    return A.audit(sparse_points(spark, sf_dir), splits, matches, sparse_tiles(spark, sf_dir), sparse_components(spark, sf_dir, matches))


@register("GR05_component_cities", _SPARSE + " SELECT name, min(city) AS city, count(DISTINCT city) > 1 AS spans FROM c JOIN p USING (point_id) GROUP BY name")
def component_cities(spark, sf_dir):
    rows = sparse_components(spark, sf_dir).join(sparse_points(spark, sf_dir).select("point_id", "city"), "point_id")
    return rows.groupBy("name").agg(F.min("city").alias("city"), (F.countDistinct("city") > 1).alias("spans"))


@register("GR09_per_city_split")
def per_city(spark, sf_dir):
    rows = sparse_components(spark, sf_dir).join(sparse_points(spark, sf_dir).select("point_id", "city"), "point_id")
    per = rows.groupBy("city", "component_id", "name").agg(F.count("*").alias("size"))
    return A.assigned_by(per, "city")


@register("AG06_per_city_counts", _SPARSE + " SELECT city, count(*) AS n FROM p GROUP BY ROLLUP (city)")
def per_city_counts(spark, sf_dir):
    return sparse_points(spark, sf_dir).rollup("city").agg(F.count("*").alias("n"))


@register("AG07_stride_stats", _SPARSE + """, d AS (SELECT a.tile_id, min(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) * cos(radians(a.lat))) AS d FROM t a JOIN t b ON a.tile_id <> b.tile_id GROUP BY a.tile_id)
SELECT round(quantile_cont(d, 0.5), 2) AS median, round(min(d), 2) AS least, round(quantile_cont(d, 0.9), 2) AS p90 FROM d""")
def stride_stats(spark, sf_dir):
    """Distances of all tiles to the nearest other one."""
    from meridia.operators.box_join import nearest

    tiles = sparse_tiles(spark, sf_dir)
    near = nearest(tiles.select("tile_id", "x", "y", "lat"), tiles.select("tile_id", "x", "y"), 1000.0, "tile_id", apart=True)
    near = near.select((F.sqrt("d2") * F.cos(F.radians("lat"))).alias("d"))
    return near.agg(F.round(F.percentile("d", F.lit(0.5)), 2).alias("median"), F.round(F.min("d"), 2).alias("least"), F.round(F.percentile("d", F.lit(0.9)), 2).alias("p90"))
