"""Queries of masks, mosaics, lattices, listings and resumed work."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meridia.operators import grid as G
from meridia.operators import raster as M
from meridia.operators import sync as Y
from meridia.registry import register
from meridia.sources.carriers import carrier, ctes

_R = ctes("runs") + ", px AS (SELECT annotation_id, image_id, category_id, unnest(generate_series(skip, least(skip + fill, 256) - 1)) AS p FROM runs WHERE skip < 256), d AS (SELECT annotation_id, image_id, category_id, p % 16 AS r, CAST(floor(p / 16e0) AS BIGINT) AS c FROM px)"


def run_pixels(spark, sf_dir):
    rows = carrier(spark, sf_dir, "runs")
    runs = rows.select("annotation_id", "image_id", "category_id", F.posexplode(F.array("skip", "fill")).alias("pos", "length"))
    return M.decode_runs(runs, ["annotation_id", "image_id", "category_id"], 16, 16)


@register("RA01_run_lengths", _R + " SELECT annotation_id, count(*) AS n, sum(r) AS rows, sum(c) AS cols FROM d GROUP BY annotation_id")
def run_lengths(spark, sf_dir):
    return run_pixels(spark, sf_dir).groupBy("annotation_id").agg(F.count("*").alias("n"), F.sum("r").alias("rows"), F.sum("c").alias("cols"))


@register("RA02_union_masks", _R + " SELECT image_id, category_id, count(*) AS pixels FROM (SELECT DISTINCT image_id, category_id, r, c FROM d) GROUP BY image_id, category_id")
def union_masks(spark, sf_dir):
    return run_pixels(spark, sf_dir).select("image_id", "category_id", "r", "c").distinct().groupBy("image_id", "category_id").agg(F.count("*").alias("pixels"))


@register("AG38_or_of_masks", _R + " SELECT image_id, r, c, bool_or(category_id = 1) AS one FROM d GROUP BY image_id, r, c")
def or_masks(spark, sf_dir):
    return run_pixels(spark, sf_dir).groupBy("image_id", "r", "c").agg(F.bool_or(F.col("category_id") == 1).alias("one"))


@register("RA04_boxes", ctes("runs") + """, b AS (SELECT annotation_id, skip % 17 + 0.5e0 AS x, fill % 13 - 2.5e0 AS y, 1 + fill % 6 AS w, 2 + skip % 7 AS h FROM runs),
e AS (SELECT annotation_id, greatest(0, least(16, CAST(round_even(y, 0) AS BIGINT))) AS r0, greatest(0, least(16, CAST(round_even(y + h, 0) AS BIGINT))) AS r1, greatest(0, least(16, CAST(round_even(x, 0) AS BIGINT))) AS c0, greatest(0, least(16, CAST(round_even(x + w, 0) AS BIGINT))) AS c1 FROM b)
SELECT annotation_id, (r1 - r0) * (c1 - c0) AS pixels FROM e WHERE r1 > r0 AND c1 > c0""")
def boxes(spark, sf_dir):
    rows = carrier(spark, sf_dir, "runs").select("annotation_id", (F.col("skip") % 17 + 0.5).alias("x"), (F.col("fill") % 13 - 2.5).alias("y"), (1 + F.col("fill") % 6).alias("w"), (2 + F.col("skip") % 7).alias("h"))
    return M.box_pixels(rows, ["annotation_id"], 16, 16).groupBy("annotation_id").agg(F.count("*").alias("pixels"))


@register("RA03_polygons", ctes("runs") + """, t AS (SELECT annotation_id, skip % 5 * 1e0 AS x0, fill % 4 * 1e0 AS y0, 8e0 + fill % 7 AS x1, 2e0 + skip % 3 AS y1, 4e0 + skip % 9 AS x2, 9e0 + fill % 6 AS y2 FROM runs),
g AS (SELECT annotation_id, r, c, (CASE WHEN (y0 <= r + 0.5e0) <> (y1 <= r + 0.5e0) AND x0 + (r + 0.5e0 - y0) * (x1 - x0) / (y1 - y0) <= c + 0.5e0 THEN 1 ELSE 0 END)
 + (CASE WHEN (y1 <= r + 0.5e0) <> (y2 <= r + 0.5e0) AND x1 + (r + 0.5e0 - y1) * (x2 - x1) / (y2 - y1) <= c + 0.5e0 THEN 1 ELSE 0 END)
 + (CASE WHEN (y2 <= r + 0.5e0) <> (y0 <= r + 0.5e0) AND x2 + (r + 0.5e0 - y2) * (x0 - x2) / (y0 - y2) <= c + 0.5e0 THEN 1 ELSE 0 END) AS n
 FROM t, (SELECT unnest(generate_series(0, 15)) AS r), (SELECT unnest(generate_series(0, 15)) AS c)) SELECT annotation_id, count(*) AS pixels FROM g WHERE n % 2 = 1 GROUP BY annotation_id""")
def polygons(spark, sf_dir):
    k = lambda c: F.col(c).cast("double")
    s, f = k("skip"), k("fill")
    rows = carrier(spark, sf_dir, "runs").select("annotation_id", F.array(F.struct((s % 5).alias("x"), (f % 4).alias("y")), F.struct((8 + f % 7).alias("x"), (2 + s % 3).alias("y")), F.struct((4 + s % 9).alias("x"), (9 + f % 6).alias("y"))).alias("ring"))
    edges = rows.select("annotation_id", F.posexplode("ring").alias("i", "a"), "ring").withColumn("b", F.get("ring", (F.col("i") + 1) % 3))
    edges = edges.select("annotation_id", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"))
    return M.polygon_pixels(edges, ["annotation_id"], 16, 16).groupBy("annotation_id").agg(F.count("*").alias("pixels"))


@register("RA06_mosaic", ctes("pixels") + ", m AS (SELECT r, c, layer, v, row_number() OVER (PARTITION BY r, c ORDER BY layer, v) AS n FROM pixels WHERE v <> 0) SELECT r, c, layer, v FROM m WHERE n = 1")
def mosaic(spark, sf_dir):
    return M.mosaic(carrier(spark, sf_dir, "pixels"))


@register("AG34_block_share", _R + ", f AS (SELECT image_id, r, c, bool_or(category_id = 1) AS on FROM d GROUP BY image_id, r, c) SELECT image_id, CASE WHEN r < 4 THEN 0 ELSE 1 + CAST(floor((r - 4) / 3e0) AS BIGINT) END AS br, CASE WHEN c < 4 THEN 0 ELSE 1 + CAST(floor((c - 4) / 3e0) AS BIGINT) END AS bc, round(avg(CAST(\"on\" AS INT)), 6) AS share FROM f GROUP BY 1, 2, 3")
def block_share(spark, sf_dir):
    pixels = or_masks(spark, sf_dir)
    return M.block_share(pixels, ["image_id"], F.col("one").cast("int"), 16, 16, 5).withColumn("share", F.round("share", 6))


@register("RA08_masker_cascade", "SELECT o_orderkey AS frame, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey WHEN o_orderkey % 3 = 0 THEN -o_custkey ELSE 0 END AS mask, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 0 WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS backend FROM orders")
def cascade(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("frame"), "o_custkey")
    of = lambda when, value: rows.filter(when).select("frame", value.cast("long").alias("mask"))
    return M.resolved(rows, [of("frame % 2 = 0", F.col("o_custkey")), of("frame % 3 = 0", -F.col("o_custkey")), of("true", F.lit(0))], "frame", "mask")


@register("AG35_backend_counts", "SELECT CAST(CASE WHEN o_orderkey % 2 = 0 THEN 0 WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS backend, count(*) AS n FROM orders GROUP BY 1")
def backend_counts(spark, sf_dir):
    return cascade(spark, sf_dir).groupBy("backend").agg(F.count("*").alias("n"))


@register("SK06_manifest_upsert", "WITH a AS (SELECT o_orderkey % 300 AS frame, o_orderkey AS version FROM orders) SELECT frame, max(version) AS version FROM a GROUP BY frame")
def upsert(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") % 300).alias("frame"), F.col("o_orderkey").alias("version"))
    return M.latest(rows.filter("version % 2 = 0"), rows.filter("version % 2 = 1"), "frame", "version")


@register("RA10_nodata_at_point", ctes("pixels") + ", p AS (SELECT DISTINCT o_orderkey % 64 AS r, o_custkey % 64 AS c FROM orders), v AS (SELECT r, c, max(v) AS v FROM pixels GROUP BY r, c) SELECT p.r, p.c, coalesce(v.v, 0) = 0 AS nodata FROM p LEFT JOIN v ON p.r = v.r AND p.c = v.c")
def nodata(spark, sf_dir):
    ask = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") % 64).alias("r"), (F.col("o_custkey") % 64).alias("c")).distinct()
    value = carrier(spark, sf_dir, "pixels").groupBy("r", "c").agg(F.max("v").alias("v"))
    return ask.join(value, ["r", "c"], "left").select("r", "c", (F.coalesce("v", F.lit(0)) == 0).alias("nodata"))


@register("JN30_annotations", ctes("runs") + ", i AS (SELECT DISTINCT image_id FROM runs WHERE image_id % 7 <> 0), k AS (SELECT DISTINCT category_id, 'class ' || category_id AS name FROM runs WHERE category_id > 0) SELECT annotation_id, coalesce(k.name, 'cat' || runs.category_id) AS class FROM runs JOIN i USING (image_id) LEFT JOIN k USING (category_id)")
def annotations(spark, sf_dir):
    rows = carrier(spark, sf_dir, "runs")
    images = rows.filter("image_id % 7 <> 0").select("image_id").distinct()
    names = rows.filter("category_id > 0").select("category_id", F.concat(F.lit("class "), "category_id").alias("name")).distinct()
    return rows.join(images, "image_id", "left_semi").join(names, "category_id", "left").select("annotation_id", F.coalesce("name", F.concat(F.lit("cat"), "category_id")).alias("class"))


@register("JN26_way_points", """WITH nodes AS (SELECT p_partkey AS node, p_size * 1e0 AS x, p_partkey % 37 * 1e0 AS y FROM part WHERE p_partkey % 10 <> 3), refs AS (SELECT l_orderkey AS way, l_linenumber AS pos, l_partkey AS node FROM lineitem)
SELECT way, count(*) AS n, list(x ORDER BY pos, node) AS xs FROM refs JOIN nodes USING (node) GROUP BY way HAVING count(*) >= 2""")
def way_points(spark, sf_dir):
    """Ways as their nodes' places in order; missing nodes are dropped, ways of less than two nodes too."""
    nodes = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("double").alias("x"))
    refs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("way"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("node"))
    ways = refs.join(nodes, "node").groupBy("way").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "node", "x"))).alias("p"))
    return ways.filter("n >= 2").select("way", "n", F.transform("p", lambda e: e["x"]).alias("xs"))


@register("JN23_screenshot_pairs", ctes("names") + """, s AS (SELECT folder, regexp_extract(stem, '^(\\d+)', 1) AS n, max(stem) AS shot FROM names WHERE regexp_matches(stem, '^\\d+_[-\\d.]+,[-\\d.]+$') GROUP BY 1, 2), p AS (SELECT folder, stem AS n, stem AS plain FROM names WHERE regexp_matches(stem, '^\\d+$'))
SELECT folder, n, plain, shot, CASE WHEN shot IS NULL THEN 'unpaired' ELSE 'paired' END AS status FROM p LEFT JOIN s USING (folder, n)""")
def screenshot_pairs(spark, sf_dir):
    return Y.paired(carrier(spark, sf_dir, "names"))


_O = ctes("objects") + ", t AS (SELECT event_id AS ord, split_part(object_key, '/', 2) || '_' || event_id % 400 AS dst, size FROM objects), h AS (SELECT dst, max(size) AS size FROM t WHERE ord % 3 = 0 GROUP BY dst), n AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY ord) AS n FROM t), s AS (SELECT ord, n.dst, CASE WHEN n > 1 THEN 'conflict' WHEN h.size = n.size THEN 'skip' ELSE 'transfer' END AS status FROM n LEFT JOIN h ON n.dst = h.dst)"


def sync_plan_rows(spark, sf_dir):
    rows = carrier(spark, sf_dir, "objects").select(F.col("event_id").alias("ord"), F.concat(F.split_part("object_key", F.lit("/"), F.lit(2)), F.lit("_"), F.col("event_id") % 400).alias("dst"), "size")
    return Y.planned(rows, rows.filter("ord % 3 = 0").groupBy("dst").agg(F.max("size").alias("size")))


@register("JN24_sync_plan", _O + " SELECT ord, dst, status FROM s")
def sync_plan(spark, sf_dir):
    return sync_plan_rows(spark, sf_dir).select("ord", "dst", "status")


@register("SY06_sync_stats", _O + " SELECT status, count(*) AS n FROM s GROUP BY status")
def sync_stats(spark, sf_dir):
    return sync_plan_rows(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@register("JN25_skip_existing", ctes("objects") + " SELECT event_id FROM objects WHERE NOT done")
def skip_existing(spark, sf_dir):
    rows = carrier(spark, sf_dir, "objects")
    return Y.remaining(rows.select("event_id", "size"), rows.filter("done").select("event_id", "size"), ["event_id", "size"]).select("event_id")


@register("SY01_resumed_jobs", ctes("tiles") + " SELECT count(*) AS done FROM tiles")
def resumed(spark, sf_dir):
    """A run that stops after half of its batches, and one that goes on from its table."""
    from meridia.sources.scratch import folder

    jobs, path = carrier(spark, sf_dir, "tiles").select("tile_id", "city"), folder(spark)
    Y.run_batches(jobs.filter("tile_id % 2 = 0"), path, ["tile_id"], lambda df: df, 2)
    return spark.createDataFrame([(Y.run_batches(jobs, path, ["tile_id"], lambda df: df, 4),)], "done long")


@register("SC19_listing_filter", ctes("objects") + " SELECT event_id FROM objects WHERE split_part(object_key, '/', 1) NOT IN ('click', 'error') AND split_part(object_key, '/', 2) <> '7'")
def listing_filter(spark, sf_dir):
    """Keys none of whose folders is excluded."""
    folders = F.slice(F.split("object_key", "/"), 1, 2)
    return carrier(spark, sf_dir, "objects").filter(~F.arrays_overlap(folders, F.array(*map(F.lit, ("click", "error", "7"))))).select("event_id")


@register("JN29_two_keys", ctes("names") + """, m AS (SELECT stem, id AS mask FROM names WHERE id % 6 = 4 AND id % 5 = 0), b AS (SELECT regexp_replace(stem, '^\\d+_', '') AS stem, max(id) AS mask FROM names WHERE id % 6 = 4 AND id % 5 = 1 GROUP BY 1)
SELECT id, coalesce(m.mask, b.mask) AS mask FROM names LEFT JOIN m ON names.stem = m.stem LEFT JOIN b ON regexp_replace(names.stem, '^\\d+_', '') = b.stem WHERE id % 6 = 4""")
def two_keys(spark, sf_dir):
    """A mask by the whole name, else by the name without its leading number."""
    rows = carrier(spark, sf_dir, "names").filter("id % 6 = 4").withColumn("bare", F.regexp_replace("stem", r"^\d+_", ""))
    whole = rows.filter("id % 5 = 0").select("stem", F.col("id").alias("a"))
    bare = rows.filter("id % 5 = 1").groupBy("bare").agg(F.max("id").alias("b"))
    return rows.join(whole, "stem", "left").join(bare, "bare", "left").select("id", F.coalesce("a", "b").alias("mask"))


@register("GN01_grid_centers", "SELECT i AS iy, j AS ix, 100e0 + j * 200e0 AS x, 100e0 + i * 200e0 AS y FROM (SELECT unnest(generate_series(0, 4)) AS i), (SELECT unnest(generate_series(0, 4)) AS j)")
def grid_centers(spark, sf_dir):
    return G.grid_centers(spark, 0.0, 1000.0, 0.0, 1000.0, 200.0, 200.0)


@register("GN02_grid_in_area", "WITH g AS (SELECT i AS iy, j AS ix, 100e0 + j * 100e0 AS x, 100e0 + i * 100e0 AS y FROM (SELECT unnest(generate_series(0, 8)) AS i), (SELECT unnest(generate_series(0, 8)) AS j)) SELECT iy, ix FROM g WHERE greatest(0e0, least(x + 100, 650e0) - greatest(x - 100, 210e0)) * greatest(0e0, least(y + 100, 720e0) - greatest(y - 100, 90e0)) / 40000e0 >= 0.3e0")
def grid_in_area(spark, sf_dir):
    from meridia.functions.geo import rect_intersection

    cells = G.grid_centers(spark, 0.0, 1000.0, 0.0, 1000.0, 200.0, 100.0)
    box = [F.col("x") - 100, F.col("y") - 100, F.col("x") + 100, F.col("y") + 100]
    area = [F.lit(v) for v in (210.0, 90.0, 650.0, 720.0)]
    return cells.filter(rect_intersection(box, area) / 40000.0 >= 0.3).select("iy", "ix")


_CELLS = ctes("tiles") + ", k AS (SELECT tile_id % 20 AS query, tile_id AS rank, tile_id % 45 * 250e0 AS x, CAST(floor(tile_id / 45e0) AS BIGINT) * 250e0 AS y FROM tiles)"


def _cells(spark, sf_dir):
    t = F.col("tile_id")
    return carrier(spark, sf_dir, "tiles").select((t % 20).alias("query"), t.alias("rank"), (t % 45 * 250.0).alias("x"), (F.floor(t / 45) * 250.0).alias("y"))


@register("GN04_needed_windows", _CELLS + """, u AS (SELECT query, round_even(x / 250, 0) * 250 AS x, round_even(y / 250, 0) * 250 AS y, min(rank) AS rank FROM k GROUP BY 1, 2, 3), w AS (SELECT query, rank, round_even((x + i * 250) / 250, 0) * 250 AS wx, round_even((y + j * 250) / 250, 0) * 250 AS wy FROM u, (SELECT unnest(generate_series(-2, 2)) AS i), (SELECT unnest(generate_series(-2, 2)) AS j))
SELECT query, wx, wy, min(rank) AS first FROM w GROUP BY query, wx, wy""")
def needed_windows(spark, sf_dir):
    return G.needed(_cells(spark, sf_dir), 500.0, 250.0)


@register("GN03_cell_windows", _CELLS + " SELECT rank, round_even((x + i * 250) / 250, 0) * 250 AS wx, round_even((y + j * 250) / 250, 0) * 250 AS wy FROM k, (SELECT unnest(generate_series(-2, 2)) AS i), (SELECT unnest(generate_series(-2, 2)) AS j)")
def cell_windows(spark, sf_dir):
    return G.windows(_cells(spark, sf_dir), 500.0, 250.0).select("rank", "wx", "wy")


@register("GN05_pyramid_levels", ctes("tiles") + " SELECT tile_id, CAST(l AS INTEGER) AS level, 1000e0 - l * 250e0 AS window_m, l * 125e0 AS margin_m FROM tiles, (SELECT unnest([0, 1, 2, 3]) AS l)")
def pyramid(spark, sf_dir):
    return G.pyramid(carrier(spark, sf_dir, "tiles").select("tile_id"), 4, 1000.0, 250.0)


@register("GN09_microbatches", "SELECT CAST(b AS BIGINT) AS begin, CAST(least(b + 7, 40) AS BIGINT) AS stop FROM (SELECT unnest(generate_series(0, 39, 7)) AS b)")
def microbatches(spark, sf_dir):
    return G.microbatches(spark, 40, 7).select("begin", F.col("stop").cast("long").alias("stop"))


@register("GN11_area_of_frames", ctes("points") + " SELECT city, round(min(lat) - 0.01e0, 7) AS south, round(max(lat) + 0.01e0, 7) AS north, round(min(lon) - 0.01e0, 7) AS west, round(max(lon) + 0.01e0, 7) AS east FROM points GROUP BY city")
def area_of_frames(spark, sf_dir):
    edge = lambda f, c, d, n: F.round(f(c) + d, 7).alias(n)
    return carrier(spark, sf_dir, "points").groupBy("city").agg(edge(F.min, "lat", -0.01, "south"), edge(F.max, "lat", 0.01, "north"), edge(F.min, "lon", -0.01, "west"), edge(F.max, "lon", 0.01, "east"))


@register("PJ20_geometric_scales", "SELECT unnest([100.0, 150.0, 225.0, 337.5, 500.0])::DOUBLE AS scale")
def scales(spark, sf_dir):
    return spark.createDataFrame([(s,) for s in G.geometric_scales(100.0, 500.0, 1.5)], "scale double")


@register("SO02_polar_order", "WITH p AS (SELECT o_orderkey % 200 AS g, o_orderkey AS id, o_custkey % 97 * 1e0 AS x, o_custkey % 89 * 1e0 AS y FROM orders), c AS (SELECT *, avg(x) OVER (PARTITION BY g) AS mx, avg(y) OVER (PARTITION BY g) AS my FROM p) SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY round(atan2(y - my, x - mx), 9), id) AS place FROM c")
def polar(spark, sf_dir):
    of = lambda c, m: F.col(c) % m * 1.0
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") % 200).alias("g"), F.col("o_orderkey").alias("id"), of("o_custkey", 97).alias("x"), of("o_custkey", 89).alias("y"))
    group = Window.partitionBy("g")
    rows = rows.withColumn("a", F.round(F.atan2(F.col("y") - F.avg("y").over(group), F.col("x") - F.avg("x").over(group)), 9))
    return rows.select("g", "id", F.row_number().over(group.orderBy("a", "id")).alias("place"))


@register("SO07_set_difference", ctes("objects") + " SELECT size FROM objects WHERE NOT done EXCEPT SELECT size FROM objects WHERE done")
def difference(spark, sf_dir):
    rows = carrier(spark, sf_dir, "objects")
    return rows.filter("NOT done").select("size").subtract(rows.filter("done").select("size"))


@register("SO08_intersection", ctes("objects") + " SELECT size FROM objects WHERE NOT done INTERSECT SELECT size FROM objects WHERE done")
def intersection(spark, sf_dir):
    rows = carrier(spark, sf_dir, "objects")
    return rows.filter("NOT done").select("size").intersect(rows.filter("done").select("size"))
