"""Queries of runs: readers of files, stores, augmentation, reports, progress and sinks, each by a round trip."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from meridia.functions import geo
from meridia.operators import augment, extract, osm, raster, report, store, tiling
from meridia.operators import positives as P
from meridia.operators import rank as K
from meridia.operators import strategies as S
from meridia.plans.q_geometry import POSITIONED, points, tiles
from meridia.plans.q_learn import _C, all_tokens, dictionary
from meridia.plans.q_raster import _R, run_pixels
from meridia.plans.q_rank import _F, _LEVELS, _T, level_matrix, level_scores, token_scores
from meridia.registry import oracles, register
from meridia.sources import readers, sinks, tile_source
from meridia.sources.carriers import carrier, ctes
from meridia.sources.scratch import folder
from meridia.streaming import progress


def _text(spark, value) -> str:
    """A folder with one text file."""
    path = folder(spark)
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.text(path)
    return path


@register("SC12_coco_file", "SELECT n_nationkey AS annotation_id, 'image' || n_regionkey AS file_name, coalesce(CASE WHEN n_nationkey % 4 > 0 THEN 'class' || n_nationkey % 4 END, 'cat' || n_nationkey % 4) AS class, n_nationkey * 1e0 AS x FROM nation WHERE n_regionkey <> 3")
def coco_file(spark, sf_dir):
    """Annotations with their images and classes, from a COCO file: one without a class is named by its number, one without an
    image is left out."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()  # 25 rows
    images = [{"id": r, "file_name": f"image{r}", "width": 16, "height": 16} for r in range(5) if r != 3]
    marks = [{"id": n.n_nationkey, "image_id": n.n_regionkey, "category_id": n.n_nationkey % 4, "bbox": [float(n.n_nationkey), 0.0, 2.0, 2.0]} for n in rows]
    path = _text(spark, json.dumps({"images": images, "annotations": marks, "categories": [{"id": k, "name": f"class{k}"} for k in (1, 2, 3)]}))
    image, mark, kind = readers.coco(spark, path)
    joined = mark.join(image.select(F.col("id").alias("image_id"), "file_name"), "image_id").join(kind.select(F.col("id").alias("category_id"), "name"), "category_id", "left")
    return joined.select(F.col("id").alias("annotation_id"), "file_name", F.coalesce("name", F.concat(F.lit("cat"), F.col("category_id").cast("string"))).alias("class"), F.get("bbox", F.lit(0)).alias("x"))


@register("SC13_map_file", "WITH w AS (SELECT n_regionkey AS way, n_nationkey AS node, n_nationkey * 0.5e0 AS lat FROM nation WHERE n_nationkey % 7 <> 0) SELECT way, CASE WHEN way < 2 THEN 'primary' WHEN way = 2 THEN 'waterway' WHEN way = 3 THEN 'natural_water' END AS class, list(lat ORDER BY node) AS lats FROM w GROUP BY way HAVING count(*) >= 2")
def map_file(spark, sf_dir):
    """Ways of a map server's answer with their class and points in order; missing nodes are dropped."""
    rows = sorted(spark.read.parquet(f"{sf_dir}/nation.parquet").collect())  # 25 rows
    tags = [{"highway": "primary"}, {"highway": "primary", "waterway": "river"}, {"waterway": "river", "highway": "footway"}, {"natural": "water"}, {"building": "yes"}]
    nodes = [{"type": "node", "id": n.n_nationkey, "lat": n.n_nationkey * 0.5, "lon": 0.0} for n in rows if n.n_nationkey % 7]
    ways = [{"type": "way", "id": k, "nodes": [n.n_nationkey for n in rows if n.n_regionkey == k], "tags": tags[k]} for k in range(5)]
    at, refs = readers.osm(spark, _text(spark, json.dumps({"elements": nodes + ways})))
    joined = refs.join(at.select(F.col("id").alias("node"), "lat"), "node").groupBy("way").agg(F.first("tags").alias("tags"), F.array_sort(F.collect_list(F.struct("pos", "lat"))).alias("p"))
    return joined.filter(F.size("p") >= 2).select("way", osm.way_class(F.col("tags")).alias("class"), F.transform("p", lambda p: p["lat"]).alias("lats"))


@register("SC20_area_file", "SELECT * FROM (VALUES (0, 30e0, 48e0), (1, 32e0, 48e0), (2, 32e0, 50e0), (3, 31e0, 51e0)) AS v(pos, lon, lat)")
def area_file(spark, sf_dir):
    """The vertices of a KMZ file's polygon, by the name of its placemark."""
    import io
    import zipfile

    ring = lambda p: "<Polygon><outerBoundaryIs><LinearRing><coordinates>" + " ".join(f"{x},{y},0" for x, y in p) + "</coordinates></LinearRing></outerBoundaryIs></Polygon>"
    mark = lambda n, p: f"<Placemark><name>{n}</name>{ring(p)}</Placemark>"
    kml = "<kml><Document>" + mark("other", [(0, 0), (1, 0), (1, 1), (0, 0)]) + mark("Area of flight", [(30, 48), (32, 48), (32, 50), (31, 51), (30, 48)]) + "</Document></kml>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as out:
        out.writestr("doc.kml", kml)
    path = folder(spark)
    fs, at = progress._files(spark, f"{path}/area.kmz")
    file = fs.create(at(f"{path}/area.kmz"), True)
    file.write(buffer.getvalue())
    file.close()
    return readers.kmz_rings(spark, path, "area").select(F.posexplode("ring").alias("pos", "p")).select("pos", "p.lon", "p.lat")


_U = "(('0x' || substr(md5(concat_ws('|', '7', frame_id, '{}')), 1, 13))::BIGINT / 4503599627370496e0)"


@register("VE18_augmentation", ctes("scores") + ", f AS (SELECT DISTINCT frame_id FROM scores) SELECT frame_id, CASE WHEN " + _U.format("do scale") + " < 0.5e0 THEN round(exp(ln(0.7e0) + (ln(1.4e0) - ln(0.7e0)) * " + _U.format("scale") + "), 9) END AS scale, CASE WHEN " + _U.format("do shift") + " < 0.5e0 THEN (floor(" + _U.format("dx") + " * 129) - 64)::INT END AS dx, " + _U.format("do perspective") + " < 0.3e0 AND " + _U.format("do scale") + " >= 0.5e0 AS bent, CASE WHEN " + _U.format("do rotation") + " < 0.5e0 THEN round(-180e0 + 360e0 * " + _U.format("rotation") + ", 6) END AS angle, CASE WHEN " + _U.format("do jpeg") + " < 0.3e0 THEN (40 + floor(" + _U.format("jpeg") + " * 56))::INT END AS jpeg FROM f")
def augmentation(spark, sf_dir):
    frames = level_scores(spark, sf_dir).select("frame_id").distinct()
    out = augment.parameters(frames, "frame_id", 640, 480, seed=7)
    return out.select("frame_id", F.round("scale", 9).alias("scale"), "dx", F.col("corners").isNotNull().alias("bent"), F.round("angle", 6).alias("angle"), "jpeg")


@register("SK17_hypothesis_report", _LEVELS + """, w AS (SELECT variant, avg(CAST(rank <= 10 AS INT)) AS r10, quantile_cont(rank, 0.5) AS med FROM f GROUP BY variant), m AS (SELECT max(r10) FILTER (variant = 'learned') AS lr, max(r10) FILTER (variant = 'mean') AS mn, max(r10) FILTER (variant = 'max') AS mx FROM w)
SELECT place, hypothesis, status FROM (SELECT 1 AS place, 'train queries rank high over the full gallery' AS hypothesis, CASE WHEN lr >= 0.5 THEN 'Supported' ELSE 'Refuted' END AS status FROM m
UNION ALL SELECT 3, 'memorisation or a shift between splits', CASE WHEN lr >= 0.5 AND mx < 0.1 THEN 'Supported' ELSE 'Insufficient' END FROM m
UNION ALL SELECT 4, 'an error of evaluation, cache, labels or checkpoint', 'Insufficient' FROM m
UNION ALL SELECT 7, 'learned weights rank worse than the mean or the best level', CASE WHEN mn > lr OR mx > lr THEN 'Supported' ELSE 'Refuted' END FROM m)""")
def hypothesis_report(spark, sf_dir):
    """What the ablations' figures say; those that weren't measured say nothing."""
    rows = K.ablations(level_matrix(spark, sf_dir))
    of = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    figures = rows.agg(of("learned", "r10").alias("train_r10"), of("max", "r10").alias("val_r10"), of("learned", "median_rank").alias("train_median"), of("learned", "r10").alias("learned_r10"), of("mean", "r10").alias("mean_r10"), of("max", "r10").alias("max_r10"))
    return report.hypotheses(figures).select("place", "hypothesis", "status")


_DENSE = POSITIONED + """, n AS (SELECT point_id, x, y, tile_id FROM (SELECT point_id, p.x, p.y, tile_id, sqrt(power(p.x - t.x, 2) + power(p.y - t.y, 2)) * cos(radians(p.lat)) AS d, row_number() OVER (PARTITION BY point_id ORDER BY sqrt(power(p.x - t.x, 2) + power(p.y - t.y, 2)) * cos(radians(p.lat)), tile_id) AS k FROM p, t) WHERE k = 1 AND d <= 140e0),
u AS (SELECT DISTINCT round(x * 100)::BIGINT AS px, round(y * 100)::BIGINT AS py FROM p), v AS (SELECT round(x * 100)::BIGINT AS px, round(y * 100)::BIGINT AS py, min(tile_id) AS tile_id FROM n GROUP BY 1, 2), h AS (SELECT vec_id // 25 AS tile_id, count(*) AS tokens FROM embeddings GROUP BY 1)"""


@register("SK08_hybrid_store", _DENSE + """, w AS (SELECT px, py, level, side FROM u, (VALUES (200, 1), (600, 3), (1000, 5)) AS l(level, side)),
d AS (SELECT w.px, w.py, level, (SELECT count(*) FROM embeddings WHERE vec_id // 25 = v.tile_id AND (vec_id % 25) // 5 BETWEEN (5 - side) // 2 AND (5 - side) // 2 + side - 1 AND vec_id % 5 BETWEEN (5 - side) // 2 AND (5 - side) // 2 + side - 1) AS n FROM w JOIN v USING (px, py))
SELECT level, count(*) FILTER (n > 0) AS dense, coalesce(sum(n), 0)::BIGINT AS tokens, (SELECT count(*) FROM u) - count(*) FILTER (n > 0) AS fresh FROM d GROUP BY level""")
def hybrid_store(spark, sf_dir):
    """A store written by level and read again: crops that a dense tile within 140 m gives, and one made token for the others."""
    tokens = carrier(spark, sf_dir, "tokens")
    crops = store.wanted(points(spark, sf_dir), [200, 600, 1000])
    made = lambda rows: rows.select("px", "py", "level", F.lit(-1).alias("r"), F.lit(-1).alias("c"), F.array(F.lit(0.0).cast("float")).alias("vec"))
    path = folder(spark)
    store.write_store(store.crops_of("hybrid", crops, tiles(spark, sf_dir), tokens, made, 5, 1000.0), path)
    back = spark.read.parquet(path)
    per = back.groupBy("px", "py", "level").agg(F.count(F.when(F.col("r") >= 0, 1)).alias("n"))
    return per.groupBy(F.col("level").cast("int").alias("level")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("dense"), F.sum("n").alias("tokens"), F.count(F.when(F.col("n") == 0, 1)).alias("fresh"))


@register("SK11_mask_files", _R + ", a AS (SELECT DISTINCT image_id, category_id, r, c FROM d WHERE category_id <> 2) SELECT category_id, count(*) AS pixels, (SELECT count(DISTINCT image_id) FROM runs WHERE image_id NOT IN (SELECT image_id FROM a)) AS empty FROM a GROUP BY category_id")
def mask_files(spark, sf_dir):
    """Masks of each image and class, written by class and read again, with the images that have none."""
    pixels = run_pixels(spark, sf_dir).filter("category_id <> 2").select("image_id", "category_id", "r", "c").distinct()
    path = folder(spark)
    sinks.write_pixels(pixels, carrier(spark, sf_dir, "runs"), path, "category_id")
    empty = spark.read.parquet(f"{path}/empty").count()
    return spark.read.parquet(f"{path}/pixels").groupBy(F.col("category_id").cast("long").alias("category_id")).agg(F.count("*").alias("pixels")).withColumn("empty", F.lit(empty).cast("long"))


@register("SK12_mosaic_files", ctes("pixels") + " SELECT layer, count(*) AS pixels, sum(v)::BIGINT AS total FROM (SELECT r, c, layer, v, row_number() OVER (PARTITION BY r, c ORDER BY layer, v) AS n FROM pixels WHERE v <> 0) WHERE n = 1 GROUP BY layer")
def mosaic_files(spark, sf_dir):
    """A mosaic of the first layer that has data, written by layer and read again."""
    found = raster.mosaic(carrier(spark, sf_dir, "pixels")).withColumn("image_id", F.lit(0))
    path = folder(spark)
    sinks.write_pixels(found, found, path, "layer")
    return spark.read.parquet(f"{path}/pixels").groupBy(F.col("layer").cast("long").alias("layer")).agg(F.count("*").alias("pixels"), F.sum("v").alias("total"))


@register("SY03_saved_state", "SELECT 3 AS step, 3::BIGINT AS saved")
def saved_state(spark, sf_dir):
    """A state that is saved three times, and then its file is broken by half a write: the one before it is read."""
    path = f"{folder(spark)}/state.json"
    for step in (1, 2, 3, 4):
        progress.save_state(spark, path, {"step": step, "done": list(range(step))})
    fs, at = progress._files(spark, path)
    out = fs.create(at(path), True)
    out.write(b'{"step": 4, "do')
    out.close()
    state = progress.load_state(spark, path)
    return spark.createDataFrame([(state["step"], len(state["done"]))], "step int, saved long")


@register("SY08_counters", ctes("objects") + " SELECT count(*) AS rows, count(*) FILTER (done) AS done, count(*) FILTER (size = 0) AS empty FROM objects")
def counters(spark, sf_dir):
    """Counters that a pass over the rows fills beside its own work."""
    rows, seen = progress.counted(carrier(spark, sf_dir, "objects"), "objects", done=F.col("done"), empty=F.col("size") == 0)
    rows.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(got["rows"], got["done"], got["empty"])], "rows long, done long, empty long")


@register("UD04_soft_aggregation", _C + """, z AS (SELECT tile_id, r, c, k, list_dot_product(vec::DOUBLE[], centre::DOUBLE[]) / 0.2e0 AS z FROM tk, ce), y AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY tile_id, r, c) AS p FROM z),
u AS (SELECT tk.tile_id, y.k, unnest(generate_series(0, 63)) AS i, y.p, unnest(tk.vec)::DOUBLE - unnest(ce.centre)::DOUBLE AS v FROM tk JOIN y USING (tile_id, r, c) JOIN ce ON ce.k = y.k), s AS (SELECT tile_id, k, i, sum(p * v) AS x FROM u GROUP BY ALL)
SELECT tile_id, k, i, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY tile_id)), 1e-12), 5) AS x FROM s""")
def soft_aggregation(spark, sf_dir):
    """The aggregation that is registered as `residual`."""
    rows = S.AGGREGATIONS["residual"](all_tokens(spark, sf_dir), dictionary(spark, sf_dir), ["tile_id"])
    return rows.select("tile_id", "k", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x"))


@register("UD03_cascade_weights", _F + """, g AS (SELECT frame_id, level, max(score) FILTER (method = 'global') AS g, max(score) FILTER (method = 'patch') AS s FROM scores GROUP BY frame_id, level), n AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY g DESC, level) AS n FROM g),
e AS (SELECT *, CASE WHEN n <= 3 THEN exp(s / 0.1e0) ELSE 0e0 END AS e FROM n) SELECT frame_id, level, round(e / sum(e) OVER (PARTITION BY frame_id), 6) AS weight FROM e""")
def cascade_weights(spark, sf_dir):
    return S.FUSIONS["cascade"](level_scores(spark, sf_dir)).select("frame_id", "level", F.round("weight", 6).alias("weight"))


_RULES = {"current_rule": "JN02_current_rule", "contains_point": "JN03_contains_point", "nearest_tile": "JN04_nearest_tile", "overlap_weighted": "JN05_overlap_weighted"}


@register("UD01_rules", " UNION ALL ".join(f"SELECT '{rule}' AS rule, (SELECT count(*) FROM ({oracles()[name]})) AS links" for rule, name in _RULES.items()))
def rules(spark, sf_dir):
    """How many links each registered rule makes, called by its name."""
    ask, all_ = points(spark, sf_dir), tiles(spark, sf_dir)
    out = None
    for rule in _RULES:
        n = P.select(rule, ask, all_, P.params()).agg(F.count("*").alias("links")).select(F.lit(rule).alias("rule"), "links")
        out = n if out is None else out.unionByName(n)
    return out


@register("UD02_estimators", _T + """, f AS (SELECT *, row_number() OVER (PARTITION BY u, w, q ORDER BY s DESC, t) AS x, row_number() OVER (PARTITION BY u, w, t ORDER BY s DESC, q) AS y FROM a), g AS (SELECT w, avg(s) FILTER (x = 1) / 1e6 AS chamfer, count(*) FILTER (x = 1 AND y = 1) / 25e0 AS mutual_share FROM f WHERE u = 0 GROUP BY w)
SELECT name, w AS level, round(score, 6) AS score FROM (UNPIVOT g ON chamfer, mutual_share INTO NAME name VALUE score)""")
def estimators(spark, sf_dir):
    """The scores of each registered estimator for one frame, called by its name."""
    pairs = token_scores(spark, sf_dir).filter("u = 0").select(F.col("u").alias("frame_id"), F.col("w").alias("level"), "q", "t", (F.col("s") / 1e6).alias("s"))
    out = None
    for name in ("chamfer", "mutual_share"):
        rows = S.ESTIMATORS[name](pairs, 25, 25).select(F.lit(name).alias("name"), "level", F.round("score", 6).alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("UD05_maskers", ctes("tiles") + " SELECT tile_id AS frame_id, CASE WHEN tile_id % 3 = 0 THEN 'stored' WHEN tile_id % 3 = 1 THEN 'blocks' ELSE 'everything' END AS backend, CASE WHEN tile_id % 3 = 0 THEN 1 WHEN tile_id % 3 = 1 THEN 1 + CAST(tile_id % 2 = 0 AS INT) ELSE 4 END AS kept FROM tiles")
def maskers(spark, sf_dir):
    """Frames with a stored mask, with shares of sky, or with neither, through the registered maskers in order."""
    k = F.col("tile_id") % 3
    frames = carrier(spark, sf_dir, "tiles").select(
        F.col("tile_id").alias("frame_id"),
        F.when(k == 0, F.array(F.lit(True), F.lit(False))).alias("mask"),
        F.when(k == 1, F.array(F.lit(0.1), F.when(F.col("tile_id") % 2 == 0, 0.2).otherwise(0.3))).alias("sky_share"),
        F.lit(4).alias("n"),
    )
    found = S.masked(frames, ["stored", "blocks", "everything"])
    value = next(c for c in found.columns if c not in ("frame_id", "backend"))
    return found.select("frame_id", "backend", F.size(F.filter(value, lambda x: x)).alias("kept"))


_H, _STEP = "20037508.342789244e0", "1222.992452562822e0"  # half of the world, and a tile's side at zoom 15


@register("GN06_metre_jobs", POSITIONED + f""", b AS (SELECT city, floor((min(x) + {_H}) / {_STEP}) * {_STEP} - {_H} AS x0, floor((min(y) + {_H}) / {_STEP}) * {_STEP} - {_H} AS y0, ceil((max(x) + {_H}) / {_STEP}) * {_STEP} - {_H} AS x1, ceil((max(y) + {_H}) / {_STEP}) * {_STEP} - {_H} AS y1 FROM p GROUP BY city),
n AS (SELECT *, round_even((x1 - x0) / {_STEP}, 0)::INT AS cols, round_even((y1 - y0) / {_STEP}, 0)::INT AS rows FROM b)
SELECT city, c::INT AS col, r::INT AS row, round(x0 + c * {_STEP}, 2) AS x0, round(y1 - r * {_STEP}, 2) AS y1, (c * 256)::INT AS col_off, (r * 256)::INT AS row_off FROM n JOIN range(0, 2000) a(c) ON c < cols JOIN range(0, 2000) z(r) ON r < rows""")
def metre_jobs(spark, sf_dir):
    found = tiling.metre_jobs(points(spark, sf_dir), ["city"], 15)
    return found.select("city", "col", "row", F.round("x0", 2).alias("x0"), F.round("y1", 2).alias("y1"), "col_off", "row_off")


_SLIPPY = POSITIONED + """, n AS (SELECT city, floor((lon + 180) / 360 * 16384e0)::BIGINT AS tx, floor((1 - asinh(tan(radians(lat))) / 3.141592653589793e0) / 2 * 16384e0)::BIGINT AS ty FROM p), b AS (SELECT city, min(tx) AS x0, max(tx) AS x1, min(ty) AS y0, max(ty) AS y1 FROM n GROUP BY city),
j AS (SELECT city, x0 + c AS x, y0 + r AS y, c * 256 AS col_off, r * 256 AS row_off, (x0 + c) / 16384e0 * 360 - 180 AS west, (x0 + c + 1) / 16384e0 * 360 - 180 AS east, degrees(atan(sinh(3.141592653589793e0 * (1 - 2 * (y0 + r) / 16384e0)))) AS north, degrees(atan(sinh(3.141592653589793e0 * (1 - 2 * (y0 + r + 1) / 16384e0)))) AS south
  FROM b JOIN range(0, 2000) a(c) ON x0 + c <= x1 JOIN range(0, 2000) z(r) ON y0 + r <= y1)"""


@register("GN07_numbered_jobs", _SLIPPY + " SELECT city, x, y, round(west, 7) AS west, round(south, 7) AS south, round(east, 7) AS east, round(north, 7) AS north, col_off, row_off FROM j")
def numbered_jobs(spark, sf_dir):
    found = tiling.numbered_jobs(points(spark, sf_dir), ["city"], 14)
    return found.select("city", "x", "y", *[F.round(c, 7).alias(c) for c in ("west", "south", "east", "north")], "col_off", "row_off")


@register("GN08_clipped_windows", _SLIPPY + " SELECT city, x, y, col_off, row_off FROM j WHERE west <= 37.62e0 AND east >= 37.5e0 + city * 0.01e0 AND south <= 48.57e0 AND north >= 48.505e0")
def clipped_windows(spark, sf_dir):
    """Where the numbered tiles that meet each city's box lie in its mosaic."""
    clip = spark.range(3).select(F.col("id").alias("city"), (37.5 + F.col("id") * 0.01).alias("west"), F.lit(48.505).alias("south"), F.lit(37.62).alias("east"), F.lit(48.57).alias("north"))
    return tiling.numbered_jobs(points(spark, sf_dir), ["city"], 14, clip).select("city", "x", "y", "col_off", "row_off")


_RECTS = """WITH v AS (SELECT s_nationkey % 4 AS view, s_suppkey, 30 + s_suppkey % 13 AS west, 44 + s_suppkey % 7 AS south, 31 + s_suppkey % 13 + s_suppkey % 5 AS east, 45 + s_suppkey % 7 + s_suppkey % 4 AS north, CAST(13 + s_suppkey % 9 AS INT) AS zoom FROM {supplier}
UNION ALL SELECT CAST(0 AS INT), CAST(-1 AS BIGINT), CAST(-180 AS BIGINT), CAST(-90 AS BIGINT), CAST(180 AS BIGINT), CAST(90 AS BIGINT), CAST(21 AS INT))"""


def rects(spark, sf_dir):
    """Rectangles of several zooms in four views, one of which spans the world."""
    return spark.sql(_RECTS + " SELECT view, west, south, east, north, zoom FROM v", supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))


@register("FL10_zoom_cap", _RECTS.format(supplier="supplier") + " SELECT view, west, south, east, north, least(zoom, 19) AS zoom FROM v WHERE NOT (north >= 89 AND south <= -89)")
def zoom_cap(spark, sf_dir):
    return tiling.capped_zooms(rects(spark, sf_dir), 19)


_AREAS = _RECTS.format(supplier="supplier") + """, u AS (SELECT view, x, y, max(least(zoom, 19)) AS zoom FROM v JOIN range(32, 43) a(x) ON x >= west AND x < east JOIN range(45, 53) b(y) ON y >= south AND y < north WHERE NOT (north >= 89 AND south <= -89) GROUP BY view, x, y)"""


def zooms(spark, sf_dir):
    area = spark.createDataFrame([(k, 32, 45, 43, 53) for k in range(4)], "view int, west long, south long, east long, north long")
    return tiling.effective_zooms(tiling.capped_zooms(rects(spark, sf_dir), 19), area, ["view"])


@register("JN12_priority_overlay", _AREAS + " SELECT view, x, y, zoom FROM u")
def overlay(spark, sf_dir):
    """The zoom of each square degree of an area: that of the highest rectangle over it."""
    cells = zooms(spark, sf_dir).withColumn("x", F.explode(F.sequence("west", F.col("east") - 1)))
    return cells.withColumn("y", F.explode(F.sequence("south", F.col("north") - 1))).select("view", "x", "y", "zoom")


@register("GN12_zoom_coverage", _AREAS + " SELECT view, zoom, count(*) AS area FROM u GROUP BY view, zoom")
def zoom_coverage(spark, sf_dir):
    """How many square degrees of a view each zoom covers."""
    return zooms(spark, sf_dir).groupBy("view", "zoom").agg(F.sum((F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))).alias("area"))


_ASKED = ctes("pixels") + ", x AS (SELECT DISTINCT r, c, max(v) AS v FROM pixels WHERE layer = 1 GROUP BY r, c), q AS (SELECT p_partkey AS id, p_partkey % 70 - 3 AS r, p_size * 2 - 5 AS c FROM part)"


def layer(spark, sf_dir):
    return carrier(spark, sf_dir, "pixels").filter("layer = 1").groupBy("r", "c").agg(F.max("v").alias("v"))


def asked(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 70 - 3).alias("r"), (F.col("p_size") * 2 - 5).alias("c"))


@register("SC16_raster_windows", _ASKED + " SELECT id, count(*) AS pixels, sum(v * (1 + (x.r - q.r) * 12 + x.c - q.c))::BIGINT AS total FROM q JOIN x ON x.r >= q.r AND x.r < q.r + 9 AND x.c >= q.c AND x.c < q.c + 12 GROUP BY id")
def raster_windows(spark, sf_dir):
    ask = asked(spark, sf_dir).select("id", F.col("r").alias("r0"), F.col("c").alias("c0"), F.lit(9).alias("height"), F.lit(12).alias("width"))
    rows = tiling.read_windows(layer(spark, sf_dir), ask)
    return rows.groupBy("id").agg(F.count("*").alias("pixels"), F.sum(F.col("v") * (1 + F.col("r") * 12 + F.col("c"))).alias("total"))


@register("SC17_levels_of_one_read", _ASKED + " SELECT id, size, count(*) AS pixels, sum(v * (1 + (x.r - q.r + size // 2) * size + x.c - q.c + size // 2))::BIGINT AS total FROM q, (VALUES (4), (7), (16)) AS s(size), x WHERE x.r >= q.r - size // 2 AND x.r < q.r - size // 2 + size AND x.c >= q.c - size // 2 AND x.c < q.c - size // 2 + size GROUP BY id, size")
def levels_of_one_read(spark, sf_dir):
    rows = tiling.read_levels(layer(spark, sf_dir), asked(spark, sf_dir), [4, 7, 16])
    return rows.groupBy("id", "size").agg(F.count("*").alias("pixels"), F.sum(F.col("v") * (1 + F.col("r") * F.col("size") + F.col("c"))).alias("total"))


@register("SC18_crops_in_metres", POSITIONED + ctes("pixels").replace("WITH RECURSIVE ", ",\n") + """, x AS (SELECT r, c, max(v) AS v FROM pixels WHERE layer = 1 GROUP BY r, c), o AS (SELECT min(x) AS x0, max(y) AS y0 FROM t),
q AS (SELECT tile_id AS id, round_even((t.y0 - t.y) / 50 - size / 100 / cos(radians(lat)), 0)::BIGINT AS r, round_even((t.x - t.x0) / 50 - size / 100 / cos(radians(lat)), 0)::BIGINT AS c, round_even(size / 50 / cos(radians(lat)), 0)::BIGINT AS n FROM (SELECT t.*, o.x0, o.y0 FROM t, o) t)
SELECT id, count(*) AS pixels, sum(v)::BIGINT AS total FROM q JOIN x ON x.r >= q.r AND x.r < q.r + n AND x.c >= q.c AND x.c < q.c + n GROUP BY id""")
def crops_in_metres(spark, sf_dir):
    """Crops of true metres around tiles' centres, from a raster of 50 grid units a pixel."""
    all_ = tiles(spark, sf_dir)
    x0, y0 = all_.agg(F.min("x"), F.max("y")).first()
    side = geo.to_grid(geo.side(F.col("size_m"), 1000.0), F.col("lat"))
    at = lambda v: F.rint(v - side / 100).cast("long")
    ask = all_.select(F.col("tile_id").alias("id"), at((y0 - F.col("y")) / 50).alias("r0"), at((F.col("x") - x0) / 50).alias("c0"), F.rint(side / 50).cast("long").alias("height"))
    rows = tiling.read_windows(layer(spark, sf_dir), ask.withColumn("width", F.col("height")))
    return rows.groupBy("id").agg(F.count("*").alias("pixels"), F.sum("v").alias("total"))


@register("UD06_tile_source", "SELECT c::INT AS col, r::INT AS row, CASE WHEN (c + r) % 5 <> 4 THEN 16 END AS bytes, CASE WHEN (c + r) % 5 <> 4 THEN lower(to_hex((c * 7 + r * 3) % 256)) END AS first FROM range(0, 30) a(c), range(0, 20) b(r)")
def tile_source_rows(spark, sf_dir):
    tile_source.register(spark, "checkered", tile_source.Checkered)
    rows = spark.read.format("checkered").option("cols", 30).option("rows", 20).load()
    return rows.select("col", "row", F.octet_length("tile").alias("bytes"), F.lower(F.regexp_replace(F.hex(F.substring("tile", 1, 1)), "^0(?=.)", "")).alias("first"))


@register("UD07_extractor", ctes("tokens") + " SELECT tile_id, r * 5 + c AS place, round(list_sum(vec::DOUBLE[]), 4) AS feature FROM tokens")
def extractor(spark, sf_dir):
    """A model that is built once a task, over tokens."""

    def factory():
        import numpy as np

        return lambda rows: rows.assign(place=rows.r * 5 + rows.c, feature=[float(np.asarray(v, float).sum()) for v in rows.vec])[["tile_id", "place", "feature"]]

    found = extract.extracted(all_tokens(spark, sf_dir), factory, "tile_id long, place long, feature double")
    return found.withColumn("feature", F.round("feature", 4))


@register("SK01_run_files", ctes("sparse") + ", s AS (SELECT tile_id, city, CASE WHEN tile_id % 7 = 0 THEN 'excluded' WHEN tile_id % 2 = 0 THEN 'train' WHEN tile_id % 4 = 1 THEN 'val' ELSE 'test' END AS split FROM sparse) SELECT city, split, count(*) AS n, (SELECT count(*) FROM s WHERE split = 'excluded') AS excluded, (SELECT count(DISTINCT tile_id // 2) FROM s) AS components FROM s GROUP BY city, split")
def run_files(spark, sf_dir):
    """A run written by city and read again: its summary, what it excludes, its components."""
    k = F.col("tile_id")
    split = F.when(k % 7 == 0, "excluded").when(k % 2 == 0, "train").when(k % 4 == 1, "val").otherwise("test")
    splits = carrier(spark, sf_dir, "sparse").select(k.alias("point_id"), F.floor(k / 2).alias("component_id"), "city", split.alias("split"))
    parts = splits.select("point_id", "component_id", F.col("component_id").cast("string").alias("name"))
    path = folder(spark)
    sinks.write_run(path, splits, spark.createDataFrame([("partition_complete", True, 0)], "check string, ok boolean, n long"), "city", parts, {"rule": "parity"})
    read = lambda name: spark.read.json(f"{path}/{name}")
    excluded, n = read("excluded").count(), read("components").select("component_id").distinct().count()
    return read("summary").select(F.col("city").cast("long").alias("city"), "split", "n", F.lit(excluded).cast("long").alias("excluded"), F.lit(n).cast("long").alias("components"))


@register("SK09_feature_files", ctes("tokens") + " SELECT tile_id, count(*) AS tokens, round(sum(list_sum(vec::DOUBLE[])), 4) AS total FROM tokens GROUP BY tile_id")
def feature_files(spark, sf_dir):
    """What a model makes of tokens, written by the tasks and read again."""

    def factory():
        import numpy as np

        return lambda rows: rows.assign(feature=[float(np.asarray(v, float).sum()) for v in rows.vec])[["tile_id", "feature"]]

    path = folder(spark)
    extract.extracted(all_tokens(spark, sf_dir), factory, "tile_id long, feature double").write.parquet(path)
    return spark.read.parquet(path).groupBy("tile_id").agg(F.count("*").alias("tokens"), F.round(F.sum("feature"), 4).alias("total"))


@register("SK15_push_plan", ctes("objects") + ", h AS (SELECT object_key, size FROM objects WHERE done) SELECT event_id, o.size FROM objects o WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.object_key = o.object_key AND h.size = o.size)")
def push_plan(spark, sf_dir):
    """The objects to send: those that aren't there under their name with their size."""
    rows = carrier(spark, sf_dir, "objects")
    there = rows.filter("done").select("object_key", "size").distinct()
    return rows.join(there, ["object_key", "size"], "left_anti").select("event_id", "size")
