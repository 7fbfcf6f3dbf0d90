"""Exact splits, burned ways, stores, reports, augmentation, saved states and outputs of runs, against plain versions."""

import io
import itertools
import json
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from meridia import cli
from meridia.operators import assign, association, augment, components, exact_split, osm, positives, report, store, strategies
from meridia.operators.box_join import nearest
from meridia.sources import readers, sinks
from meridia.streaming import progress

THIRDS = (1 / 3, 1 / 3, 1 / 3)


def named(sizes):
    return [(i, n, f"p{i:04d}") for i, n in enumerate(sizes)]


def best_by_trial(sizes, ratios, tolerance):
    """(left out, largest left out, squares, deviation) of the best split, by trying all; None if there is none."""
    best = None
    for choice in itertools.product(range(4), repeat=len(sizes)):
        got = [sum(n for n, c in zip(sizes, choice, strict=True) if c == s) for s in range(3)]
        out = [n for n, c in zip(sizes, choice, strict=True) if c == 3]
        if min(got) < 1:
            continue
        worst = max(abs(g / sum(got) - r) for g, r in zip(got, ratios, strict=True))
        if worst <= tolerance + 1e-12:
            key = (sum(out), max(out, default=0), sum(n * n for n in out), round(worst, 9))
            best = key if best is None else min(best, key)
    return best


def test_exact_split_is_the_best_one():
    rng = random.Random(1)
    for _ in range(40):
        sizes = [rng.choice([1, 2, 3, 5, 8, 13]) for _ in range(rng.randrange(3, 8))]
        ratios, tolerance = rng.choice([(0.7, 0.15, 0.15), THIRDS, (0.5, 0.3, 0.2)]), rng.choice([0.02, 0.05, 0.15])
        found, want = exact_split.solve(named(sizes), ratios, tolerance), best_by_trial(sizes, ratios, tolerance)
        assert (found.status == "ok") == (want is not None) and found.proven
        if want:
            got = [sum(sizes[c] for c, s in found.splits.items() if s == name) for name in assign.SPLITS]
            out = [sizes[c] for c, s in found.splits.items() if s == assign.EXCLUDED]
            worst = max(abs(g / sum(got) - r) for g, r in zip(got, ratios, strict=True))
            assert (sum(out), max(out, default=0), sum(n * n for n in out), round(worst, 9)) == want and found.left_out == bool(out)


def test_exact_split_of_known_cases():
    cut = exact_split.solve(named([10, 10, 10, 1]), THIRDS, 0.02)
    assert cut.splits[3] == assign.EXCLUDED and sorted(cut.splits.values()) == ["excluded", "test", "train", "val"]
    assert not exact_split.solve(named([10, 10, 10, 1]), THIRDS, 0.10).left_out
    assert exact_split.solve(named([100, 1, 1]), (0.7, 0.15, 0.15), 0.05).status == "infeasible"
    assert exact_split.solve(named([5, 5])).status == "infeasible"
    assert exact_split.solve(named([50] * 40), limit=1000) is None
    assert not exact_split.best_or_greedy(named([50] * 40), limit=1000).proven


def test_numbers_follow_the_key(spark):
    rng = random.Random(2)
    keys = rng.sample(range(10**6), 500)
    got = {r.k: r.n for r in components.numbered(spark.createDataFrame([(k,) for k in keys], "k long").repartition(5), "k", "n").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_nearest_other_tile(spark):
    rng = random.Random(3)
    at = {i: (rng.uniform(0, 1000) + (20_000 if i == 0 else 0), rng.uniform(0, 1000)) for i in range(60)}
    rows = spark.createDataFrame([(i, x, y) for i, (x, y) in at.items()] + [(99, None, None)], "tile_id long, x double, y double")
    got = {r.tile_id: r.r_tile_id for r in nearest(rows, rows, 10.0, "tile_id", apart=True).collect()}
    d = lambda a, b: (at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2
    assert got == {i: min((j for j in at if j != i), key=lambda j: (d(i, j), j)) for i in at}


def test_lines_touch_all_their_pixels(spark):
    rng = random.Random(4)
    lines = [(i, *(rng.uniform(-3, 20) for _ in range(4))) for i in range(60)] + [(70, 2.5, 1.0, 9.5, 1.0), (71, 4.0, 0.5, 4.0, 9.5), (72, 3.3, 3.3, 3.3, 3.3)]
    table = spark.createDataFrame(lines, "id int, x0 double, y0 double, x1 double, y1 double")
    got = {}
    for r in osm.touched_pixels(table, ["id"], 16, 16).collect():
        got.setdefault(r.id, set()).add((r.r, r.c))
    for i, x0, y0, x1, y1 in lines:
        fine = {(math.floor(y0 + (y1 - y0) * k / 5000), math.floor(x0 + (x1 - x0) * k / 5000)) for k in range(5001)}
        fine = {p for p in fine if 0 <= p[0] < 16 and 0 <= p[1] < 16}
        found = got.get(i, set())
        assert fine <= found and len(found - fine) <= 2  # what is more is grazed at a corner
    areas = spark.createDataFrame([(1, 2.0, 2.0, 9.0, 2.0), (1, 9.0, 2.0, 9.0, 9.0), (1, 9.0, 9.0, 2.0, 2.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    inside = {(r.r, r.c) for r in osm.burned(table.limit(0), areas, ["id"], 16, 16).collect()}
    assert {(3, 5), (4, 8), (8, 9)} <= inside and (8, 3) not in inside
    assert osm.burned(table.limit(0), areas.limit(0), ["id"], 16, 16).collect() == []


def test_way_classes(spark):
    tags = [{"highway": "road"}, {"highway": "steps", "waterway": "ditch"}, {"natural": "water"}, {"natural": "wood"}, {}, {"highway": "trunk", "natural": "water"}]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tags)] + [(9, None)], "i int, tags map<string,string>")
    got = {r.i: r.c for r in rows.select("i", osm.way_class(F.col("tags")).alias("c")).collect()}
    assert got == {0: "road", 1: "waterway", 2: "natural_water", 3: None, 4: None, 5: "trunk", 9: None}


def test_pair_status(spark):
    cases = [(0.8, 0.4, 0.3, False), (0.8, 0.1, 0.06, False), (0.1, 0.1, 0.01, False), (0.9, 0.9, 0.8, True), (0.0, 0.0, 0.0, True)]
    rows = spark.createDataFrame(cases, "cq double, ct double, iou double, refused boolean")
    got = [tuple(r.s) for r in rows.select(association.pair_status(*map(F.col, ("cq", "ct", "iou", "refused"))).alias("s")).collect()]
    assert got == [("strong", 0.8), ("partial", 0.06), ("negative", 0.0), ("undetermined", 0.0), ("negative", 0.0)]


def test_safe_negatives(spark):
    tiles = spark.createDataFrame([(i, 1000.0 * i, 0.0, 1000.0) for i in range(6)], "tile_id int, x double, y double, size_m double")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 2500.0, 0.0), (3, 9e9, 0.0)], "point_id int, x double, y double")
    matches = spark.createDataFrame([(1, 5, None), (1, 0, 0.5), (2, 2, None)], "point_id int, tile_id int, score double")
    got = {r.point_id: (r.positives, r.safe, r.weight) for r in positives.relevance(points, matches, tiles).collect()}
    assert got == {1: (2, 4, 1.5), 2: (1, 4, 1.0)}


def test_report_speaks_of_what_was_measured(spark):
    row = spark.createDataFrame([(0.8, 0.05, None, 0.95)], "train_r10 double, val_r10 double, learned_r10 double, gate_dominant_share double")
    found = {r.hypothesis: r.status for r in report.hypotheses(row).collect()}
    assert found["memorisation or a shift between splits"] == "Supported" and found["the gate has collapsed to one level"] == "Supported (flag)" and len(found) == 4
    text = report.markdown(report.hypotheses(row))
    assert text.count("\n| ") == 5 and "train_r10=0.8" in text
    assert report.hypotheses(spark.range(1)).collect() == []


def test_augmentation_is_seeded(spark):
    rows = spark.range(3000).withColumnRenamed("id", "f")
    got = augment.parameters(rows, "f", 640, 480, seed=1).collect()
    assert sorted(got, key=lambda r: r.f) == sorted(augment.parameters(rows.repartition(7), "f", 640, 480, seed=1).collect(), key=lambda r: r.f)
    assert got != augment.parameters(rows, "f", 640, 480, seed=2).collect()
    assert all(r.corners is None for r in got if r.scale is not None) and any(r.corners for r in got)
    assert all(0.7 <= r.scale <= 1.4 for r in got if r.scale) and 0.45 < sum(r.scale is not None for r in got) / 3000 < 0.55
    assert {r.dx for r in got if r.dx is not None} <= set(range(-64, 65)) and all(40 <= r.jpeg <= 95 for r in got if r.jpeg)


def test_store_modes(spark):
    lat = 48.5
    step = 100 / math.cos(math.radians(lat))
    tiles = spark.createDataFrame([(1, 0.0, 0.0)], "tile_id int, x double, y double")
    tokens = spark.createDataFrame([(1, r, c, [float(r), float(c)]) for r in range(5) for c in range(5)], "tile_id int, r int, c int, vec array<double>")
    crops = store.wanted(spark.createDataFrame([(step, 0.0, lat), (step + 0.001, 0.0, lat), (5 * step, 0.0, lat)], "x double, y double, lat double"), [200, 600, 1000])
    made = lambda rows: rows.select("px", "py", "level", F.lit(0).alias("r"), F.lit(0).alias("c"), F.array(F.lit(-1.0)).alias("vec"))
    count = lambda mode: {(round(r.px), r.level): r.n for r in store.crops_of(mode, crops, tiles, tokens, made, 5, 1000.0).groupBy("px", "level").agg(F.count("*").alias("n")).collect()}
    near, far = round(step), round(5 * step)
    assert count("dense") == {(near, 200): 1, (near, 600): 9, (near, 1000): 25}
    assert count("hybrid") == count("dense") | {(far, k): 1 for k in (200, 600, 1000)}
    assert set(count("fresh").values()) == {1} and len(count("fresh")) == 6
    with pytest.raises(ValueError, match="unknown mode"):
        count("stale")


def test_a_broken_state_falls_back(spark, tmp_path):
    path = str(tmp_path / "state.json")
    assert progress.load_state(spark, path) == {}
    progress.save_state(spark, path, {"n": 1})
    progress.save_state(spark, path, {"n": 2})
    assert progress.load_state(spark, path) == {"n": 2}
    (tmp_path / "state.json").write_text('{"n": ')
    assert progress.load_state(spark, path) == {"n": 1}
    (tmp_path / "state.json").unlink()
    assert progress.load_state(spark, path) == {"n": 1}
    (tmp_path / "state.json.bak").write_text("no state")
    assert progress.load_state(spark, path) == {}


def kmz(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as box:
        box.writestr("doc.kml", f"<kml><Document>{body}</Document></kml>")
    return out.getvalue()


def test_rings_of_areas():
    mark = lambda name, kind, *p: f"<Placemark><name>{name}</name><{kind}><coordinates>{' '.join(f'{x},{y},0' for x, y in p)}</coordinates></{kind}></Placemark>"
    both = kmz(mark("a", "Polygon", (0, 0), (2, 0), (2, 2), (0, 0)) + mark("Flight B", "Polygon", (5, 5), (6, 5), (6, 6), (5, 6), (5, 5)))
    assert readers.ring_of(both) == [(0, 0), (2, 0), (2, 2)] and readers.ring_of(both, "flight") == [(5, 5), (6, 5), (6, 6), (5, 6)]
    hull = readers.ring_of(kmz("".join(mark("p", "Point", p) for p in [(0, 0), (4, 0), (4, 4), (0, 4), (2, 2)])))
    assert sorted(hull) == [(0, 0), (0, 4), (4, 0), (4, 4)]
    with pytest.raises(ValueError, match="less than three vertices"):
        readers.ring_of(kmz(mark("a", "Polygon", (0, 0), (1, 1), (0, 0))))
    with pytest.raises(ValueError, match="less than three points"):
        readers.ring_of(both, "none of them")


def test_run_files(spark, tmp_path):
    splits = spark.createDataFrame([(1, 0, "train", "k"), (2, 0, "train", "k"), (3, 1, "val", "l"), (4, 2, "excluded", "l")], "point_id int, component_id int, split string, city string")
    parts = spark.createDataFrame([(1, 0, "1"), (2, 0, "1"), (3, 1, "3"), (4, 2, "4")], "point_id int, component_id int, name string")
    checks = spark.createDataFrame([("partition_complete", True, 0)], "check string, ok boolean, n long")
    sinks.write_run(str(tmp_path), splits, checks, "city", parts, {"tolerance": 0.05})
    read = lambda name: spark.read.json(f"{tmp_path}/{name}")
    assert read("split").count() == 4 and [r.point_id for r in read("excluded").collect()] == [4]
    assert {(r.city, r.split): r.n for r in read("summary").collect()} == {("k", "train"): 2, ("l", "val"): 1, ("l", "excluded"): 1}
    assert {(r.component_id, r["size"], r.split) for r in read("components").collect()} == {(0, 2, "train"), (1, 1, "val"), (2, 1, "excluded")}
    assert json.loads(read("config").first().value) == 0.05
    ring = spark.createDataFrame([("a<b", "s", [(1.0, 2.0), (3.0, 2.0), (1.0, 2.0)])], "n string, s string, ring array<struct<lon:double,lat:double>>")
    assert "<coordinates>1.0000000,2.0000000,0 3.0000000,2.0000000,0 1.0000000,2.0000000,0</coordinates>" in sinks.polygons(ring, "n", "ring", "s").first().kml


def test_unknown_strategies_are_errors():
    for names in (strategies.ESTIMATORS, strategies.FUSIONS, strategies.AGGREGATIONS, strategies.MASKERS):
        with pytest.raises(ValueError, match="unknown"):
            names["nothing"]
        with pytest.raises(ValueError, match="registered already"):
            names.add(next(iter(names.known)))(lambda: None)
    assert strategies.AGGREGATIONS["residual"] is strategies.AGGREGATIONS["supervlad"]


def test_cli_is_there():
    assert callable(cli.main)


def test_windows_of_one_read(spark):
    from meridia.operators import tiling

    rng = random.Random(6)
    image = {(r, c): rng.randrange(100) for r in range(30) for c in range(41)}
    pixels = spark.createDataFrame([(r, c, v) for (r, c), v in image.items()], "r long, c long, v int")
    asks = [(i, rng.randrange(-5, 33), rng.randrange(-5, 45), rng.randrange(0, 20), rng.randrange(0, 25)) for i in range(30)]
    got = {(r.id, r.r, r.c): r.v for r in tiling.read_windows(pixels, spark.createDataFrame(asks, "id int, r0 long, c0 long, height int, width int"), block=7).collect()}
    assert got == {(i, r - r0, c - c0): v for i, r0, c0, h, w in asks for (r, c), v in image.items() if r0 <= r < r0 + h and c0 <= c < c0 + w}
    levels = {(r.size, r.r, r.c): r.v for r in tiling.read_levels(pixels, spark.createDataFrame([(1, 10, 12)], "id int, r long, c long"), [3, 8]).collect()}
    assert levels == {(n, r - 10 + n // 2, c - 12 + n // 2): v for n in (3, 8) for (r, c), v in image.items() if 0 <= r - 10 + n // 2 < n and 0 <= c - 12 + n // 2 < n}


def test_the_highest_zoom_counts(spark):
    from meridia.operators import tiling

    rects = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0, 13), (1, 2.0, 2.0, 4.0, 12.0, 16), (1, 3.0, 3.0, 20.0, 5.0, 19), (1, -180.0, -90.0, 180.0, 90.0, 22), (2, 0.0, 0.0, 1.0, 1.0, 5)], "v int, west double, south double, east double, north double, zoom int")
    area = spark.createDataFrame([(1, 0.0, 0.0, 15.0, 11.0)], "v int, west double, south double, east double, north double")
    cells = tiling.effective_zooms(tiling.capped_zooms(rects, 18), area, ["v"]).collect()
    size = {}
    for r in cells:
        size[r.zoom] = size.get(r.zoom, 0) + (r.east - r.west) * (r.north - r.south)
    assert size == {18: 24.0, 16: 18.0 - 2.0, 13: 100.0 - 16.0 - 14.0 + 2.0}
    with pytest.raises(ValueError, match="4096"):
        tiling.metre_jobs(rects, ["v"], 10, 5000)


def test_a_tile_source_is_read_in_parts(spark):
    from meridia.sources import tile_source

    tile_source.register(spark, "trial", tile_source.Checkered)
    rows = spark.read.format("trial").option("cols", 9).option("rows", 7).option("jobs_per_task", 10).load()
    assert rows.rdd.getNumPartitions() == 7
    got = rows.collect()
    assert len(got) == 63 and all((r.tile is None) == ((r.col + r.row) % 5 == 4) for r in got)


def test_a_model_is_built_once_a_task(spark, tmp_path):
    from meridia.operators import extract

    def factory():
        import uuid

        (tmp_path / uuid.uuid4().hex).touch()
        return lambda rows: rows.assign(twice=rows.id * 2)[["id", "twice"]]

    got = extract.extracted(spark.range(0, 50_000, 1, 2), factory, "id long, twice long")
    assert got.filter("twice <> 2 * id").count() == 0 and len(list(tmp_path.iterdir())) == 2
    assert extract.extracted(spark.range(0), factory, "id long, twice long").collect() == []


def test_kmz_of_a_run(spark, tmp_path):
    from meridia import config

    rows = [(i, 0, 48.5 + 0.05 * (i // 7), 37.5 + 0.07 * (i % 7), 1000.0) for i in range(28)]
    spark.createDataFrame(rows, "tile_id int, city int, lat double, lon double, size_m double").write.parquet(f"{tmp_path}/tiles.parquet")
    spark.createDataFrame([r[:4] for r in rows], "point_id int, city int, lat double, lon double").write.parquet(f"{tmp_path}/points.parquet")
    s = config.settings(tolerance=0.1)
    assert cli.build(spark, str(tmp_path), s, checks=["geo_disjoint"], exact=True) == 0
    assert cli.export_kmz(spark, str(tmp_path), s, with_tiles=True) == 56
    with zipfile.ZipFile(tmp_path / "split.kmz") as box:
        assert box.read("doc.kml").count(b"<Polygon>") == 28
    with pytest.raises(ValueError, match="unknown checks: no such"):
        cli.build(spark, str(tmp_path), s, write=False, checks=["no such"])


def test_evenly_spaced_rows(spark):
    from meridia.operators import retrieval

    for n, most in ((50, 7), (50, 50), (50, 1), (5, 9), (400, 399), (1000, 13)):
        rows = spark.range(0, 3 * n, 3).withColumnRenamed("id", "k").repartition(4)
        want = range(n) if n <= most else [0] if most == 1 else sorted({round(j * (n - 1) / (most - 1)) for j in range(most)})
        assert sorted(r.k for r in retrieval.evenly(rows, "k", most).collect()) == [3 * i for i in want]


def test_samples_of_tokens(spark):
    from meridia.operators import retrieval

    rows = [(t, i, [float(t + 1), float(i)]) for t in range(9) for i in range(10)]
    table = spark.createDataFrame(rows, "tile int, token int, vec array<double>")
    got = retrieval.sample_tokens(table, "tile", "token", 4, 100, most_tiles=3, seed=2).collect()
    assert {r.tile for r in got} == {0, 4, 8} and len(got) == 12 and all(abs(sum(x * x for x in r.vec) - 1) < 1e-9 for r in got)
    assert len(retrieval.sample_tokens(table, "tile", "token", 4, 7).collect()) == 7
    odd = spark.createDataFrame([*rows, (9, 0, [1.0])], "tile int, token int, vec array<double>")
    with pytest.raises(ValueError, match="tokens of 1 and of 2"):
        retrieval.sample_tokens(odd, "tile", "token", 4, 7)
    bad = spark.createDataFrame([([1, 2], 3)], "keep array<int>, n int")
    with pytest.raises(Exception, match="tokens and indices differ"):
        bad.select(retrieval.kept_places(F.col("keep"), F.col("n"), 5)).collect()


def test_area_sweep_keeps_far_tiles_behind(spark):
    from meridia.operators import retrieval

    rows = [(1, 1, 5, False, 0.0, 0.0), (1, 2, 9, False, 1e5, 0.0), (1, 3, 1, True, 10.0, 10.0), (2, 1, 1, False, 0.0, 0.0), (3, 1, 1, True, 1e5, 0.0), (3, 2, 3, False, 0.0, 0.0)]
    table = spark.createDataFrame(rows, "q int, t int, s int, positive boolean, dx double, dy double")
    got = {r.km2: r for r in retrieval.area_sweep(table, [1, 1e6]).collect()}
    assert (got[1.0].n, got[1.0].mean_candidates, got[1.0].median_rank) == (2, 1.5, 2.0)
    assert (got[1e6].n, got[1e6].mean_candidates, got[1e6].median_rank, got[1e6].within250) == (2, 2.5, 2.5, 0.5)


def test_windows_far_larger_than_the_raster(spark):
    from meridia.operators import tiling

    pixels = spark.range(40 * 30).selectExpr("id div 30 + 5 AS r", "id % 30 - 7 AS c", "id AS v")
    ask = [(1, -(10**9), -(10**9), 2 * 10**9, 2 * 10**9), (2, 44, 22, 10**9, 10**9), (3, 45, 0, 10**9, 9), (4, None, 0, 9, 9), (5, 0, 0, -4, 4), (6, 10, 3, 9, 12)]
    got = tiling.read_windows(pixels, spark.createDataFrame(ask, "id long, r0 long, c0 long, height long, width long")).collect()
    want = [(i, r - r0, c - c0, (r - 5) * 30 + c + 7) for i, r0, c0, h, w in ask if r0 is not None for r in range(5, 45) for c in range(-7, 23) if r0 <= r < r0 + h and c0 <= c < c0 + w]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 1200 + 1 + 108


def test_sweep_by_boxes_is_that_of_all_pairs(spark):
    from meridia.operators import retrieval

    rng = random.Random(8)
    queries = [(q, rng.randrange(2), rng.uniform(0, 9000), rng.uniform(0, 9000)) for q in range(12)] + [(50, 0, 1e7, 1e7), (51, 0, None, None)]
    tiles = [(t, rng.randrange(2), rng.uniform(0, 9000), rng.uniform(0, 9000)) for t in rng.sample(range(300), 70)] + [(301, 1, 5.0, None)]
    links = {(q, rng.choice(tiles[:-1])[0]) for q in [*range(10), 50] for _ in range(1 + q % 2)}
    score = (F.col("q") * 31 + F.col("t") * 17) % 23
    ask, all_ = spark.createDataFrame(queries, "q int, city int, x double, y double"), spark.createDataFrame(tiles, "t int, city int, x double, y double")
    positive = spark.createDataFrame(sorted(links), "q int, t int")
    pairs = ask.alias("a").crossJoin(all_.alias("b")).select("q", "t", (F.col("b.x") - F.col("a.x")).alias("dx"), (F.col("b.y") - F.col("a.y")).alias("dy"), (F.col("a.city") == F.col("b.city")).alias("own"))
    pairs = pairs.fillna(1e12, ["dx", "dy"]).withColumn("s", score).join(positive.withColumn("p", F.lit(True)), ["q", "t"], "left").withColumn("positive", F.coalesce("p", F.lit(False)))
    areas = [0.01, 1, 9, 100]
    want = {r.km2: tuple(r) for r in retrieval.area_sweep(pairs, areas, also=F.col("own")).collect()}
    got = {r.km2: tuple(r) for r in retrieval.swept(ask, all_, positive, score, areas, ["city"]).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want) and want[100.0][1] == 11


def test_sweep_makes_no_pairs_of_all(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from meridia import registry

    held, real = [], DataFrame.crossJoin
    monkeypatch.setattr(DataFrame, "crossJoin", lambda self, other: held.append(other.count()) or real(self, other))
    assert registry.queries()["AG12_area_sweep"](spark, "/root/testdata/sf0.001").count() == 3
    assert all(n <= 1 for n in held)


def test_projection_matrix_is_normal(spark):
    from meridia.operators import descriptors

    w = [r.w for r in descriptors.gaussian(spark, 200, 50, seed=1).collect()]
    assert len(w) == 10_000 and abs(sum(w) / len(w)) < 0.01 and abs(sum(x * x for x in w) / len(w) * 50 - 1) < 0.05
    rows = spark.createDataFrame([(1, [3.0, 4.0])], "id int, vec array<double>")
    assert [(r.j, r.y) for r in descriptors.projected(rows, None, ["id"], 2, 2).orderBy("j").collect()] == [(0, 3.0), (1, 4.0)]
