"""Closed-form and planted cases."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.functions import geo, stats, vec
from meridia.operators import assign, components, descriptors, grid, losses, positives, raster, sync, verify
from meridia.operators import rank as K
from meridia.operators.box_join import box_join, nearest


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_rectangles(spark):
    box = lambda *v: [F.lit(float(x)) for x in v]
    row = one(spark, geo.rect_intersection(box(0, 0, 10, 10), box(5, 5, 15, 15)), geo.rect_intersection(box(0, 0, 10, 10), box(10, 0, 20, 10)))
    assert tuple(row) == (25.0, 0.0)


def test_snap_goes_to_even_halves(spark):
    v = lambda x: geo.snap(F.lit(x), 100.0)
    assert tuple(one(spark, v(137.0), v(151.0), v(250.0), v(350.0))) == (100.0, 200.0, 200.0, 400.0)


def test_mercator_goes_back(spark):
    row = one(spark, geo.inverse_lat(geo.mercator_y(F.lit(48.5))), geo.inverse_lon(geo.mercator_x(F.lit(37.8))))
    assert row[0] == pytest.approx(48.5) and row[1] == pytest.approx(37.8)


def test_latitude_out_of_range_is_an_error(spark):
    with pytest.raises(Exception, match="latitude out of range"):
        one(spark, geo.cos_lat(F.lit(89.5)))


def world(spark):
    lat, x0 = 48.5, 6378137 * math.radians(37.8)
    tiles = spark.createDataFrame([(i, 0, lat, 37.8, s) for i, s in ((1, 1000.0), (2, None))], "tile_id int, city int, lat double, lon double, size_m double")
    points = spark.createDataFrame([(7, 0, lat, math.degrees((x0 + 500 / math.cos(math.radians(lat))) / 6378137)), (8, 1, lat, 37.8), (9, None, lat, 37.8), (10, 0, None, None)], "point_id int, city int, lat double, lon double")
    return positives.positioned(points), positives.positioned(tiles)


def test_half_of_a_square_on_the_border(spark):
    points, tiles = world(spark)
    rows = positives.select("overlap_weighted", points, tiles, positives.params(query_size=250.0)).collect()
    assert {(r.point_id, r.tile_id) for r in rows} == {(7, 1), (7, 2)}
    assert all(abs(r.score - 0.5) < 1e-3 for r in rows)


def test_nulls_match_nothing(spark):
    points, tiles = world(spark)
    found = positives.select("current_rule", points, tiles)
    assert {r.point_id for r in positives.without_positive(points, found).collect()} >= {8, 9, 10}


def test_wrong_tile_size_is_an_error(spark):
    points, tiles = world(spark)
    with pytest.raises(Exception, match="1000 m wide"):
        positives.select("tile_iou_1000", points, tiles.withColumn("size_m", F.lit(500.0))).collect()


def test_unknown_names_are_errors(spark):
    points, tiles = world(spark)
    with pytest.raises(ValueError, match="unknown rule"):
        positives.select("no_such", points, tiles)
    with pytest.raises(ValueError, match="unknown parameters"):
        positives.params(no_such=1)


def test_box_join_is_the_nested_loop(spark):
    rng = random.Random(1)
    a = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(150)] + [(999, None, 1.0)]
    b = [(i, rng.choice([0.0, 10.0, 20.0, rng.uniform(-50, 50)]), rng.uniform(-50, 50)) for i in range(150)]
    left, right = (spark.createDataFrame(r, "id int, x double, y double") for r in (a, b))
    got = {(r.id, r.r_id) for r in box_join(left, right, 10.0).collect()}
    assert got == {(i, j) for i, x, y in a if x is not None for j, u, v in b if abs(x - u) <= 10 and abs(y - v) <= 10}


def test_nearest_far_away_and_ties(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 10000.0, 0.0)], "point_id int, x double, y double")
    tiles = spark.createDataFrame([(5, 3.0, 0.0), (4, -3.0, 0.0), (6, 50.0, 0.0)], "tile_id int, x double, y double")
    got = {r.point_id: (r.r_tile_id, r.d2) for r in nearest(points, tiles, 1.0).collect()}
    assert got == {1: (4, 9.0), 2: (6, 9950.0**2)}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(500, 500)]
    vertices = spark.createDataFrame([(v,) for v in {x for e in edges for x in e} | {900}], "v int")
    got = {r.v: r.component for r in components.connected(vertices, spark.createDataFrame(edges, "a int, b int")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 180)) and got[900] == 900 and got[500] == 500


@pytest.mark.parametrize(("sizes", "ratios", "tolerance", "status", "dropped"), [
    ([10, 10, 10, 1], (1 / 3, 1 / 3, 1 / 3), 0.02, "ok", 1),
    ([10, 10, 10, 1], (1 / 3, 1 / 3, 1 / 3), 0.10, "ok", 0),
    ([100, 1, 1], (0.7, 0.15, 0.15), 0.05, "infeasible", 0),
    ([5, 5], (0.7, 0.15, 0.15), 0.5, "infeasible", 0),
])
def test_deletion_policy(sizes, ratios, tolerance, status, dropped):
    found = assign.solve([(i, n, f"p{i:04d}") for i, n in enumerate(sizes)], ratios, tolerance)
    assert found.status == status and sum(s == assign.EXCLUDED for s in found.splits.values()) == dropped


def test_audit_catches_a_leak(spark):
    points, tiles = world(spark)
    near = points.filter("point_id = 7").select("point_id").union(spark.createDataFrame([(11,)], "point_id int"))
    matches = spark.createDataFrame([(7, 1), (11, 2)], "point_id int, tile_id int")
    parts = spark.createDataFrame([(7, 0), (11, 0)], "point_id int, component_id int")
    splits = spark.createDataFrame([(7, "train"), (11, "test"), (12, "moon")], "point_id int, split string")
    bad = {r.check: r.n for r in assign.audit(near, splits, matches, tiles, parts).collect() if not r.ok}
    assert bad == {"partition_complete": 1, "valid_labels": 1, "components_atomic": 1, "geo_disjoint": 1, "ratios_within_tolerance": 1}


def test_empty_sums(spark):
    rows = spark.createDataFrame([(1, 2.0, False), (2, 3.0, True), (2, 1000.0, True)], "q int, s double, m boolean")
    got = {r.q: r.out for r in stats.logsumexp(rows, ["q"], F.col("s"), F.col("m"), "out").collect()}
    assert got[1] == float("-inf") and got[2] == pytest.approx(1000.0)


def test_rank_of_the_first_positive(spark):
    s = [[0.1, 0.2, 0.9, 0.3], [0.9, 0.1, 0.2, 0.3]]
    rows = spark.createDataFrame([(q, t, v) for q, r in enumerate(s) for t, v in enumerate(r)], "q int, t int, s double")
    ranks = K.first_positive(rows, ((F.col("q") == 0) & (F.col("t") == 2)) | ((F.col("q") == 1) & (F.col("t") == 0)), 4)
    assert K.recall(ranks, (1,)).first().asDict() == {"n": 2, "r1": 1.0, "median_rank": 1.0}


def test_cosine_of_nothing(spark):
    assert one(spark, vec.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))))[0] == 0.0


def test_loss_needs_positives(spark):
    rows = spark.createDataFrame([(1, 1, 0.5, False, True)], "q int, t int, s double, is_pos boolean, is_cand boolean")
    with pytest.raises(Exception, match="no positive"):
        losses.validated(rows).collect()


def test_kmeans_finds_blobs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [5.0 * (j == i % 3) + float(rng.normal(0, 0.2)) for j in range(4)]) for i in range(150)]
    centroids, trace = descriptors.kmeans(spark.createDataFrame(rows, "id int, vec array<double>"), 3, steps=12, seed=3)
    inertia = [r.inertia for r in trace.orderBy("step").collect()]
    assert centroids.count() == 3 and inertia == sorted(inertia, reverse=True)


def test_grid(spark):
    rows = grid.grid_centers(spark, 0.0, 1000.0, 0.0, 1000.0, 200.0, 200.0).collect()
    assert len(rows) == 25 and {r.x for r in rows} == {100.0, 300.0, 500.0, 700.0, 900.0}
    assert grid.windows(spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double"), 500.0, 250.0).count() == 25


def test_block_sizes(spark):
    rows = spark.range(8).select(raster.block_of(F.col("id"), 8, 3).alias("b")).groupBy("b").count().orderBy("b").collect()
    assert [r["count"] for r in rows] == [3, 3, 2]


def test_missing_mask_is_an_error(spark):
    frames = spark.createDataFrame([(1,), (2,)], "frame int")
    with pytest.raises(Exception, match="no backend has frame 2"):
        raster.resolved(frames, [spark.createDataFrame([(1, 5)], "frame int, mask int")], "frame", "mask").collect()


def test_sync_pairs(spark):
    rows = spark.createDataFrame([("f", "1"), ("f", "1_48.5,37.5"), ("f", "2"), ("g", "3_1.0,2.0")], "folder string, stem string")
    got = {(r.folder, r.n): r.status for r in sync.paired(rows).collect()}
    assert got == {("f", "1"): "paired", ("f", "2"): "unpaired"}


def test_ransac_explains_a_turn():
    rng = np.random.default_rng(1)
    a = rng.uniform(0, 50, (40, 2))
    turn = np.array([[0.8, -0.6], [0.6, 0.8]])
    b = a @ turn.T * 1.5 + [3, 4]
    b[30:] = rng.uniform(0, 80, (10, 2))
    for model in verify.NEEDS:
        assert 30 <= verify.ransac(a, b, model) <= 33
    assert verify.ransac(a[:3], b[:3], "homography") == 0


def test_greedy_cap_follows_the_order(spark):
    rows = spark.createDataFrame([(1, i, 10.0 - i, i % 2, [0]) for i in range(6)], "q int, item int, score double, position int, cells array<int>")
    got = [r.item for r in K.greedy_capped(rows, "q", budget=4, per_position=2, per_cell=3, min_cells=0).collect()]
    assert sorted(got) == [0, 1, 2]


def test_kmeans_and_batches_take_the_whole_table(spark, monkeypatch, tmp_path):
    from meridia import registry
    from meridia.plans import q_learn

    rng = np.random.default_rng(2)
    rows = [(i, i % 5, rng.normal(size=4).tolist()) for i in [*range(60), *range(1000, 1061)]]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    seen = []
    real = q_learn.D.kmeans
    monkeypatch.setattr(q_learn.D, "kmeans", lambda points, *a, **k: seen.append(points.count()) or real(points, *a, **k))
    assert registry.queries()["VE07_kmeans"](spark, str(tmp_path)).count() > 0 and seen == [121]
    planned = registry.queries()["GR10_planned_batches"](spark, str(tmp_path)).collect()
    assert {r["pair"] for r in planned} == {i for i, *_ in rows}


def test_caps_hold_and_nothing_free_is_passed_over(spark):
    rng = random.Random(3)
    rows = [(q, i, rng.randrange(50), rng.randrange(6), [rng.randrange(5) for _ in range(rng.randrange(0, 3))]) for q in range(4) for i in range(60)]
    table = spark.createDataFrame(rows, "q int, item int, score int, position int, cells array<int>")
    caps = {"budget": 12, "per_position": 3, "per_cell": 4, "min_cells": 3}
    found = {}
    for r in K.greedy_capped(table, "q", **caps).collect():
        found.setdefault(r.q, []).append(r.item)
    for q in range(4):
        own = {r[1]: r for r in rows if r[0] == q}
        order = sorted(own, key=lambda i: (-own[i][2], i))
        picks = found[q]
        assert picks == [i for i in order if i in picks] and len(picks) <= 12
        for i in order[: order.index(picks[-1]) + 1]:  # each candidate is chosen exactly if the choices before it leave room
            before = [own[k] for k in picks if order.index(k) < order.index(i)]
            uses = [c for r in before for c in r[4]]
            full = all(uses.count(c) >= 4 for c in own[i][4]) and len(set(uses)) >= 3
            assert (i in picks) == (not full and sum(r[3] == own[i][3] for r in before) < 3)


def test_batches_have_each_query_and_tile_once(spark):
    pairs = [(i % 2, i, i // 3, i % 11) for i in range(80)]
    near = [(i, k, (i + 2 * k) % 80) for i in range(80) for k in range(1, 5)]
    args = spark.createDataFrame(pairs, "shard int, pair int, q int, t int"), spark.createDataFrame(near, "pair int, rank int, nbr int")
    rows = K.planned_batches(*args, "shard", 6, seed=5).collect()
    assert sorted(rows) == sorted(K.planned_batches(*args, "shard", 6, seed=5).collect())
    of = {p[1]: p for p in pairs}
    batches = {}
    for r in rows:
        assert of[r.pair][0] == r.shard
        batches.setdefault((r.shard, r.batch), []).append((r.place, r.pair))
    seen = {0: set(), 1: set()}
    for (shard, _), members in sorted(batches.items()):
        ids = [p for _, p in sorted(members)]
        assert [x for x, _ in sorted(members)] == list(range(len(ids))) and len(ids) <= 6
        assert len({of[p][2] for p in ids}) == len({of[p][3] for p in ids}) == len(ids)
        assert ids[0] == min(p[1] for p in pairs if p[0] == shard and p[1] not in seen[shard])
        assert set(ids[1:3]) <= {(ids[0] + 2 * k) % 80 for k in range(1, 5)}
        seen[shard].update(ids)
    assert {p[1] for p in pairs} == seen[0] | seen[1]


@pytest.mark.parametrize(("name", "query", "top", "least"), [("overlap_weighted", 250.0, None, 0.0), ("tile_iou_1000", 1000.0, None, 0.5), ("pyramid_top_iou_250", 250.0, 250.0, 0.15)])
def test_overlap_rules_hold_up_to_the_poles_and_beyond(spark, name, query, top, least):
    rng = random.Random(9)
    lats = [-89.9995, -89.9, -60.0, 0.0, 48.5, 80.0, 89.0, 89.9, 89.997, 89.9999]
    spread = lambda lat: (max(-89.99999, min(89.99999, lat + rng.uniform(-0.01, 0.01))), 37.5 + rng.uniform(0, 0.02))
    at = lambda n: [(i, i % 2, *spread(lats[i % len(lats)])) for i in range(n)]
    inner, tiles = at(90), at(160)
    points = spark.createDataFrame([*inner, (900, 0, 95.0, 37.5), (901, 0, 108.5, 37.5), (902, 0, None, 37.5)], "point_id long, city int, lat double, lon double")
    all_ = spark.createDataFrame([(*t, None if t[0] % 3 else 1000.0) for t in [*tiles, (950, 0, 108.5, 37.5)]], "tile_id long, city int, lat double, lon double, size_m double")
    p = positives.params(min_iou=least)
    got = {(r.point_id, r.tile_id): r.score for r in positives.select(name, positives.positioned(points), positives.positioned(all_), p).collect()}

    def square(lat, lon, side):
        return 6378137 * math.radians(lon), 6378137 * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)), side / math.cos(math.radians(lat))

    want = {}
    for i, city, lat, lon in inner:
        x, y, a = square(lat, lon, query)
        for j, c, tlat, tlon in tiles:
            tx, ty, b = square(tlat, tlon, top or 1000.0)
            shared = math.prod(max(0.0, min(u + a / 2, v + b / 2) - max(u - a / 2, v - b / 2)) for u, v in ((x, tx), (y, ty)))
            score = shared / (a * a) if name == "overlap_weighted" else shared / (a * a + b * b - shared)
            if city == c and (score > 0 if not least else score >= least):
                want[i, j] = score
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert {lats[i % len(lats)] for i, _ in want} >= set(lats) - ({-89.9995, 89.9999, 89.997} if least else set())


@pytest.mark.parametrize("k", [3, 9])
def test_best_of_blocks_are_the_best_of_all(spark, k):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(19, 4)), 3, axis=0)  # copies, so many scores tie
    x[5] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, vec array<double>").repartition(3)
    found = K.cosine_scores(rows, rows, "id", "id").filter("q <> t").withColumn("s", F.round(F.col("s") * 1e6).cast("long"))
    want = sorted((r.q, r["rank"], r.t, r.s) for r in K.top_k(found, k).collect())
    for block in (2, 7, 2048):
        assert sorted((r.q, r["rank"], r.t, r.s) for r in K.cosine_top_k(rows, rows, k, "id", "id", block=block).collect()) == want


def test_tasks_keep_the_best_of_all_their_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([np.repeat(rng.normal(size=(300, 5)), 2, axis=0), np.ones((200, 5)), rng.normal(size=(100, 5)), [[np.nan] * 5]])
    ids = [int(i) for i in rng.permutation(len(x))]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, vec array<double>").coalesce(1)
    units = x[:-1] / np.linalg.norm(x[:-1], axis=1, keepdims=True)
    whole = np.floor(np.abs(units @ units.T) * 1e6 + 0.5) * np.sign(units @ units.T)
    want = sorted((ids[i], k + 1, t, s) for i, row in enumerate(whole.astype(int)) for k, (s, t) in enumerate((-s, t) for s, t in sorted((-s, t) for t, s in zip(ids, row.tolist(), strict=False) if t != ids[i])[:4]))
    for block in (100, 280, 2048):
        assert sorted((r.q, r["rank"], r.t, r.s) for r in K.cosine_top_k(rows, rows, 4, "id", "id", block=block).collect()) == want
    monkeypatch.setattr(K, "top_k", lambda scores, _k: scores)
    assert K.cosine_top_k(rows, rows, 4, "id", "id", block=100).count() == 4 * 900  # not four for each of its blocks


def test_long_shards_are_planned_in_time_of_their_length(spark):
    n = 40_000
    pairs = spark.range(n).selectExpr("0 AS shard", "id AS pair", "id AS q", "id % 45 AS t").coalesce(1)
    near = spark.range(n).selectExpr("id AS pair", "1 AS rank", f"(id + 1) % {n} AS nbr")
    began = time.monotonic()
    rows = K.planned_batches(pairs, near, "shard", 8).toPandas()
    assert time.monotonic() - began < 15 and set(rows["pair"]) == set(range(n))
    assert (rows.groupby("batch").size() == 8).all() and not rows.assign(t=rows["pair"] % 45).duplicated(["batch", "t"]).any()


def test_batches_of_few_free_pairs_are_filled_as_far_as_they_go(spark):
    # pairs share query 0 or tile 0, but for three; so a batch holds at most one of each kind, and those three
    pairs = [(0, i, 0 if i % 2 else i, i if i % 2 else 0) for i in range(1, 401)] + [(0, 1000 + i, 5000 + i, 6000 + i) for i in range(3)]
    near = spark.createDataFrame([], "pair int, rank int, nbr int")
    rows = K.planned_batches(spark.createDataFrame(pairs, "shard int, pair int, q int, t int"), near, "shard", 8).toPandas()
    assert (rows.groupby("batch").size() == 5).all() and set(rows["pair"]) == {p[1] for p in pairs}


def test_planned_batches_never_make_all_pairs_as_rows(spark, monkeypatch, tmp_path):
    from meridia import registry

    def refuse(*_args, **_named):
        raise AssertionError("all pairs are made as rows")

    rows = [(i, i % 5, [float(i % 7), 1.0]) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(K, "cosine_scores", refuse)
    got = {r.shard: r.pairs for r in registry.queries()["GR11_epoch_seeds"](spark, str(tmp_path)).collect()}
    assert got == {0: 14, 1: 13, 2: 13}


def test_halves_of_sizes_go_to_the_even_tenth(spark):
    from meridia.functions import text

    sizes = [0, 1, 1023, 1024, 1024 + 256, 1024 + 768, 1024 * 1024 - 1, 1024 * 1024 * 5 // 4, 1024 * 1024 * 7 // 4, 1024**3 * 9 // 4, 1024**3 * 11 // 4 + 1, 1024**4 * 5 // 4, 123456789012]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(text.human_bytes(F.col("n"))).collect()]
    unit = lambda n: max(k for k in range(5) if k == 0 or n >= 1024**k)
    assert got == [f"{n} B" if n < 1024 else f"{n / 1024 ** unit(n):.1f} {' KMGT'[unit(n)]}B" for n in sizes]


def test_numbered_tiles_near_both_poles(spark):
    lats = [-89.9999999, -89.99, -60.0, 0.0, 48.5, 89.9999999, 90.0005, 95.0, 108.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lats], "lat double").coalesce(1).select(geo.slippy_y(F.col("lat"), 18)).collect()]
    assert got == [math.floor((1 - math.asinh(math.tan(math.radians(x))) / math.pi) / 2 * 2**18) for x in lats]


def test_best_tile_of_all(spark):
    queries, tiles = list(range(0, 900, 41)), random.Random(3).sample(range(2000), 700)
    ids = lambda some: spark.createDataFrame([(i,) for i in some], "id long").repartition(3)
    want = [(q, *max((((q * 3 + t * 7) % 23, -t) for t in tiles))) for q in queries]
    for block in (3, 64, 16384):
        got = K.best(ids(queries), ids(tiles), lambda q, t: (q[:, None] * 3 + t[None, :] * 7) % 23, "id", "id", block)
        assert sorted((r.q, r.s, -r.t) for r in got.collect()) == want


def test_planned_batches_by_the_nearest_of_all_pairs(spark, monkeypatch, tmp_path):
    from meridia import registry
    from meridia.plans import q_rank
    from meridia.sources.carriers import carrier

    rng = np.random.default_rng(11)
    rows = [(i, i % 5, rng.normal(size=4).tolist()) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    asked, real = [], K.planned_batches
    monkeypatch.setattr(q_rank.K, "planned_batches", lambda pairs, near, *a: asked.append(near) or real(pairs, near, *a))
    assert registry.queries()["GR10_planned_batches"](spark, str(tmp_path)).count() >= 60
    vectors = carrier(spark, str(tmp_path), "vectors")
    all_ = K.cosine_scores(vectors, vectors, "vec_id", "vec_id").filter("q <> t").withColumn("s", F.round(F.col("s") * 1e6).cast("long"))
    want = [(r.q, r["rank"], r.t) for r in K.top_k(all_, 5).collect()]
    assert sorted(map(tuple, asked[0].select("pair", "rank", "nbr").collect())) == sorted(want)


def test_scores_of_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(57, 8))
    x[3] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, vec array<double>").repartition(3)
    got = {(r.q, r.t): r.s for r in K.cosine_scores(rows.filter("id < 20"), rows, "id", "id", block=7).collect()}
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    assert len(got) == 20 * 57 and all(abs(s - unit[q] @ unit[t]) < 1e-12 for (q, t), s in got.items())
