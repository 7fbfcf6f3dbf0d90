"""Queries of objectives, descriptors and dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import vec
from meridia.operators import descriptors as D
from meridia.operators import losses as L
from meridia.operators import positives as P
from meridia.plans.q_geometry import POSITIONED, points, tiles
from meridia.registry import register
from meridia.sources.carriers import carrier, ctes

_B = ctes("batch") + ", z AS (SELECT *, s / 0.1e0 AS z FROM batch)"


def batch(spark, sf_dir):
    return carrier(spark, sf_dir, "batch")


_NLL = " SELECT {k}, ln(sum(exp(z)) FILTER (is_cand)) - ln(sum(exp(z)) FILTER (is_pos)) AS nll FROM z {w} GROUP BY {k}"


@register("AG23_masked_logsumexp", _B + " SELECT q, round(ln(sum(exp(z)) FILTER (is_pos)), 6) AS lse FROM z GROUP BY q HAVING bool_or(is_pos)")
def masked_logsumexp(spark, sf_dir):
    from meridia.functions.stats import logsumexp

    rows = logsumexp(batch(spark, sf_dir), ["q"], F.col("s") / 0.1, F.col("is_pos"), "lse")
    return rows.filter(F.col("lse") > float("-inf")).select("q", F.round("lse", 6).alias("lse"))


@register("AG25_full_gallery_nll", _B + ", n AS (" + _NLL.format(k="q", w="") + ") SELECT q, round(nll, 6) AS nll FROM n")
def full_gallery(spark, sf_dir):
    return L.multipositive_nll(L.validated(batch(spark, sf_dir)), 0.1).select("q", F.round("nll", 6).alias("nll"))


@register("AG24_symmetric_ce", _B + ", a AS (" + _NLL.format(k="q", w="") + "), b AS (" + _NLL.format(k="t", w="WHERE t IN (SELECT t FROM z WHERE is_pos)") + ") SELECT round(((SELECT avg(nll) FROM a) + (SELECT avg(nll) FROM b)) / 2, 6) AS loss")
def symmetric(spark, sf_dir):
    return L.symmetric(batch(spark, sf_dir), 0.1).select(F.round("loss", 6).alias("loss"))


@register("AG24_weighted_ce", _B + ", w AS (SELECT q, sum(1 + t % 3) FILTER (is_pos) AS w FROM z GROUP BY q) SELECT z.q, round(ln(sum(exp(z)) FILTER (is_cand)) - ln(sum(exp(z) * (1 + t % 3) / w) FILTER (is_pos)), 6) AS nll FROM z JOIN w ON z.q = w.q GROUP BY z.q")
def weighted(spark, sf_dir):
    return L.multipositive_nll(batch(spark, sf_dir), 0.1, weight=1.0 + F.col("t") % 3).select("q", F.round("nll", 6).alias("nll"))


@register("AG27_infonce", _B + ", d AS (SELECT *, count(*) OVER (PARTITION BY q) AS n, ln(sum(exp(z)) OVER (PARTITION BY q)) AS l FROM z) SELECT q, round(-sum(((CASE WHEN q = t THEN 0.9e0 ELSE 0e0 END) + 0.1e0 / n) * (z - l)), 6) AS loss FROM d GROUP BY q")
def infonce(spark, sf_dir):
    return L.infonce(batch(spark, sf_dir), F.col("q") == F.col("t"), 0.1, 0.1).select("q", F.round("loss", 6).alias("loss"))


@register("JN16_cross_relevance", ctes("batch") + ", m AS (SELECT DISTINCT q FROM batch) SELECT batch.q, t, is_pos, is_cand FROM batch JOIN m ON t = m.q")
def cross_relevance(spark, sf_dir):
    rows = batch(spark, sf_dir)
    return rows.join(rows.select(F.col("q").alias("t")).distinct(), "t", "left_semi").select("q", "t", "is_pos", "is_cand")


_C = ctes("tokens", "vectors") + """, ce AS (SELECT vec_id % 8 AS k, vec AS centre FROM vectors WHERE vec_id >= 400 AND vec_id < 408),
tk AS (SELECT tile_id, r, c, vec FROM tokens),
d AS (SELECT tile_id, r, c, k, vec, centre, list_sum(list_transform(list_zip(vec, centre), lambda p: power(p[1]::DOUBLE - p[2]::DOUBLE, 2))) AS d2 FROM tk, ce),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile_id, r, c ORDER BY d2, k) AS o FROM d) WHERE o = 1),
x AS (SELECT tile_id, r, c, k, unnest(generate_series(0, 63)) AS i, unnest(vec)::DOUBLE AS v, unnest(centre)::DOUBLE AS m FROM n)"""


def dictionary(spark, sf_dir):
    rows = carrier(spark, sf_dir, "vectors").where("vec_id >= 400 AND vec_id < 408")
    return rows.select((F.col("vec_id") % 8).alias("k"), F.transform("vec", lambda x: x.cast("double")).alias("centre"))


def all_tokens(spark, sf_dir):
    return carrier(spark, sf_dir, "tokens")


@register("VE07_assign_step", _C + " SELECT k, count(*) AS n, round(sum(d2), 4) AS inertia FROM n GROUP BY k")
def assign_step(spark, sf_dir):
    near = D.assigned(all_tokens(spark, sf_dir), dictionary(spark, sf_dir))
    return near.groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("d2"), 4).alias("inertia"))


@register("VE07_kmeans")
def kmeans(spark, sf_dir):
    rows = carrier(spark, sf_dir, "vectors").select(F.col("vec_id").alias("id"), "vec")
    return D.kmeans(rows, 4, steps=4)[1]


@register("VE08_vlad", _C + ", s AS (SELECT tile_id, k, i, sum(v - m) AS x FROM x GROUP BY tile_id, k, i), a AS (SELECT tile_id, k, i, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY tile_id, k)), 1e-12) AS x FROM s) SELECT tile_id, k, i, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY tile_id)), 1e-12), 5) AS x FROM a")
def vlad(spark, sf_dir):
    return D.vlad(all_tokens(spark, sf_dir), dictionary(spark, sf_dir), ["tile_id"]).select("tile_id", "k", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x"))


_W = "greatest(0e0, least({p} + 1e0, 4e0) - greatest({p} * 1e0, 1e0))"


@register("VE09_concentric_vlad", _C + f", s AS (SELECT tile_id, k, i, sum({_W.format(p='r')} * {_W.format(p='c')} * (v - m)) AS x FROM x GROUP BY tile_id, k, i) SELECT tile_id, k, round(sqrt(sum(x * x)), 5) AS length FROM s GROUP BY tile_id, k")
def concentric(spark, sf_dir):
    near = D.assigned(all_tokens(spark, sf_dir), dictionary(spark, sf_dir)).join(dictionary(spark, sf_dir), "k")
    rows = near.withColumn("residual", F.zip_with("vec", "centre", lambda a, b: a.cast("double") - b))
    sums = D.positional(rows, ["tile_id", "k"], "residual", D.concentric_weight(F.col("r"), F.col("c"), 5, 0.6))
    return sums.groupBy("tile_id", "k").agg(F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 5).alias("length"))


@register("VE10_query_residuals", _C + " SELECT tile_id, k, i, round(sum(v) - count(*) * m, 5) AS x FROM x GROUP BY tile_id, k, i, m")
def query_residuals(spark, sf_dir):
    rows = D.residual_query(all_tokens(spark, sf_dir), dictionary(spark, sf_dir), ["tile_id"])
    return rows.select("tile_id", "k", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x"))


@register("PJ25_unit_length", ctes("vectors") + " SELECT vec_id, round(sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])), 5) AS length FROM vectors")
def unit_length(spark, sf_dir):
    return carrier(spark, sf_dir, "vectors").select("vec_id", F.round(vec.norm(F.col("vec")), 5).alias("length"))


@register("PJ27_cosine", ctes("vectors") + " SELECT a.vec_id, round(list_dot_product(a.vec::DOUBLE[], b.vec::DOUBLE[]) / (sqrt(list_dot_product(a.vec::DOUBLE[], a.vec::DOUBLE[])) * sqrt(list_dot_product(b.vec::DOUBLE[], b.vec::DOUBLE[]))), 5) AS cosine FROM vectors a, vectors b WHERE b.vec_id = a.vec_id + 1")
def cosine(spark, sf_dir):
    rows = carrier(spark, sf_dir, "vectors")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("next"))
    return rows.join(after, "vec_id").select("vec_id", F.round(vec.cosine(F.col("vec"), F.col("next")), 5).alias("cosine"))


@register("AG33_adaptive_pool", ctes("tokens") + """, g AS (SELECT unnest([0, 1]) AS k), e AS (SELECT tile_id, r, c, unnest(generate_series(0, 63)) AS i, unnest(vec)::DOUBLE AS x FROM tokens)
SELECT tile_id, a.k AS cr, b.k AS cc, i, round(avg(x), 6) AS x FROM e JOIN g a ON r >= floor(a.k * 5 / 2e0) AND r < ceil((a.k + 1) * 5 / 2e0) JOIN g b ON c >= floor(b.k * 5 / 2e0) AND c < ceil((b.k + 1) * 5 / 2e0) GROUP BY ALL""")
def adaptive_pool(spark, sf_dir):
    rows = D.adaptive_pool(carrier(spark, sf_dir, "tokens"), 5, 2)
    return rows.select("tile_id", "cr", "cc", F.posexplode("vec").alias("i", "x")).select("tile_id", "cr", "cc", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@register("VE16_sky_filtered_mean", ctes("tokens") + ", e AS (SELECT tile_id, r, c, unnest(generate_series(0, 63)) AS i, unnest(vec)::DOUBLE AS x FROM tokens) SELECT tile_id, i, round(coalesce(avg(x) FILTER (r >= tile_id % 7), avg(x)), 6) AS x FROM e GROUP BY tile_id, i")
def sky_filtered(spark, sf_dir):
    """The mean of tokens below the sky; of all tokens where nothing else is left."""
    from pyspark.sql import Window

    rows = carrier(spark, sf_dir, "tokens").withColumn("keep", F.col("r") >= F.col("tile_id") % 7)
    rows = rows.withColumn("any", F.max(F.col("keep").cast("int")).over(Window.partitionBy("tile_id"))).filter("keep OR any = 0")
    return D.mean_pool(rows, ["tile_id"]).select("tile_id", F.posexplode("vec").alias("i", "x")).select("tile_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@register("VE13_recast_centroids", ctes("vectors") + " SELECT vec_id, i, round(3e0 * x / n, 5) AS x FROM (SELECT vec_id, unnest(generate_series(0, 63)) AS i, unnest(vec)::DOUBLE AS x, sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) AS n FROM vectors)")
def recast(spark, sf_dir):
    rows = carrier(spark, sf_dir, "vectors").select("vec_id", F.posexplode(vec.unit(F.col("vec"))).alias("i", "x"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), F.round(3.0 * F.col("x"), 5).alias("x"))


@register("VE12_level_pooling", ctes("scores") + ", w AS (SELECT frame_id, level, max(score) FILTER (method = 'global') AS g, max(score) FILTER (method = 'patch') AS p FROM scores GROUP BY frame_id, level), e AS (SELECT *, exp(g / 0.5e0) AS e FROM w) SELECT frame_id, round(sum(e * p) / sum(e), 6) AS score FROM e GROUP BY frame_id")
def level_pooling(spark, sf_dir):
    from meridia.functions.stats import softmax

    pick = lambda m: F.max(F.when(F.col("method") == m, F.col("score")))
    rows = carrier(spark, sf_dir, "scores").groupBy("frame_id", "level").agg(pick("global").alias("g"), pick("patch").alias("p"))
    return rows.withColumn("b", softmax(F.col("g"), ["frame_id"], 0.5)).groupBy("frame_id").agg(F.round(F.sum(F.col("b") * F.col("p")), 6).alias("score"))


_GATE = ctes("scores") + """, g AS (SELECT frame_id, level, max(score) FILTER (method = 'global') AS g, max(score) FILTER (method = 'patch') AS s FROM scores GROUP BY frame_id, level), e AS (SELECT *, exp(g / 0.2e0) AS e FROM g), p AS (SELECT *, e / sum(e) OVER (PARTITION BY frame_id) AS b FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY round(b, 9) DESC, level) AS gr, row_number() OVER (PARTITION BY frame_id ORDER BY s DESC, level) AS sr, row_number() OVER (PARTITION BY frame_id ORDER BY round(b * s, 9) DESC, level) AS cr FROM p)"""


def gates(spark, sf_dir):
    """(frame_id, level, b, s): a level's weight in its frame and its score."""
    from meridia.functions.stats import softmax

    pick = lambda m: F.max(F.when(F.col("method") == m, F.col("score")))
    rows = carrier(spark, sf_dir, "scores").groupBy("frame_id", "level").agg(pick("global").alias("g"), pick("patch").alias("s"))
    return rows.withColumn("b", softmax(F.col("g"), ["frame_id"], 0.2))


@register("AG31_gate_summary", _GATE + """, f AS (SELECT frame_id, max(level) FILTER (gr = 1) AS g, max(level) FILTER (sr = 1) AS s, max(level) FILTER (cr = 1) AS c, -sum(b * ln(greatest(b, 1e-9))) AS h FROM n GROUP BY frame_id), d AS (SELECT g, count(*) AS k FROM f GROUP BY g ORDER BY k DESC, g LIMIT 1)
SELECT count(*) AS n, round(avg(h), 6) AS entropy_mean, round(min(h), 6) AS entropy_min, round(avg(CAST(s <> g OR c <> g OR s <> c AS INT)), 6) AS disagree, (SELECT g FROM d) AS dominant, round((SELECT k FROM d) / count(*), 6) AS dominant_share, (SELECT k FROM d) / count(*) > 0.9 AS collapse FROM f""")
def gate_summary(spark, sf_dir):
    return D.gate_summary(gates(spark, sf_dir)).select("n", *[F.round(c, 6).alias(c) for c in ("entropy_mean", "entropy_min", "disagree")], "dominant", F.round("dominant_share", 6).alias("dominant_share"), "collapse")


@register("AG31_gate_histograms", _GATE + " SELECT level, count(*) FILTER (gr = 1) AS by_gate, count(*) FILTER (sr = 1) AS by_score, count(*) FILTER (cr = 1) AS by_product FROM n GROUP BY level")
def gate_histograms(spark, sf_dir):
    return D.best_by(gates(spark, sf_dir)).groupBy("level").agg(*[F.count(F.when(F.col(c), 1)).alias(c) for c in ("by_gate", "by_score", "by_product")])


@register("JN13_safe_negatives", POSITIONED + """, m AS (SELECT point_id, tile_id FROM p JOIN t ON p.city = t.city AND abs(p.x - t.x) <= (size + 250e0) / 2 AND abs(p.y - t.y) <= (size + 250e0) / 2),
o AS (SELECT point_id, tile_id FROM p, t WHERE greatest(0e0, (size + 1000e0) / 2 - abs(p.x - t.x)) * greatest(0e0, (size + 1000e0) / 2 - abs(p.y - t.y)) > 0), u AS (SELECT * FROM m UNION SELECT * FROM o)
SELECT point_id, positives, (SELECT count(*) FROM t) - touched AS safe, positives::DOUBLE AS weight FROM (SELECT point_id, count(*) AS positives FROM m GROUP BY point_id) JOIN (SELECT point_id, count(*) AS touched FROM u GROUP BY point_id) USING (point_id)""")
def safe(spark, sf_dir):
    ask, all_ = points(spark, sf_dir), tiles(spark, sf_dir)
    return P.relevance(ask, P.select("current_rule", ask, all_), all_)


@register("AG31_gate_stats", ctes("scores") + ", e AS (SELECT *, exp(score / 0.2e0) AS e FROM scores WHERE method = 'global'), p AS (SELECT frame_id, level, e / sum(e) OVER (PARTITION BY frame_id) AS b FROM e) SELECT level, round(avg(b), 6) AS mean, round(stddev_pop(b), 6) AS std, round(avg(CAST(b > 0.9e0 AS INT)), 6) AS dominant FROM p GROUP BY level")
def gate_stats(spark, sf_dir):
    from meridia.functions.stats import softmax

    rows = carrier(spark, sf_dir, "scores").filter("method = 'global'").withColumn("b", softmax(F.col("score"), ["frame_id"], 0.2))
    return rows.groupBy("level").agg(F.round(F.avg("b"), 6).alias("mean"), F.round(F.stddev_pop("b"), 6).alias("std"), F.round(F.avg((F.col("b") > 0.9).cast("int")), 6).alias("dominant"))
