"""Descriptors of token grids: k-means, residual sums (VLAD), pooling. Tokens: tile_id, r, c, vec."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.functions import vec
from meridia.sources.scratch import written


def positional(df: DataFrame, by: list[str], vector: str = "vec", weight: Column | None = None) -> DataFrame:
    """(by, i, x): element i of the weighted sum of each group's vectors, as rows: sums are combined before the shuffle."""
    rows = df.select(*by, (F.lit(1.0) if weight is None else weight).alias("_w"), F.posexplode(vector).alias("i", "x"))
    return rows.groupBy(*by, "i").agg(F.sum(F.col("_w") * F.col("x").cast("double")).alias("x"), F.sum("_w").alias("w"))


def gathered(rows: DataFrame, by: list[str], out: str = "vec") -> DataFrame:
    """Element rows (by, i, x) as an array again; a group is one vector."""
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias(out))


def mean_pool(tokens: DataFrame, by: list[str]) -> DataFrame:
    return gathered(positional(tokens, by).withColumn("x", F.col("x") / F.col("w")), by)


def pool_cells(position: Column, n: int, g: int) -> Column:
    """The cells of g that adaptive pooling puts position of n in: cell i takes floor(i * n / g) to ceil((i + 1) * n / g)."""
    cells = F.sequence(F.lit(0), F.lit(g - 1))
    return F.filter(cells, lambda i: (position >= F.floor(i * n / g)) & (position < F.ceil((i + 1) * n / g)))


def adaptive_pool(tokens: DataFrame, n: int, g: int) -> DataFrame:
    """(tile_id, cr, cc, vec): means of g x g overlapping cells of an n x n grid."""
    rows = tokens.withColumn("cr", F.explode(pool_cells(F.col("r"), n, g))).withColumn("cc", F.explode(pool_cells(F.col("c"), n, g)))
    return mean_pool(rows, ["tile_id", "cr", "cc"])


def assigned(tokens: DataFrame, centroids: DataFrame) -> DataFrame:
    """Tokens with k, the nearest centroid (k, centre), and d2; equal distances go to the smaller k.

    The centroids are a dictionary of a stated size; each token keeps only its least distance.
    """
    d2 = F.aggregate(F.zip_with("vec", "centre", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda t, x: t + x)
    keys = [c for c in tokens.columns if c != "vec"]
    near = tokens.crossJoin(centroids).withColumn("d2", d2).groupBy(*keys).agg(F.min(F.struct("d2", "k")).alias("m"), F.first("vec").alias("vec"))
    return near.select(*keys, "vec", F.col("m.k").alias("k"), F.col("m.d2").alias("d2"))


def kmeans(points: DataFrame, k: int, steps: int = 20, tolerance: float = 1e-4, seed: int = 0, id_: str = "id") -> tuple[DataFrame, DataFrame]:
    """(centroids (k, centre), trace (step, inertia, moved)) by Lloyd's steps from k points that a hash of the seed picks.

    A cluster that loses all its points gets the point that lies farthest from its own centre.
    """
    spark = points.sparkSession
    order = F.xxhash64(F.lit(seed), id_), F.col(id_)
    first = points.orderBy(*order).limit(k).withColumn("k", F.row_number().over(Window.orderBy(*order)) - 1)
    centroids = written(first.select("k", F.transform("vec", lambda x: x.cast("double")).alias("centre")))
    trace = []
    for step in range(steps):
        near = written(assigned(points.select(F.col(id_).alias("id"), "vec"), centroids))
        inertia = near.agg(F.sum("d2")).first()[0]
        means = gathered(positional(near, ["k"]).withColumn("x", F.col("x") / F.col("w")), ["k"], "centre")
        lost = centroids.join(means, "k", "left_anti").select("k").withColumn("n", F.row_number().over(Window.orderBy("k")))
        far = near.orderBy(F.col("d2").desc(), "id").limit(k).select(F.row_number().over(Window.orderBy(F.col("d2").desc(), "id")).alias("n"), F.transform("vec", lambda x: x.cast("double")).alias("centre"))
        new = written(means.unionByName(lost.join(far, "n").select("k", "centre")))
        shift = new.join(centroids.withColumnRenamed("centre", "old"), "k").agg(F.max(vec.norm(F.zip_with("centre", "old", lambda a, b: a - b)))).first()[0]
        centroids = new
        trace.append((step, float(inertia or 0.0), float(shift or 0.0)))
        if (shift or 0.0) <= tolerance:
            break
    return centroids, spark.createDataFrame(trace, "step int, inertia double, moved double")


def vlad(tokens: DataFrame, centroids: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """(by, k, i, x): sums of residuals to the nearest centroid, scaled to length 1 for each cluster and then for each group."""
    near = assigned(tokens, centroids)
    residual = F.zip_with("vec", "centre", lambda a, b: a.cast("double") - b)
    rows = near.join(centroids, "k").withColumn("residual", residual)
    sums = positional(rows, [*by, "k"], "residual", weight).drop("w")
    inner, outer = Window.partitionBy(*by, "k"), Window.partitionBy(*by)
    sums = sums.withColumn("x", F.col("x") / F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x")).over(inner)), F.lit(1e-12)))
    return sums.withColumn("x", F.col("x") / F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x")).over(outer)), F.lit(1e-12)))


def residual_query(tokens: DataFrame, centroids: DataFrame, by: list[str]) -> DataFrame:
    """(by, k, i, x): the same sums as the tokens' sum less their number times the centroid, not scaled."""
    sums = positional(assigned(tokens, centroids), [*by, "k"])
    centre = centroids.select("k", F.posexplode("centre").alias("i", "c"))
    return sums.join(centre, ["k", "i"]).select(*by, "k", "i", (F.col("x") - F.col("w") * F.col("c")).alias("x"))


def soft_vlad(tokens: DataFrame, centroids: DataFrame, by: list[str], tau: float = 0.2) -> DataFrame:
    """(by, k, i, x): residuals to every centroid of a dictionary of stated size, weighted by the softmax over centroids of the
    token's product with them, summed, and scaled to length 1 for each group."""
    pairs = tokens.withColumn("_t", F.monotonically_increasing_id()).crossJoin(F.broadcast(centroids))
    z = F.aggregate(F.zip_with("vec", "centre", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda t, x: t + x) / tau
    rows = pairs.withColumn("_z", z)
    over = Window.partitionBy("_t")
    rows = rows.withColumn("_e", F.exp(F.col("_z") - F.max("_z").over(over))).withColumn("_p", F.col("_e") / F.sum("_e").over(over))
    rows = rows.withColumn("residual", F.zip_with("vec", "centre", lambda a, b: a.cast("double") - b))
    sums = positional(rows, [*by, "k"], "residual", F.col("_p")).drop("w")
    return sums.withColumn("x", F.col("x") / F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(*by))), F.lit(1e-12)))


def concentric_weight(r: Column, c: Column, n: int, share: float) -> Column:
    """The part of token (r, c) of an n x n grid that the centred square of this share of the side covers."""
    low, high = n * (1 - share) / 2, n * (1 + share) / 2
    part = lambda p: F.greatest(F.lit(0.0), F.least(p + 1.0, F.lit(high)) - F.greatest(p.cast("double"), F.lit(low)))
    return part(r) * part(c)


def concentric_levels(spark: SparkSession, height: int, width: int, sizes: list[float], side: float) -> DataFrame:
    """(size, weight_sum, side_h, side_w, r0, r1, c0, c1, error_r, error_c) of each centred square of a grid: the sum of its tokens'
    weights, along each axis their sum and the first and last token of any weight, and how far their centre is from the
    grid's."""
    cells = spark.range(height * width).select(F.floor(F.col("id") / width).alias("r"), (F.col("id") % width).alias("c"))
    rows = cells.withColumn("size", F.explode(F.array(*[F.lit(float(s)) for s in sizes])))

    def along(p: str, n: int) -> Column:
        low, high = 0.5 - F.col("size") / (2 * side), 0.5 + F.col("size") / (2 * side)
        part = F.least((F.col(p) + 1) / F.lit(float(n)), high) - F.greatest(F.col(p) / F.lit(float(n)), low)
        return F.least(F.greatest(part, F.lit(0.0)) * n, F.lit(1.0))

    rows = rows.withColumn("_h", along("r", height)).withColumn("_w", along("c", width)).withColumn("w", F.col("_h") * F.col("_w"))
    edge = lambda f, p, w: f(F.when(F.col(w) > 0, F.col(p)))
    centre = lambda p, n: F.abs(F.sum(F.col(p) * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-12)) - (n - 1) / 2)
    return rows.groupBy("size").agg(
        F.sum("w").alias("weight_sum"), (F.sum("_h") / width).alias("side_h"), (F.sum("_w") / height).alias("side_w"),
        edge(F.min, "r", "_h").alias("r0"), edge(F.max, "r", "_h").alias("r1"), edge(F.min, "c", "_w").alias("c0"), edge(F.max, "c", "_w").alias("c1"),
        centre("r", height).alias("error_r"), centre("c", width).alias("error_c"),
    )


def projected(rows: DataFrame, matrix: DataFrame, by: list[str], width: int, out: int) -> DataFrame:
    """(by, j, y): vectors times a matrix (j, i, w) that comes as data, of stated size; vectors that are no longer than `out` stay
    as they are."""
    parts = rows.select(*by, F.posexplode("vec").alias("i", "x"))
    if out >= width:
        return parts.select(*by, F.col("i").cast("long").alias("j"), F.col("x").cast("double").alias("y"))
    return parts.join(F.broadcast(matrix), "i").groupBy(*by, "j").agg(F.sum(F.col("x").cast("double") * F.col("w")).alias("y"))


def gaussian(spark: SparkSession, width: int, out: int, seed: int = 0) -> DataFrame:
    """(j, i, w): a matrix of normal numbers over sqrt(out), from MD5 by Box and Muller's rule, the same in every engine."""
    u = lambda n: (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "j", "i", F.lit(n))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    grid = spark.range(width * out).select((F.col("id") % out).alias("j"), F.floor(F.col("id") / out).alias("i"))
    return grid.select("j", "i", (F.sqrt(-2 * F.ln(u("a"))) * F.cos(2 * 3.141592653589793 * u("b")) / float(out) ** 0.5).alias("w"))


def best_by(gates: DataFrame) -> DataFrame:
    """gates (frame_id, level, b, s) with by_gate, by_score, by_product: whether the level has its frame's largest weight b,
    score s, product of both; ties, within nine decimals, go to the smaller level."""
    first = lambda v: F.row_number().over(Window.partitionBy("frame_id").orderBy(F.round(v, 9).desc(), "level")) == 1
    return gates.select("*", first(F.col("b")).alias("by_gate"), first(F.col("s")).alias("by_score"), first(F.col("b") * F.col("s")).alias("by_product"))


def gate_summary(gates: DataFrame, collapse: float = 0.9) -> DataFrame:
    """One row of all frames: n, mean and least entropy of their weights, the share in which the three best levels disagree, the
    level that most gates prefer, its share, and whether that share exceeds `collapse`."""
    at = lambda c: F.max(F.when(F.col(c), F.col("level")))
    entropy = -F.sum(F.col("b") * F.ln(F.greatest(F.col("b"), F.lit(1e-9))))
    frames = best_by(gates).groupBy("frame_id").agg(at("by_gate").alias("g"), at("by_score").alias("s"), at("by_product").alias("c"), entropy.alias("h"))
    differ = ((F.col("s") != F.col("g")) | (F.col("c") != F.col("g")) | (F.col("s") != F.col("c"))).cast("int")
    by = frames.groupBy("g").agg(F.count("*").alias("k"), F.sum("h").alias("h"), F.min("h").alias("least"), F.sum(differ).alias("d"))
    n, top = F.sum("k"), F.max(F.struct("k", -F.col("g")))
    out = by.agg(n.alias("n"), (F.sum("h") / n).alias("entropy_mean"), F.min("least").alias("entropy_min"), (F.sum("d") / n).alias("disagree"), top.alias("_t"))
    share = F.col("_t.k") / F.col("n")
    return out.select("n", "entropy_mean", "entropy_min", "disagree", (-F.col("_t.col2")).alias("dominant"), share.alias("dominant_share"), (share > collapse).alias("collapse"))
