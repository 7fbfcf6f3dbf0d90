"""Connected components, and the components of points that overlapping tiles bridge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import geo
from meridia.operators.box_join import self_pairs
from meridia.sources.scratch import written


def connected(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, component) of every vertex v: the least vertex that edges (a, b) reach; a vertex without edges is its own.

    Each step hooks a vertex, and the vertex that its label names, onto the least label's label among its neighbours, and takes
    its own label's label, so that trees merge by their roots and paths shrink at once: a path of n edges needs about log n
    steps. Steps are written tables, so the plan doesn't grow. A step that changes nothing ends it.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = written(vertices.select("v", F.col("v").alias("f")).distinct())
    while True:
        two = labels.join(labels.select(F.col("v").alias("f"), F.col("f").alias("g")), "f").select("v", "f", "g")
        met = both.join(two.select(F.col("v").alias("a"), F.col("f").alias("fa")), "a").join(two.select(F.col("v").alias("b"), F.col("g").alias("gb")), "b")
        near = met.groupBy("a").agg(F.min("fa").alias("fa"), F.min("gb").alias("gb"))
        offers = near.select(F.col("fa").alias("v"), "gb").unionByName(near.select(F.col("a").alias("v"), "gb")).unionByName(two.select("v", F.col("g").alias("gb")))
        best = offers.groupBy("v").agg(F.min("gb").alias("gb"))
        step = written(labels.join(best, "v").select("v", F.col("f").alias("old"), F.least("f", "gb").alias("f")))
        labels = step.select("v", "f")
        if step.filter("old <> f").isEmpty():
            return labels.select("v", F.col("f").alias("component"))


def numbered(df: DataFrame, key: str, out: str) -> DataFrame:
    """Adds `out`: the rows' numbers from 0 in order of the key. Ranges of the key are counted, and each is numbered from the sum
    of those before it, so no task sees all rows."""
    rows = written(df.repartitionByRange(key).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return rows.join(F.broadcast(offsets), "_p").withColumn(out, (F.col("_o") + place).cast("int")).drop("_p", "_o")


def overlap_true_m2(fallback: float) -> Column:
    """Shared area in true square metres of a pair of tiles (left columns and r_): grid squares at the mean latitude."""
    a, b = geo.side(F.col("size_m"), fallback), geo.side(F.col("r_size_m"), fallback)
    shared = geo.square_intersection(F.col("x"), F.col("y"), a, F.col("r_x"), F.col("r_y"), b)
    return geo.true_area(shared, (F.col("lat") + F.col("r_lat")) / 2)


def overlapping(tiles: DataFrame, fallback: float = 1000.0, epsilon: float = 1.0) -> DataFrame:
    """(a, b, area) of unordered pairs of tiles that share more than epsilon true square metres."""
    reach = tiles.agg(F.max(geo.side(F.col("size_m"), fallback))).first()[0] or fallback
    pairs = self_pairs(tiles, "tile_id", reach).withColumn("area", overlap_true_m2(fallback))
    return pairs.filter(F.col("area") > epsilon).select(F.col("tile_id").alias("a"), F.col("r_tile_id").alias("b"), "area")


def tile_clusters(tiles: DataFrame, fallback: float = 1000.0, epsilon: float = 1.0) -> DataFrame:
    """(tile_id, cluster): tiles that a chain of overlaps joins; the cluster is its least tile."""
    found = connected(tiles.select(F.col("tile_id").alias("v")), overlapping(tiles, fallback, epsilon))
    return found.select(F.col("v").alias("tile_id"), F.col("component").alias("cluster"))


def point_components(matches: DataFrame, clusters: DataFrame) -> DataFrame:
    """(point_id, component_id, name): points that share clusters; numbered from 0 by their least point, the name."""
    links = matches.select("point_id", "tile_id").join(clusters, "tile_id").select("point_id", "cluster").distinct()
    hub = links.groupBy("cluster").agg(F.min("point_id").alias("b"))  # a star for each cluster, not all its pairs
    edges = links.join(hub, "cluster").select(F.col("point_id").alias("a"), "b")
    found = connected(links.select(F.col("point_id").alias("v")), edges)
    names = numbered(found.select("component").distinct(), "component", "component_id")
    return found.join(names, "component").select(F.col("v").alias("point_id"), "component_id", F.col("component").alias("name"))


def sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component_id", "name").agg(F.count("*").alias("size"))
