"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm._store import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of every vertex of edges (a, b): the smallest vertex that it can reach.

    Each step takes the least label of all neighbours and then the label of one's label, so a path of n edges needs about
    log n steps. Every step is a written table; vertices and edges stay distributed, and a vertex with very many edges is
    summed in parts.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), free=False)
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("label")), free=False)
    before = labels
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        least = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        step = written(least.join(jump, "label", "left").select("v", "old", F.least("label", "far").alias("label")), free=False)
        discard(before)
        labels, before = step.select("v", "label"), step
        if step.filter("old <> label").isEmpty():
            discard(both)
            return labels
