"""Registries of interchangeable steps: estimators, fusions, aggregations and maskers. A name is taken once; an unknown one is
an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import stats
from meridia.operators import descriptors, rank, raster


class Registry:
    def __init__(self, what: str) -> None:
        self.what, self.known = what, {}

    def add(self, name: str, *aliases: str) -> Callable[[Callable], Callable]:
        def put(f: Callable) -> Callable:
            for n in (name, *aliases):
                if n in self.known:
                    raise ValueError(f"{self.what} {n!r} is registered already")
                self.known[n] = f
            return f

        return put

    def __getitem__(self, name: str) -> Callable:
        if name not in self.known:
            raise ValueError(f"unknown {self.what} {name!r}; there are {', '.join(sorted(self.known))}")
        return self.known[name]


ESTIMATORS, FUSIONS, AGGREGATIONS, MASKERS = (Registry(x) for x in ("estimator", "fusion", "aggregation", "masker"))


# Estimators: fn(scores of token pairs (frame_id, level, q, t, s), tokens of a query, tokens of a level) -> (frame_id, level, score)


@ESTIMATORS.add("patch_overlap")
def patch_overlap(scores: DataFrame, n_queries: int, n_tiles: int) -> DataFrame:
    return rank.patch_overlap(scores, ["frame_id", "level"], n_queries, n_tiles).select("frame_id", "level", "score")


@ESTIMATORS.add("chamfer")
def chamfer(scores: DataFrame, n_queries: int, n_tiles: int) -> DataFrame:
    return rank.cheap_scores(scores, ["frame_id", "level"], n_queries).select("frame_id", "level", F.col("chamfer").alias("score"))


@ESTIMATORS.add("mutual_share")
def mutual_share(scores: DataFrame, n_queries: int, n_tiles: int) -> DataFrame:
    return rank.cheap_scores(scores, ["frame_id", "level"], n_queries).select("frame_id", "level", F.col("mnn").alias("score"))


# Fusions: fn(level scores (frame_id, method, level, score)) -> (frame_id, level, weight)


@FUSIONS.add("rank_vote")
def rank_vote(scores: DataFrame) -> DataFrame:
    """Reciprocal ranks of all methods, as a softmax."""
    fused = rank.reciprocal_rank_fusion(scores, "frame_id", "method", "level")
    return fused.withColumn("weight", stats.softmax(F.col("score"), ["frame_id"], 0.01)).drop("score")


@FUSIONS.add("mean")
def mean(scores: DataFrame) -> DataFrame:
    fused = scores.groupBy("frame_id", "level").agg(F.avg("score").alias("score"))
    return fused.withColumn("weight", stats.softmax(F.col("score"), ["frame_id"], 0.1)).drop("score")


@FUSIONS.add("cascade")
def cascade(scores: DataFrame, first: str = "global", then: str = "patch", most: int = 3, tau: float = 0.1) -> DataFrame:
    """The softmax of the second method over the `most` best levels of the first; other levels weigh nothing."""
    of = lambda m: F.max(F.when(F.col("method") == m, F.col("score")))
    rows = scores.groupBy("frame_id", "level").agg(of(first).alias("a"), of(then).alias("b"))
    place = F.row_number().over(Window.partitionBy("frame_id").orderBy(F.col("a").desc_nulls_last(), "level"))
    rows = rows.withColumn("_n", place)
    return rows.select("frame_id", "level", stats.softmax(F.col("b"), ["frame_id"], tau, F.col("_n") <= most).alias("weight"))


# Aggregations: fn(tokens, dictionary (k, centre), keys) -> (keys, k, i, x)


@AGGREGATIONS.add("vlad")
def vlad(tokens: DataFrame, centroids: DataFrame, by: list[str]) -> DataFrame:
    return descriptors.vlad(tokens, centroids, by)


@AGGREGATIONS.add("supervlad", "residual")
def supervlad(tokens: DataFrame, centroids: DataFrame, by: list[str]) -> DataFrame:
    """Residuals to every centroid, weighted by the softmax of their products."""
    return descriptors.soft_vlad(tokens, centroids, by)


@AGGREGATIONS.add("query")
def query(tokens: DataFrame, centroids: DataFrame, by: list[str]) -> DataFrame:
    return descriptors.residual_query(tokens, centroids, by)


# Maskers, in the order in which they are asked: fn(frames with a key) -> (key, keep)


@MASKERS.add("stored")
def stored(masks: DataFrame, key: str = "frame_id") -> DataFrame:
    """Masks that were written before."""
    return masks.filter("mask IS NOT NULL").select(key, F.col("mask").alias("keep"))


@MASKERS.add("blocks")
def blocks(masks: DataFrame, key: str = "frame_id", most: float = 0.2) -> DataFrame:
    """Blocks whose share of sky is at most `most`; masks: key, sky_share (an array)."""
    return masks.filter("sky_share IS NOT NULL").select(key, F.transform("sky_share", lambda s: s <= most).alias("keep"))


@MASKERS.add("everything")
def everything(masks: DataFrame, key: str = "frame_id") -> DataFrame:
    """Keeps all of a grid of n tokens; masks: key, n."""
    return masks.select(key, F.array_repeat(F.lit(True), F.col("n").cast("int")).alias("keep"))


def masked(frames: DataFrame, names: list[str], key: str = "frame_id") -> DataFrame:
    """(key, keep, backend): each frame's mask by the first masker that has one; that none has it is an error."""
    found = raster.resolved(frames, [MASKERS[n](frames, key) for n in names], key, "keep")
    return found.withColumn("backend", F.get(F.array(*map(F.lit, names)), F.col("backend")))


def estimated(scores: DataFrame, fusion: str = "rank_vote") -> DataFrame:
    """(frame_id, level, weight, top): a frame's levels under a fusion, and which is the best."""
    order = Window.partitionBy("frame_id").orderBy(F.col("weight").desc(), "level")
    return FUSIONS[fusion](scores).withColumn("top", F.row_number().over(order) == 1)
