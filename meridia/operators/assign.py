"""Assignment of whole components to train, val and test near given ratios, and its audit.

The assignment needs components' sizes only. A component's members never part. Largest components go first, each to the
split that lacks most; if that misses the tolerance, components are left out one by one, the one whose absence leaves the
least deviation, until it fits or three are left. That no assignment fits is a result, not an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.operators.components import overlapping
from meridia.sources.scratch import written

SPLITS = ("train", "val", "test")
EXCLUDED = "excluded"
RATIOS = (0.7, 0.15, 0.15)


@dataclass
class Outcome:
    status: str
    splits: dict[int, str] = field(default_factory=dict)
    left_out: bool = False
    proven: bool = False
    message: str = ""


def _deal(order: list[tuple[int, int]], ratios: tuple[float, ...], without: int | None = None) -> tuple[dict[int, int], list[int], int]:
    """Deals (component, size), in order, to the split that lacks most; equal lacks go to the first split."""
    total = sum(n for c, n in order if c != without)
    got, out = [0] * len(ratios), {}
    for c, n in order:
        if c != without:
            s = max(range(len(ratios)), key=lambda i: (ratios[i] * total - got[i], -i))
            out[c], got[s] = s, got[s] + n
    return out, got, total


def _deviation(got: list[int], total: int, ratios: tuple[float, ...]) -> float:
    return max(abs(g / total - r) for g, r in zip(got, ratios, strict=True)) if total and all(got) else float("inf")


def solve(components: list[tuple[int, int, object]], ratios: tuple[float, ...] = RATIOS, tolerance: float = 0.05) -> Outcome:
    """components: (id, size, name)."""
    if len(components) < len(ratios):
        return Outcome("infeasible", message=f"{len(components)} components can't fill {len(ratios)} splits")
    of = {c: (n, name) for c, n, name in components}
    order = sorted(((c, n) for c, n, _ in components), key=lambda x: (-x[1], of[x[0]][1]))
    out, got, total = _deal(order, ratios)
    dropped: list[int] = []
    while _deviation(got, total, ratios) > tolerance + 1e-12:
        if len(order) <= len(ratios):
            return Outcome("infeasible", message="no split is within the tolerance, even without some components")
        seen: dict[int, tuple[float, int, object, int]] = {}
        for c, n in reversed(order):  # of components of one size, the first by name decides: the others deal alike
            if n not in seen or of[c][1] < seen[n][2]:
                _, g, t = _deal(order, ratios, c)
                seen[n] = (_deviation(g, t, ratios), n, of[c][1], c)
        best = heapq.nsmallest(1, seen.values())[0]
        if best[0] == float("inf"):
            return Outcome("infeasible", message="without any component a split is empty")
        dropped.append(best[3])
        order = [x for x in order if x[0] != best[3]]
        out, got, total = _deal(order, ratios)
    splits = {c: SPLITS[s] for c, s in out.items()} | dict.fromkeys(dropped, EXCLUDED)
    return Outcome("ok", splits, bool(dropped))


def assigned(components: DataFrame, sizes: DataFrame, ratios: tuple[float, ...] = RATIOS, tolerance: float = 0.05, solver: Callable[..., Outcome] = solve) -> tuple[DataFrame, Outcome]:
    """(point_id, component_id, split) and the outcome. Only a row for each component goes to the driver, in order of size.

    solver: solve, the greedy one, or exact_split.best_or_greedy.
    """
    spark = components.sparkSession
    found = solver([tuple(r) for r in sizes.select("component_id", "size", "name").collect()], ratios, tolerance)
    kind = T.StructType.fromDDL("component_id int, split string")
    table = spark.createDataFrame(list(found.splits.items()), kind)
    return components.join(table, "component_id").select("point_id", "component_id", "split"), found


def assigned_by(components: DataFrame, key: str, ratios: tuple[float, ...] = RATIOS, tolerance: float = 0.05) -> DataFrame:
    """(key, component_id, split, status) of each component, solved for each key apart; a group holds components, not points."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        found = solve([(int(c), int(n), name) for c, n, name in zip(pdf.component_id, pdf["size"], pdf.name, strict=True)], ratios, tolerance)
        return pdf.assign(split=[found.splits.get(int(c)) for c in pdf.component_id], status=found.status)[[key, "component_id", "split", "status"]]

    kinds = {f.name: f.dataType.simpleString() for f in components.schema.fields}
    return components.groupBy(key).applyInPandas(one, f"{key} {kinds[key]}, component_id {kinds['component_id']}, split string, status string")


def audit(points: DataFrame, splits: DataFrame, matches: DataFrame, tiles: DataFrame, components: DataFrame, ratios: tuple[float, ...] = RATIOS, tolerance: float = 0.05, epsilon: float = 1.0) -> DataFrame:
    """(check, ok, n): each hard check, recomputed from the relations themselves.

    points: all that must be labelled; splits: (point_id, split).
    """
    splits, components = written(splits), written(components)  # each is read by several checks
    kept = splits.filter(F.col("split").isin(*SPLITS))
    tile_splits = written(matches.join(kept, "point_id").select("tile_id", "split").distinct())
    shared = tile_splits.groupBy("tile_id").agg(F.count("*").alias("n")).filter("n > 1")
    pairs = overlapping(tiles.join(tile_splits.select("tile_id").distinct(), "tile_id", "left_semi"), epsilon=epsilon)
    crossing = pairs.join(tile_splits.select(F.col("tile_id").alias("a"), F.col("split").alias("sa")), "a").join(tile_splits.select(F.col("tile_id").alias("b"), F.col("split").alias("sb")), "b").filter("sa <> sb").select("a", "b").distinct()
    torn = components.join(splits.select("point_id", "split"), "point_id", "left").groupBy("component_id").agg(F.countDistinct(F.coalesce("split", F.lit("?"))).alias("n")).filter("n > 1")
    unlabelled = points.join(splits, "point_id", "left_anti").select("point_id").union(splits.join(points, "point_id", "left_anti").select("point_id"))
    strange = splits.filter(~F.col("split").isin(*SPLITS, EXCLUDED))
    counted = [("partition_complete", unlabelled), ("valid_labels", strange), ("components_atomic", torn), ("tile_id_disjoint", shared), ("geo_disjoint", crossing.union(shared.select("tile_id", "tile_id")))]
    checks = None
    for name, bad in counted:
        row = bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), (F.col("n") == 0).alias("ok"), F.col("n"))
        checks = row if checks is None else checks.unionByName(row)
    per = kept.agg(*[F.count(F.when(F.col("split") == s, 1)).alias(s) for s in SPLITS], F.count("*").alias("n"))
    worst = F.greatest(*[F.abs(F.try_divide(F.col(s), F.col("n")) - r) for s, r in zip(SPLITS, ratios, strict=True)])
    fits = (F.least(*SPLITS) >= 1) & (F.coalesce(worst, F.lit(1.0)) <= tolerance + 1e-12)
    return checks.unionByName(per.select(F.lit("ratios_within_tolerance").alias("check"), fits.alias("ok"), F.when(fits, 0).otherwise(1).cast("long").alias("n")))


def split_counts(splits: DataFrame) -> DataFrame:
    """(split, n, share): excluded points are counted, but not in the shares' denominator."""
    kept = F.col("split").isin(*SPLITS)
    per = splits.groupBy("split").agg(F.count("*").alias("n"))
    total = per.filter(kept).agg(F.sum("n").alias("_t"))
    return per.crossJoin(total).select("split", "n", F.when(kept, F.try_divide(F.col("n"), F.col("_t"))).otherwise(0.0).alias("share"))


def outcome_row(spark: SparkSession, found: Outcome) -> DataFrame:
    return spark.createDataFrame([(found.status, found.left_out, found.proven, found.message)], "status string, deletion_used boolean, optimality_proven boolean, message string")
