"""`python -m meridia.cli build|audit|export-kmz|list DIR`: a leakage-free split of points.parquet and tiles.parquet in DIR.

build writes DIR/run and audit writes nothing; --checks names the checks that count, --solver the exact or the greedy one.
export-kmz writes DIR/split.kmz from DIR/run, with --tiles the positive tiles' squares too. Exit codes: 0 valid, 1 invalid, 2
infeasible.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from meridia import config
from meridia.functions import geo
from meridia.operators import assign, components, exact_split, positives
from meridia.sources import sinks


COLOURS = {"train": "ff00aa00", "val": "ff00aaff", "test": "ffff5500", "excluded": "ff888888"}


def export_kmz(spark: SparkSession, folder: str, s: config.Settings, with_tiles: bool = False) -> int:
    """DIR/split.kmz of a run: a placemark for each point, in its split's colour; how many marks."""
    points = spark.read.parquet(f"{folder}/points.parquet")
    splits = spark.read.json(f"{folder}/run/split").select("point_id", "split")
    rows = points.join(splits, "point_id")
    marks = sinks.placemarks(rows, "point_id", "lat", "lon", "split")
    if with_tiles:
        tiles = positives.positioned(spark.read.parquet(f"{folder}/tiles.parquet"))
        used = positives.select(s.rule, positives.positioned(points), tiles, positives.params(fallback_size=s.tile_size_m)).join(splits, "point_id")
        of = used.groupBy("tile_id").agg(F.min("split").alias("split"))
        ring = geo.corners(F.col("x"), F.col("y"), geo.side(F.col("size_m"), s.tile_size_m) / 2)
        at = F.transform(ring, lambda p: F.struct(geo.inverse_lon(p["x"]).alias("lon"), geo.inverse_lat(p["y"]).alias("lat")))
        marks = marks.unionByName(sinks.polygons(tiles.join(of, "tile_id").withColumn("ring", at), "tile_id", "ring", "split"))
    return sinks.write_kmz(f"{folder}/split.kmz", marks, "split", COLOURS)


def build(spark: SparkSession, folder: str, s: config.Settings, write: bool = True, checks: list[str] | None = None, exact: bool = False) -> int:
    points = positives.positioned(spark.read.parquet(f"{folder}/points.parquet"))
    tiles = positives.positioned(spark.read.parquet(f"{folder}/tiles.parquet"))
    matches = positives.best_matches(positives.select(s.rule, points, tiles, positives.params(fallback_size=s.tile_size_m))).cache()
    clusters = components.tile_clusters(tiles, s.tile_size_m, s.area_epsilon_m2)
    parts = components.point_components(matches, clusters).cache()
    splits, found = assign.assigned(parts, components.sizes(parts), s.ratios, s.tolerance, exact_split.best_or_greedy if exact else assign.solve)
    if found.status != "ok":
        print(found.message)
        return 2
    labelled = matches.select("point_id").distinct()
    audit = assign.audit(labelled, splits.select("point_id", "split"), matches, tiles, parts, s.ratios, s.tolerance, s.area_epsilon_m2).cache()
    if write:
        sinks.write_run(f"{folder}/run", splits, audit, components=parts, config=asdict(s))
    rows = [r for r in audit.orderBy("check").collect() if checks is None or r.check in checks]
    if checks is not None and len(rows) < len(set(checks)):
        raise ValueError(f"unknown checks: {', '.join(sorted(set(checks) - {r.check for r in rows}))}")
    for row in rows:
        print(f"{row.check}: {'ok' if row.ok else f'{row.n} wrong'}")
    return 0 if all(r.ok for r in rows) else 1


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=("build", "audit", "export-kmz", "list"))
    parser.add_argument("folder", nargs="?", default=".")
    parser.add_argument("--config")
    parser.add_argument("--rule")
    parser.add_argument("--tolerance", type=float)
    parser.add_argument("--checks", help="names of checks, parted by commas")
    parser.add_argument("--solver", choices=("greedy", "exact"), default="greedy")
    parser.add_argument("--tiles", action="store_true")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(positives.RULES)))
        return 0
    given = {"rule": args.rule, "tolerance": args.tolerance}
    s = config.load(args.config, **given) if args.config else config.settings(**given)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "export-kmz":
        print(f"{export_kmz(spark, args.folder, s, args.tiles)} placemarks")
        return 0
    checks = args.checks.split(",") if args.checks else None
    return build(spark, args.folder, s, args.command == "build", checks, args.solver == "exact")


if __name__ == "__main__":
    sys.exit(main())
