"""Ways of a street map: their classes, the text that asks for them, and masks that their lines and areas burn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.operators.raster import polygon_pixels

# The bands of a mask in their order, and the road classes among them.
BANDS = ("waterway", "natural_water", "motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service", "road", "track")
ROADS = BANDS[2:]


def way_class(tags: Column) -> Column:
    """The class of a way by its tags (a map): a known road, else a waterway, else water; null for others."""
    road = F.try_element_at(tags, F.lit("highway"))
    return (
        F.when(road.isin(*ROADS), road)
        .when(F.map_contains_key(tags, "waterway"), "waterway")
        .when(F.try_element_at(tags, F.lit("natural")) == "water", "natural_water")
    )


def query_text(south: Column, west: Column, north: Column, east: Column, timeout: int = 120) -> Column:
    """The text that asks a map server for the ways of a box."""
    box = F.concat_ws(",", *(c.cast("string") for c in (south, west, north, east)))
    ways = [f'way["highway"~"^({"|".join(sorted(ROADS))})$"]', 'way["waterway"]', 'way["natural"="water"]']
    lines = [F.concat(F.lit(f"  {w}("), box, F.lit(");\n")) for w in ways]
    return F.concat(F.lit(f"[out:json][timeout:{timeout}];\n(\n"), *lines, F.lit(");\nout body;\n>;\nout skel qt;\n"))


def touched_pixels(segments: DataFrame, by: list[str], height: int, width: int) -> DataFrame:
    """(by, r, c) of the pixels that segments x0, y0, x1, y1 (in pixels) touch, once each.

    A segment meets the rows between its ends; in a row it runs over the columns between its crossings with the row's borders.
    Pixel (r, c) is [r, r + 1) x [c, c + 1); an end on a border belongs to the pixel behind it.
    """
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = segments.select(*by, "x0", "y0", "x1", "y1").withColumn("r", F.explode(F.sequence(F.floor(low), F.floor(high))))
    rows = rows.filter((F.col("r") >= 0) & (F.col("r") < height))
    at = lambda y: F.col("x0") + (F.least(F.greatest(y, low), high) - F.col("y0")) * (F.col("x1") - F.col("x0")) / F.nullif(F.col("y1") - F.col("y0"), F.lit(0.0))
    flat = F.col("y0") == F.col("y1")
    a = F.when(flat, F.col("x0")).otherwise(at(F.col("r").cast("double")))
    b = F.when(flat, F.col("x1")).otherwise(at(F.col("r") + 1.0))
    first, last = F.greatest(F.floor(F.least(a, b)), F.lit(0)), F.least(F.floor(F.greatest(a, b)), F.lit(width - 1))
    rows = rows.select(*by, "r", first.alias("_a"), last.alias("_b")).filter("_b >= _a")
    return rows.select(*by, "r", F.explode(F.sequence("_a", "_b")).alias("c")).distinct()


def burned(lines: DataFrame, areas: DataFrame, by: list[str], height: int, width: int) -> DataFrame:
    """(by, r, c) of set pixels: all that lines touch, and of areas (their edges) what their borders touch and their inside.

    by: the image, and the band where each class has a mask of its own; leave the band out for one mask of all. An image
    without a set pixel has no row.
    """
    edges = lines.select(*by, "x0", "y0", "x1", "y1").unionByName(areas.select(*by, "x0", "y0", "x1", "y1"))
    inside = polygon_pixels(areas, by, height, width).select(*by, "r", "c")
    return touched_pixels(edges, by, height, width).unionByName(inside).distinct()
