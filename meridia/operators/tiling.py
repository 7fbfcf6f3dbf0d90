"""Tile jobs of map servers over an area, and the zoom that counts where rectangles of several zooms overlap."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import geo

#: Half of the world's side in grid units; the grid's origin is its lower left corner for jobs in metres, its upper left one for
#: numbered tiles.
HALF = math.pi * geo.EARTH
PIXELS = 256


def resolution(zoom: int) -> float:
    """Grid units of a pixel."""
    return 2 * HALF / (PIXELS * 2**zoom)


def metre_jobs(points: DataFrame, by: list[str], zoom: int, tile_px: int = PIXELS) -> DataFrame:
    """(by, col, row, x0, y0, x1, y1, col_off, row_off): squares of tile_px pixels that cover each group's points (x, y).

    The box of the points is widened to whole squares of the zoom's lattice; rows count from above. The offsets place a square
    in the mosaic of its group.
    """
    if not 0 < tile_px <= 4096:
        raise ValueError("a server gives at most 4096 pixels")
    step = tile_px * resolution(zoom)
    low, high = (lambda c: geo.snap_down(F.min(c), -HALF, step)), (lambda c: geo.snap_up(F.max(c), -HALF, step))
    box = points.groupBy(*by).agg(low("x").alias("_x"), low("y").alias("_y"), high("x").alias("_x1"), high("y").alias("_y1"))
    count = lambda a, b: F.rint((F.col(b) - F.col(a)) / step).cast("int")
    box = box.withColumn("_c", count("_x", "_x1")).withColumn("_r", count("_y", "_y1")).filter("_c > 0 AND _r > 0")
    jobs = box.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("_r") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    x0, y1 = F.col("_x") + F.col("col") * step, F.col("_y1") - F.col("row") * step
    return jobs.select(*by, "col", "row", x0.alias("x0"), (y1 - step).alias("y0"), (x0 + step).alias("x1"), y1.alias("y1"), (F.col("col") * tile_px).alias("col_off"), (F.col("row") * tile_px).alias("row_off"))


def numbered_jobs(points: DataFrame, by: list[str], zoom: int, clip: DataFrame | None = None) -> DataFrame:
    """(by, x, y, west, south, east, north, col_off, row_off): numbered tiles from the first to the last of each group's points
    (lat, lon).

    clip: (by, west, south, east, north); only tiles that meet their group's box, borders included.
    """
    tiles = points.select(*by, geo.slippy_x(F.col("lon"), zoom).alias("_x"), geo.slippy_y(F.col("lat"), zoom).alias("_y"))
    box = tiles.groupBy(*by).agg(*[f(c).alias(f"{c}{n}") for c in ("_x", "_y") for f, n in ((F.min, 0), (F.max, 1))])
    jobs = box.withColumn("y", F.explode(F.sequence("_y0", "_y1"))).withColumn("x", F.explode(F.sequence("_x0", "_x1")))
    side = PIXELS * resolution(zoom)
    lon = lambda n: geo.inverse_lon(n * side - HALF)
    lat = lambda n: geo.inverse_lat(HALF - n * side)
    x, y = F.col("x"), F.col("y")
    jobs = jobs.select(*by, "x", "y", lon(x).alias("west"), lat(y + 1).alias("south"), lon(x + 1).alias("east"), lat(y).alias("north"), ((x - F.col("_x0")) * PIXELS).alias("col_off"), ((y - F.col("_y0")) * PIXELS).alias("row_off"))
    if clip is None:
        return jobs
    area = clip.select(*by, *[F.col(c).alias(f"_{c}") for c in ("west", "south", "east", "north")])
    meets = (F.col("west") <= F.col("_east")) & (F.col("east") >= F.col("_west")) & (F.col("south") <= F.col("_north")) & (F.col("north") >= F.col("_south"))
    return jobs.join(area, by).filter(meets).select(*jobs.columns)


def capped_zooms(rects: DataFrame, most: int | None = None) -> DataFrame:
    """Rectangles without those that span the world from pole to pole, and with zooms of at most `most`."""
    rows = rects.filter(~((F.col("north") >= 89) & (F.col("south") <= -89)))
    return rows if most is None else rows.withColumn("zoom", F.least("zoom", F.lit(most)))


def effective_zooms(rects: DataFrame, area: DataFrame, by: list[str]) -> DataFrame:
    """(by, west, south, east, north, zoom): cells that don't overlap, each with the highest zoom of the rectangles over it.

    rects: by, west, south, east, north, zoom; area: by and a box, outside of which nothing counts. The plane of each group is
    cut at all borders of its rectangles, of which a server's answer has few.
    """
    box = area.select(*by, *[F.col(c).alias(f"_{c}") for c in ("west", "south", "east", "north")])
    inside = {"west": F.greatest("west", "_west"), "south": F.greatest("south", "_south"), "east": F.least("east", "_east"), "north": F.least("north", "_north")}
    cut = rects.join(box, by).select(*by, "zoom", *[v.alias(c) for c, v in inside.items()]).filter("west < east AND south < north")

    def strips(low: str, high: str) -> DataFrame:
        edges = cut.select(*by, F.explode(F.array(low, high)).alias(low)).distinct()
        over = Window.partitionBy(*by).orderBy(low)
        return edges.withColumn(high, F.lead(low).over(over)).filter(F.col(high).isNotNull())

    x, y = strips("west", "east"), strips("south", "north")
    of = cut.select(*by, *[F.col(c).alias(f"_{c}") for c in ("west", "south", "east", "north")], "zoom")

    def within(cells: DataFrame, low: str, high: str) -> Column:
        return (F.col(low) >= F.col(f"_{low}")) & (F.col(high) <= F.col(f"_{high}"))

    across = of.join(x, by).filter(within(x, "west", "east"))  # each rectangle's own strips, then its own cells
    cells = across.join(y, by).filter(within(y, "south", "north"))
    return cells.groupBy(*by, "west", "south", "east", "north").agg(F.max("zoom").alias("zoom"))


def read_windows(pixels: DataFrame, requests: DataFrame, block: int = 16) -> DataFrame:
    """(id, r, c, v): the pixels of each request's window, counted from its corner.

    requests: id, r0, c0, height, width, in pixels; what lies outside the raster has no row. Pixels and requests meet by blocks,
    so a window reads its own blocks and no others, and a pixel goes to the windows that hold it only. A window's blocks are
    those within the raster's own bounds, however far it reaches beyond them.
    """
    bounds = pixels.agg(*[f(c).alias(f"_{c}{n}") for c in ("r", "c") for f, n in ((F.min, 0), (F.max, 1))])
    asked = requests.filter("height > 0 AND width > 0").crossJoin(F.broadcast(bounds))
    for c, n in (("r", "height"), ("c", "width")):
        low, high = F.greatest(F.col(f"{c}0"), F.col(f"_{c}0")), F.least(F.col(f"{c}0") + F.col(n) - 1, F.col(f"_{c}1"))
        asked = asked.filter(F.col(f"{c}0").isNotNull() & (low <= high)).withColumn(f"_b{c}", F.explode(F.sequence(F.floor(low / block), F.floor(high / block))))
    held = pixels.select("r", "c", "v", F.floor(F.col("r") / block).alias("_br"), F.floor(F.col("c") / block).alias("_bc"))
    rows = asked.join(held, ["_br", "_bc"])
    rows = rows.select("id", (F.col("r") - F.col("r0")).alias("r"), (F.col("c") - F.col("c0")).alias("c"), "v", "height", "width")
    return rows.filter("r >= 0 AND c >= 0 AND r < height AND c < width").select("id", "r", "c", "v")


def read_levels(pixels: DataFrame, requests: DataFrame, sizes: list[int], block: int = 16) -> DataFrame:
    """(id, size, r, c, v): concentric square windows of several sizes around each request's centre (id, r, c), from one read of
    the largest; smaller ones are its middle."""
    top = max(sizes)
    asked = requests.select("id", (F.col("r") - top // 2).alias("r0"), (F.col("c") - top // 2).alias("c0"), F.lit(top).alias("height"), F.lit(top).alias("width"))
    rows = read_windows(pixels, asked, block).withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    edge = F.lit(top // 2) - F.floor(F.col("size") / 2)
    rows = rows.withColumn("r", F.col("r") - edge).withColumn("c", F.col("c") - edge)
    return rows.filter("r >= 0 AND c >= 0 AND r < size AND c < size").select("id", "size", "r", "c", "v")
