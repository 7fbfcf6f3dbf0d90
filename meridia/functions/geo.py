"""Scalar geometry as column expressions: Web-Mercator, axis-aligned squares, overlaps, lattices.

Two unit systems stand side by side: grid units are Mercator metres, true metres are grid units times cos(latitude).
A NaN number counts as missing. Squares that only touch don't overlap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6378137.0
SPHERE = 6371000.0
#: Fixed cosine of the ranking reports.
REPORT_COS = 0.657


def mercator_x(lon: Column) -> Column:
    return F.lit(EARTH) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    return F.lit(EARTH) * F.ln(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2))


def northing(lat: Column) -> Column:
    """mercator_y, but a latitude beyond the poles gives NaN, as a logarithm does in SQL, where mercator_y gives null."""
    return F.when(lat.isNotNull(), F.coalesce(mercator_y(lat), F.lit(float("nan"))))


def inverse_lon(x: Column) -> Column:
    return F.degrees(x / F.lit(EARTH))


def inverse_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / F.lit(EARTH))) - F.lit(1.5707963267948966))


def cos_lat(lat: Column) -> Column:
    """cos of a latitude; null and beyond 89 degrees is an error."""
    bad = lat.isNull() | F.isnan(lat) | (F.abs(lat) > 89)
    return F.when(bad, F.raise_error(F.concat(F.lit("latitude out of range: "), F.coalesce(lat.cast("string"), F.lit("null")))).cast("double")).otherwise(F.cos(F.radians(lat)))


def rounded(v: Column, digits: int) -> Column:
    """v in whole parts of 10 ** -digits, halves of the product away from zero, as DuckDB and C round. Spark's round() goes by the
    decimal text instead, and tells 48.515 from the binary number just below it."""
    unit = float(10**digits)
    x = v * unit
    rest = x % 1
    whole = (x - rest) + F.when(rest >= 0.5, 1.0).when(rest <= -0.5, -1.0).otherwise(0.0)
    return F.when(F.abs(x) < float("inf"), whole / unit).otherwise(v)


def to_grid(metres: Column, lat: Column) -> Column:
    return metres / F.cos(F.radians(lat))


def true_area(grid_area: Column, lat: Column) -> Column:
    return grid_area * F.pow(F.cos(F.radians(lat)), 2)


def true_distance(dx: Column, dy: Column, lat: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy) * F.cos(F.radians(lat))


def side(size: Column, fallback: float) -> Column:
    """A square's side; missing or not positive means the fallback."""
    return F.when(size.isNotNull() & ~F.isnan(size) & (size > 0), size).otherwise(F.lit(fallback))


def overlap_1d(a: Column, ra: Column, b: Column, rb: Column) -> Column:
    """Length that intervals of centres a, b and half lengths ra, rb share."""
    return F.greatest(F.lit(0.0), F.least(a + ra, b + rb) - F.greatest(a - ra, b - rb))


def square_intersection(ax: Column, ay: Column, a: Column, bx: Column, by: Column, b: Column) -> Column:
    """Area that squares of sides a and b share."""
    return overlap_1d(ax, a / 2, bx, b / 2) * overlap_1d(ay, a / 2, by, b / 2)


def rect_intersection(a: list[Column], b: list[Column]) -> Column:
    """Area that boxes (min x, min y, max x, max y) share."""
    dx = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    dy = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((dx <= 0) | (dy <= 0), F.lit(0.0)).otherwise(dx * dy)


def iou(shared: Column, a: Column, b: Column) -> Column:
    """Intersection over union of areas, within [0, 1]; an empty square is an error."""
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), shared / (a + b - shared)))
    return F.when((a <= 0) | (b <= 0), F.raise_error(F.lit("a square has no area")).cast("double")).otherwise(value)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * SPHERE) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def snap(v: Column, step: float) -> Column:
    """The nearest multiple of step; halves go to the even one."""
    return F.rint(v / step) * step


def snap_down(v: Column, origin: float, step: float) -> Column:
    return F.floor((v - origin) / step) * step + origin


def snap_up(v: Column, origin: float, step: float) -> Column:
    return F.ceil((v - origin) / step) * step + origin


def slippy_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180) / 360 * float(1 << zoom)).cast("long")


def slippy_y(lat: Column, zoom: int) -> Column:
    t = F.tan(F.radians(lat))
    asinh = F.signum(t) * F.ln(F.abs(t) + F.sqrt(t * t + 1))  # Spark's own cancels out below zero
    return F.floor((1 - asinh / F.lit(3.141592653589793)) / 2 * float(1 << zoom)).cast("long")


def corners(x: Column, y: Column, half: Column) -> Column:
    """The closed ring of a square, from its lower left corner."""
    at = lambda sx, sy: F.struct((x + sx * half).alias("x"), (y + sy * half).alias("y"))
    return F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1), at(-1, -1))
