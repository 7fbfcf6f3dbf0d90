"""Checks of rows: which of a job's tiles are wrong, which images were taken at night, which keys and frames are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Images of less mean chroma were taken at night.
NIGHT = 12.0


def first_error(sent: Column, got: Column, shape: list[Column], expected: tuple[int, int, int], kind: Column, col: Column, row: Column, width: Column, height: Column, total_width: Column, total_height: Column) -> Column:
    """What is wrong with a tile first, or null: its shape (bands, rows, columns), type, job, and window in the mosaic."""
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    same = F.lit(True)
    for s, e in zip(shape, expected, strict=True):
        same = same & s.eqNullSafe(F.lit(e))
    whole = shape[0].isNotNull() & shape[1].isNotNull() & shape[2].isNotNull()
    return (
        F.when(~whole, "no array of three dimensions")
        .when(~same, text("shape ", shape[0], "x", shape[1], "x", shape[2], " instead of ", "x".join(map(str, expected))))
        .when(~kind.eqNullSafe(F.lit("uint8")), text("type ", F.coalesce(kind, F.lit("null")), " instead of uint8"))
        .when(~sent.eqNullSafe(got), text("asked for job ", sent, ", got ", F.coalesce(got.cast("string"), F.lit("null"))))
        .when((width != expected[2]) | (height != expected[1]), text("window ", width, "x", height, " for a tile of ", f"{expected[2]}x{expected[1]}"))
        .when((col < 0) | (row < 0) | (col + width > total_width) | (row + height > total_height), text("window at ", col, ", ", row, " is out of bounds"))
    )


def chroma(pixels: DataFrame, by: list[str], channels: tuple[str, ...] = ("red", "green", "blue"), night: float = NIGHT) -> DataFrame:
    """(by, chroma, night): the mean distance of channels from their pixel's mean, over all pixels and channels of an image."""
    values = [F.col(c).cast("double") for c in channels]
    gray = sum(values[1:], values[0]) / len(values)
    apart = [F.abs(v - gray) for v in values]
    out = pixels.groupBy(*by).agg((F.sum(sum(apart[1:], apart[0])) / (len(values) * F.count("*"))).alias("chroma"))
    return out.withColumn("night", F.col("chroma") < night)


def in_excluded_folder(key: Column, excluded: list[str]) -> Column:
    """Whether a folder on the key's path, not its last part, has one of these names."""
    parts = F.split(key, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, excluded)).cast("array<string>"))


def enough(matches: DataFrame, by: list[str], visible: str = "visible", tokens: int = 8, least: int = 4) -> DataFrame:
    """(by, tokens, matches) of pairs with enough visible tokens, and enough matches among these."""
    rows = matches.groupBy(*by).agg(F.count(F.when(F.col(visible), 1)).alias("tokens"), F.count(F.when(F.col(visible) & F.col("matched"), 1)).alias("matches"))
    return rows.filter((F.col("tokens") >= tokens) & (F.col("matches") >= least))


def missing_inputs(frames: DataFrame, tokens: DataFrame, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(status, n): frames without coordinates, those with them but without tokens, and the others; none is dropped silently."""
    known = tokens.select(key).distinct().withColumn("_has", F.lit(True))
    rows = frames.join(known, key, "left")
    unplaced = F.col(lat).isNull() | F.col(lon).isNull() | F.isnan(lat) | F.isnan(lon)
    return rows.groupBy(F.when(unplaced, "no_coordinates").when(F.col("_has").isNull(), "no_tokens").otherwise("usable").alias("status")).agg(F.count("*").alias("n"))
