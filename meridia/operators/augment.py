"""Parameters of augmented frames, drawn once for each frame and seed as columns; what they do to pixels is left to the reader."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ranges:
    """How likely each change is, and the range of its size."""

    scale: tuple[float, float, float] = (0.5, 0.7, 1.4)
    shift: tuple[float, float] = (0.5, 0.1)
    perspective: tuple[float, float] = (0.3, 0.08)
    rotation: tuple[float, float] = (0.5, 180.0)
    brightness: tuple[float, float] = (0.5, 0.3)
    contrast: tuple[float, float, float] = (0.5, 0.7, 1.3)
    gamma: tuple[float, float, float] = (0.3, 0.7, 1.5)
    jpeg: tuple[float, int, int] = (0.3, 40, 95)
    blur: tuple[float, float, float] = (0.2, 0.5, 2.0)
    noise: tuple[float, float, float] = (0.2, 2.0, 12.0)


def drawn(key: Column, seed: int, name: str) -> Column:
    """A number in [0, 1) for each key, seed and name: 52 bits of a MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), key.cast("string"), F.lit(name))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def parameters(frames: DataFrame, key: str, width: int, height: int, seed: int = 0, ranges: Ranges = Ranges(), exclusive: bool = True) -> DataFrame:
    """(key, scale, dx, dy, corners, angle, brightness, contrast, gamma, jpeg, blur, noise) of each frame; null: no such change.

    The scale is uniform in its logarithm; dx and dy are whole pixels; corners are eight shifts in parts of the side. With
    `exclusive` a scaled frame has no perspective. The same seed gives the same draws, whatever the order of rows.
    """
    u = lambda name: drawn(F.col(key), seed, name)
    between = lambda name, a, b: a + (b - a) * u(name)
    happens = lambda name, p: u(f"do {name}") < p
    scaled = happens("scale", ranges.scale[0])
    moved = happens("shift", ranges.shift[0])
    whole = lambda name, n: (F.floor(u(name) * (2 * n + 1)) - n).cast("int")
    bent = happens("perspective", ranges.perspective[0]) & (~scaled if exclusive else F.lit(True))
    some = lambda name, r: F.when(happens(name, r[0]), between(name, float(r[1]), float(r[2])))
    f = ranges.perspective[1]
    return frames.select(
        key,
        F.when(scaled, F.exp(between("scale", F.ln(F.lit(ranges.scale[1])), F.ln(F.lit(ranges.scale[2]))))).alias("scale"),
        F.when(moved, whole("dx", max(1, int(width * ranges.shift[1])))).alias("dx"),
        F.when(moved, whole("dy", max(1, int(height * ranges.shift[1])))).alias("dy"),
        F.when(bent, F.array(*[between(f"corner {i}", -f, f) for i in range(8)])).alias("corners"),
        F.when(happens("rotation", ranges.rotation[0]), between("rotation", -ranges.rotation[1], ranges.rotation[1])).alias("angle"),
        F.when(happens("brightness", ranges.brightness[0]), 1.0 + between("brightness", -ranges.brightness[1], ranges.brightness[1])).alias("brightness"),
        some("contrast", ranges.contrast).alias("contrast"),
        some("gamma", ranges.gamma).alias("gamma"),
        F.when(happens("jpeg", ranges.jpeg[0]), (ranges.jpeg[1] + F.floor(u("jpeg") * (ranges.jpeg[2] - ranges.jpeg[1] + 1))).cast("int")).alias("jpeg"),
        some("blur", ranges.blur).alias("blur"),
        some("noise", ranges.noise).alias("noise"),
    )
