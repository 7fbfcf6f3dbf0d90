"""Names, paths and identifiers as column expressions. Five parsers read coordinates from names, each by its own rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _numbers(tokens: Column) -> Column:
    """The tokens that are numbers, in order."""
    return F.filter(F.transform(tokens, lambda t: t.try_cast("double")), lambda x: x.isNotNull())


def parse_after_first(stem: Column) -> Column:
    """The first two numbers behind the first token; tokens end at _ and comma."""
    found = _numbers(F.slice(F.split(stem, "[_,]"), F.lit(2), F.size(F.split(stem, "[_,]"))))
    return F.when(F.size(found) >= 2, F.struct(F.get(found, F.lit(0)).alias("lat"), F.get(found, F.lit(1)).alias("lon")))


def parse_in_range(stem: Column, lat: tuple[float, float] = (44.0, 53.0), lon: tuple[float, float] = (20.0, 45.0)) -> Column:
    """The first two neighbouring tokens that are a latitude and a longitude in range."""
    tokens = F.transform(F.split(stem, "[_,]"), lambda t: t.try_cast("double"))
    pairs = F.arrays_zip(tokens.alias("lat"), F.slice(tokens, F.lit(2), F.size(tokens)).alias("lon"))
    good = F.filter(pairs, lambda p: p["lat"].between(*lat) & p["lon"].between(*lon))
    first = F.get(good, F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["lat"].alias("lat"), first["lon"].alias("lon")))


def parse_last_two(stem: Column) -> Column:
    """The last two tokens between underscores, if both are numbers."""
    tokens = F.split(stem, "_")
    lat, lon = F.try_element_at(tokens, F.lit(-2)).try_cast("double"), F.try_element_at(tokens, F.lit(-1)).try_cast("double")
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def parse_id_lat_lon(stem: Column) -> Column:
    """Tokens 0, 1 and 2 if the last two are numbers; else the whole name without coordinates."""
    tokens = F.split(stem, "_")
    lat, lon = F.get(tokens, F.lit(1)).try_cast("double"), F.get(tokens, F.lit(2)).try_cast("double")
    ok = lat.isNotNull() & lon.isNotNull()
    return F.struct(F.when(ok, F.get(tokens, F.lit(0))).otherwise(stem).alias("id"), F.when(ok, lat).alias("lat"), F.when(ok, lon).alias("lon"))


def parse_last_numbers(point_id: Column) -> Column:
    """The last two numbers of the part behind `city:`."""
    found = _numbers(F.split(F.element_at(F.split(point_id, ":"), -1), "[_,]"))
    return F.when(F.size(found) >= 2, F.struct(F.element_at(found, -2).alias("lat"), F.element_at(found, -1).alias("lon")))


def looks_corrupt(stem: Column, low: float = 44.0, high: float = 53.0) -> Column:
    """Whether the first token between underscores is a number out of the band of latitudes; other names are accepted."""
    lat = F.get(F.split(stem, "_"), F.lit(0)).try_cast("double")
    return F.coalesce(~lat.between(low, high), F.lit(False))


def without_leading_id(stem: Column) -> Column:
    return F.regexp_replace(stem, r"^\d+_", "")


def key_value(text: Column) -> Column:
    """`k=v`, split at the first =; the key loses a leading gt_. Without = the key is the last path component."""
    parts = F.split(text, "=", 2)
    key = F.when(F.size(parts) == 2, F.get(parts, F.lit(0))).otherwise(F.element_at(F.split(text, "/"), -1))
    return F.struct(F.regexp_replace(key, "^gt_", "").alias("key"), F.element_at(parts, -1).alias("value"))


def folder_of(key: Column) -> Column:
    return F.regexp_replace(key, r"/?[^/]*$", "")


def city_of(point_id: Column) -> Column:
    return F.substring_index(point_id, ":", 1)


def with_night(stem: Column) -> Column:
    """`night` behind the first token of a name of three tokens or more."""
    tokens = F.split(stem, "_")
    return F.when(F.size(tokens) >= 3, F.array_join(F.array_insert(tokens, 2, F.lit("night")), "_")).otherwise(stem)


def safe(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def human_bytes(n: Column) -> Column:
    """Powers of 1024, with one decimal from KB on; a half goes to the even one, as C's printf has it and Java's doesn't."""
    n = n.cast("long")
    out = F.format_string("%d B", n)
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        size = 1024**power
        parts = n.bitwiseAND(F.lit(size - 1).cast("long")) * 10
        tenth, rest = F.shiftright(parts, 10 * power), parts.bitwiseAND(F.lit(size - 1).cast("long"))
        up = (rest > size // 2) | ((rest == size // 2) & (tenth % 2 == 1))
        tenths = F.shiftright(n, 10 * power) * 10 + tenth + up.cast("long")
        whole = ((tenths - tenths % 10) / 10).cast("long")
        out = F.when(n >= size, F.format_string(f"%d.%d {unit}", whole, tenths % 10)).otherwise(out)
    return out


def hash_number(text: Column, digits: int = 10) -> Column:
    """The first hexadecimal digits of the SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10).cast("long")


def canonical_weight(seed: int, name: Column, index: Column) -> Column:
    return hash_number(F.concat_ws("|", F.lit(str(seed)), name.cast("string"), index.cast("string")))


def is_quota_error(message: Column) -> Column:
    return F.lower(message).rlike("quota|rate limit|too many requests|429")


def is_remote(path: Column) -> Column:
    return F.lower(path).rlike("^(s3|gs|https?|hdfs|abfss?)://")
