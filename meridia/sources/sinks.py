"""Writers of runs, tables and maps. Large relations go out as Spark tables; only reports of bounded size pass the driver."""

from __future__ import annotations

import json
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def write_run(folder: str, splits: DataFrame, audit: DataFrame, by: str | None = None, components: DataFrame | None = None, config: dict | None = None) -> None:
    """A run under a folder, as JSON: the split (by city, if named), what it excludes, the audit's checks, a summary of points
    for each split (and city), the components with their sizes, and the settings."""
    writer = splits.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(f"{folder}/split")
    splits.filter("split = 'excluded'").write.mode("overwrite").json(f"{folder}/excluded")
    audit.coalesce(1).write.mode("overwrite").json(f"{folder}/audit")
    keys = [by, "split"] if by else ["split"]
    splits.groupBy(*keys).agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").json(f"{folder}/summary")
    if components is not None:
        sized = components.groupBy("component_id", "name").agg(F.count("*").alias("size"))
        of = splits.select("component_id", "split").distinct()
        sized.join(of, "component_id", "left").write.mode("overwrite").json(f"{folder}/components")
    if config is not None:
        rows = [(k, json.dumps(v, default=str)) for k, v in sorted(config.items())]
        splits.sparkSession.createDataFrame(rows, "setting string, value string").coalesce(1).write.mode("overwrite").json(f"{folder}/config")


def polygons(df: DataFrame, name: str, ring: str, style: str) -> DataFrame:
    """(kml): a KML polygon for each row, from a closed ring of (lon, lat) structs."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), "&", "&amp;"), "<", "&lt;")
    line = F.array_join(F.transform(ring, lambda p: F.format_string("%.7f,%.7f,0", p["lon"], p["lat"])), " ")
    return df.select(F.concat(F.lit("<Placemark><name>"), clean(name), F.lit("</name><styleUrl>#"), clean(style), F.lit("</styleUrl><Polygon><outerBoundaryIs><LinearRing><coordinates>"), line, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>")).alias("kml"))


def write_pixels(pixels: DataFrame, images: DataFrame, folder: str, by: str, key: str = "image_id") -> None:
    """Masks or mosaics as pixels, by class or layer, and the images that have none, so that an empty one can be told from one
    that is missing."""
    pixels.write.mode("overwrite").partitionBy(by).parquet(f"{folder}/pixels")
    images.select(key).distinct().join(pixels.select(key).distinct(), key, "left_anti").write.mode("overwrite").parquet(f"{folder}/empty")


def write_json(path: str, value: dict) -> None:
    with open(path, "w") as out:
        json.dump({"schema_version": SCHEMA_VERSION, **value}, out, indent=1, sort_keys=True, default=str)


def placemarks(df: DataFrame, name: str, lat: str, lon: str, style: str) -> DataFrame:
    """(kml): a KML placemark for each row."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), "&", "&amp;"), "<", "&lt;")
    at = F.format_string("%.7f,%.7f,0", F.col(lon), F.col(lat))
    return df.select(F.concat(F.lit("<Placemark><name>"), clean(name), F.lit("</name><styleUrl>#"), clean(style), F.lit("</styleUrl><Point><coordinates>"), at, F.lit("</coordinates></Point></Placemark>")).alias("kml"))


def write_kmz(path: str, marks: DataFrame, title: str, styles: dict[str, str]) -> int:
    """Writes placemarks to a KMZ file, row by row as they arrive; returns how many."""
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out, out.open("doc.kml", "w") as doc:
        doc.write(f'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{escape(title)}</name>'.encode())
        for style, colour in styles.items():
            doc.write(f'<Style id="{escape(style)}"><IconStyle><color>{escape(colour)}</color></IconStyle></Style>'.encode())
        for row in marks.toLocalIterator():
            doc.write(row.kml.encode())
            n += 1
        doc.write(b"</Document></kml>")
    return n


def schema_report(tables: dict[str, DataFrame]) -> str:
    """A Markdown table of tables, columns, types and row counts."""
    lines = ["| table | rows | column | type |", "|-|-|-|-|"]
    for name, df in tables.items():
        n = df.count()
        lines += [f"| {name} | {n} | {f.name} | {f.dataType.simpleString()} |" for f in df.schema.fields]
    return "\n".join(lines)


def union_columns(parts: list[DataFrame]) -> DataFrame:
    """All rows with all columns, in order of their names; what a part lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*sorted(out.columns))
