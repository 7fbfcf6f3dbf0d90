"""Readers of nested JSON sources as flat relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COCO = {
    "images": "array<struct<id:bigint,file_name:string,width:bigint,height:bigint>>",
    "annotations": "array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>>>",
    "categories": "array<struct<id:bigint,name:string>>",
}
OSM = "elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>>"


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of a file; one that lacks any of them is an error."""
    whole = spark.read.schema(", ".join(f"{k} {v}" for k, v in COCO.items())).json(path, multiLine=True)
    for part, kind in COCO.items():
        missing = F.from_json(F.raise_error(F.lit(f"no {part}")).cast("string"), kind)
        whole = whole.withColumn(part, F.when(F.col(part).isNull(), missing).otherwise(F.col(part)))
    return tuple(whole.select(F.inline(part)) for part in COCO)


def osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, lat, lon) and ways (way, pos, node, tags) of a response."""
    each = spark.read.schema(OSM).json(path, multiLine=True).select(F.inline("elements"))
    nodes = each.filter("type = 'node'").select("id", "lat", "lon")
    ways = each.filter("type = 'way'").select(F.col("id").alias("way"), "tags", F.posexplode("nodes").alias("pos", "node"))
    return nodes, ways


def split_json(spark: SparkSession, path: str) -> DataFrame:
    """(point_id, split, reason) of a split file with an array of points for each split."""
    kind = "struct<point_id:string,reason:string>"
    whole = spark.read.schema(f"train array<{kind}>, val array<{kind}>, test array<{kind}>, excluded array<{kind}>").json(path, multiLine=True)
    out = None
    for split in ("train", "val", "test", "excluded"):
        rows = whole.select(F.inline(split)).select("point_id", F.lit(split).alias("split"), "reason")
        out = rows if out is None else out.unionByName(rows)
    return out


def kmz_rings(spark: SparkSession, path: str, name_filter: str | None = None) -> DataFrame:
    """(path, ring) of KMZ files, which Spark reads as whole binaries; ring: lon and lat of the vertices, the first not again."""
    from pyspark.sql.functions import udf

    ring = udf(lambda content: [tuple(p) for p in ring_of(bytes(content), name_filter)], "array<struct<lon:double,lat:double>>")
    return spark.read.format("binaryFile").load(path).select("path", ring("content").alias("ring"))


def kmz_ring(path: str, name_filter: str | None = None) -> list[tuple[float, float]]:
    """ring_of() of a local file."""
    with open(path, "rb") as f:
        return ring_of(f.read(), name_filter)


def ring_of(content: bytes, name_filter: str | None = None) -> list[tuple[float, float]]:
    """(lon, lat) of a KMZ file's first polygon, without its closing vertex; without one, the convex hull of its three or more
    points. name_filter: only placemarks whose names contain it, whatever the case. A ring of less than three is an error."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(content)) as box:
        root = ElementTree.fromstring(box.read(next(n for n in box.namelist() if n.endswith(".kml"))))
    name = lambda e: e.tag.rpartition("}")[2]
    places = lambda e: [tuple(map(float, p.split(",")[:2])) for x in e.iter() if name(x) == "coordinates" for p in re.split(r"\s+", (x.text or "").strip()) if p]
    title = lambda e: next((x.text or "" for x in e if name(x) == "name"), "")
    marks = [root] if name_filter is None else [e for e in root.iter() if name(e) == "Placemark" and name_filter.lower() in title(e).lower()]
    for e in (x for m in marks for x in m.iter()):
        if name(e) == "Polygon":
            found = places(e)
            found = found[:-1] if len(found) > 1 and found[0] == found[-1] else found
            if len(found) < 3:
                raise ValueError("a polygon has less than three vertices")
            return found
    points = sorted({p for m in marks for e in m.iter() if name(e) == "Point" for p in places(e)})
    if len(points) < 3:
        raise ValueError("the file has no polygon and less than three points")

    def half(row: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in row:  # keep left turns only
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])
