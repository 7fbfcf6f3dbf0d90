"""Readers, sinks, resumed work and streams, on files of their own."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from meridia.operators import sync
from meridia.sources import readers, sinks
from meridia.streaming.resume import resumed_stream, windowed_counts


def test_coco(spark, tmp_path):
    whole = {"images": [{"id": 1, "file_name": "a.jpg", "width": 16, "height": 16}], "annotations": [{"id": 5, "image_id": 1, "category_id": 2, "bbox": [0, 0, 4, 4]}], "categories": []}
    (tmp_path / "a.json").write_text(json.dumps(whole, indent=1))
    images, annotations, categories = readers.coco(spark, str(tmp_path / "a.json"))
    assert images.first().file_name == "a.jpg" and annotations.first().bbox == [0.0, 0.0, 4.0, 4.0] and categories.count() == 0
    (tmp_path / "b.json").write_text(json.dumps({"images": []}))
    with pytest.raises(Exception, match="no annotations"):
        readers.coco(spark, str(tmp_path / "b.json"))[1].collect()


def test_osm(spark, tmp_path):
    each = [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0}, {"type": "way", "id": 9, "nodes": [1, 7], "tags": {"highway": "primary"}}]
    (tmp_path / "o.json").write_text(json.dumps({"elements": each}))
    nodes, ways = readers.osm(spark, str(tmp_path / "o.json"))
    assert nodes.count() == 1 and [(r.pos, r.node) for r in ways.orderBy("pos").collect()] == [(0, 1), (1, 7)]


def test_kmz(spark, tmp_path):
    rows = spark.createDataFrame([("a<b&c", 1.0, 2.0, "s")], "name string, lat double, lon double, style string")
    n = sinks.write_kmz(str(tmp_path / "x.kmz"), sinks.placemarks(rows, "name", "lat", "lon", "style"), "t", {"s": "ff0000ff"})
    text = zipfile.ZipFile(tmp_path / "x.kmz").read("doc.kml").decode()
    assert n == 1 and "a&lt;b&amp;c" in text and "2.0000000,1.0000000,0" in text


def test_run_and_split_files(spark, tmp_path):
    splits = spark.createDataFrame([("a", "x", "train")], "city string, point_id string, split string")
    sinks.write_run(str(tmp_path / "run"), splits, spark.createDataFrame([("c", True)], "check string, ok boolean"), "city")
    assert spark.read.json(str(tmp_path / "run/split")).first().city == "a"
    (tmp_path / "s.json").write_text(json.dumps({"train": [{"point_id": "p", "reason": None}], "excluded": [{"point_id": "q", "reason": "excluded_component"}]}))
    assert {tuple(r) for r in readers.split_json(spark, str(tmp_path / "s.json")).collect()} == {("p", "train", None), ("q", "excluded", "excluded_component")}
    sinks.write_json(str(tmp_path / "j.json"), {"a": 1})
    assert json.loads((tmp_path / "j.json").read_text()) == {"a": 1, "schema_version": 1}
    assert "| run | 1 | city | string |" in sinks.schema_report({"run": splits})


def test_a_cut_off_run_goes_on(spark, tmp_path):
    jobs, done, seen = spark.range(40).withColumnRenamed("id", "job"), str(tmp_path / "done"), []

    def work(df):
        if len(seen) == 2:
            seen.append("cut")
            raise RuntimeError("cut off")
        seen.append(df.count())
        return df

    with pytest.raises(RuntimeError):
        sync.run_batches(jobs, done, ["job"], work, 4)
    assert sync.run_batches(jobs, done, ["job"], lambda df: df, 4) == 40
    assert spark.read.parquet(done).distinct().count() == 40


def test_stream_drops_what_is_done(spark, tmp_path):
    jobs, done = str(tmp_path / "jobs"), str(tmp_path / "done")
    rows = spark.range(10).withColumnRenamed("id", "job")
    for part in (rows, rows.filter("job < 5").union(spark.createDataFrame([(77,)], "job long"))):
        part.write.mode("append").parquet(jobs)
        resumed_stream(spark, jobs, rows.schema, done, str(tmp_path / "at"), ["job"], lambda df: df).awaitTermination()
    got = [r.job for r in spark.read.parquet(done).collect()]
    assert sorted(got) == [*range(10), 77]


def test_windowed_counts(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "t string, event_type string").withColumn("ts", F.to_timestamp("t"))
    assert {(r.event_type, r.n) for r in windowed_counts(rows).collect()} == {("a", 2), ("b", 1)}
