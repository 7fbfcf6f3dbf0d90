"""The split from tables to files, settings and the hull of a KMZ."""

import zipfile

import pytest

from meridia import cli, config
from meridia.operators import strategies
from meridia.sources import readers


def city(spark, folder, n=28):
    rows = [(i, 0, 48.5 + 0.05 * (i // 7), 37.5 + 0.07 * (i % 7), 1000.0) for i in range(n)] + [(n, 0, 48.5, 37.503, 1000.0)]
    spark.createDataFrame(rows, "tile_id int, city int, lat double, lon double, size_m double").write.parquet(f"{folder}/tiles.parquet")
    spark.createDataFrame([r[:4] for r in rows], "point_id int, city int, lat double, lon double").write.parquet(f"{folder}/points.parquet")


def test_build(spark, tmp_path):
    city(spark, tmp_path)
    assert cli.build(spark, str(tmp_path), config.settings(tolerance=0.1)) == 0
    splits = {r.point_id: r.split for r in spark.read.json(f"{tmp_path}/run/split").collect()}
    assert len(splits) == 29 and splits[0] == splits[28] and set(splits.values()) == {"train", "val", "test"}
    city(spark, f"{tmp_path}/small", n=1)  # one component can't fill three splits
    assert cli.build(spark, f"{tmp_path}/small", config.settings(), write=False) == 2


def test_list(capsys):
    assert cli.main(["list"]) == 0 and "nearest_tile" in capsys.readouterr().out


def test_settings(tmp_path):
    with pytest.raises(ValueError, match="unknown settings: colour"):
        config.settings({"colour": 1})
    with pytest.raises(ValueError, match="add up to 1"):
        config.settings(train=0.9)
    (tmp_path / "s.yaml").write_text("rule: nearest_tile\n")
    assert config.load(str(tmp_path / "s.yaml"), tolerance=0.2, rule=None).tolerance == 0.2


def test_registries(spark):
    with pytest.raises(ValueError, match="registered already"):
        strategies.FUSIONS.add("mean")(None)
    with pytest.raises(ValueError, match="unknown fusion"):
        strategies.FUSIONS["no such"]
    rows = spark.createDataFrame([(1, "a", 1, 0.9), (1, "a", 2, 0.1), (1, "b", 1, 0.8), (1, "b", 2, 0.7)], "frame_id int, method string, level int, score double")
    assert [r.level for r in strategies.estimated(rows).filter("top").collect()] == [1]


def kmz(path, body):
    with zipfile.ZipFile(path, "w") as out:
        out.writestr("doc.kml", f'<kml xmlns="http://www.opengis.net/kml/2.2"><Document>{body}</Document></kml>')
    return str(path)


def test_kmz_ring(tmp_path):
    point = lambda x, y: f"<Placemark><Point><coordinates>{x},{y},0</coordinates></Point></Placemark>"
    square = "".join(point(x, y) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 0)))
    assert readers.kmz_ring(kmz(tmp_path / "a.kmz", square)) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    ring = "<Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 1,0,5 1,1</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"
    assert readers.kmz_ring(kmz(tmp_path / "b.kmz", square + ring)) == [(0, 0), (1, 0), (1, 1)]
    with pytest.raises(ValueError, match="less than three points"):
        readers.kmz_ring(kmz(tmp_path / "c.kmz", point(0, 0)))


def test_the_entry_works_without_the_training_data_operators():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules[{!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'JN02_current_rule' in q and 'JN02_current_rule' in e.oracle_sql() and not any(k.startswith('op') for k in q)"
    for missing in ("zstandard", "meridia.llm"):
        subprocess.run([sys.executable, "-c", code.format(missing)], check=True, cwd=Path(__file__).parents[1])
