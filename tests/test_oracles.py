"""Every registered query against its DuckDB oracle; those without one run and give rows."""

import math
from pathlib import Path

import duckdb
import pytest

from meridia import registry
from meridia.sources.carriers import ctes

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    got = table(df.columns, df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    relation = duck.sql(sql)
    assert got == table(relation.columns, relation.fetchall())


def far_customers(spark, folder):
    """Customers whose points lie up to 108 degrees north, as at 60 times sf0.1, as a table and a DuckDB connection that sees it."""
    odd = spark.createDataFrame([(k,) for k in (632500, 643300, 845800, 342824, 622485, 622486, 622513)], "id long")  # halves, and the poles' neighbours
    spark.range(0, 900_000, 211).union(odd).distinct().selectExpr("id AS c_custkey").write.parquet(f"{folder}/customer.parquet")
    spark.range(0, 1_200_000, 499).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").write.parquet(f"{folder}/part.parquet")
    con = duckdb.connect()
    for t in ("customer", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["PJ02_true_scale", "AG14_distance_report", "PJ22_validated_numbers", "SC03_dedupe_positions", "AG30_split_shift", "PJ23_slippy_tile"])
def test_points_beyond_the_pole(spark, tmp_path, name):
    relation = far_customers(spark, tmp_path).sql(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, str(tmp_path))
    assert table(df.columns, df.collect()) == table(relation.columns, relation.fetchall())


def test_rules_leave_out_what_lies_beyond_the_pole(spark, tmp_path):
    con = far_customers(spark, tmp_path)
    for t, key, lat, source in (("customer", "point_id", "points", "c_custkey"), ("part", "tile_id", "tiles", "p_partkey")):
        near = con.sql(f"{ctes(lat)} SELECT {key} FROM {lat} WHERE lat < 90").fetchall()
        con.sql(f"CREATE TABLE near_{t} AS SELECT unnest({[k for (k,) in near]}) AS k")
        con.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet' WHERE {source} IN (SELECT k FROM near_{t})")
    relation = con.sql(registry.oracle_sql()["UD01_rules"])
    df = registry.queries()["UD01_rules"](spark, str(tmp_path))
    assert table(df.columns, df.collect()) == table(relation.columns, relation.fetchall())


def test_names_are_unique():
    with pytest.raises(ValueError, match="registered already"):
        registry.register("JN02_current_rule")(None)
