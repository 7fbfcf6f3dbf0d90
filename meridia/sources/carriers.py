"""The relations that queries run on, derived from the driver's tables by arithmetic.

Each is one SELECT that Spark and DuckDB both read, so a query and its oracle start from the same rows. Doubles are written
with an exponent, because a plain decimal point means a DECIMAL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL = {
    # a lattice of about 250 m; some sizes are missing
    "tiles": """SELECT p_partkey AS tile_id, CAST(floor((p_partkey % 45) / 15e0) AS BIGINT) AS city,
        48.5e0 + 0.00225e0 * CAST(floor(p_partkey / 45e0) AS BIGINT) AS lat, 37.5e0 + 0.0034e0 * (p_partkey % 45) AS lon,
        CASE WHEN p_size % 10 = 0 THEN NULL ELSE 1000e0 END AS size_m FROM {part}""",
    # frames on the lattice; every twentieth lies far from all tiles
    "points": """SELECT c_custkey AS point_id, CAST(floor((j % 45) / 15e0) AS BIGINT) AS city,
        48.5e0 + 0.00225e0 * (CAST(floor(j / 45e0) AS BIGINT) + ((c_custkey * 37) % 100) / 100e0) + CASE WHEN c_custkey % 20 = 0 THEN 0.5e0 ELSE 0e0 END AS lat,
        37.5e0 + 0.0034e0 * ((j % 45) + ((c_custkey * 53) % 100) / 100e0) AS lon
        FROM (SELECT c_custkey, CAST(floor(c_custkey * 4 / 3e0) AS BIGINT) AS j FROM {customer}) AS c""",
    # pairs of tiles, of which a third overlap
    "sparse": """SELECT s_suppkey AS tile_id, CAST(floor(s_suppkey / 50e0) AS BIGINT) % 3 AS city,
        48.5e0 + 0.02e0 * CAST(floor(i / 20e0) AS BIGINT) + 0.002e0 * (s_suppkey % 2) * (CASE WHEN i % 3 = 0 THEN 1 ELSE 0 END) AS lat,
        37.5e0 + 0.03e0 * (i % 20) + 0.015e0 * (s_suppkey % 2) * (CASE WHEN i % 3 = 0 THEN 0 ELSE 1 END) AS lon, 1000e0 AS size_m
        FROM (SELECT s_suppkey, CAST(floor(s_suppkey / 2e0) AS BIGINT) AS i FROM {supplier}) AS s""",
    # a score of each frame, level and method
    "scores": """SELECT l_orderkey AS frame_id, method, CAST(l_linenumber AS BIGINT) AS level, score FROM (
        SELECT l_orderkey, l_linenumber, 'global' AS method, round(max(l_quantity) / 50e0, 6) AS score FROM {lineitem} GROUP BY l_orderkey, l_linenumber
        UNION ALL SELECT l_orderkey, l_linenumber, 'patch' AS method, round(abs(max(l_tax)) * 10e0, 6) AS score FROM {lineitem} GROUP BY l_orderkey, l_linenumber) AS m""",
    "vectors": "SELECT vec_id, CAST(label AS BIGINT) AS label, vec_id % 3 AS city, embedding AS vec FROM {embeddings}",
    # 5 x 5 tokens of a tile
    "tokens": """SELECT CAST(floor(vec_id / 25e0) AS BIGINT) AS tile_id, CAST(floor((vec_id % 25) / 5e0) AS BIGINT) AS r, vec_id % 5 AS c, embedding AS vec FROM {embeddings}""",
    # file names of frames, in the shapes that parsers meet
    "names": """SELECT o_orderkey AS id, CASE o_orderkey % 6
        WHEN 0 THEN concat('gt_', CAST(o_orderkey AS VARCHAR(20)), '_48.', CAST(100000 + o_orderkey % 900000 AS VARCHAR(20)), '_37.', CAST(200000 + o_orderkey % 700000 AS VARCHAR(20)))
        WHEN 1 THEN concat(CAST(o_orderkey AS VARCHAR(20)), '_48.', CAST(100000 + o_orderkey % 900000 AS VARCHAR(20)), ',37.', CAST(200000 + o_orderkey % 700000 AS VARCHAR(20)))
        WHEN 2 THEN concat('city_night_', CAST(o_orderkey AS VARCHAR(20)), '_47.5_31.25')
        WHEN 3 THEN concat('frame', CAST(o_orderkey AS VARCHAR(20)))
        WHEN 4 THEN concat(CAST(o_orderkey AS VARCHAR(20)), '_91.5_x_46.25_30.5')
        ELSE CAST(o_orderkey AS VARCHAR(20)) END AS stem, concat('folder', CAST(o_custkey % 7 AS VARCHAR(20))) AS folder FROM {orders}""",
    # a listing of objects; a third is there already
    "objects": """SELECT event_id, concat(event_type, '/', CAST(user_id % 50 AS VARCHAR(20)), '/', CAST(event_id AS VARCHAR(20)), CASE WHEN event_id % 4 = 0 THEN '_48.5,37.5' ELSE '' END, '.jpg') AS object_key,
        CAST(floor(abs(value) * 100) AS BIGINT) AS size, event_id % 3 = 0 AS done FROM {events}""",
    # runs of a 16 x 16 mask: two for each image and class
    "runs": """SELECT o_orderkey AS annotation_id, o_orderkey % 50 AS image_id, o_custkey % 4 AS category_id, o_orderkey % 200 AS skip, 1 + o_custkey % 40 AS fill FROM {orders}""",
    # pixels of overlapping layers, of which the finest that has data counts
    "pixels": """SELECT CAST(l_linenumber AS BIGINT) AS layer, l_orderkey % 64 AS r, l_partkey % 64 AS c, CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE 1 + l_suppkey % 200 END AS v FROM {lineitem}""",
    # the frames of a training batch, every id divisible by 100, against the whole gallery: scores, positives and candidates
    "batch": """SELECT a.vec_id AS q, b.vec_id AS t, (a.vec_id * 31 + b.vec_id * 17) % 97 / 97e0 AS s, a.label = b.label AS is_pos, a.label = b.label OR (a.vec_id + b.vec_id) % 3 = 0 AS is_cand
        FROM {embeddings} AS a, {embeddings} AS b WHERE a.vec_id % 100 = 0""",
}


def tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def carrier(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = SQL[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(sql)})


def ctes(*names: str) -> str:
    """WITH clauses of carriers, for DuckDB, where the driver's tables are views."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n].format(**{t: t for t in tables_of(SQL[n])})})" for n in names)
