"""Progress of long runs: a small state file that survives a broken write, and counters that a job fills as it runs."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _read(spark: SparkSession, path: str) -> dict | None:
    fs, at = _files(spark, path)
    if not fs.exists(at(path)):
        return None
    file = fs.open(at(path))
    try:
        found = json.loads(bytes(file.readAllBytes()).decode())  # a state is small
    except (Py4JJavaError, ValueError):  # the store finds it damaged, or it is no JSON
        return None
    finally:
        file.close()
    return found if isinstance(found, dict) else None


def save_state(spark: SparkSession, path: str, state: dict) -> None:
    """Writes the state beside the file and moves it there; what was there is kept as `.bak`."""
    fs, at = _files(spark, path)
    new, old = at(f"{path}.tmp"), at(f"{path}.bak")
    out = fs.create(new, True)
    out.write(json.dumps(state, sort_keys=True).encode())
    out.close()
    if fs.exists(at(path)):
        fs.delete(old, False)
        fs.rename(at(path), old)
    fs.rename(new, at(path))


def load_state(spark: SparkSession, path: str) -> dict:
    """The state, or that of `.bak` where the file is missing or broken, or nothing."""
    for p in (path, f"{path}.bak"):
        if (found := _read(spark, p)) is not None:
            return found
    return {}


def counted(df: DataFrame, name: str, **events: Column) -> tuple[DataFrame, Observation]:
    """The rows unchanged, and counters of the rows for which each condition holds, ready when an action has run once."""
    seen = Observation(name)
    counts = [F.count(F.when(when, 1)).alias(e) for e, when in events.items()]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), seen
