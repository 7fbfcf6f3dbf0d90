"""Plans of what to transfer and what to skip; the transfers themselves are left to the caller."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paired(listing: DataFrame) -> DataFrame:
    """(folder, n, shot, plain, status) of a listing (folder, stem): plain numbers with their shot `n_lat,lon`.

    The last of several shots counts. A plain number without a shot is unpaired; a shot alone is left out.
    """
    n = F.regexp_extract("stem", r"^(\d+)", 1)
    shots = listing.filter(F.col("stem").rlike(r"^\d+_[-\d.]+,[-\d.]+$")).groupBy("folder", n.alias("n")).agg(F.max("stem").alias("shot"))
    plain = listing.filter(F.col("stem").rlike(r"^\d+$")).select("folder", n.alias("n"), F.col("stem").alias("plain"))
    return plain.join(shots, ["folder", "n"], "left").withColumn("status", F.when(F.col("shot").isNull(), "unpaired").otherwise("paired"))


def planned(targets: DataFrame, there: DataFrame, name: str = "dst", order: str = "ord") -> DataFrame:
    """Targets with a status: of one name the first is kept, the others conflict; what is there with that size is skipped."""
    by = Window.partitionBy(name).orderBy(order)
    rows = targets.withColumn("_n", F.row_number().over(by))
    known = there.select(F.col(name), F.col("size").alias("_size"))
    rows = rows.join(known, name, "left")
    status = F.when(F.col("_n") > 1, "conflict").when(F.col("_size") == F.col("size"), "skip").otherwise("transfer")
    return rows.withColumn("status", status).drop("_n", "_size")


def remaining(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs that aren't done; a resumed run starts from these."""
    return jobs.join(done, keys, "left_anti")


def run_batches(jobs: DataFrame, done_path: str, keys: list[str], work: Callable[[DataFrame], DataFrame], batches: int) -> int:
    """Works through the jobs in hashed batches; each batch's valid rows are appended to the done table before the next.

    A run that was cut off is started again with the same arguments and goes on with what is missing. Returns the rows done.
    """
    spark = jobs.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(done_path)
    kind = jobs.select(*keys).schema
    exists = lambda: path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    done = lambda: spark.read.schema(kind).parquet(done_path) if exists() else spark.createDataFrame([], kind)
    for i in range(batches):
        part = remaining(jobs.filter(F.pmod(F.xxhash64(*keys), F.lit(batches)) == i), done(), keys)
        work(part).select(*keys).write.mode("append").parquet(done_path)
    return done().count()
