"""Streams of jobs: an extra beside the batch operators.

resumed_stream() is the streaming form of sync.run_batches(): files of new jobs arrive in a folder, each micro-batch drops
what is done, works on the rest and appends what was done. The checkpoint makes a restarted stream go on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def resumed_stream(spark: SparkSession, jobs: str, schema: StructType, done: str, checkpoint: str, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """A query over Parquet files of jobs; it ends when all files that are there have been worked on."""
    kind = StructType([schema[k] for k in keys])

    def batch(new: DataFrame, _: int) -> None:
        session = new.sparkSession
        path = session.sparkContext._jvm.org.apache.hadoop.fs.Path(done)
        there = path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).exists(path)
        known = session.read.schema(kind).parquet(done) if there else session.createDataFrame([], kind)
        work(new.dropDuplicates(keys).join(known, keys, "left_anti")).select(*keys).write.mode("append").parquet(done)

    stream = spark.readStream.schema(schema).parquet(jobs)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours", at: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts by tumbling window and kind; rows later than the watermark are dropped. Works on streams and on tables."""
    return events.withWatermark(at, late).groupBy(F.window(at, every), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
