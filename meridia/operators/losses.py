"""Ranking objectives over scored pairs (q, t, s, is_pos, is_cand), as aggregates. Chunks of the gallery don't matter: sums
of exponentials are combined like any partial aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.stats import logsumexp


def validated(pairs: DataFrame, by: str = "q") -> DataFrame:
    """The pairs; an anchor without a positive, or a positive that is no candidate, is an error."""
    anchor = Window.partitionBy(by)
    none = F.max(F.col("is_pos").cast("int")).over(anchor) == 0
    stray = F.max((F.col("is_pos") & ~F.col("is_cand")).cast("int")).over(anchor) == 1
    wrong = F.when(none, F.raise_error(F.lit("an anchor has no positive"))).when(stray, F.raise_error(F.lit("a positive is no candidate")))
    return pairs.withColumn("_checked", F.coalesce(wrong.cast("string"), F.lit(""))).filter("_checked = ''").drop("_checked")


def multipositive_nll(pairs: DataFrame, tau: float = 1.0, by: str = "q", weight: Column | None = None) -> DataFrame:
    """(by, nll): log of the sum over candidates minus log of the sum over positives, of exp(s / tau).

    weight: shares of the positives, which are normalised for each anchor.
    """
    z = F.col("s") / tau
    rows = pairs.withColumn("_z", z)
    top = z
    if weight is not None:
        total = F.sum(F.when(F.col("is_pos"), weight)).over(Window.partitionBy(by))
        top = z + F.ln(F.when(F.col("is_pos"), weight) / total)
    positive = logsumexp(rows.withColumn("_p", top), [by], F.col("_p"), F.col("is_pos"), "_pos")
    every = logsumexp(rows, [by], F.col("_z"), F.col("is_cand"), "_all")
    return every.join(positive, by).select(by, (F.col("_all") - F.col("_pos")).alias("nll"))


def symmetric(pairs: DataFrame, tau: float = 1.0) -> DataFrame:
    """One row: the mean over queries and over tiles that have a positive, averaged."""
    with_positive = Window.partitionBy("t")
    back = pairs.withColumn("_any", F.max(F.col("is_pos").cast("int")).over(with_positive)).filter("_any = 1")
    forth = multipositive_nll(pairs, tau).agg(F.avg("nll").alias("a"))
    return forth.crossJoin(multipositive_nll(back, tau, "t").agg(F.avg("nll").alias("b"))).select(((F.col("a") + F.col("b")) / 2).alias("loss"))


def infonce(pairs: DataFrame, match: Column, tau: float = 0.07, smoothing: float = 0.0) -> DataFrame:
    """(q, loss): cross entropy of each query's softmax with its one match, with label smoothing over all its tiles."""
    anchor = Window.partitionBy("q")
    z = F.col("s") / tau
    rows = pairs.withColumn("_z", z).withColumn("_m", F.max("_z").over(anchor))
    rows = rows.withColumn("_log", F.col("_z") - F.col("_m") - F.ln(F.sum(F.exp(F.col("_z") - F.col("_m"))).over(anchor)))
    share = F.when(match, 1 - smoothing).otherwise(0.0) + smoothing / F.count("*").over(anchor)
    return rows.withColumn("_share", share).groupBy("q").agg((-F.sum(F.col("_share") * F.col("_log"))).alias("loss"))
