"""Numerically safe sums of exponentials, over groups and over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softmax(score: Column, by: list[str], tau: float = 1.0, mask: Column | None = None) -> Column:
    """The softmax of score / tau over the rows of each group that the mask lets through; 0 elsewhere."""
    over = Window.partitionBy(*by)
    z = score / max(tau, 1e-9)
    kept = z if mask is None else F.when(mask, z)
    e = F.exp(kept - F.max(kept).over(over))
    return F.coalesce(e / F.sum(e).over(over), F.lit(0.0))


def logsumexp(df: DataFrame, by: list[str], value: Column, mask: Column, out: str) -> DataFrame:
    """A row for each group: the log of the sum of exp(value) of the rows that the mask lets through, or minus infinity."""
    kept = F.when(mask, value)
    top = df.withColumn("_z", kept).withColumn("_m", F.max("_z").over(Window.partitionBy(*by)))
    total = F.sum(F.exp(F.col("_z") - F.col("_m")))
    return top.groupBy(*by).agg(F.coalesce(F.max("_m") + F.ln(total), F.lit(float("-inf"))).alias(out))
