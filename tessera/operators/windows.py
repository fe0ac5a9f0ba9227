"""Window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leave_one_out(df: DataFrame, group: str, value: str, out: str = "loo_mean") -> DataFrame:
    """Mean of the other rows of the group; alone in it, the mean of all. Sums by group are
    joined back, so a large group is a join side that Spark may split."""
    g = df.groupBy(group).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    whole = df.agg(F.avg(value).alias("_mean"))
    other = F.when(F.col("_n") > 1, (F.col("_s") - F.col(value)) / (F.col("_n") - 1)).otherwise(F.col("_mean"))
    return df.join(g, group).crossJoin(F.broadcast(whole)).withColumn(out, other).drop("_s", "_n", "_mean")


def place_in_group(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Place from 0."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
