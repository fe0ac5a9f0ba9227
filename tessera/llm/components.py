"""Connected components of a graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Nodes of the links with the smallest node each can reach, as a written table: ``node``, ``component``.

    Links are undirected; loops and repeated links change nothing, links with a null end are
    left out. Each round ties every node's larger neighbours to the smallest node it sees
    (large-star), then its smaller ones (small-star), and writes the links that stay; it ends
    when they are stars. Minima are aggregated before they are shuffled, and a hub's links are
    a join side that Spark may split, so a node with many links needs no task for itself."""
    hi, lo = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    now = written(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(hi, lo).distinct(), "links")
    state = _state(now)
    while True:
        least = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi")).groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = now.join(least, F.col("lo") == F.col("u")).select("hi", F.col("m").alias("lo")).distinct()
        first = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(first.withColumnRenamed("hi", "h"), F.col("hi") == F.col("h")).where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = written(small.union(first).distinct(), "links")
        new = _state(after)
        drop_written(now)
        now = after
        if new == state:
            break
        state = new
    out = written(now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct()), "components")
    drop_written(now)
    return out


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
