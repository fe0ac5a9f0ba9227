"""Streams of arriving rows. An extension: the batch operators need none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_counts(stream: DataFrame, key: str, time: str, kind: str, late: str = "1 day") -> DataFrame:
    """Counts by day and kind of rows whose key comes once within the watermark."""
    rows = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    once = rows.dropDuplicatesWithinWatermark([key])
    return once.groupBy(F.window("_at", "1 day").alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), kind, "n")


def run_available(df: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """Processes what there is and ends; a later run goes on from there."""
    query = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(to)
    query.awaitTermination()
    return query
