"""Exact percentiles of groups of any size.

The built-in percentile keeps all distinct values of a group in one buffer, which serves as long as no group has very many. Beyond that,
values are counted by slices of their range: first 256 slices an octave, then a million slices of every slice that holds
a wanted rank; the ranks' values are then looked up in what is left, all groups and ranks at once. No task holds a
group, and what the rounds hand on is a few rows a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group up to which one buffer serves.
BUFFERED = 1_000_000
OCTAVE = 256
FINE = 1 << 20


def _slice(v: Column) -> Column:
    """A number that never falls as the value grows: sign, and place of the logarithm. NaN counts as the largest value."""
    place = F.floor(F.log2(F.abs(v)) * OCTAVE).cast("bigint") + 300_000
    ends = F.when(F.isnan(v), 2_000_000).when(v == float("inf"), 1_000_000).when(v == float("-inf"), -1_000_000).when(v == 0, 0)
    return ends.otherwise(F.when(v > 0, place).otherwise(-place)).cast("bigint")


def _fine(v: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi > lo, F.least(F.lit(FINE - 1), F.floor((v - lo) / (hi - lo) * FINE))).otherwise(0).cast("bigint")


def _holding(rows: DataFrame, parts: list[str], order: str, base: Column) -> DataFrame:
    """Rows whose run of ranks holds some of ``wanted``: ``before`` (ranks ahead of them) and ``wanted`` become their own."""
    ahead = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", base + F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    own = F.filter("wanted", lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n")))
    return placed.withColumn("wanted", own).where(F.size("wanted") > 0)


def values_at(counts: DataFrame, ranks: Column) -> DataFrame:
    """(g, rank, value, total) of ``counts`` (g, v, n: how often a group has a value): for each group the values at the
    places ``ranks`` (from 0, an array over ``total``) of its rows in order."""
    coarse = counts.withColumn("s", _slice(F.col("v"))).groupBy("g", "s").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    totals = coarse.groupBy("g").agg(F.sum("n").alias("total")).withColumn("wanted", ranks)
    first = _holding(coarse.join(totals, "g"), ["g"], "s", F.lit(0)).drop("n")
    fine = counts.withColumn("s", _slice(F.col("v"))).join(first, ["g", "s"]).withColumn("f", _fine(F.col("v"), F.col("lo"), F.col("hi")))
    one = lambda c: F.any_value(c).alias(c)  # noqa: E731  the same on all rows of a slice
    fine = fine.groupBy("g", "s", "f").agg(F.sum("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), *map(one, ("lo", "hi", "before", "wanted", "total")))
    second = _holding(fine, ["g", "s"], "f", F.col("before")).drop("n")
    known = second.where("least = most or isnan(least)").select("g", F.explode("wanted").alias("rank"), F.col("least").alias("value"), "total")
    left = second.where("least < most and not isnan(least)").select("g", "s", "f", "lo", "hi", "before", "wanted", "total")
    inside = counts.withColumn("s", _slice(F.col("v"))).join(left, ["g", "s"]).where(_fine(F.col("v"), F.col("lo"), F.col("hi")) == F.col("f"))
    found = _holding(inside, ["g", "s", "f"], "v", F.col("before")).select("g", F.explode("wanted").alias("rank"), F.col("v").alias("value"), "total")
    return known.unionByName(found)


def percentiles(df: DataFrame, by: list[str], value: Column, probs: list[float], buffered: int = BUFFERED) -> DataFrame:
    """``by`` and ``p``, an array: the linear percentiles of each group that has a value. Nulls don't count."""
    rows = df.select(F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("_")), (value.cast("double") + 0.0)).toDF("g", "v").where("v is not null")
    back = [F.col("g").getField(c).alias(c) for c in by]
    largest = rows.groupBy("g").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= buffered:
        return rows.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("p")).select(*back, "p")
    counts = rows.groupBy("g", "v").agg(F.count("*").alias("n"))
    place = [F.lit(p) * (F.col("total") - 1) for p in probs]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x).cast("bigint"), F.ceil(x).cast("bigint")) for x in place])))
    found = values_at(counts, ranks).groupBy("g", "total").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))  # two entries a percentile
    at = lambda k: F.col("at")[k.cast("bigint")]
    each = [F.when(F.floor(x) == F.ceil(x), at(F.floor(x))).otherwise((F.ceil(x) - x) * at(F.floor(x)) + (x - F.floor(x)) * at(F.ceil(x))) for x in place]
    return found.select(*back, F.array(*each).alias("p"))


def with_percentiles(grouped: DataFrame, df: DataFrame, by: list[str], value: Column, probs: list[float], name: str = "p", buffered: int = BUFFERED) -> DataFrame:
    """``grouped``, a row a group, with the group's percentiles as an array (null without values)."""
    found = percentiles(df, by, value, probs, buffered).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("p").alias(name))
    if not by:
        return grouped.join(F.broadcast(found), F.lit(True), "left")  # a row or none
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return grouped.join(found, same, "left").drop(*[f"_{c}" for c in by])
