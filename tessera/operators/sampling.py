"""Samples by hash: exact, repeatable, independent of partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import draw
from .bounds import small


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int, nested: int | None = None) -> DataFrame:
    """``n`` rows of each stratum without replacement, in the order of their draws; the first
    ``nested`` of them are marked as the inner sample. A few more rows than needed go by their
    draw before any window sees them."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    d = draw(seed, F.col(stratum).cast("string"), F.col(key).cast("string"))
    rows = df.join(small(sizes), stratum).withColumn("_draw", d)  # a row a stratum
    # Of a stratum of s rows about n + 6 sqrt(n) + 12 have a draw below this; should fewer than n, all are taken.
    likely = rows.where(F.col("_draw") <= (n + 6.0 * n**0.5 + 12) / F.col("_size") * 4294967296.0)
    enough = likely.groupBy(stratum).agg(F.count("*").alias("_likely"))
    short = sizes.join(enough, stratum, "left").where(F.coalesce("_likely", F.lit(0)) < F.least(F.lit(n), F.col("_size"))).select(stratum)
    short = small(short)
    pool = likely.join(short, stratum, "left_anti").unionByName(rows.join(short, stratum, "left_semi"))
    ranked = pool.withColumn("ordinal", F.row_number().over(Window.partitionBy(stratum).orderBy("_draw", key))).where(F.col("ordinal") <= n)
    return ranked.withColumn("inner", F.col("ordinal") <= (n if nested is None else nested)).drop("_size", "_draw")


def dense_numbers(df: DataFrame, key: str, seed: int, by: list[str] = [], name: str = "_row") -> DataFrame:  # noqa: B006
    """Adds a number from 0 on in each group, without gaps and the same on every partitioning: counts by slice
    of the key's hash come first, so no window sees more than a slice of a group."""
    sliced = df.withColumn("_slice", draw(seed, F.col(key).cast("string")) % 256)
    per = sliced.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(*by, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # 256 rows a group
    inside = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy(key))
    return sliced.join(base, [*by, "_slice"]).withColumn(name, F.col("_base") + inside - 1).drop("_slice", "_base")


def uniform_draws(asks: DataFrame, pool: DataFrame, ask_key: list[str], pool_key: str, seed: int) -> DataFrame:
    """For each row asked for one member of the pool, drawn evenly with replacement: the row's key and the
    member's. One equi-join on the number drawn; none of an empty pool."""
    members = dense_numbers(pool.select(pool_key), pool_key, seed)
    total = members.agg(F.count("*").alias("_all"))  # one row
    rolls = asks.select(*ask_key).crossJoin(F.broadcast(total)).where("_all > 0").withColumn("_row", draw(seed, *[F.col(k).cast("string") for k in ask_key]) % F.col("_all"))
    return rolls.join(members, "_row").select(*ask_key, pool_key)


PAIR_SCALES = ("matched", "shrunk", "enlarged")


def pairing(sources: DataFrame, targets: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` random pairs of a source and a target area, by scale class; pairs without a
    positive area count in the total alone. Areas carry dense numbers ``row`` from 0."""
    found = pairing_by(sources.withColumn("_g", F.lit("")), targets, "_g", n, seed).drop("_g")
    nothing = sources.sparkSession.createDataFrame([(s, 0, 0.0) for s in PAIR_SCALES], "scale string, n bigint, pct double")
    return found.unionByName(nothing.join(found, "scale", "left_anti"))


def pairing_by(sources: DataFrame, targets: DataFrame, group: str, n: int, seed: int) -> DataFrame:
    """The same for every group of sources: group, scale, n, pct; ``row`` counts from 0 in each group."""
    sizes = sources.groupBy(group).agg(F.count("*").alias("_ns")).crossJoin(F.broadcast(targets.agg(F.count("*").alias("_nt")))).where("_nt > 0")  # a row a group
    name = [] if group == "_g" else [F.col(group).cast("string")]
    i = F.col("id").cast("string")
    rolls = sources.sparkSession.range(n).crossJoin(small(sizes)).select(group, (draw(seed, F.lit("s"), *name, i) % F.col("_ns")).alias("s"), (draw(seed, F.lit("t"), *name, i) % F.col("_nt")).alias("t"))
    pairs = rolls.join(sources.select(group, F.col("row").alias("s"), F.col("area").alias("sa")), [group, "s"]).join(targets.select(F.col("row").alias("t"), F.col("area").alias("ta")), "t")
    factor = F.try_divide("ta", "sa")
    good = (F.col("sa") > 0) & (F.col("ta") > 0)
    counts = pairs.groupBy(group).agg(*[F.count(F.when(good & c, 1)).alias(k) for k, c in zip(PAIR_SCALES, (factor.between(0.5, 2), factor < 0.5, factor > 2))])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("scale"), F.col(k).alias("n")) for k in PAIR_SCALES])).alias("x")
    return counts.select(group, each).select(group, "x.scale", "x.n", (F.col("x.n") * 100.0 / n).alias("pct"))


def group_folds(df: DataFrame, group: str, k: int, seed: int = 42) -> DataFrame:
    """Folds by group: no group is in two."""
    return df.withColumn("fold", (draw(seed, F.col(group).cast("string")) % k).cast("int"))


def bootstrap_groups(df: DataFrame, group: str, n: int, seed: int) -> DataFrame:
    """``n`` resamples of groups with replacement: columns replicate, group, times. Each of a
    replicate's draws is one row of a group number and no replicate is gathered anywhere."""
    groups = df.select(group).distinct()
    total = groups.count()
    numbered = dense_numbers(groups, group, seed)
    rolls = df.sparkSession.range(n * total).select((F.col("id") % n).cast("int").alias("replicate"), (draw(seed, F.col("id").cast("string")) % max(1, total)).alias("_row"))
    return rolls.groupBy("replicate", "_row").agg(F.count("*").alias("times")).join(numbered, "_row").select("replicate", group, "times")
