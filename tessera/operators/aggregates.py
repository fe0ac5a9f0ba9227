"""Profiles, counts and checks of groups."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bounds import small
from .order_statistics import with_percentiles
from .scratch import written

PERCENTS = (5, 10, 25, 75, 90, 95)


def profile(df: DataFrame, measures: dict[str, Column], by: list[str] = []) -> DataFrame:  # noqa: B006
    """Count, mean, median, extremes and linear percentiles of measures, one row each."""
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.cast("double").alias("value")) for k, v in measures.items()])).alias("m")).select(*by, "m.*")
    out = long.groupBy(*by, "measure").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    out = with_percentiles(out, long, [*by, "measure"], F.col("value"), [0.5, *(x / 100 for x in PERCENTS)])
    return out.select(*by, "measure", "n", "mean", "min", "max", F.col("p")[0].alias("median"), *[F.col("p")[i + 1].alias(f"p{x}") for i, x in enumerate(PERCENTS)])


def shares(df: DataFrame, category: Column, names: list[str]) -> DataFrame:
    """Count and percentage of each name, zero where there are none."""
    counted = df.agg(F.count("*").alias("_all"), *[F.count(F.when(category == n, 1)).alias(f"n{i}") for i, n in enumerate(names)])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("category"), F.col(f"n{i}").alias("n")) for i, n in enumerate(names)])).alias("x")
    return counted.select(each, "_all").select("x.category", "x.n", F.coalesce(F.try_divide(F.col("x.n") * F.lit(100.0), F.col("_all")), F.lit(0.0)).alias("pct"))


def thresholds(df: DataFrame, group: str, value: str, limits: list[int]) -> DataFrame:
    """Per group and threshold the rows kept, and their share in percent to one decimal."""
    each = F.explode(F.array(*map(F.lit, limits))).alias("threshold")
    return df.select(group, value, each).groupBy(group, "threshold").agg(F.count(F.when(F.col(value) >= F.col("threshold"), 1)).alias("n_kept"), F.round(F.count(F.when(F.col(value) >= F.col("threshold"), 1)) * 100.0 / F.count("*"), 1).alias("pct"))


def hits(best: DataFrame, key: list[str], seed: str = "seed", least: float = 0.25) -> DataFrame:
    """Per box: seeds that hit, mean confidence, and the vote of a majority (half, rounded down, plus one)."""
    n = best.groupBy(*key).agg(F.count("*").alias("n_seeds"), F.count(F.when(F.col("conf_max") >= least, 1)).alias("n_hits"), F.avg("conf_max").alias("conf_mean"))
    return n.withColumn("hit", (F.col("n_hits") >= F.floor(F.col("n_seeds") / 2) + 1).cast("int"))


def keep_first(df: DataFrame, group: Column, order: str) -> DataFrame:
    """status: kept (first of its group), discarded, or unrecognised (no group). The first is
    found by an aggregate and joined, so a large group needs no task for itself; rows of no group aren't joined."""
    rows = df.withColumn("_group", group)
    first = rows.where("_group is not null").groupBy("_group").agg(F.min(order).alias("_first"))
    status = F.when(F.col(order) == F.col("_first"), "kept").otherwise("discarded")
    judged = rows.where("_group is not null").join(first, "_group").select(*[F.col(f"`{c}`") for c in df.columns], status.alias("status"))
    return judged.unionByName(rows.where("_group is null").drop("_group").withColumn("status", F.lit("unrecognised")))


def bag_violations(bag: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Members whose number differs from the expected one (either may be 0)."""
    have = bag.groupBy(key).agg(F.count("*").alias("n"))
    both = have.join(expected.select(key, "n_expected"), key, "full_outer")
    return both.select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_expected", F.lit(0)).cast("bigint").alias("n_expected")).where("n != n_expected")


def line_fit(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """Intercept a and slope b by least squares; a constant x gives the mean of y and 0."""
    rows = df.select(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return rows.agg(F.coalesce(F.regr_intercept("y", "x"), F.avg("y")).alias("a"), F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("b"))


def residuals(df: DataFrame, x: Column, y: Column, keep: list[str]) -> DataFrame:
    fit = line_fit(df, x, y)  # one row
    return df.crossJoin(F.broadcast(fit)).select(*keep, (y - (F.col("a") + F.col("b") * x)).alias("residual"))


SCALES = ("matched", "shrunk", "enlarged")


#: Pool groups of a design that a box's row holds side by side.
MOST_GROUPS = 256


def cell_counts(boxes: DataFrame, counts: DataFrame, box_key: list[str], group: list[str], levels: dict[str, list], scales: tuple[str, ...] = SCALES) -> DataFrame:
    """Members for every box, pool group and scale: a row each, 0 where the pool has none, and ``fewest``, the least of a box's cells.

    ``counts`` is what ``range_counts`` gives; ``levels`` names the values that each column of the pool group
    has by design, so a group that the pool lacks counts too. Of a box that has several counts the fewest count. Counts that are
    dealt by the box's key stay where they are: what is shuffled is the boxes' keys alone."""
    cells = list(product(*(levels[c] for c in group)))
    if len(cells) > MOST_GROUPS:
        raise ValueError(f"a design of more than {MOST_GROUPS} pool groups")

    def of(cell) -> Column:
        same = F.lit(True)
        for c, v in zip(group, cell):
            same = same & (F.col(c) == F.lit(v))
        return same

    kinds = [(cell, s, f"_n{i}_{s}") for i, cell in enumerate(cells) for s in scales]
    per_box = counts.groupBy(*[F.col(k).alias(f"_{k}") for k in box_key]).agg(*[F.min(F.when(of(cell), F.col(f"n_{s}"))).alias(n) for cell, s, n in kinds])
    keys = boxes.select(*box_key).distinct()
    same = F.lit(True)
    for k in box_key:
        same = same & (F.col(k) == F.col(f"_{k}"))
    n = {name: F.coalesce(name, F.lit(0)).cast("bigint") for _, _, name in kinds}
    fewest = F.least(*n.values()) if len(n) > 1 else next(iter(n.values()))
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(group, cell)], F.lit(s).alias("scale"), n[name].alias("n")) for cell, s, name in kinds])).alias("x")
    return keys.join(per_box, same, "left").withColumn("fewest", fewest).select(*box_key, "fewest", each).select(*box_key, "x.*", "fewest")


def feasible(cells: DataFrame, box_key: list[str], least: int) -> DataFrame:
    """Per box: whether every cell and pool group has at least ``least`` members, and the fewest."""
    return cells.groupBy(*box_key).agg(F.min("n").alias("bottleneck")).withColumn("feasible", F.col("bottleneck") >= least)


def feasible_by_cell(cells: DataFrame, box_key: list[str], source: str, cell: list[str], least: int) -> DataFrame:
    """Per cell (scale and further columns): boxes for which each of its sources has enough members, whatever
    the other cells have."""
    per_box = cells.groupBy(*box_key, *cell).agg(F.min("n").alias("_n"))
    return per_box.groupBy(*cell).agg(F.count(F.when(F.col("_n") >= least, 1)).alias("n_feasible"))


def bottlenecks(cells: DataFrame, box_key: list[str], source: str, cell: list[str], least: int) -> DataFrame:
    """Per cell and source the fewest members among the boxes that are feasible in all cells; 0 without any."""
    n = cells.groupBy(*cell, source).agg(F.min(F.when(F.col("fewest") >= least, F.col("n"))).alias("n"))
    return n.select(*cell, source, F.coalesce("n", F.lit(0)).cast("bigint").alias("bottleneck"))


def median_split(df: DataFrame, column: str, among: Column | None = None, name: str = "level", high: str = "high", low: str = "low") -> DataFrame:
    """Adds whether a value is over the median of the rows ``among`` (of all without it); the median is
    0 of nothing."""
    one = df.sparkSession.range(1).select(F.lit(0).alias("_one"))
    mid = with_percentiles(one, df, [], F.col(column) if among is None else F.when(among, F.col(column)), [0.5]).select(F.coalesce(F.col("p")[0], F.lit(0.0)).alias("_mid"))  # one row
    return df.crossJoin(F.broadcast(mid)).withColumn(name, F.when(F.col(column) > F.col("_mid"), high).when(F.col(column).isNotNull(), low)).drop("_mid")


def grid_counts(df: DataFrame, dims: list[str]) -> DataFrame:
    """Counts over the full grid of the dimensions' values; zero counts stay."""
    grid = df.select(dims[0]).distinct()
    for d in dims[1:]:
        grid = grid.crossJoin(small(df.select(d).distinct()))
    return grid.join(df.groupBy(*dims).agg(F.count("*").alias("n")), dims, "left").select(*dims, F.coalesce("n", F.lit(0)).alias("n"))


def same_keys(df: DataFrame, cell: str, key: str) -> DataFrame:
    """Keys that not every cell has."""
    n = df.select(cell).distinct().agg(F.count("*").alias("n_all"))
    return df.groupBy(key).agg(F.count_distinct(cell).alias("n_cells")).crossJoin(F.broadcast(n)).where("n_cells != n_all").select(key, "n_cells")


def series(df: DataFrame, run: list[str], step: str, value: str) -> DataFrame:
    """Peak (the first of equals), last value, normalised area under the curve by trapezoids,
    and whether the steps are 1..n, each once."""
    w = Window.partitionBy(*run).orderBy(step)
    rows = df.withColumn("_dx", F.col(step) - F.lag(step).over(w)).withColumn("_y", (F.col(value) + F.lag(value).over(w)) / 2)
    out = rows.groupBy(*run).agg(
        F.max_by(step, F.struct(value, -F.col(step))).alias("peak_step"), F.max(value).alias("peak"), F.max_by(value, step).alias("last"),
        F.sum(F.col("_dx") * F.col("_y")).alias("_area"), (F.max(step) - F.min(step)).alias("_span"), F.count("*").alias("n"), F.count_distinct(step).alias("_steps"), F.min(step).alias("_lo"), F.max(step).alias("_hi"),
    )
    return out.select(*run, "peak_step", "peak", "last", F.coalesce(F.try_divide("_area", "_span"), F.col("last")).alias("auc"), ((F.col("_lo") == 1) & (F.col("_hi") == F.col("n")) & (F.col("_steps") == F.col("n"))).alias("complete"))


def between_share(df: DataFrame, group: str, value: Column) -> DataFrame:
    """Share of the variance that lies between groups, and groups that always, sometimes, never have 1."""
    g = df.select(group, value.cast("double").alias("y")).groupBy(group).agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.sum(F.col("y") * F.col("y")).alias("q"))
    total = g.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("b"), F.sum("q").alias("q"), F.count(F.when(F.col("m") == 1, 1)).alias("n_always"), F.count(F.when(F.col("m") == 0, 1)).alias("n_never"), F.count("*").alias("n_groups"))
    centre = F.col("n") * F.col("mean") * F.col("mean")
    return total.select(F.try_divide(F.col("b") - centre, F.col("q") - centre).alias("between"), "n_groups", "n_always", "n_never")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def by_cluster(ranking: DataFrame, clusters: DataFrame) -> DataFrame:
    """Importance summed by cluster (a feature without one stands alone), ranked anew."""
    named = ranking.join(clusters, "feature", "left").groupBy(F.coalesce("cluster", "feature").alias("cluster")).agg(F.sum("importance").alias("importance"))
    return named.withColumn("position", F.row_number().over(Window.orderBy(F.desc("importance"), "cluster")))  # a row a cluster


def binned_mean(df: DataFrame, x: Column, y: Column, width: float) -> DataFrame:
    return df.groupBy(F.floor(x / width).cast("bigint").alias("bin")).agg(F.count("*").alias("n"), F.avg(y).alias("mean"))


def one_hot(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """A column for each value, in alphabetical order."""
    values = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())  # a row a value
    return df.select("*", *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in values])


def objects_per_image(df: DataFrame, image: str) -> DataFrame:
    """Images that have objects, objects, and their mean and most in an image."""
    n = df.groupBy(image).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_images"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_objects"), F.avg("n").alias("mean"), F.max("n").alias("most"))


def source_profile(manifests: DataFrame, source: str, extracted: Column, width: str, height: str) -> DataFrame:
    """Smaller sides of the crops of each source; sources of which nothing was extracted stay, with 0 crops."""
    side = F.when(extracted, F.least(width, height).cast("double"))
    p = manifests.groupBy(source).agg(F.count(side).alias("n_crops"), F.min(side).alias("min"), F.max(side).alias("max"))
    p = with_percentiles(p, manifests, [source], side, [0.05, 0.1, 0.25, 0.5])
    return p.select(source, "n_crops", "min", "max", *[F.col("p")[i].alias(n) for i, n in enumerate(("p5", "p10", "p25", "median"))])


def compare_geometry(boxes: DataFrame, feasible: str, area: str, boxed: str, small: float = 1024.0) -> DataFrame:
    """Boxes that stay and those that go: median areas, side of the median, share of small ones;
    the letterboxed measures are null if any box has none."""
    whole = F.count(boxed) == F.count("*")
    out = boxes.groupBy(feasible).agg(F.count("*").alias("n"), whole.alias("_whole"), F.when(whole, F.avg((F.col(boxed) < small).cast("double"))).alias("small_share"))
    out = with_percentiles(with_percentiles(out, boxes, [feasible], F.col(area), [0.5], "_area"), boxes, [feasible], F.col(boxed), [0.5], "_boxed")
    mid = F.when(F.col("_whole"), F.col("_boxed")[0])
    return out.select(feasible, "n", F.col("_area")[0].alias("area"), mid.alias("boxed_area"), F.sqrt(mid).alias("boxed_side"), "small_share")


def audit_pastes(pastes: DataFrame, cell: str, box: list[str], wrong: dict[str, Column], factor: str) -> DataFrame:
    """Per cell: pastes, distinct boxes, rows that a check finds wrong, and spread of the factor."""
    p = pastes.groupBy(cell).agg(F.count("*").alias("n"), F.count_distinct(*box).alias("n_boxes"), *[F.count(F.when(c, 1)).alias(k) for k, c in wrong.items()], F.min(factor).alias("min"), F.max(factor).alias("max"))
    p = with_percentiles(p, pastes, [cell], F.col(factor), [0.05, 0.5, 0.95])
    return p.select(cell, "n", "n_boxes", *wrong, "min", "max", *[F.col("p")[i].alias(n) for i, n in enumerate(("p5", "median", "p95"))])


def group_shares(df: DataFrame, cell: str, group: str, names: list[str]) -> DataFrame:
    """Share of each name among the rows of a cell, 0 where there are none."""
    n = df.groupBy(cell).agg(F.count("*").alias("_n"), *[F.count(F.when(F.col(group) == x, 1)).alias(f"_{i}") for i, x in enumerate(names)])
    each = F.explode(F.array(*[F.struct(F.lit(x).alias(group), (F.col(f"_{i}").cast("double") / F.col("_n")).alias("share")) for i, x in enumerate(names)])).alias("x")
    return n.select(cell, each).select(cell, "x.*")


def totals(df: DataFrame, by: str, measures: dict[str, Column], name: str = "all") -> DataFrame:
    """Measures by a column, and a row of all, from one pass."""
    r = df.rollup(by).agg(F.grouping(by).alias("_all"), *[c.alias(k) for k, c in measures.items()])
    return r.select(F.when(F.col("_all") == 1, name).otherwise(F.col(by)).alias(by), *measures)


def distance_summary(near: DataFrame, distance: str, same: Column) -> DataFrame:
    """Mean, median and ends of distances, and the share of rows whose nearest is of their kind. The rows are found once, for all of these."""
    found = written(near.select(F.col(distance).alias("distance"), same.cast("double").alias("same")), "distances")
    p = found.agg(F.count("distance").alias("n"), F.avg("distance").alias("mean"), F.avg("same").alias("same_share"))
    p = with_percentiles(p, found, [], F.col("distance"), [0.05, 0.5, 0.95])
    return p.select("n", "mean", *[F.col("p")[i].alias(n) for i, n in enumerate(("p5", "median", "p95"))], "same_share")


def variance_inflation(df: DataFrame, columns: list[str]) -> DataFrame:
    """How much each column's variance is inflated by the others: the diagonal of the inverse of
    their correlations, which one pass of sums gives; null where they are dependent."""
    r = np.eye(len(columns))
    at = {c: i for i, c in enumerate(columns)}
    for x in correlations(df, columns).collect():  # a row a pair of columns
        r[at[x["a"]], at[x["b"]]] = r[at[x["b"]], at[x["a"]]] = np.nan if x["r"] is None else x["r"]
    well = np.isfinite(r).all() and np.linalg.cond(r) < 1e12
    found = np.diag(np.linalg.inv(r)).tolist() if well else [None] * len(columns)
    return df.sparkSession.createDataFrame(list(zip(columns, found)), "column string, vif double")
