"""Contrasts, analyses of variance, corrections and ranking measures over result tables.

Result tables are long: one row for each budget, arm, seed and value. Contrasts are rows of
coefficients, so any of them is one join and one sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import f_upper, t_quantiles, t_two_sided, tost

FLOOR_PP, MARGIN_PP, UNDERPOWERED_SD = 2.0, 1.0, 0.8


def contrast_values(cube: DataFrame, coefficients: DataFrame, keys: list[str], seed: str = "seed", value: str = "value", scale: float = 100.0) -> DataFrame:
    """contrast, seed, difference (in points): coefficient times value, summed by seed."""
    return cube.join(coefficients, keys).groupBy("contrast", seed).agg(F.sum(F.col("weight") * F.col(value) * scale).alias("difference"))


def contrast_summary(values: DataFrame, seed: str = "seed") -> DataFrame:
    """Mean, sd, effect size, t, seeds on the mean's side, extremes of the means without one seed."""
    w = Window.partitionBy("contrast")  # a few seeds each
    rows = values.withColumn("_n", F.count("*").over(w)).withColumn("_sum", F.sum("difference").over(w))
    rows = rows.withColumn("_loo", F.when(F.col("_n") > 2, (F.col("_sum") - F.col("difference")) / (F.col("_n") - 1))).withColumn("_same", (F.signum("difference") == F.signum(F.col("_sum"))).cast("int"))
    s = rows.groupBy("contrast").agg(F.count("*").alias("n"), F.avg("difference").alias("mean"), F.stddev_samp("difference").alias("sd"), F.sum("_same").alias("n_same_sign"), F.min("_loo").alias("loo_min"), F.max("_loo").alias("loo_max"))
    return s.withColumn("t", _ratio(F.col("mean"), F.col("sd") / F.sqrt("n"))).withColumn("effect", _ratio(F.col("mean"), F.col("sd")))


def _ratio(a: Column, b: Column) -> Column:
    """a / b; of a zero b infinite with a's sign, 0 for both zero; null without b."""
    inf = F.lit(float("inf"))
    return F.when(b.isNull(), None).when(b > 0, a / F.when(b > 0, b)).otherwise(F.when(a > 0, inf).when(a < 0, -inf).otherwise(F.lit(0.0)))


def verdict_by_signs(s: DataFrame) -> DataFrame:
    """real: beyond the floor with all signs equal; direction: two thirds of the signs; else noise."""
    two_thirds = F.ceil(F.col("n") * 2 / 3)
    return s.withColumn("verdict", F.when((F.abs("mean") > FLOOR_PP) & (F.col("n_same_sign") == F.col("n")), "real").when(F.col("n_same_sign") >= two_thirds, "direction").otherwise("noise"))


def intervals(s: DataFrame) -> DataFrame:
    """p, confidence intervals, equivalence p and whether the spread is too large to tell."""
    df, se = (F.col("n") - 1).cast("double"), F.col("sd") / F.sqrt("n")
    s = s.withColumn("p", t_two_sided(F.col("t"), df)).withColumn("_q95", t_quantiles(F.lit(0.975), df)).withColumn("_q90", t_quantiles(F.lit(0.95), df)).withColumn("_se", se)
    s = s.withColumn("p_equivalent", tost(F.col("mean"), F.col("_se"), df, F.lit(MARGIN_PP)))
    for level in ("95", "90"):
        s = s.withColumn(f"lo{level}", F.col("mean") - F.col(f"_q{level}") * F.col("_se")).withColumn(f"hi{level}", F.col("mean") + F.col(f"_q{level}") * F.col("_se"))
    return s.withColumn("underpowered", F.col("sd") > UNDERPOWERED_SD).drop("_q95", "_q90", "_se")


def verdict_by_intervals(s: DataFrame) -> DataFrame:
    """A difference counts before equivalence; the flag says that both hold."""
    inside = (F.col("lo90") > -MARGIN_PP) & (F.col("hi90") < MARGIN_PP)
    v = F.when(F.col("hi95") < 0, "worse").when(F.col("lo95") > 0, "better").when(inside, "equivalent").otherwise("inconclusive")
    return s.withColumn("verdict", v).withColumn("also_within_margin", inside & F.col("verdict").isin("worse", "better"))


def holm(df: DataFrame, family: str, name: str, p: str = "p") -> DataFrame:
    """Holm's adjusted p within families; null and NaN stay out."""
    rows = df.where(F.col(p).isNotNull() & ~F.isnan(p))
    w = Window.partitionBy(family).orderBy(p, name)
    n = F.count("*").over(Window.partitionBy(family))
    rows = rows.withColumn("_step", F.least(F.lit(1.0), (n - F.row_number().over(w) + 1) * F.col(p)))
    return rows.withColumn("p_holm", F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def families(cube: DataFrame, coefficients: DataFrame, keys: list[str], adjusted: tuple[str, ...], seed: str = "seed", value: str = "value") -> DataFrame:
    """Every contrast of every family with its interval, tests and verdict; p values of the ``adjusted``
    families are corrected by Holm within the family, the others' have none."""
    names = coefficients.select("contrast", "family").distinct()
    found = verdict_by_intervals(intervals(contrast_summary(contrast_values(cube, coefficients.drop("family"), keys, seed, value), seed)))
    found = found.join(F.broadcast(names), "contrast")  # a row a contrast
    corrected = holm(found.where(F.col("family").isin(*adjusted)), "family", "contrast").select("contrast", "p_holm")
    return found.join(corrected, "contrast", "left")


def sign_families(cube: DataFrame, coefficients: DataFrame, keys: list[str], adjusted: tuple[str, ...], seed: str = "seed", value: str = "value") -> DataFrame:
    """The same with verdicts by signs and the floor, and plain p values."""
    names = coefficients.select("contrast", "family").distinct()
    s = contrast_summary(contrast_values(cube, coefficients.drop("family"), keys, seed, value), seed)
    found = verdict_by_signs(s).withColumn("p", t_two_sided(F.col("t"), (F.col("n") - 1).cast("double"))).join(F.broadcast(names), "contrast")  # a row a contrast
    corrected = holm(found.where(F.col("family").isin(*adjusted)), "family", "contrast").select("contrast", "p_holm")
    return found.join(corrected, "contrast", "left")


def group_means(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Means over seeds, a row a group."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])


def unpaired_difference(df: DataFrame, which: Column, other: DataFrame, value: str, scale: float = 100.0) -> DataFrame:
    """Mean of chosen rows, mean of another table's, and their difference in points: a check of plausibility,
    not a paired contrast."""
    one = df.where(which).agg(F.avg(value).alias("mean"))
    return one.crossJoin(F.broadcast(other.agg(F.avg(value).alias("other_mean")))).withColumn("difference", (F.col("mean") - F.col("other_mean")) * scale)


def anova(cube: DataFrame, a: str, b: str, block: str, value: str, scale: float = 100.0) -> DataFrame:
    """Two factors and a block in a balanced table: one row a term with ss, df, f and p.

    All means come from one pass of grouping sets over the (small) table of results."""
    v = cube.select(a, b, block, (F.col(value) * scale).alias("v"))
    g = v.groupingSets([[F.col(a)], [F.col(b)], [F.col(a), F.col(b)], [F.col(block)], []], F.col(a), F.col(b), F.col(block)).agg(F.avg("v").alias("m"), F.count("*").alias("n"), F.grouping_id(F.col(a), F.col(b), F.col(block)).alias("which"))
    grand = v.agg(F.avg("v").alias("mean"), F.count("*").alias("total"), F.sum(F.pow(F.col("v"), 2.0)).alias("q"))
    sums = g.crossJoin(F.broadcast(grand)).groupBy("which").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2.0)).alias("ss"), F.count("*").alias("k"))
    pick = lambda which, what: F.max(F.when(F.col("which") == which, F.col(what)))
    one = sums.agg(*[pick(w, x).alias(f"{x}_{t}") for t, w in (("a", 3), ("b", 5), ("ab", 1), ("s", 6)) for x in ("ss", "k")]).crossJoin(F.broadcast(grand))
    one = one.withColumn("all", F.col("q") - F.col("total") * F.pow("mean", F.lit(2.0))).withColumn("ss_i", F.col("ss_ab") - F.col("ss_a") - F.col("ss_b"))
    one = one.withColumn("ss_e", F.col("all") - F.col("ss_ab") - F.col("ss_s")).withColumn("df_e", (F.col("k_ab") - 1) * (F.col("k_s") - 1))
    terms = [(a, F.col("ss_a"), F.col("k_a") - 1), (b, F.col("ss_b"), F.col("k_b") - 1), (f"{a}:{b}", F.col("ss_i"), (F.col("k_a") - 1) * (F.col("k_b") - 1)), (block, F.col("ss_s"), F.col("k_s") - 1), ("error", F.col("ss_e"), F.col("df_e"))]
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), ss.alias("ss"), df.cast("bigint").alias("df")) for t, ss, df in terms])).alias("x"), (F.col("ss_e") / F.col("df_e")).alias("ms_e"), "df_e").select("x.*", "ms_e", "df_e")
    f = F.when(F.col("term") != "error", _ratio(F.col("ss") / F.col("df"), F.col("ms_e")))
    return rows.withColumn("f", f).withColumn("p", f_upper(F.col("f"), F.col("df").cast("double"), F.col("df_e").cast("double"))).drop("ms_e", "df_e")


def ranking_measures(df: DataFrame, score: str, label: str, by: list[str] = [], slices: int = 1024) -> DataFrame:  # noqa: B006
    """Average precision (by steps at distinct scores) and area under the ROC curve.

    Rows are counted by score first; running sums go over distinct scores, in slices of them
    whose totals are summed up before, so no task holds them all."""
    per = df.groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.count("*").alias("n"))
    ends = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    sliced = per.crossJoin(F.broadcast(ends)).withColumn("_slice", F.coalesce(F.floor(F.try_divide((F.col("s") - F.col("_lo")) * F.lit(float(slices)), F.col("_hi") - F.col("_lo"))), F.lit(0)).cast("bigint")).drop("_lo", "_hi")
    totals = sliced.groupBy(*by, "_slice").agg(F.sum("pos").alias("_pos"), F.sum("n").alias("_n"))
    after = Window.partitionBy(*by).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*by, "_slice", F.coalesce(F.sum("_pos").over(after), F.lit(0)).alias("_bp"), F.coalesce(F.sum("_n").over(after), F.lit(0)).alias("_bn"))
    w = Window.partitionBy(*by, "_slice").orderBy(F.desc("s"))
    rows = sliced.join(base, [*by, "_slice"]).withColumn("cp", F.col("_bp") + F.sum("pos").over(w)).withColumn("cn", F.col("_bn") + F.sum("n").over(w))
    neg = F.col("n") - F.col("pos")
    above = F.col("cp") - F.col("pos")
    out = rows.groupBy(*by).agg(F.sum(F.col("pos") * F.col("cp") / F.col("cn")).alias("_ap"), F.sum(neg * (above + F.col("pos") / 2)).alias("_auc"), F.sum("pos").alias("n_pos"), F.sum(neg).alias("n_neg"))
    return out.select(*by, F.try_divide("_ap", "n_pos").alias("ap"), F.try_divide(F.col("_auc"), F.col("n_pos") * F.col("n_neg")).alias("auc"), "n_pos", "n_neg")


def importance_ranking(long: DataFrame) -> DataFrame:
    """feature, importance (mean absolute phi), direction (correlation of x and phi, 0 if constant), position."""
    r = long.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance"), F.coalesce(F.try_divide(F.covar_pop("x", "phi"), F.stddev_pop("x") * F.stddev_pop("phi")), F.lit(0.0)).alias("direction"))
    return r.withColumn("position", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))  # a row a feature
