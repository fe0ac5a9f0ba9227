"""Training designs: steps, arms, lists of training images and plans of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogs import ambiguous
from .gates import Refused


def steps_per_epoch(n_images, batch) -> Column:
    """Batches of an epoch, the last one may be short; counts must be positive."""
    ok = (F.lit(n_images) > 0) & (F.lit(batch) > 0)
    return F.when(ok, F.ceil(F.lit(n_images) / F.lit(batch))).otherwise(F.raise_error(F.lit("images and batch must be positive")).cast("bigint"))


def warmup_epochs(steps, n_images, batch) -> Column:
    """Epochs of an arm that give as many warm-up steps in any arm; counts must be positive."""
    ok = (F.lit(n_images) > 0) & (F.lit(batch) > 0)
    return F.when(ok, F.lit(steps) / (F.lit(n_images) / F.lit(batch))).otherwise(F.raise_error(F.lit("images and batch must be positive")).cast("double"))


def warmup_steps(epochs, n_images, batch) -> Column:
    return F.lit(epochs) * (F.lit(n_images) / F.lit(batch))


def arms(fractions: DataFrame, length: int, n_real: int) -> DataFrame:
    """Columns arm, fraction -> arm, n_synthetic (rounded half to even), repeat_real: real images fill what
    is left of the list, each as often; an error where they can't."""
    n = F.rint(F.col("fraction") * length).cast("bigint")
    rows = fractions.select("arm", n.alias("n_synthetic"), (F.lit(length) - n).alias("_left"))
    bad = F.raise_error(F.concat(F.col("arm"), F.lit(": real images don't fill the list evenly"))).cast("bigint")
    return rows.select("arm", "n_synthetic", F.when(F.col("_left") % n_real == 0, (F.col("_left") / n_real).cast("bigint")).otherwise(bad).alias("repeat_real"))


def run_plan(budgets: DataFrame, arm_names: list[str], seeds: list[int], length: int, batch: int, mosaic: int = 15) -> DataFrame:
    """All runs in order of budget, seed, arm. ``budgets`` has ordinal, budget and epochs; epochs must
    be a multiple of ``mosaic``."""
    close = F.when(F.col("epochs") % mosaic == 0, (F.col("epochs") / mosaic).cast("int")).otherwise(F.raise_error(F.concat(F.col("budget"), F.lit(": epochs don't divide evenly"))).cast("int"))
    grid = budgets.select("ordinal", "budget", "epochs", F.posexplode(F.array(*map(F.lit, seeds))).alias("_s", "seed")).select("*", F.posexplode(F.array(*map(F.lit, arm_names))).alias("_a", "arm"))
    place = (F.col("ordinal") * len(seeds) + F.col("_s")) * len(arm_names) + F.col("_a")
    name = F.concat_ws("_", "budget", "arm", F.concat(F.lit("seed"), F.col("seed").cast("string")))
    return grid.select(place.cast("int").alias("place"), name.alias("run"), close.alias("close_mosaic"), (F.col("epochs") * steps_per_epoch(length, batch)).alias("steps"))


def trainlist(real: DataFrame, synthetic: DataFrame, path: str, repeat_real: int) -> DataFrame:
    """Each real path ``repeat_real`` times and each synthetic one once: columns path, real, turn. In the order of
    turn (then path) the real ones come first, all of them as often as they repeat, then the synthetic ones.

    Refused: a repeat count below 1, a path twice in a list, a path in both."""
    if repeat_real < 1:
        raise Refused("repeat_real must be at least 1")
    for name, df in (("real", real), ("synthetic", synthetic)):
        if not ambiguous(df, path).isEmpty():
            raise Refused(f"{name} paths repeat")
    if not real.join(synthetic.select(path), path, "left_semi").isEmpty():
        raise Refused("a path is real and synthetic")
    times = F.explode(F.sequence(F.lit(1), F.lit(repeat_real)))
    return real.select(path, F.lit(True).alias("real"), times.alias("turn")).unionByName(synthetic.select(path, F.lit(False).alias("real"), F.lit(repeat_real + 1).alias("turn")))


def trainlist_counts(rows: DataFrame) -> DataFrame:
    """n_real, n_synthetic, n_total and the share of real ones (0 of nothing)."""
    n = rows.agg(F.count(F.when(F.col("real"), 1)).alias("n_real"), F.count(F.when(~F.col("real"), 1)).alias("n_synthetic"), F.count("*").alias("n_total"))
    return n.withColumn("real_share", F.coalesce(F.try_divide(F.col("n_real").cast("double"), F.col("n_total")), F.lit(0.0)))


def complete_runs(metrics: DataFrame, run: str, step: str, epochs: int, checkpoints: DataFrame) -> DataFrame:
    """Per run: complete if it has a row for each epoch, its last epoch is the last one, and its
    checkpoint exists."""
    m = metrics.groupBy(run).agg(F.count("*").alias("n"), F.max(step).alias("_last"))
    j = m.join(checkpoints.select(run, F.lit(True).alias("_saved")).distinct(), run, "left")
    return j.select(run, "n", ((F.col("n") == epochs) & (F.col("_last") == epochs) & F.coalesce("_saved", F.lit(False))).alias("complete"))


def training_arguments(protocol: dict, n_images: int, arm: str, seed: int) -> dict:
    """Arguments of a training run of an arm: the warm-up as epochs of the arm's own length, so that every arm has as many
    warm-up steps; no early stopping within the epochs; and the checkpoint fixed beforehand. ``protocol``
    has weights, epochs, batch, image_size, optimizer, rate, final_rate, cosine, warmup_steps, close_mosaic, cache, checkpoint_epoch."""
    if min(n_images, protocol["batch"]) < 1:
        raise Refused("images and batch must be positive")
    names = {"weights": "model", "epochs": "epochs", "batch": "batch", "image_size": "imgsz", "optimizer": "optimizer", "rate": "lr0", "final_rate": "lrf", "cosine": "cos_lr", "close_mosaic": "close_mosaic", "cache": "cache"}
    out = {to: protocol[own] for own, to in names.items()}
    warmup = protocol["warmup_steps"] * protocol["batch"] / n_images
    return out | {"patience": protocol["epochs"] + 1, "warmup_epochs": warmup, "seed": seed, "name": f"{arm}_seed{seed}", "checkpoint_epoch": protocol["checkpoint_epoch"]}


# The contrasts of a budget by arm design by family, each with its measure and the coefficients of its cells.
FAMILIES = {
    "F1": {
        "P11": ("recall", {("S2", "M50"): 1.0, ("S2", "C"): -1.0}),
        "P12": ("recall", {("S2", "M50"): 0.5, ("S2", "C"): -0.5}),
        "P13": ("recall", {("S2", "M50"): 1.0, ("S2", "C"): -1.0, ("S1", "M50"): -1.0, ("S1", "C"): 1.0}),
    },
    "F2": {
        "F2a": ("small", {("S2", "M50"): 1.0, ("S2", "C"): -1.0}),
        "F2b": ("map50", {("S2", "M50"): 1.0, ("S2", "C"): -1.0}),
        "F2c": ("auc", {("S2", "M50"): 1.0, ("S2", "C"): -1.0}),
        "F2d": ("recall", {("S1", "M50"): 1.0, ("S1", "C"): -1.0}),
    },
    "F3": {
        "F3a": ("recall", {("S2", "M25"): 1.0, ("S2", "M50"): -1.0}),
        "F3b": ("recall", {("S2", "M25"): 1.0, ("S2", "C"): -1.0}),
        "F3c": ("recall", {("S2", "C"): 0.5, ("S2", "M25"): -1.0, ("S2", "M50"): 0.5}),
        "F3d": ("recall", {("S1", "C"): 0.5, ("S1", "M25"): -1.0, ("S1", "M50"): 0.5}),
    },
}
ADJUSTED = ("F1", "F2")  # families whose p values are corrected; the others describe
CONTRASTS = {name: weights for family in FAMILIES.values() for name, (_, weights) in family.items()}

# The contrasts of scale by contrast cells and a control arm, as coefficients of the arms.
CELLS = ("matched__high", "matched__low", "shrunk__high", "shrunk__low")
CELL_FAMILIES = {
    "F1": {"P5b": dict(zip(CELLS, (0.5, 0.5, -0.5, -0.5))), "P8": dict(zip(CELLS, (0.5, -0.5, 0.5, -0.5)))},
    "F3": {"P9": dict(zip(CELLS, (1.0, -1.0, -1.0, 1.0))), **{f"P10_{c}": {c: 1.0, "control": -1.0} for c in CELLS}, "P10_mean": {**dict.fromkeys(CELLS, 0.25), "control": -1.0}},
}


def contrasts(spark: SparkSession, names: list[str] = list(CONTRASTS)) -> DataFrame:  # noqa: B006
    """Columns contrast, budget, arm, weight, to be joined with a table of results."""
    return spark.createDataFrame([(n, b, a, w) for n in names for (b, a), w in CONTRASTS[n].items()], "contrast string, budget string, arm string, weight double")


def family_coefficients(spark: SparkSession) -> DataFrame:
    """Columns family, contrast, measure, budget, arm, weight of all families of the budget by arm design."""
    rows = [(f, n, m, b, a, w) for f, family in FAMILIES.items() for n, (m, weights) in family.items() for (b, a), w in weights.items()]
    return spark.createDataFrame(rows, "family string, contrast string, measure string, budget string, arm string, weight double")


def cell_coefficients(spark: SparkSession) -> DataFrame:
    """Columns family, contrast, arm, weight of the cells and the control arm."""
    rows = [(f, n, a, w) for f, family in CELL_FAMILIES.items() for n, weights in family.items() for a, w in weights.items()]
    return spark.createDataFrame(rows, "family string, contrast string, arm string, weight double")
