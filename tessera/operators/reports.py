"""Whole steps of an analysis: a sampled set with its digest, the table of features, the evaluation of a closed list of models."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import aggregates, catalogs, gates, sampling, statistics

MOST_SAMPLED = 1_000_000


def sampled_set(outputs: DataFrame, parts: DataFrame, cell: str, key: str, n: int, seed: int, nested: int | None = None) -> tuple[DataFrame, str]:
    """Outputs of each cell that have parts, ``n`` of them drawn, and the SHA-256 of the list in its order (a line of
    cell, ordinal and key each). Refused where a cell has fewer than ``n``."""
    whole = outputs.join(parts.select(cell, key).distinct(), [cell, key], "left_semi")
    few = outputs.select(cell).distinct().join(whole.groupBy(cell).agg(F.count("*").alias("n")), cell, "left").where(F.coalesce("n", F.lit(0)) < n).limit(5).collect()
    if few:
        raise gates.Refused(f"fewer than {n}: {[(r[0], r['n'] or 0) for r in few]}")
    drawn = sampling.stratified(whole, cell, key, n, seed, nested)
    lines = drawn.select(F.concat_ws("\t", F.col(cell).cast("string"), F.col("ordinal").cast("string"), F.col(key).cast("string")).alias("line"), cell, "ordinal").orderBy(cell, "ordinal")
    if drawn.count() > MOST_SAMPLED:
        raise gates.Refused(f"a list of more than {MOST_SAMPLED} rows has no digest here")
    digest = hashlib.sha256()
    for r in lines.toLocalIterator():  # at most n rows a cell
        digest.update((r["line"] + "\n").encode())
    return drawn, digest.hexdigest()


def cell_pool(spark: SparkSession, path: str, schema: str = "name string, source string, width int, height int, contrast double") -> DataFrame:
    """The members of a pool from their cached manifest, with their areas; rows without a contrast or an extent are left out."""
    from ..sources.manifests import manifest

    rows = manifest(spark, path, schema).where("contrast is not null and width > 0 and height > 0")
    return rows.withColumn("area", (F.col("width") * F.col("height")).cast("double"))


def feature_table(pastes: DataFrame, crops: DataFrame, crop: str, order: str, target: DataFrame, key: list[str], compute, log_scale: Column, measure: Column) -> DataFrame:
    """Pastes with the features of their crop (computed once a crop; of repeated crops the last row counts), their target,
    and the residual of ``measure`` on ``log_scale``. Rows without target are left out; a crop that isn't found leaves nulls."""
    index = catalogs.last_wins(crops, crop, order)
    rows = pastes.join(target, key).join(index.select(crop, F.lit(True).alias("found")), crop, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    rows = catalogs.computed_once(rows, crop, lambda keys: compute(keys.join(index, crop)))
    fit = aggregates.line_fit(rows, log_scale, measure)  # one row
    return rows.crossJoin(F.broadcast(fit)).withColumn("residual", measure - (F.col("a") + F.col("b") * log_scale)).drop("a", "b")


def feature_summary(table: DataFrame, crop: str, target: str) -> DataFrame:
    """Rows, distinct crops, rows without a crop, share of the target."""
    return table.agg(F.count("*").alias("n"), F.count_distinct(crop).alias("n_crops"), F.count(F.when(~F.col("found"), 1)).alias("n_lost"), F.avg(F.col(target).cast("double")).alias("target_share"))


def closed_evaluation(metrics: DataFrame, model: str, models: list[str], coefficients: DataFrame, keys: list[str], adjusted: tuple[str, ...], lock: str | None = None) -> DataFrame:
    """Contrasts over the metrics of exactly these models, one row each: any other list is refused. With
    ``lock`` the result is written there once; a second evaluation is refused before anything is computed."""
    if lock is not None:
        gates.unlocked(metrics.sparkSession, lock)
    names = metrics.sparkSession.createDataFrame([(m,) for m in models], f"{model} string")
    n = metrics.groupBy(model).agg(F.count("*").alias("n"))
    odd = n.join(names.withColumn("_listed", F.lit(True)), model, "full_outer").where("n is null or n != 1 or _listed is null").orderBy(model).limit(5).collect()
    if odd:
        raise gates.Refused(f"not one row for each listed model: {[(r[0], r['n'] or 0) for r in odd]}")
    found = statistics.sign_families(metrics, coefficients, keys, adjusted)
    if lock is not None:
        gates.once(metrics.sparkSession, lock, found)
    return found


def letterboxed(boxes: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Boxes with their own area (sides of 1 at least) and the letterboxed one."""
    area = F.greatest(F.lit(1), F.col("x1") - F.col("x0")) * F.greatest(F.lit(1), F.col("y1") - F.col("y0"))
    return boxes.withColumn("area", area.cast("double")).withColumn("boxed_area", g.letterbox_area(area.cast("double"), F.col(width), F.col(height)))
