"""Pairs of boxes of one scene that overlap, by a grid of several levels.

Two boxes whose overlap by union is at least ``t`` have widths and heights within a factor ``t`` of each other, and their left
and upper edges are no further apart than (1 - t) of the larger side. A box of a busy scene is therefore filed by the
level of its sides and by its cell there, and meets only those of the few levels and cells that can hold
a partner: the scene is many keys. In other scenes, all boxes are one cell, and where no scene is busy nothing is filed at all."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iou
from .bounds import small

SIDES = ("x0", "y0", "x1", "y1")
#: Boxes of a scene from which it counts as busy.
BUSY = 512
#: What the bounds are widened by, so that rounding loses no pair.
SLACK = 1e-9


def _level(size: Column, base: float) -> Column:
    return F.floor(F.log(size) / log(base)).cast("int")


def _side(level: Column, base: float) -> Column:
    """No box of a level is longer than this."""
    return F.pow(F.lit(base), level + 1)


def _filed(lo: Column, size: Column, base: float) -> Column:
    level = _level(size, base)
    return F.struct(level.alias("l"), F.floor(lo / _side(level, base)).alias("c"))


def _probes(lo: Column, size: Column, least: float, base: float) -> Column:
    """Levels and cells where a partner along one axis can be filed."""
    few, many = size * (least * (1 - SLACK)), size * ((1 + SLACK) / least)

    def cells(level: Column) -> Column:
        side = _side(level, base)
        reach = F.greatest(size, F.least(side, many)) * ((1 - least) * (1 + SLACK) + SLACK) + F.abs(lo) * SLACK
        return F.transform(F.sequence(F.floor((lo - reach) / side), F.floor((lo + reach) / side)), lambda c: F.struct(level.alias("l"), c.alias("c")))

    return F.flatten(F.transform(F.sequence(_level(few, base), _level(many, base)), cells))


def listed(scene: str | list[str]) -> list[str]:
    return [scene] if isinstance(scene, str) else list(scene)


def crowds(rows: DataFrame, scene: str | list[str] = "scene", busy: int = BUSY) -> DataFrame | None:
    """The scenes, by their first column, of more than so many rows, sent to every task if they are few; None without any."""
    found = small(rows.groupBy(F.col(listed(scene)[0]).alias("_crowd")).agg(F.count("*").alias("_n")).where(F.col("_n") > busy).select("_crowd"))
    return None if found.isEmpty() else found


def overlapping(boxes: DataFrame, others: DataFrame, scene: str | list[str] = "scene", least: float = 0.5, busy: int = BUSY, within: DataFrame | None | bool = False) -> DataFrame:
    """Left join of ``boxes`` with the rows of ``others`` in their scene (one column or several) that they overlap by at least ``least``
    (over 0, at most 1), columns of ``others`` prefixed with ``_``; ``_iou`` is the overlap. ``within`` are the busy scenes, if they
    are known. Without any, rows meet by the scene's first column and the others are compared, so tables dealt by the first aren't shuffled again."""
    if not 0 < least <= 1:
        raise ValueError("least has to be over 0 and at most 1")
    keys = listed(scene)
    within = crowds(others, keys, busy) if within is False else within
    base = max(2.0, least**-2)
    o = others.select(*[F.col(c).alias(f"_{c}") for c in others.columns])
    over = iou(tuple(F.col(c) for c in SIDES), tuple(F.col(f"_{c}") for c in SIDES))
    first, *further = keys
    met = F.col(first) == F.col(f"_{first}")
    known = F.when(F.col(f"_{first}").isNotNull(), over)
    if within is None:
        for c in further:  # no equality, which would be a key to shuffle by
            met = met & (F.col(c) <= F.col(f"_{c}")) & (F.col(c) >= F.col(f"_{c}"))
        return boxes.join(o, met & (over >= least), "left").withColumn("_iou", known)

    one = F.struct(*[F.lit(0).cast("int").alias(f"l{a}") if k == "l" else F.lit(0).cast("bigint").alias(f"c{a}") for a in "xy" for k in "lc"])

    def sizes(p: str) -> tuple[Column, Column]:
        return F.col(f"{p}x1") - F.col(f"{p}x0"), F.col(f"{p}y1") - F.col(f"{p}y0")

    pair = lambda x, y: F.struct(x["l"].alias("lx"), x["c"].alias("cx"), y["l"].alias("ly"), y["c"].alias("cy"))
    w, h = sizes("_")
    # a box without a positive area overlaps nothing
    filed = F.when((w > 0) & (h > 0), pair(_filed(F.col("_x0"), w, base), _filed(F.col("_y0"), h, base)))
    o = o.join(within, F.col(f"_{first}") == F.col("_crowd"), "left").withColumn("_cell", F.when(F.col("_crowd").isNull(), one).otherwise(filed)).drop("_crowd")
    w, h = sizes("")
    xs, ys = _probes(F.col("x0"), w, least, base), _probes(F.col("y0"), h, least, base)
    many = F.when((w > 0) & (h > 0), F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: pair(x, y)))))
    b = boxes.join(within, F.col(first) == F.col("_crowd"), "left").withColumn("_probe", F.explode_outer(F.when(F.col("_crowd").isNull(), F.array(one)).otherwise(many))).drop("_crowd")
    for c, d in [*((c, f"_{c}") for c in further), *((f"_probe.{c}", f"_cell.{c}") for c in ("lx", "cx", "ly", "cy"))]:
        met = met & (F.col(c) == F.col(d))
    return b.join(o, met & (over >= least), "left").withColumn("_iou", known).drop("_probe", "_cell")


def apart(pairs: DataFrame, scene: str | list[str]) -> DataFrame:
    """Adds ``_part``: pairs of a scene that share a box, directly or over others, are of one part. A sweep along x cuts
    where nothing reaches over, and another along y cuts what is left."""
    for axis, name, parts in (("x", "_px", listed(scene)), ("y", "_py", [*listed(scene), "_px"])):
        lo, hi = F.least(f"{axis}0", f"_{axis}0"), F.greatest(f"{axis}1", f"_{axis}1")
        swept = Window.partitionBy(*parts).orderBy("_lo")
        before = swept.rowsBetween(Window.unboundedPreceding, -1)
        pairs = pairs.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_cut", (F.col("_lo") >= F.max("_hi").over(before)).cast("int"))
        pairs = pairs.withColumn(name, F.sum(F.coalesce("_cut", F.lit(0))).over(swept.rowsBetween(Window.unboundedPreceding, 0))).drop("_lo", "_hi", "_cut")
    return pairs.withColumn("_part", F.struct("_px", "_py")).drop("_px", "_py")
