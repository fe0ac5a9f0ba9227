"""Joins by overlap, range, nearness and content."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import draw
from ..functions.vectors import unit
from .bounds import MOST_ROWS, dealt, small
from .nearness import nearest  # noqa: F401
from .overlaps import SIDES, apart, crowds, listed, overlapping


MOST_GROUPS = 64  # sums that a row carries side by side
MOST_SEEDS = 64  # maxima that one aggregate keeps side by side


def best_overlap(boxes: DataFrame, detections: DataFrame, key: list[str], scene: str = "scene", seed: str = "seed", least: float = 0.5) -> DataFrame:
    """Per box and seed the highest confidence among detections of its scene that overlap it
    enough, 0 without one. Boxes meet the detections of all seeds once, a maximum for each seed is kept
    beside the others; of more than MOST_SEEDS seeds, a box has a row for each."""
    seeds = detections.select(F.col(seed).alias("_of")).distinct()
    values = [r[0] for r in seeds.orderBy("_of").limit(MOST_SEEDS + 1).collect()]
    met = overlapping(boxes, detections.select(scene, seed, "conf", *SIDES), scene, least)
    if len(values) <= MOST_SEEDS:
        best = [F.coalesce(F.max(F.when(F.col(f"_{seed}").eqNullSafe(F.lit(v)), F.col("_conf"))), F.lit(0.0)).alias(f"_m{i}") for i, v in enumerate(values)]
        wide = met.groupBy(*key).agg(*(best or [F.lit(None).alias("_none")]))
        each = [F.struct(F.lit(v).cast(detections.schema[seed].dataType).alias(seed), F.col(f"_m{i}").alias("conf_max")) for i, v in enumerate(values)]
        return wide.select(*key, F.explode(F.array(*each)).alias("_x")).select(*key, "_x.*") if each else wide.where("false").select(*key, F.lit(None).cast(detections.schema[seed].dataType).alias(seed), F.lit(0.0).alias("conf_max"))
    found = met.groupBy(*key, F.col(f"_{seed}").alias("_of")).agg(F.max("_conf").alias("_best"))
    grown = boxes.select(*key).distinct().crossJoin(F.broadcast(seeds) if seeds.limit(MOST_ROWS + 1).count() <= MOST_ROWS else seeds)
    same = [grown[c].eqNullSafe(found[c]) for c in [*key, "_of"]]
    return grown.join(found, same, "left").select(*[grown[c] for c in key], grown["_of"].alias(seed), F.coalesce("_best", F.lit(0.0)).alias("conf_max"))


def range_counts(boxes: DataFrame, pool: DataFrame, box_key: list[str], group: list[str], area: str = "area", pool_area: str = "area") -> DataFrame:
    """Per box and pool group the number of pool members in [A/2, 2A], over 2A and under A/2.

    Members are counted by distinct area and the counts summed up along it, so nothing pairs
    boxes with members. A box's two bounds are looked up in the same order of areas: two rows, with the sums of up to
    MOST_GROUPS groups beside one another. The result is dealt by the box's key. Boxes without an area have no row,
    members without one are over every range."""
    known = pool.where(" and ".join(f"`{c}` is not null" for c in group)).groupBy(*group).agg(F.count("*").alias("_n")).limit(MOST_GROUPS + 1).collect()
    if not 0 < len(known) <= MOST_GROUPS:
        return _range_counts_by_group(boxes, pool, box_key, group, area, pool_area)
    value = {c: lambda x, c=c: F.lit(x[c]).cast(pool.schema[c].dataType) for c in group}
    names, at = [f"_n{i}" for i in range(len(known))], F.col("_at")

    def of(x) -> Column:
        same = F.lit(True)
        for c in group:
            same = same & (F.col(c) == value[c](x))
        return F.count(F.when(same, 1))

    # Sums run within slices of the range of areas, on top of the totals of earlier slices: no group is one task.
    part = F.when(F.isnan(at), 1 << 40).otherwise(F.floor(F.log2(F.greatest(at, F.lit(1e-9))) * 64)).cast("bigint").alias("_slice")
    members = pool.where(F.col(pool_area).isNotNull()).select(*group, F.col(pool_area).cast("double").alias("_at")).select(*group, "_at", part)
    keys = [f"_k{i}" for i in range(len(box_key))]
    box = boxes.where(F.col(area).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(box_key, keys)], F.col(area).cast("double").alias("_a"))
    ends = F.explode(F.array(*[F.struct(F.lit(turn).alias("turn"), c.alias("at")) for turn, c in ((0, F.col("_a") / 2), (2, F.col("_a") * 2))])).alias("_x")
    asks = box.select(*keys, "_a", ends).select(*keys, "_a", F.col("_x.turn").alias("_turn"), F.col("_x.at").alias("_at")).select("*", part)
    per_slice = members.groupBy("_slice").agg(*[of(x).alias(n) for x, n in zip(known, names)]).unionByName(asks.select("_slice").distinct(), allowMissingColumns=True)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    base = per_slice.groupBy("_slice").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).select("_slice", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_b{n}") for n in names])
    areas = members.groupBy("_slice", "_at").agg(*[of(x).alias(n) for x, n in zip(known, names)]).withColumn("_turn", F.lit(1))
    inside = Window.partitionBy("_slice").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = areas.unionByName(asks, allowMissingColumns=True).select(*keys, "_a", "_turn", "_slice", "_at", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    summed = marks.select(*keys, "_a", "_turn", "_slice", *[F.sum(n).over(inside).alias(n) for n in names]).where("_turn != 1")
    found = summed.join(small(base), "_slice").select(*keys, "_a", "_turn", *[(F.col(n) + F.col(f"_b{n}")).alias(n) for n in names])
    end = lambda n, turn: F.max(F.when(F.col("_turn") == turn, F.col(n)))
    both = [c for n in names for c in (end(n, 0).alias(f"{n}_lo"), end(n, 2).alias(f"{n}_hi"))]
    met = dealt(found, box.count() * 2, *keys).groupBy(*keys, "_a").agg(*both, F.count(F.when(F.col("_turn") == 0, 1)).cast("int").alias("_times"))
    each = [
        F.struct(*[value[c](x).alias(c) for c in group], (F.col(f"{n}_hi") - F.col(f"{n}_lo")).alias("n_matched"), (F.lit(x["_n"]) - F.col(f"{n}_hi")).alias("n_shrunk"), F.col(f"{n}_lo").alias("n_enlarged"))
        for x, n in zip(known, names)
    ]
    # equal rows of boxes have a row each
    rows = met.select(*[F.col(k).alias(c) for c, k in zip(box_key, keys)], F.explode(F.flatten(F.array_repeat(F.array(*each), F.col("_times")))).alias("_x"))
    return rows.select(*box_key, "_x.*")


def _range_counts_by_group(boxes: DataFrame, pool: DataFrame, box_key: list[str], group: list[str], area: str, pool_area: str) -> DataFrame:
    """The same for many groups: a box's bounds are rows for each group."""
    members = pool.where(F.col(pool_area).isNotNull()).select(*group, F.col(pool_area).alias("at")).groupBy(*group, "at").agg(F.count("*").alias("n"))
    groups = pool.select(*group).distinct()
    asks = boxes.select(F.col(area).alias("a")).distinct().crossJoin(small(groups))
    marks = (
        members.select(*group, "at", "n", F.lit(1).alias("turn"), F.lit(None).cast("double").alias("a"), F.lit("").alias("side"))
        .unionByName(asks.select(*group, (F.col("a") / 2).alias("at"), F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("turn"), "a", F.lit("lo").alias("side")))
        .unionByName(asks.select(*group, (F.col("a") * 2).alias("at"), F.lit(0).cast("bigint").alias("n"), F.lit(2).alias("turn"), "a", F.lit("hi").alias("side")))
    )
    # Sums run within slices of the range of areas, on top of the totals of earlier slices: no group is one task.
    sliced = marks.withColumn("slice", F.floor(F.log2(F.greatest("at", F.lit(1e-9))) * 16).cast("bigint"))
    per_slice = sliced.groupBy(*group, "slice").agg(F.sum("n").alias("slice_n"))
    before = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = per_slice.select(*group, "slice", F.coalesce(F.sum("slice_n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*group, "slice").orderBy("at", "turn")
    counted = sliced.join(base, [*group, "slice"]).withColumn("upto", F.col("base") + F.sum("n").over(inside))
    bounds = counted.where("side != ''").groupBy(*group, "a").agg(F.max(F.when(F.col("side") == "lo", F.col("upto"))).alias("under"), F.max(F.when(F.col("side") == "hi", F.col("upto"))).alias("within"))
    totals = pool.groupBy(*group).agg(F.count("*").alias("total"))
    out = boxes.select(*box_key, F.col(area).alias("a")).join(bounds, "a").join(small(totals), group)
    return out.select(*box_key, *group, (F.col("within") - F.col("under")).alias("n_matched"), (F.col("total") - F.col("within")).alias("n_shrunk"), F.col("under").alias("n_enlarged"))


def range_pick(boxes: DataFrame, pool: DataFrame, box_key: list[str], pool_key: str, seed: int, area: str = "area") -> DataFrame:
    """For each box one pool member in [A/2, 2A], drawn evenly; null where there is none. Members in range lie at
    consecutive positions along the area, so a draw names a position and one equi-join finds its member."""
    every = pool.select(F.lit(0).alias("_all"), F.col(area), pool_key)
    keys = [F.col(k).cast("string") for k in box_key]
    at = F.col("n_enlarged") + draw(seed, F.lit("member"), *keys) % F.greatest(F.lit(1), "n_matched")
    asks = range_counts(boxes, every, box_key, ["_all"], area, area).where("n_matched > 0").select(*box_key, at.alias("position"))
    members = numbered(every, ["_all"], area, pool_key, seed).select("position", F.col(pool_key).alias("picked"))
    return boxes.select(*box_key).join(asks.join(members, "position"), box_key, "left").select(*box_key, "picked")


def unpaired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side alone, and which."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti").select(key, F.lit("left").alias("side")).union(right.select(key).distinct().join(left.select(key).distinct(), key, "left_anti").select(key, F.lit("right")))


def drift(before: DataFrame, now: DataFrame, key: str, content: str) -> DataFrame:
    """changed, missing or new keys between two manifests of content hashes."""
    a, b = before.select(key, F.col(content).alias("was")), now.select(key, F.col(content).alias("is_now"))
    state = F.when(F.col("is_now").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("is_now"), "changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state")).where("state is not null")


def overlaps(sets: DataFrame, against: DataFrame, tag: str, key: str) -> DataFrame:
    """How many and the first of each tagged set's keys that are also in another set."""
    return sets.join(against.select(key).distinct(), key, "left_semi").groupBy(tag).agg(F.count_distinct(key).alias("n_shared"), F.min(key).alias("first_shared"))


def overlaps_of_all(sets: DataFrame, tag: str, key: str, most: int) -> DataFrame:
    """For each two tagged sets that share keys: how many, and the first ``most`` of them. Sets meet by key; a
    key is in as many rows as there are sets, which are few."""
    rows = sets.select(tag, key).where(F.col(key).isNotNull()).distinct()
    pairs = rows.join(rows.select(F.col(tag).alias("other"), key), key).where(F.col(tag) != F.col("other"))
    w = Window.partitionBy(tag, "other", "_part").orderBy(key)
    # the first ones of each part of a pair's keys, so no pair of large sets is sorted in one task
    first = pairs.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(64))).withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most)
    shared = first.groupBy(tag, "other").agg(F.slice(F.array_sort(F.collect_list(key)), 1, most).alias("shared"))  # 64 * most of a pair
    return pairs.groupBy(tag, "other").agg(F.count("*").alias("n_shared")).join(shared, [tag, "other"])


def same_rows(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per column: compared rows and those that differ; NaN equals NaN, null equals null."""
    pairs = a.select(key, *[F.col(c).alias(f"a_{c}") for c in columns]).join(b.select(key, *[F.col(c).alias(f"b_{c}") for c in columns]), key, "full_outer")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).cast("int").alias("differs")) for c in columns])).alias("x")
    return pairs.select(each).groupBy(F.col("x.column").alias("column")).agg(F.count("*").alias("n"), F.sum("x.differs").cast("bigint").alias("n_differ"))


def paired_differences(cube: DataFrame, keys: list[str], arm: str, value: str, one: str, other: str) -> DataFrame:
    """Value of one arm minus the other's, for keys that both have."""
    wide = cube.where(F.col(arm).isin(one, other)).groupBy(*keys).agg(F.max(F.when(F.col(arm) == one, F.col(value))).alias("p"), F.max(F.when(F.col(arm) == other, F.col(value))).alias("q"))
    return wide.where("p is not null and q is not null").select(*keys, (F.col("p") - F.col("q")).alias("difference"))


def centroid(vectors: DataFrame, vector_col: str) -> DataFrame:
    """One row: the normalised mean of normalised vectors, aggregated by component."""
    parts = vectors.where(F.col(vector_col).isNotNull()).select(F.posexplode(unit(vector_col)).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    whole = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))  # as many entries as components
    return whole.select(unit("c").alias("centroid"))


def greedy_match(predictions: DataFrame, truth: DataFrame, scene: str | list[str] = "scene", least: float = 0.5, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """One-to-one matches within a scene (one column or several): objects in their order each take the unused
    prediction of highest confidence (then by x0, y0, x1, y1) that overlaps them enough: scene, idx, ``keep`` of the objects, detected.

    Spark joins the pairs that overlap; a task goes through them in order and remembers the predictions taken in the scene at
    hand. Where some scene is busy, scenes are cut in parts that share no box first; otherwise objects
    and predictions move once, by scene. ``idx`` numbers the objects of a scene."""
    keys = listed(scene)
    # equal predictions are told apart by a number; which of them is taken makes no difference
    p = predictions.select(*keys, "conf", *SIDES).withColumn("n", F.monotonically_increasing_id())
    t = truth.select(*keys, F.col("idx").cast("bigint").alias("idx"), *keep, *[c for c in SIDES if c not in keep])
    busy = crowds(t.select(*keys).unionByName(p.select(*keys)), keys)
    pairs = overlapping(t, p, keys, least, within=busy)
    own = [*keys, "idx", *keep]
    place = keys
    if busy is not None:
        pairs, place = apart(pairs.where("_iou is not null"), keys).select("*", "_part.*"), [*keys, "_px", "_py"]
    order = Window.partitionBy(*place).orderBy("idx", F.desc("_conf"), *[f"_{c}" for c in SIDES], "_n")

    def take(batches):
        last, done, used, first, held = None, True, set(), None, None
        for batch in batches:
            some, at, hit = batch.select(own), [], []
            before = []
            for row, (turn, i, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_turn", "idx", "_n")))):
                if turn == 1 or i != last:
                    if not done and first is None:
                        before.append(held)
                    elif not done:
                        at.append(first)
                        hit.append(False)
                    if turn == 1:
                        used = set()
                    last, done, first = i, n is None, row
                    if done:
                        at.append(row)
                        hit.append(False)
                if not done and n not in used:
                    used.add(n)
                    done = True
                    at.append(row)
                    hit.append(True)
            if not done and first is not None:
                held, first = some.slice(first, 1), None
            for found, what in [*((h, [False]) for h in before), (some.take(pa.array(at, pa.int64())), hit)]:
                yield pa.RecordBatch.from_arrays([*found.columns, pa.array(what, pa.bool_())], names=[*own, "detected"])
        if not done:
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array([False], pa.bool_())], names=[*own, "detected"])

    types = dict(t.dtypes)
    rows = pairs.withColumn("_turn", F.row_number().over(order)).select(*own, "_turn", "_n")
    found = rows.mapInArrow(take, ", ".join(f"`{c}` {types[c]}" for c in own) + ", detected boolean")
    if busy is None:
        return found
    taken = found.where("detected").select(*keys, "idx", F.lit(True).alias("_taken"))
    return t.join(taken, [*keys, "idx"], "left").select(*own, F.coalesce("_taken", F.lit(False)).alias("detected"))


def best_match(boxes: DataFrame, candidates: DataFrame, key: list[str], idx: str, scene: str | list[str] = "scene", least: float = 0.5) -> DataFrame:
    """Per box the candidate of its scene (one column or several) that overlaps it most (the smallest ``idx`` of equals), if enough; else null."""
    pairs = overlapping(boxes, candidates.select(*listed(scene), F.col(idx).alias("idx"), *SIDES), scene, least)
    best = F.max(F.when(F.col("_iou").isNotNull(), F.struct("_iou", (-F.col("_idx")).alias("_minus")))).alias("_best")
    return pairs.groupBy(*key).agg(best).select(*key, (-F.col("_best._minus")).alias("match"), F.col("_best._iou").alias("overlap"))


def replication(first: DataFrame, second: DataFrame, name: str = "contrast") -> DataFrame:
    """Contrasts that both analyses have, by what their names have before a colon, and whether
    the verdicts agree."""
    short = F.split_part(F.col(name), F.lit(":"), F.lit(1))
    a, b = (df.select(short.alias(name), F.col("mean").alias(f"mean_{i}"), F.col("verdict").alias(f"verdict_{i}")) for i, df in ((1, first), (2, second)))
    return a.join(b, name).withColumn("replicates", F.col("verdict_1").eqNullSafe(F.col("verdict_2")))


def numbered(pool: DataFrame, group: list[str], area: str, key: str, seed: int, pieces: int = 64, most: int = 1_000_000) -> DataFrame:
    """Adds ``position``, from 0 along the area in each group (of one area by piece, then key): by sorting slices of the range, as long as none
    has more than ``most`` members. Otherwise members of one area are dealt to
    pieces, whose counts are summed up in slices: neither a group nor an area is one task."""
    pool = pool.where(F.col(area).isNotNull())  # as in range_counts, which counts none of them below a range
    rows = pool.withColumn("_piece", draw(seed, F.col(key).cast("string")) % pieces)
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    start_of = lambda n: n.select(*group, "_slice", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    slice_of = lambda k: F.when(F.isnan(F.col(area)), 1 << 40).otherwise(F.floor(F.log2(F.greatest(F.col(area), F.lit(1e-9))) * k)).cast("bigint").alias("_slice")
    narrow = slice_of(256)
    per_slice = small(pool.groupBy(*group, narrow).agg(F.count("*").alias("_s")))  # a row a slice
    if (per_slice.agg(F.max("_s")).first()[0] or 0) <= most:
        # a slice is sorted in one task, and rows move once
        inside = Window.partitionBy(*group, "_slice").orderBy(area, "_piece", key)
        placed = rows.withColumn("_slice", narrow).withColumn("_place", F.row_number().over(inside) - 1)
        return placed.join(small(start_of(per_slice)), [*group, "_slice"]).withColumn("position", F.col("_base") + F.col("_place")).drop("_piece", "_slice", "_place", "_base")
    n = rows.groupBy(*group, area, "_piece").agg(F.count("*").alias("_n")).withColumn("_slice", slice_of(16))
    base = start_of(n.groupBy(*group, "_slice").agg(F.sum("_n").alias("_s")))
    inside = Window.partitionBy(*group, "_slice").orderBy(area, "_piece").rowsBetween(Window.unboundedPreceding, -1)
    start = n.join(base, [*group, "_slice"]).select(*group, area, "_piece", (F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*group, area, "_piece").orderBy(key)) - 1
    return rows.withColumn("_place", place).join(start, [*group, area, "_piece"]).withColumn("position", F.col("_start") + F.col("_place")).drop("_piece", "_place", "_start")


def balanced_pick(boxes: DataFrame, pool: DataFrame, box_key: list[str], source: str, pool_key: str, scale: str, seed: int, least: int = 2, area: str = "area", refuse: bool = True) -> DataFrame:
    """For each box a member of the pool of the right scale: its source is drawn first, evenly, then the member.

    Members of a scale lie at consecutive positions along the area, so a draw names a position
    and one equi-join finds its member; boxes and members never meet as pairs. A box for which
    some source has fewer than ``least`` eligible members is an error, or without ``refuse`` has
    a null source and pick."""
    counts = range_counts(boxes, pool, box_key, [source], area, area)
    n = {"matched": F.col("n_matched"), "shrunk": F.col("n_shrunk"), "enlarged": F.col("n_enlarged")}[scale]
    first = {"matched": F.col("n_enlarged"), "shrunk": F.col("n_enlarged") + F.col("n_matched"), "enlarged": F.lit(0)}[scale]
    keys = [F.col(k).cast("string") for k in box_key]
    options = counts.groupBy(*box_key).agg(F.array_sort(F.collect_list(F.struct(source, n.alias("n"), first.cast("bigint").alias("first")))).alias("o"))  # an entry a source
    short = F.exists("o", lambda x: x["n"] < least)
    bad = F.raise_error(F.concat(F.lit("too few members for box "), F.concat_ws(",", *keys))).cast("bigint")
    roll = F.element_at("o", (draw(seed, F.lit("source"), *keys) % F.size("o") + 1).cast("int"))
    picks = options.withColumn("_short", short).withColumn("_pick", roll)
    at = F.when(F.col("_short"), bad).otherwise(F.col("_pick.first") + draw(seed, F.lit("member"), *keys) % F.greatest(F.lit(1), F.col("_pick.n")))
    members = numbered(pool.select(source, F.col(area), pool_key), [source], area, pool_key, seed).select(source, "position", F.col(pool_key).alias("picked"))
    if refuse:
        return picks.select(*box_key, F.col(f"_pick.{source}").alias(source), at.alias("position")).join(members, [source, "position"]).select(*box_key, source, "picked")
    drawn = picks.where(~F.col("_short")).select(*box_key, F.col(f"_pick.{source}").alias(source), at.alias("position")).join(members, [source, "position"])
    return boxes.select(*box_key).join(drawn, box_key, "left").select(*box_key, source, "picked")
