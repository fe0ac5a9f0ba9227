"""Overlap joins and greedy matches against all pairs, in busy scenes and others."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import joins, overlaps

BOX = "scene int, id int, x0 double, y0 double, x1 double, y1 double"


def union_share(a, b):
    w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def scene(rnd, n, spread):
    """Boxes of all sizes, some moved or scaled copies of others, some without an area."""
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.6:
            x0, y0, x1, y1 = rnd.choice(out)
            k, dx, dy = rnd.choice([1, 0.5, 2, 0.71, 1.4]), rnd.choice([0, 0.5, -0.33]) * (x1 - x0), rnd.choice([0, 0.1]) * (y1 - y0)
            out.append((x0 + dx, y0 + dy, x0 + dx + (x1 - x0) * k, y0 + dy + (y1 - y0) / k))
        else:
            x0, y0 = rnd.uniform(-spread, spread), rnd.uniform(-spread, spread)
            out.append((x0, y0, x0 + 2 ** rnd.uniform(-6, 6), y0 + 2 ** rnd.uniform(-6, 6)))
    return out + [(1.0, 1.0, 1.0, 5.0), (3.0, 3.0, 2.0, 4.0), (0.0, 0.0, 4.0, 4.0), (0.0, 0.0, 4.0, 2.0)]


@pytest.mark.parametrize("least", [0.5, 0.25, 0.9, 1.0])
@pytest.mark.parametrize("busy", [0, 10_000])
def test_overlapping_pairs_equal_all_pairs(spark, least, busy):
    rnd = random.Random(int(least * 100))
    rows = {k: [(s, i, *b) for s in (1, 2, None) for i, b in enumerate(scene(rnd, 60, 20.0))] for k in ("box", "other")}
    rows["other"] += [(1, 1000 + i, *b[2:]) for i, b in enumerate(rows["box"]) if b[0] == 1]
    met = overlaps.overlapping(spark.createDataFrame(rows["box"], BOX), spark.createDataFrame(rows["other"], BOX), least=least, busy=busy)
    got = [(r.scene, r.id, r._id) for r in met.where("_iou is not null").collect()]
    want = [(a[0], a[1], b[1]) for a in rows["box"] for b in rows["other"] if a[0] is not None and a[0] == b[0] and union_share(a[2:], b[2:]) >= least]
    assert sorted(got) == sorted(want) and len(want) > 50
    assert {(r.scene, r.id) for r in met.collect()} == {(a[0], a[1]) for a in rows["box"]}


def test_a_scene_of_many_boxes_is_many_keys(spark):
    """200,000 boxes and as many detections in one scene: 4e10 pairs, were they all made."""
    b = spark.range(200_000).select(F.lit(1).alias("scene"), F.col("id").cast("int").alias("id"), (F.col("id") % 500 * 10.0).alias("x0"), (F.floor(F.col("id") / 500) * 10.0).alias("y0"))
    b = b.select("*", (F.col("x0") + 8 + F.col("id") % 3).alias("x1"), (F.col("y0") + 9).alias("y1"))
    d = b.select("scene", (F.col("id") % 2).alias("seed"), F.lit(0.5).alias("conf"), (F.col("x0") + 1).alias("x0"), "y0", (F.col("x1") + 1).alias("x1"), "y1")
    best = joins.best_overlap(b, d, ["scene", "id"])
    assert best.groupBy("seed").agg(F.sum("conf_max").alias("s")).orderBy("seed").collect() == [(0, 50_000.0), (1, 50_000.0)]
    keys = overlaps.overlapping(b, d)._jdf.queryExecution().optimizedPlan().toString()
    assert "_cell" in keys or "cx" in keys


def greedy(objects, predictions):
    used, out = set(), {}
    order = sorted(range(len(predictions)), key=lambda i: (-predictions[i][0], *predictions[i][1:]))
    for idx, box in objects:
        hit = next((i for i in order if i not in used and union_share(box, predictions[i][1:]) >= 0.5), None)
        out[idx] = hit is not None
        used |= {hit} - {None}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_matches_equal_the_loop(spark, seed):
    """With predictions that differ in nothing or in x1 alone, and chains of boxes over a scene."""
    rnd = random.Random(seed)
    boxes = {s: scene(rnd, 50, 6.0) for s in (1, 2)}
    predictions = {s: [(rnd.choice([0.2, 0.5, 0.9]), b[0] + rnd.choice([0, 0.01]), b[1], b[2] + rnd.choice([0, 0.05]), b[3]) for b in rnd.choices(boxes[s], k=60)] for s in boxes}
    for s in boxes:
        predictions[s] += predictions[s][:7] + [(c, x0, y0, x1 + 0.01, y1) for c, x0, y0, x1, y1 in predictions[s][7:14]]
    truth = spark.createDataFrame([(s, i, *b) for s, bs in boxes.items() for i, b in enumerate(bs)], BOX.replace("id int", "idx int"))
    found = spark.createDataFrame([(s, *p) for s, ps in predictions.items() for p in ps], "scene int, conf double, x0 double, y0 double, x1 double, y1 double")
    got = {(r.scene, r.idx): r.detected for r in joins.greedy_match(found, truth).collect()}
    want = {(s, i): v for s in boxes for i, v in greedy(list(enumerate(boxes[s])), predictions[s]).items()}
    assert got == want


def test_a_tie_in_place_and_confidence_goes_by_the_far_corner(spark):
    """The object takes the prediction with the smaller x1, which leaves the other one for its neighbour."""
    truth = spark.createDataFrame([("s", 0, 0.0, 0.0, 10.0, 10.0), ("s", 1, 0.0, 0.0, 19.0, 10.0)], "scene string, idx int, x0 double, y0 double, x1 double, y1 double")
    found = spark.createDataFrame([("s", 0.5, 0.0, 0.0, 15.0, 10.0), ("s", 0.5, 0.0, 0.0, 9.0, 10.0)], "scene string, conf double, x0 double, y0 double, x1 double, y1 double")
    assert [r.detected for r in joins.greedy_match(found, truth).orderBy("idx").collect()] == [True, True]
    assert [r.detected for r in joins.greedy_match(found.where("x1 = 9"), truth).orderBy("idx").collect()] == [True, False]


def test_parts_of_a_scene_are_matched_apart(spark):
    """Boxes that share nothing along x or y are different parts, so one scene is many tasks."""
    pairs = spark.createDataFrame([("s", 20.0 * (i % 30), 20.0 * (i // 30)) for i in range(900)], "scene string, x0 double, y0 double")
    for c, k in (("x1", "x0"), ("y1", "y0"), ("_x1", "x0"), ("_y1", "y0")):
        pairs = pairs.withColumn(c, F.col(k) + 10)
    pairs = pairs.withColumn("_x0", F.col("x0") + 1).withColumn("_y0", F.col("y0") + 1)
    assert overlaps.apart(pairs, "scene").select("_part").distinct().count() == 900


def exchanges(df, spark):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line]


def test_dealt_tables_meet_without_another_shuffle(spark, tmp_path):
    """Where no scene is busy, objects and predictions that are dealt by scene stay where they are."""
    rnd = random.Random(5)
    boxes = spark.createDataFrame([(s, i, *b) for s in range(40) for i, b in enumerate(scene(rnd, 6, 6.0))], BOX.replace("id int", "idx int"))
    seeds = F.explode(F.array(F.lit(0), F.lit(1))).alias("seed")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        truth, found = (boxes.repartition("scene").select("*", seeds).withColumn("conf", F.lit(0.5)) for _ in range(2))
        for df in (joins.greedy_match(found, truth, ["scene", "seed"], keep=["x1"]), joins.best_match(truth, found, ["scene", "seed", "idx"], "idx", ["scene", "seed"]), joins.best_overlap(boxes.repartition("scene"), found, ["scene", "idx"])):
            assert len(exchanges(df, spark)) == 2 and df.count() in (boxes.count(), 2 * boxes.count())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_objects_without_a_free_prediction_are_rows_too(spark, batch):
    """Also where an object's pairs lie in several batches of rows, and where the last one finds all its predictions taken."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        truth = spark.createDataFrame([(s, i, 0.0, 0.0, 10.0, 10.0) for s in (1, 2, None) for i in range(4)], BOX.replace("id int", "idx int"))
        found = spark.createDataFrame([(s, c, 0.0, 0.0, 10.0, 10.0) for s in (1, 2, None) for c in (0.5, 0.5, 0.9)], "scene int, conf double, x0 double, y0 double, x1 double, y1 double")
        got = sorted((r.scene or 0, r.idx, r.x1, r.detected) for r in joins.greedy_match(found, truth, keep=["x1"]).collect())
        assert got == [(s, i, 10.0, s > 0 and i < 3) for s in (0, 1, 2) for i in range(4)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_busy_scenes_are_matched_like_others(spark, monkeypatch):
    monkeypatch.setattr(overlaps.crowds, "__defaults__", ("scene", 5))
    for seed in range(2):
        test_greedy_matches_equal_the_loop(spark, seed)
    test_objects_without_a_free_prediction_are_rows_too(spark, 100)
