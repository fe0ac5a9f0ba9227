import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates as agg
from tessera.operators import catalogs as cat
from tessera.operators import designs, gates, joins
from tessera.plans import registry


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_unique_index_and_last_wins(spark):
    f = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, None)], "stem string, at int, path string")
    with pytest.raises(gates.Refused, match="a"):
        cat.unique_index(f, "stem")
    assert rows(cat.last_wins(f, "stem", "at"), "stem") == [("a", 2, "y"), ("b", 3, None)]
    assert cat.last_wins(f.limit(0), "stem", "at").count() == 0


def test_features_are_computed_for_distinct_keys(spark):
    seen = []

    def compute(keys):
        seen.append(keys.count())
        return keys.where("k != 'b'").select("k", F.length("k").alias("n"))

    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    assert rows(cat.computed_once(df, "k", compute), "k") == [(None, None), ("a", 1), ("a", 1), ("b", None)] and seen == [2]


def test_extraction_manifest(spark):
    b = spark.createDataFrame([("a", 0, -5, 0, 5, 5), ("a", 1, 20, 20, 30, 30), ("z", 0, 1, 1, 2, 2), ("z", 1, 1, 1, 2, 2)], "image string, box_index int, x0 int, y0 int, x1 int, y1 int")
    m = cat.extraction_manifest(b, spark.createDataFrame([("a", 10, 10)], "image string, width int, height int"))
    assert [(r.image, r.box_index, r.status) for r in m.orderBy("image", "box_index").collect()] == [("a", 0, "ok"), ("a", 1, "degenerate"), ("z", -1, "image missing")]


def test_labels(spark):
    t = spark.createDataFrame([(1, "0 a\n\n1 b\n"), (2, ""), (3, None)], "id int, text string")
    assert [(r.n_boxes, r.orphan) for r in cat.label_digests(t, "id", "text").orderBy("id").collect()] == [(2, False), (0, False), (None, True)]
    lines = spark.createDataFrame([("1 0.5 0.5",), ("2 0.1 0.1",)], "line string")
    assert rows(cat.collapsed(lines, "line", ["1", "2"]), "line") == [("0 0.1 0.1",), ("0 0.5 0.5",)]
    with pytest.raises(Exception, match="class not allowed: 2"):
        cat.collapsed(lines, "line", ["1"]).collect()
    assert rows(cat.class_counts(lines, "line", ["1", "3"]), "category") == [("1", 1), ("3", 0)]


def test_designs(spark):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    n = designs.trainlist_counts(designs.trainlist(paths("a", "b"), paths("c"), "path", 3)).first()
    assert (n.n_real, n.n_synthetic, n.n_total) == (6, 1, 7)
    for real, made, times in ((paths("a"), paths("b"), 0), (paths("a", "a"), paths("b"), 1), (paths("a"), paths("b", "b"), 1), (paths("a"), paths("a"), 1)):
        with pytest.raises(gates.Refused):
            designs.trainlist(real, made, "path", times)
    with pytest.raises(Exception, match="evenly"):
        designs.arms(spark.createDataFrame([("X", 0.3)], "arm string, fraction double"), 5392, 1348).collect()
    with pytest.raises(Exception, match="positive"):
        spark.range(1).select(designs.steps_per_epoch(F.lit(0), 16)).collect()
    empty = designs.trainlist_counts(designs.trainlist(paths("a"), paths("b"), "path", 1).limit(0)).first()
    assert empty.n_total == 0 and empty.real_share == 0
    gates.check_protocol(30, 30, 900, 16, 2)
    with pytest.raises(gates.Refused):
        gates.check_protocol(30, 31, 900, 16, 2)


@pytest.mark.parametrize("scale", ["matched", "shrunk", "enlarged"])
def test_balanced_pick_is_eligible(spark, scale):
    pool = spark.createDataFrame([(s, float(a), f"{s}{a}") for s in "pq" for a in (*range(1, 40), *[10] * 30)], "source string, area double, k string").withColumn("k", F.concat_ws("-", "k", F.monotonically_increasing_id()))
    asks = spark.createDataFrame([(i, 9.0 + i % 3) for i in range(60)], "id int, area double")
    picks = joins.balanced_pick(asks, pool, ["id"], "source", "k", scale, 5).join(pool.select(F.col("k").alias("picked"), F.col("area").alias("pa")), "picked").join(asks, "id").collect()
    ok = {"matched": lambda a, p: a / 2 <= p <= 2 * a, "shrunk": lambda a, p: p > 2 * a, "enlarged": lambda a, p: p < a / 2}[scale]
    assert len(picks) == 60 and all(ok(r.area, r.pa) for r in picks) and {r.source for r in picks} == {"p", "q"} and len({r.picked for r in picks}) > 5
    with pytest.raises(Exception, match="too few members"):
        joins.balanced_pick(asks.limit(1).withColumn("area", F.lit(1e6)), pool, ["id"], "source", "k", "matched", 5).collect()


def test_balanced_pick_of_all_keeps_boxes_with_too_few(spark):
    pool = spark.createDataFrame([(s, float(a), f"{s}{a}") for s in "pq" for a in range(1, 40)], "source string, area double, k string")
    asks = spark.createDataFrame([(1, 9.0), (2, 1e6), (3, None), (4, 70.0)], "id int, area double")
    picks = {r.id: (r.source, r.picked) for r in joins.balanced_pick(asks, pool, ["id"], "source", "k", "matched", 5, refuse=False).collect()}
    assert picks[2] == picks[3] == (None, None) and len(picks) == 4
    assert picks[1][1][0] == picks[1][0] and 5 <= int(picks[1][1][1:]) <= 18 and 35 <= int(picks[4][1][1:]) <= 39


def test_balanced_pick_has_every_order(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    got = registry.QUERIES["balanced_pick"](spark, sf_dir)
    high = orders.where("o_totalprice > 200000").select("o_orderkey")
    assert got.count() == orders.count() and high.count() > 0 and got.join(high, "o_orderkey").where("picked is not null").count() > 0


def test_best_match_takes_first_of_equals(spark):
    b = spark.createDataFrame([(1, 0, 0.0, 0.0, 2.0, 2.0), (2, 0, 0.0, 0.0, 2.0, 2.0)], "scene int, box int, x0 double, y0 double, x1 double, y1 double")
    c = spark.createDataFrame([(1, 3, 0.0, 0.0, 2.0, 2.0), (1, 2, 0.0, 0.0, 2.0, 2.0), (2, 1, 1.5, 1.5, 3.0, 3.0)], "scene int, idx int, x0 double, y0 double, x1 double, y1 double")
    assert rows(joins.best_match(b, c, ["scene", "box"], "idx"), "scene") == [(1, 0, 2, 1.0), (2, 0, None, None)]


def test_dependent_columns_have_no_inflation(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"))
    assert [r.vif for r in agg.variance_inflation(df, ["a", "b"]).collect()] == [None, None]


def test_determinism_verdict(spark):
    one = spark.createDataFrame([(1, 0.5)], "k int, v double")
    doc = spark.createDataFrame([("r", '{"steps": 5}')], "run string, doc string")
    assert gates.same_runs(joins.same_rows(one, one, "k", ["v"]), gates.unexpected(doc, "run", "doc", {"steps": 5})).first().verdict == "GO"
    assert gates.same_runs(joins.same_rows(one, one, "k", ["v"]), gates.unexpected(doc, "run", "doc", {"steps": 5, "epochs": 1})).first().verdict == "NO-GO"


def test_reports_refuse_odd_lists(spark, tmp_path):
    from tessera.operators import designs, reports

    rows = [(a, s, 0.1 * s + len(a)) for a in (*designs.CELLS, "control") for s in range(3)]
    metrics = spark.createDataFrame([(f"{a}{s}", a, s, v) for a, s, v in rows], "model string, arm string, seed int, value double")
    models = [f"{a}{s}" for a, s, _ in rows]
    run = lambda m, names, lock=None: reports.closed_evaluation(m, "model", names, designs.cell_coefficients(spark), ["arm"], ("F1",), lock)
    assert run(metrics, models, str(tmp_path / "lock")).count() == 8
    for m, names, lock in ((metrics, models, str(tmp_path / "lock")), (metrics, models[1:], None), (metrics.union(metrics.limit(1)), models, None), (metrics.limit(3), models, None)):
        with pytest.raises(gates.Refused):
            run(m, names, lock)
    outputs = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1)], "cell string, k int")
    drawn, digest = reports.sampled_set(outputs.where("cell = 'a'"), outputs, "cell", "k", 4, 1)
    assert drawn.count() == 4 and len(digest) == 64 and digest == reports.sampled_set(outputs.where("cell = 'a'").repartition(5), outputs, "cell", "k", 4, 1)[1]
    with pytest.raises(gates.Refused):
        reports.sampled_set(outputs, outputs, "cell", "k", 4, 1)


def test_letterboxed_and_pool(spark, tmp_path):
    from tessera.operators import reports

    b = reports.letterboxed(spark.createDataFrame([(0, 0, 20, 10, 1280, 720), (5, 5, 5, 9, 640, 640)], "x0 int, y0 int, x1 int, y1 int, width int, height int")).collect()
    assert [(r.area, r.boxed_area) for r in b] == [(200.0, 50.0), (4.0, 4.0)]
    (tmp_path / "pool.csv").write_text("name,source,width,height,contrast\na,S,4,5,1.5\nb,S,4,5,\nc,T,0,5,2\n")
    assert [(r.name, r.area) for r in reports.cell_pool(spark, str(tmp_path / "pool.csv")).collect()] == [("a", 20.0)]


def test_cells_that_the_pool_lacks_count_as_none(spark):
    """Fixed cases: a pool with one group of each source alone, and a giant box that no member is larger than twice of."""
    from tessera.operators import aggregates, joins

    levels = {"source": ["A", "B"], "contrast": ["hi", "lo"]}
    pool = spark.createDataFrame([("A", "hi", 10.0), ("B", "lo", 10.0)], "source string, contrast string, area double")
    boxes = spark.createDataFrame([(1, 10.0)], "box int, area double")
    cells = aggregates.cell_counts(boxes, joins.range_counts(boxes, pool, ["box"], ["source", "contrast"]), ["box"], ["source", "contrast"], levels, ("matched",))
    assert {(r.source, r.contrast): r.n for r in cells.collect()} == {("A", "hi"): 1, ("B", "lo"): 1, ("A", "lo"): 0, ("B", "hi"): 0}
    assert [r.feasible for r in aggregates.feasible(cells, ["box"], 1).collect()] == [False]
    full = spark.createDataFrame([(s, c, a) for s in "AB" for c in ("hi", "lo") for a in (10.0, 100.0, 1000.0, 10000.0)], "source string, contrast string, area double")
    boxes = spark.createDataFrame([(1, 500.0), (2, 1e6)], "box int, area double")
    cells = aggregates.cell_counts(boxes, joins.range_counts(boxes, full, ["box"], ["source", "contrast"]), ["box"], ["source", "contrast"], levels)
    assert {r.box: r.feasible for r in aggregates.feasible(cells, ["box"], 1).collect()} == {1: True, 2: False}
    by = {(r.scale, r.contrast): r.n_feasible for r in aggregates.feasible_by_cell(cells, ["box"], "source", ["scale", "contrast"], 1).collect()}
    assert by["shrunk", "hi"] == 1 and by["enlarged", "hi"] == 2
    assert {r.bottleneck for r in aggregates.bottlenecks(cells, ["box"], "source", ["scale"], 1).collect()} == {1, 2}


def test_series_with_a_repeated_step_is_not_complete(spark):
    from tessera.operators import aggregates

    rows = spark.createDataFrame([("a", s, 1.0) for s in (1, 2, 2, 4)] + [("b", s, 1.0) for s in (1, 2, 3)], "run string, step int, v double")
    assert {r.run: r.complete for r in aggregates.series(rows, ["run"], "step", "v").collect()} == {"a": False, "b": True}


def test_coverage_of_a_small_mask():
    import numpy as np

    from tessera.operators.images import crop_features

    p = np.zeros((4, 4, 4), np.uint8)
    p[0, 0, 3] = 255
    assert crop_features(p) == (0.0, 0.0, 0.0, 1 / 16)


def test_range_counts_of_odd_rows_and_with_few_shuffles(spark):
    """Repeated boxes have a row each, areas that are null count as over every range, bounds may lie where no member does."""
    from tessera.operators import aggregates

    pool = spark.createDataFrame([("a", 4.0), ("a", 8.0), ("a", None), ("b", 1000.0), ("b", float("nan")), (None, 4.0)], "source string, area double")
    boxes = spark.createDataFrame([(1, 4.0), (1, 4.0), (1, 16.0), (2, 8.0), (3, None), (4, 1e-3), (None, 500.0)], "box int, area double")
    want = sorted([(1, "a", 2, 1, 0), (1, "a", 2, 1, 0), (1, "a", 1, 1, 1), (2, "a", 2, 1, 0), (4, "a", 0, 3, 0), (None, "a", 0, 1, 2)] + [(1, "b", 0, 2, 0)] * 3 + [(2, "b", 0, 2, 0), (4, "b", 0, 2, 0), (None, "b", 1, 1, 0)], key=str)
    assert sorted((tuple(r) for r in joins.range_counts(boxes, pool, ["box"], ["source"]).collect()), key=str) == want
    plan = aggregates.cell_counts(boxes, joins.range_counts(boxes, pool, ["box"], ["source"]), ["box"], ["source"], {"source": ["a", "b", "c"]}).groupBy("box").agg(F.min("n").alias("n"))
    assert sum("Exchange hashpartitioning" in line and "box" in line for line in plan._jdf.queryExecution().executedPlan().toString().split("\n")) <= 1  # the boxes' keys
    assert {r.box: r.n for r in plan.collect()} == {1: 0, 2: 0, 3: 0, 4: 0, None: 0}


@pytest.mark.parametrize("most", [0, 10**6])
def test_positions_and_counts_leave_out_the_same_members(spark, most):
    """Positions along the area fit the counts below a range, whatever areas are missing or no number."""
    areas = [5.0, None, 5.0, 0.5, float("nan"), -2.0, 700.0, 5.0]
    pool = spark.createDataFrame([("a", x, str(i)) for i, x in enumerate(areas)], "source string, area double, k string")
    got = {r.position: r.area for r in joins.numbered(pool, ["source"], "area", "k", 3, most=most).collect()}
    assert [str(got[i]) for i in range(7)] == ["-2.0", "0.5", "5.0", "5.0", "5.0", "700.0", "nan"] and len(got) == 7
    n = joins.range_counts(spark.createDataFrame([(1, 5.0)], "id int, area double"), pool, ["id"], ["source"]).first()
    assert (n.n_enlarged, n.n_matched) == (2, 3) and {got[i] for i in range(n.n_enlarged, n.n_enlarged + n.n_matched)} == {5.0}


def test_numbering_moves_members_once(spark):
    pool = spark.createDataFrame([("a", float(i % 7), str(i)) for i in range(100)], "source string, area double, k string")
    plan = joins.numbered(pool, ["source"], "area", "k", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_manifest_of_many_boxes_is_dealt_by_their_number(spark, monkeypatch):
    from tessera.operators import bounds

    monkeypatch.setattr(bounds, "PART_ROWS", 10)
    monkeypatch.setattr(cat, "MOST_ROWS", 30)
    b = spark.range(200).select((F.col("id") % 50).alias("image"), F.col("id").alias("box_index"), *[F.lit(i).alias(c) for i, c in ((0, "x0"), (0, "y0"), (4, "x1"), (4, "y1"))])
    m = cat.extraction_manifest(b, spark.range(40).select(F.col("id").alias("image"), F.lit(9).alias("width"), F.lit(9).alias("height")))
    assert "hashpartitioning(image" in (plan := m._jdf.queryExecution().executedPlan().toString()) and ", 20), REPARTITION_BY_NUM" in plan and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert m.groupBy("status").count().orderBy("status").collect() == [("image missing", 10), ("ok", 160)]
