from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import gates, images, models
from tessera.plans import registry, surrogates

SMALL = models.Settings(iterations=6, rate=0.3, depth=3, least_rows=5, held=10**9)  # nothing held back


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(scale=0.3, size=600) > 0).astype(int)
    rows = [(f"g{i % 40}", *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "g string, a double, b double, c double, y int").cache()


def by_coalitions(leaves, x, n):
    """Every coalition, with absent features going both ways by cover."""

    def worth(known):
        return sum(v * np.prod([float(lo < x[f] <= hi) if f in known else z for f, lo, hi, z in c]) for v, c in leaves)

    phi = np.zeros(n)
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        for k in range(n):
            for s in combinations(rest, k):
                phi[i] += factorial(k) * factorial(n - k - 1) / factorial(n) * (worth({*s, i}) - worth(set(s)))
    return phi


def test_attributions_are_shapley_values_and_sum_to_the_log_odds(table):
    model = models.fit(table, ["a", "b", "c"], "y", SMALL)
    rows = models.scores(model, table, ["a", "b", "c"]).limit(40).toPandas()
    x = rows[["a", "b", "c"]].to_numpy()
    leaves = model.leaves
    phi, base = models.shapley(leaves, x)
    p = rows["score"].to_numpy()
    assert np.allclose(phi.sum(axis=1) + base, np.log(p / (1 - p)), atol=1e-9) and len(model.leaves) > 12
    for i in range(5):
        assert np.allclose(phi[i], by_coalitions(leaves, x[i], 3), atol=1e-9)


def test_the_table_of_nodes_gives_the_margins_in_sql(table):
    """A walk over the nodes in DuckDB adds up to the log odds of Spark's own scores; covers of children add up to their parent's."""
    import duckdb
    import pandas as pd

    model = models.fit(table, ["a", "b", "c"], "y", models.Settings(iterations=8, depth=3, least_rows=5, held=4), group="g")
    rows = models.scores(model, table, ["a", "b", "c"]).toPandas()
    assert list(rows.columns) == [*table.columns, "score"]
    nodes = pd.DataFrame(model.nodes, columns=["tree", "node", "feature", "threshold", "lo", "hi", "value", "cover"])  # noqa: F841
    x = pd.DataFrame({"id": range(len(rows)), "f": rows[["a", "b", "c"]].to_numpy().tolist(), "score": rows["score"]})  # noqa: F841
    got = duckdb.sql("""WITH RECURSIVE w AS (SELECT id, f, tree, 0 AS node FROM x, (SELECT DISTINCT tree FROM nodes)
        UNION ALL SELECT id, f, w.tree, CASE WHEN f[feature::INT + 1] <= threshold THEN lo::INT ELSE hi::INT END FROM w JOIN nodes USING (tree, node) WHERE feature IS NOT NULL)
        SELECT id, sum(value) AS margin FROM w JOIN nodes USING (tree, node) WHERE feature IS NULL GROUP BY id ORDER BY id""").df()
    p = rows["score"].to_numpy()
    assert np.allclose(got["margin"], np.log(p / (1 - p)), atol=1e-9)
    assert duckdb.sql("SELECT count(*) FROM nodes p JOIN nodes a ON a.tree = p.tree AND a.node = p.lo::INT JOIN nodes b ON b.tree = p.tree AND b.node = p.hi::INT WHERE abs(p.cover - a.cover - b.cover) > 1e-6").fetchall() == [(0,)]


def test_odd_features_and_labels(spark, table):
    with pytest.raises(ValueError, match="null, NaN or infinite"):
        models.fit(table.withColumn("a", F.when(F.col("a") > 1, F.lit(float("nan"))).otherwise(F.col("a"))), ["a"], "y", SMALL)
    few = table.where("g in ('g1', 'g2')")
    assert models.fit(few.unionByName(few.withColumn("y", F.lit(None).cast("int"))), ["a"], "y", models.Settings(iterations=2, least_rows=1, held=1), group="g").leaves  # all would be held back
    heavy = table.withColumn("w", F.when(F.col("y") == 1, 50.0).otherwise(1.0))
    light, more = (models.scores(models.fit(df, ["c"], "y", SMALL, w), table, ["c"]).agg(F.avg("score")).first()[0] for df, w in ((table, None), (heavy, "w")))
    assert more > light + 0.2


def test_ranking_folds_stability_and_mediation(table):
    r = models.ranking(table, ["a", "b", "c"], "y", SMALL).orderBy("position").collect()
    assert r[0].feature == "a" and r[0].direction > 0.5
    folds = models.cross_validate(table, ["a", "b", "c"], "y", "g", 3, SMALL)
    assert models.require_precision(folds) > 0.8 and folds.count() == 3
    with pytest.raises(gates.Refused):
        models.require_precision(folds, 1.1)
    s = {x.feature: x for x in models.stability(table, ["a", "b", "c"], "y", "g", 2, 1, SMALL).collect()}
    assert s["a"].top_share == 1 and s["a"].mean_position == 1
    m = models.mediation(table.withColumn("d", F.col("a") + 0.0), ["b", "c"], ["a"], ["b"], "y", SMALL).first()
    assert m.without_mediators > 0 and m["drop"] == pytest.approx(1 - m.with_mediators / m.without_mediators)
    with pytest.raises(gates.Refused):
        models.mediation(table, ["a"], ["a"], ["a"], "y", SMALL)
    with pytest.raises(gates.Refused):
        models.fit(table.where("y = 1"), ["a"], "y", SMALL)


def test_registered_surrogates_are_whole(spark, sf_dir, monkeypatch):
    seen = {}
    for name in ("cross_validate", "ranking", "mediation", "stability"):
        monkeypatch.setattr(models, name, lambda df, *a, name=name: seen.__setitem__(name, a))
    for name in ("surrogate_folds", "surrogate_ranking", "mediation_test", "surrogate_stability"):
        registry.QUERIES[name](spark, sf_dir)
    assert {a[-1] for a in seen.values()} == {models.Settings()} and len(seen) == 4
    assert seen["cross_validate"][3] == 5 and seen["stability"][3] == 30
    assert registry.QUERIES["bootstrap_groups"](spark, sf_dir).select("replicate").distinct().count() == 30


def test_texts_are_measured_before_labels_meet_them(spark, sf_dir):
    plan = surrogates.measured(registry.Tables(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join") :]
    assert "regexp_replace" in joined and "regexp_replace" not in plan[: plan.index("Join")]


def test_masked_crop():
    rgb = np.full((4, 6, 3), 7, np.uint8)
    mask = np.zeros((4, 6), bool)
    mask[:, :3] = True
    crop, share = images.masked_crop(rgb, (-2, 1, 6, 9), mask)
    assert crop.shape == (3, 6, 4) and share == 0.5 and crop[0, 0].tolist() == [7, 7, 7, 255] and crop[0, 5, 3] == 0
    assert images.masked_crop(rgb, (9, 9, 12, 12), mask)[1] == 0


def test_resizing():
    flat = np.full((5, 7, 4), 90, np.uint8)
    for w, h in ((3, 2), (14, 11), (7, 5), (1, 1)):
        out = images.resized(flat, w, h)
        assert out.shape == (h, w, 4) and (out == 90).all()
    p = np.random.default_rng(0).integers(0, 256, (6, 6, 4), dtype=np.uint8)
    p[..., 3] = 255
    assert (images.resized(p, 6, 6) == p).all()


def test_composition(spark):
    scene = np.zeros((4, 8, 3), np.uint8)
    crop = np.full((2, 2, 4), 255, np.uint8)
    s = spark.createDataFrame([("a", 0, 8, 4, scene.tobytes()), ("b", 0, 8, 4, scene.tobytes())], "image string, variation int, width int, height int, rgb binary")
    p = spark.createDataFrame([("a", 0, 0, 2, 1, 6, 3, crop.tobytes(), 2, 2), ("a", 0, 1, 0, 0, 2, 2, None, None, None), ("z", 0, 0, 0, 0, 1, 1, crop.tobytes(), 2, 2)], "image string, variation int, box_index int, x0 int, y0 int, x1 int, y1 int, crop binary, crop_width int, crop_height int")
    a, b = images.composed(s, p).orderBy("image").collect()
    out = np.frombuffer(a.rgb, np.uint8).reshape(4, 8, 3)
    assert (out[1:3, 2:6] == 255).all() and out.sum() == 255 * 3 * 8 and a.n_pasted == 1
    assert a.label.splitlines() == ["0 0.500000 0.500000 0.500000 0.500000", "0 0.125000 0.250000 0.250000 0.500000"] and b.label == "" and b.n_pasted == 0


def test_features_are_worked_out_once(spark, table):
    """Fits and attributions read a table of measured rows, not the features' own work again."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(x):
        seen.add(1)
        return x

    costly = costly.asNondeterministic()
    models.ranking(table.withColumn("a", costly("a")), ["a", "b"], "y", models.Settings(iterations=2, depth=2, held=10**9)).collect()
    assert seen.value == table.count()


def test_models_grow_side_by_side(spark, table, monkeypatch):
    """Resamples have jobs of their own in no way, and passes over all rows grow the trees that tasks grow."""
    settings, features = models.Settings(iterations=3, rate=0.3, depth=2, least_rows=5, held=4), ["a", "b", "c"]
    weights = F.array((F.col("b") > 0).cast("double"), F.lit(1.0), F.lit(2.0))
    status, jobs = spark.sparkContext.statusTracker(), []
    for replicates in (2, 12):
        spark.sparkContext.setJobGroup(f"grow{replicates}", "")
        models.stability(table, features, "y", "g", replicates, 1, settings).collect()
        jobs.append(len(status.getJobIdsForGroup(f"grow{replicates}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 2
    tasks = models.fit_all(table, features, "y", weights, 3, settings, "g")
    monkeypatch.setattr(models, "TASK_ROWS", 0)
    monkeypatch.setattr(models, "PENDING", 2)
    passes = models.fit_all(table, features, "y", weights, 3, settings, "g")
    for a, b in zip(tasks, passes):
        shape = lambda m: sorted((n[0], n[1], n[2], n[3]) for n in m.nodes if n[2] is not None)
        assert shape(a) == shape(b) and len(shape(a)) > 3
        assert np.allclose(sorted(v for v, _ in a.leaves), sorted(v for v, _ in b.leaves), atol=1e-9)
    assert tasks[0].nodes[0][7] < tasks[1].nodes[0][7] == tasks[2].nodes[0][7] / 2


def test_passes_write_rows_once_and_count_alike_ones_together(spark, table, monkeypatch):
    """Passes of many trees read the rows written at first, rows alike are one of more weight, and the trees are those of the weights."""
    settings, features, paths = models.Settings(iterations=5, rate=0.3, depth=2, least_rows=5, held=4), ["a", "b", "c"], []
    own, status = models.new_path, spark.sparkContext.statusTracker()
    monkeypatch.setattr(models, "new_path", lambda *a: paths.append(own(*a)) or paths[-1])
    monkeypatch.setattr(models, "PENDING", 2)
    few = table.where("b > 0")
    copies = few.unionByName(few).unionByName(few)
    fitted, jobs = [], []
    for df, weight, rows in ((copies, 1.0, 0), (copies, 1.0, 600), (few, 3.0, 600)):
        monkeypatch.setattr(models, "TASK_ROWS", rows)
        spark.sparkContext.setJobGroup(f"alike{len(jobs)}", "")
        fitted.append(models.fit_all(df, features, "y", F.array(F.lit(weight), (F.col("a") > -1).cast("double") * weight), 2, settings, "g"))
        jobs.append(len(status.getJobIdsForGroup(f"alike{len(jobs)}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(paths) == 3 and jobs[1] <= jobs[2] < jobs[0]
    for two in fitted[:2]:
        for a, b in zip(two, fitted[2]):
            assert [n[:4] for n in a.nodes] == [n[:4] for n in b.nodes] and len(a.nodes) > 16
            assert np.allclose([v for v, _ in a.leaves], [v for v, _ in b.leaves], atol=1e-9)


def test_attributions_by_cell_are_those_of_the_leaves(table, monkeypatch):
    leaves, rng = models.fit(table, ["a", "b", "c"], "y", SMALL).leaves, np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(50, 3)), [[v, v, v] for _, c in leaves for _, lo, hi, _ in c for v in (lo, hi) if np.isfinite(v)]])  # on the bounds too
    by_leaf = sum(models.shapley([leaf], x)[0] for leaf in leaves)
    for cells in (1, 50, 10**5):
        monkeypatch.setattr(models, "CELLS", cells)
        assert np.allclose(models.shapley(leaves, x)[0], by_leaf, atol=1e-12)
    for i in range(0, len(x), 7):
        assert np.allclose(by_leaf[i], by_coalitions(leaves, x[i], 3), atol=1e-9)


def test_a_fold_without_a_group_has_no_measures(spark, table):
    folds = {r.fold: r.ap for r in models.cross_validate(table.where("g in ('g1', 'g2', 'g3')"), ["a"], "y", "g", 12, models.Settings(iterations=1, depth=1, least_rows=1, held=10**9)).collect()}
    assert len(folds) == 12 and 9 <= sum(ap is None for ap in folds.values()) <= 11
