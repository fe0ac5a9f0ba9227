import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import tails
from tessera.operators import gates, joins
from tessera.operators import statistics as st
from tessera.operators.images import crop_features
from tessera.sources import labels, manifests
from tessera.streaming import detections


def test_yolo_index_counts_all_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.5 0.5 0.1 0.1\nbad\n1 0.25 0.5 0.1 0.1\n")
    rows = labels.yolo(spark, str(tmp_path)).orderBy("box_index").collect()
    assert [(r.image, r.box_index, r.valid_index, r.category) for r in rows] == [("a", 0, 0, "0"), ("a", 2, 1, "1")]
    px = labels.yolo_pixels(spark, str(tmp_path), spark.createDataFrame([("a", 200, 100)], "image string, width int, height int")).orderBy("box_index").first()
    assert (px.x0, px.y0, px.x1, px.y1) == (90, 45, 110, 55)


def test_voc_and_csv(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<annotation><filename>a.jpg</filename><size><width>10</width><height>20</height></size><object><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object><object><name>x</name></object></annotation>")
    rows = labels.voc(spark, str(tmp_path / "a.xml")).collect()
    assert [(r.category, r.x0, r.y1, r.width) for r in rows] == [("unknown", 1, 4, 10)]
    (tmp_path / "b.csv").write_text("filename,width,height,class,xmin,xmax,ymin,ymax\na,2,2,ship,1,3,1,3\na,9,2,ship,1,3,1,3\n")
    assert sorted(r.consistent for r in labels.box_csv(spark, str(tmp_path / "b.csv")).collect()) == [False, True]


def test_manifests(spark, tmp_path):
    assert manifests.manifest(spark, str(tmp_path / "none.csv"), "a string").count() == 0
    (tmp_path / "m.csv").write_text("a,b\nx,\ny,2\n")
    assert manifests.manifest(spark, str(tmp_path / "m.csv"), "a string, b int").where("b is null").count() == 1
    (tmp_path / "r.csv").write_text(" epoch, metrics/recall(B)\n 1, 0.5\n 2, 0.25\n")
    assert manifests.run_metrics(spark, str(tmp_path / "r.csv")).columns == ["epoch", "metrics_recall_B"]
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("s/a.png", b"1")
        z.writestr("s/b.png", b"22")
    assert {(r.name, len(r.content)) for r in manifests.zip_pool(spark, str(tmp_path / "p.zip")).collect()} == {("s/a.png", 1), ("s/b.png", 2)}


def test_tails_against_closed_forms():
    t = np.array([-3.0, -0.4, 0.0, 0.7, 2.5, 40.0])
    # of 1, 2 and 3 degrees of freedom the tail is elementary
    closed = {
        1: 0.5 - np.arctan(t) / np.pi,
        2: 0.5 - t / (2 * np.sqrt(2 + t * t)),
        3: 0.5 - (t / (np.sqrt(3) * (1 + t * t / 3)) + np.arctan(t / np.sqrt(3))) / np.pi,
    }
    for df, want in closed.items():
        assert tails.t_tail(t, df) == pytest.approx(want, rel=1e-9, abs=1e-13)
    p = np.array([0.5, 0.6, 0.9, 0.9995])
    assert tails.t_quantile(p, 1) == pytest.approx(np.tan(np.pi * (p - 0.5)), rel=1e-9, abs=1e-12)
    a = 4 * p * (1 - p)
    assert tails.t_quantile(p, 2) == pytest.approx((2 * p - 1) * np.sqrt(2 / a), rel=1e-9, abs=1e-12)
    for df in (5, 17, 250.5):
        assert tails.t_tail(tails.t_quantile(p, df), df) == pytest.approx(1 - p, rel=1e-9)
    f = np.array([0.0, 0.3, 1.0, 9.0])
    assert tails.f_tail(f, 2, 7) == pytest.approx((1 + 2 * f / 7) ** -3.5, rel=1e-9)
    assert tails.f_tail(t * t, 1, 6) == pytest.approx(2 * tails.t_tail(np.abs(t), 6), rel=1e-9)
    assert tails.f_tail(np.inf, 3, 4) == 0 and tails.t_tail(-np.inf, 4) == 1
    # of whole a and b the share is a sum of binomial terms
    x = np.array([0.05, 0.4, 0.93])
    assert tails.share_below(x, 3, 2) == pytest.approx(4 * x**3 * (1 - x) + x**4, rel=1e-12)


def test_equivalence():
    one, other = tails.t_tail((0.3 + 1) / 0.2, 8), tails.t_tail((1 - 0.3) / 0.2, 8)
    assert tails.equivalence_p(0.3, 0.2, 8, 1.0) == pytest.approx(max(one, other)) == tails.equivalence_p(-0.3, 0.2, 8, 1.0)
    assert tails.equivalence_p([0.5, 1.0, -2.0], 0.0, 4, 1.0).tolist() == [0, 1, 1]
    assert tails.equivalence_p(3.0, 0.2, 8, 1.0) > 0.99


def test_tails_of_columns(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (float("inf"), 2.0)], "t double, df double")
    got = [r[0] for r in rows.select(tails.t_two_sided("t", "df")).collect()]
    assert got[0] == pytest.approx(0.4226497308103742) and got[1:] == [None, 0.0]


def test_verdicts(spark):
    # Fixed vectors of differences and their verdicts.
    vectors = {"worse": [-2, -1.8, -2.2, -1.9, -2.1], "better": [2, 1.8, 2.2, 1.9, 2.1], "equivalent": [0.1, -0.2, 0.15, -0.05, 0], "inconclusive": [2, -1.5, 1, -2, 0.8]}
    v = spark.createDataFrame([(k, i, float(x)) for k, xs in vectors.items() for i, x in enumerate(xs)], "contrast string, seed int, difference double")
    s = st.verdict_by_intervals(st.intervals(st.contrast_summary(v))).collect()
    assert {r.contrast: r.verdict for r in s} == {k: k for k in vectors}


def test_gates(spark, tmp_path):
    one = spark.createDataFrame([("a", 1)], "k string, v int")
    gates.once(spark, str(tmp_path / "lock"), one)
    with pytest.raises(gates.Refused):
        gates.once(spark, str(tmp_path / "lock"), one)
    with pytest.raises(gates.Refused):
        gates.seal(one, one, "k")
    with pytest.raises(gates.Refused):
        gates.require(gates.violations({"x": one}))
    d = spark.sql("select map('a', 1, 'b', 2) x, map('b', 3, 'c', 4) y").select(F.map_keys(gates.map_differences("x", "y")).alias("k")).first().k
    assert sorted(d) == ["a", "b", "c"]


def test_image_features():
    p = np.zeros((4, 4, 4), np.uint8)
    assert crop_features(p) == (0, 0, 0, 0)
    p[...] = (10, 10, 10, 255)
    assert crop_features(p) == pytest.approx((0, 0, 10, 1))


def test_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    detections.run_available(detections.daily_counts(stream, "event_id", "ts", "event_type"), str(tmp_path / "out"), str(tmp_path / "ck"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() and out.agg(F.sum("n")).first()[0] <= events.count()


def test_nearest_makes_no_nested_loop(spark, sf_dir):
    rows = joins.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    assert "BroadcastNestedLoopJoin" not in rows._jdf.queryExecution().toString()
