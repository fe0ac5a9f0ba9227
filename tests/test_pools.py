"""Archives of sources, pools of crops, generated scenes, and sinks that check what they write."""

import hashlib
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.gates import Refused
from tessera.sources import labels, manifests, pools


def noise(h, w, n, seed):
    return np.random.default_rng(seed).integers(1, 255, (h, w, n), dtype=np.uint8)


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    """An archive with two images, of which one has boxes of three kinds, and a label without an image."""
    at = tmp_path_factory.mktemp("source")
    with zipfile.ZipFile(at / "raw.zip", "w") as z:
        z.writestr("set/images/a.png", pools.png(noise(40, 60, 3, 1)))
        z.writestr("set/images/b.png", pools.png(noise(20, 20, 3, 2)))
        z.writestr("set/labels/a.txt", "0 0.5 0.5 0.5 0.5\n0 0.25 0.25 0.05 0.05\n0 1.5 0.5 0.1 0.1\n")
        z.writestr("set/labels/b.txt", "0 0.5 0.5 1.0 1.0\n")
        z.writestr("set/labels/lost.txt", "0 0.5 0.5 0.5 0.5\n")
    return at


def test_png_is_read_back(spark, tmp_path):
    for n in (3, 4):
        p = noise(7, 5, n, n)
        p[..., 3:] = 255
        (tmp_path / f"x{n}.png").write_bytes(pools.png(p))
    rows = {r.image: r for r in pools.pixels(spark, str(tmp_path)).collect()}
    for n in (3, 4):
        got = np.frombuffer(rows[f"x{n}"].data, np.uint8).reshape(7, 5, -1)
        assert (got[..., :3] == noise(7, 5, n, n)[..., :3]).all()


def test_source_from_archive_to_archive(spark, source, tmp_path):
    archives, manifest = pools.load_source(spark, "S", str(source / "raw.zip"), str(tmp_path / "work"), str(tmp_path / "out"), "set/images", "set/labels", least_side=10)
    rows = {(r.image, r.box_index): r for r in manifest.collect()}
    assert rows["a", 0].status == "ok" and rows["a", 0].keep and (rows["a", 0].width, rows["a", 0].height) == (30, 20)
    assert not rows["a", 1].keep and rows["a", 1].reason.startswith("min_side") and rows["a", 2].status == "degenerate"
    assert rows["b", 0].keep and rows["lost", -1].status == "image missing" and {r.source for r in rows.values()} == {"S"}
    (archive,) = archives.collect()
    assert archive.n == 2
    with zipfile.ZipFile(archive.path) as z:
        assert sorted(z.namelist()) == ["a_box000.png", "b_box000.png"]
    pool = pools.load_pool(spark, {"S": archive.path}, str(tmp_path / "work")).collect()
    crop = next(r for r in pool if r.name == "a_box000")
    got = np.frombuffer(crop.data, np.uint8).reshape(20, 30, 4)
    assert (got[..., :3] == noise(40, 60, 3, 1)[10:30, 15:45]).all() and (got[..., 3] == 255).all()


def test_segmenter_hook(spark, source, tmp_path):
    def left_half(rgb, box):
        mask = np.zeros(rgb.shape[:2], bool)
        mask[:, : (box[0] + box[2]) // 2] = True
        return mask

    _, manifest = pools.load_source(spark, "S", str(source / "raw.zip"), str(tmp_path / "work"), str(tmp_path / "out"), "set/images", "set/labels", 10, 0.6, left_half)
    rows = {(r.image, r.box_index): r for r in manifest.collect()}
    assert rows["a", 0].coverage == 0.5 and not rows["a", 0].keep and rows["a", 0].reason.startswith("mask 0.500")
    with pytest.raises(Refused):
        with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
            pass
        pools.load_source(spark, "S", str(tmp_path / "empty.zip"), str(tmp_path / "w"), str(tmp_path / "o"), "i", "l", 10)


def test_generated_scenes(spark, tmp_path):
    scenes = spark.createDataFrame([("s", 30, 20, noise(20, 30, 3, 4).tobytes()), ("t", 8, 8, noise(8, 8, 3, 5).tobytes())], "image string, width int, height int, data binary")
    boxes = spark.createDataFrame([("s", 0, 2, 3, 12, 13), ("s", 1, 20, 5, 28, 15)], "image string, box_index int, x0 int, y0 int, x1 int, y1 int")
    white, black = (np.dstack([np.full((6, 6, 3), v, np.uint8), np.full((6, 6), 255, np.uint8)]).tobytes() for v in (255, 0))
    pool = spark.createDataFrame([("w", "S", 6, 6, white), ("b", "T", 6, 6, black)], "key string, source string, width int, height int, data binary")
    with pytest.raises(Refused):
        pools.generate(scenes, boxes, pool, str(tmp_path / "no"), "train")
    archives, manifest = pools.generate(scenes, boxes, pool, str(tmp_path / "out"), "train", variations=5, allow_train=True)
    rows = manifest.collect()
    assert len(rows) == 10 and {r.key for r in rows} == {"w", "b"} and {r.source for r in rows} == {"S", "T"}
    paths = {r.kind: r for r in archives.collect()}
    assert (paths["images"].n, paths["labels"].n) == (10, 10)
    picked = {(r.variation, r.box_index): r.key for r in rows}
    with zipfile.ZipFile(paths["images"].path) as z:
        (tmp_path / "made").mkdir()
        z.extractall(tmp_path / "made")
    made = {r.image: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, -1) for r in pools.pixels(spark, str(tmp_path / "made")).collect()}
    for k in range(5):
        for i, (x0, y0, x1, y1) in enumerate([(2, 3, 12, 13), (20, 5, 28, 15)]):
            assert (made[f"s_v{k}"][y0:y1, x0:x1, :3] == (255 if picked[k, i] == "w" else 0)).all()
        assert (made[f"t_v{k}"][..., :3] == noise(8, 8, 3, 5)).all()
    with zipfile.ZipFile(paths["labels"].path) as z:
        assert z.read("t_v0.txt") == b"" and z.read("s_v3.txt").startswith(b"0 0.233333 0.400000 0.333333 0.500000\n")


def test_selector_hook_leaves_boxes_real(spark, tmp_path):
    scenes = spark.createDataFrame([("s", 30, 20, noise(20, 30, 3, 4).tobytes())], "image string, width int, height int, data binary")
    boxes = spark.createDataFrame([("s", 0, 2, 3, 12, 13), ("s", 1, 20, 5, 28, 15)], "image string, box_index int, x0 int, y0 int, x1 int, y1 int")
    pool = spark.createDataFrame([("w", "S", 1, 1, b"\xff" * 4)], "key string, source string, width int, height int, data binary")
    only_first = lambda asks: asks.where("box_index = 0").select("image", "variation", "box_index", F.lit("w").alias("key"))
    archives, manifest = pools.generate(scenes, boxes, pool, str(tmp_path / "out"), "val", variations=1, selector=only_first)
    assert [(r.box_index, r.key, r.scale) for r in manifest.collect()] == [(0, "w", "enlarged")]
    with zipfile.ZipFile(next(r.path for r in archives.collect() if r.kind == "labels")) as z:
        assert z.read("s_v0.txt").count(b"\n") == 2  # the real box keeps its label


def test_parts_of_archives(spark, tmp_path):
    rows = spark.createDataFrame([(f"n{i}", bytes([i]), "g" if i % 2 else "h") for i in range(40)], "name string, content binary, source string")
    made = pools.write_zips(rows, str(tmp_path), "source", parts=3).collect()
    assert sum(r.n for r in made) == 40 and {r.source for r in made} == {"g", "h"} and len(made) > 2
    names = [n for r in made for n in zipfile.ZipFile(r.path).namelist()]
    assert sorted(names) == sorted(f"n{i}" for i in range(40))


def test_ordered_trainlist(spark, tmp_path):
    from tessera.operators import designs

    real, synthetic = (spark.createDataFrame([(p,) for p in paths], "path string") for paths in (["r2", "r1"], ["a1"]))
    manifests.write_trainlist(designs.trainlist(real, synthetic, "path", 2), str(tmp_path / "list"), "path", ("turn",))
    assert [r.value for r in spark.read.text(str(tmp_path / "list")).coalesce(1).collect()] == ["r1", "r2", "r1", "r2", "a1"]


def test_vectors_of_an_index(spark, tmp_path):
    manifests.write_vectors(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.0, 1.0]), (3, [1.0])], "id int, v array<double>"), str(tmp_path / "v"), "id", "v")
    index = lambda *ids: spark.createDataFrame([(i, f"n{i}") for i in ids], "id int, name string")
    assert sorted((r.name, r.v) for r in manifests.read_vectors(spark, str(tmp_path / "v"), index(1, 2), "id", "v").collect()) == [("n1", [0.5, 1.0]), ("n2", [0.0, 1.0])]
    for ids in ((1, 9), (1, 2, 3)):
        with pytest.raises(Refused):
            manifests.read_vectors(spark, str(tmp_path / "v"), index(*ids), "id", "v")


def test_materialise_checks_what_it_writes(spark, tmp_path):
    digest = lambda b: hashlib.sha256(b).hexdigest()
    files = spark.createDataFrame([("a", b"1"), ("b", b""), ("c", b"x"), ("c", b"x")], "name string, content binary")
    want = lambda *rows: spark.createDataFrame([(n, digest(b)) for n, b in rows], "name string, sha256 string")
    done = manifests.materialise(files, "name", "content", want(("a", b"1"), ("b", b"")), "sha256", str(tmp_path / "ok"))
    assert sorted((r.name, r.n_bytes) for r in done.collect()) == [("a", 1), ("b", 0)]
    for k, rows in enumerate([[("c", b"x")], [("z", b"")], [("a", b"2")]]):
        with pytest.raises(Refused):
            manifests.materialise(files, "name", "content", want(*rows), "sha256", str(tmp_path / f"bad{k}"))


def test_shares_and_absolute_sizes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.5 0.25 0.5 0.5\n0 0.5 0.5 0.001 0.5\nbad\n")
    assert [(r.pos_v, r.area) for r in labels.yolo_shares(spark, str(tmp_path)).orderBy("box_index").collect()] == [(0.25, 0.25), (0.5, 0.0005)]
    images = spark.createDataFrame([("a.JPG", 10, 10), ("a.png", 100, 40), ("a.gif", 7, 7)], "name string, width int, height int")
    assert [(r.box_index, r.bw, r.bh) for r in labels.absolute_sizes(spark, str(tmp_path), images).collect()] == [(0, 50, 20)]


def test_training_arguments():
    from tessera.operators import designs

    protocol = {"weights": "w.pt", "epochs": 30, "batch": 16, "image_size": 640, "optimizer": "SGD", "rate": 0.01, "final_rate": 0.01, "cosine": True, "warmup_steps": 900, "close_mosaic": 2, "cache": False, "checkpoint_epoch": 30}
    a = designs.training_arguments(protocol, 5392, "M25", 7)
    assert a["name"] == "M25_seed7" and a["patience"] == 31 and a["warmup_epochs"] * 5392 / 16 == pytest.approx(900)
    with pytest.raises(Refused):
        designs.training_arguments(protocol, 0, "M25", 7)
