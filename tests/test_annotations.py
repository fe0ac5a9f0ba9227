"""Annotation folders with odd files, image sizes by headers, sources with several splits and repeated exports."""

import io
import struct
import zipfile

import numpy as np
import pytest

from tessera.operators import catalogs
from tessera.sources import annotations, labels, pools


def test_labels_without_a_line_or_an_image(spark, tmp_path):
    """Of three labels without an image, one empty, one with a bad line, one good, each has a row; a label without a line whose image is there has none."""
    (tmp_path / "sub").mkdir()
    for name, text in {"empty": "", "bad": "0 0.5\n\n", "good": "0 0.5 0.5 0.1 0.1\n", "sub/blank": " \n", "here": "x\n1 0.5 0.5 0.1 0.1 0.9\nno 1.5 2 0.1 0.1\n"}.items():
        (tmp_path / f"{name}.txt").write_text(text)
    (tmp_path / "note.md").write_text("0 0.5 0.5 0.1 0.1")
    sizes = spark.createDataFrame([("blank", 100, 100), ("here", 100, 50)], "image string, width int, height int")
    boxes = labels.yolo_pixels(spark, str(tmp_path), sizes, "left", "valid_index")
    got = sorted((r.image, r.box_index, r.status) for r in catalogs.extraction_manifest(boxes.drop("category"), sizes).collect())
    assert got == [("bad", -1, "image missing"), ("empty", -1, "image missing"), ("good", -1, "image missing"), ("here", 0, "ok"), ("here", 1, "degenerate")]
    assert [(r.box_index, r.valid_index) for r in labels.yolo(spark, str(tmp_path)).where("image = 'here'").orderBy("box_index").collect()] == [(1, 0), (2, 1)]


def test_objects_are_numbered_among_those_with_a_box(spark, tmp_path):
    box = "<bndbox><xmin>1</xmin><ymin>2.0</ymin><xmax>3.9</xmax><ymax>4</ymax></bndbox>"
    (tmp_path / "img1.xml").write_text(f"<annotation><filename>other.jpg</filename><size><width>10.0</width><height>20</height></size><object><name>a</name></object><object><name> ship </name>{box}</object><object><name></name>{box}</object><object>{box}</object></annotation>")
    (tmp_path / "img2.xml").write_text(f"<annotation><size><width>5</width></size><object><name>b</name>{box}</object></annotation>")
    (tmp_path / "img3.xml").write_text("<annotation></annotation>")
    rows = [tuple(r) for r in labels.voc(spark, str(tmp_path), empty=True).orderBy("image", "box_index").collect()]
    assert rows == [("img1", 10, 20, i, c, 1, 2, 3, 4) for i, c in enumerate(("ship", "unknown", "unknown"))] + [("img2", None, None, 0, "b", 1, 2, 3, 4), ("img3", None, None, -1, None, None, None, None, None)]
    assert labels.voc(spark, str(tmp_path / "img2.xml")).count() == 1


def jpeg(width: int, height: int) -> bytes:
    """Head of a JPEG file: a comment longer than one read, tables, fill bytes, then the frame."""
    comment = b"c" * 500
    return b"\xff\xd8\xff\xfe" + struct.pack(">H", len(comment) + 2) + comment + b"\xff\xc4\x00\x04ab" + b"\xff\xff\xc2" + struct.pack(">HBHHB", 8, 8, height, width, 1) + b"rest"


def test_sizes_come_from_headers(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(pools.png(np.zeros((7, 5, 3), np.uint8))[:60])  # the pixels are cut off
    (tmp_path / "b.JPG").write_bytes(jpeg(300, 200))
    (tmp_path / "c.jpeg").write_bytes(b"\xff\xd8\xff")
    (tmp_path / "d.png").write_bytes(b"")
    assert sorted((r.image, r.width, r.height) for r in annotations.sizes(spark, str(tmp_path)).collect()) == [("a", 5, 7), ("b", 300, 200)]
    assert annotations.size_of(io.BytesIO(jpeg(4, 9))) == (4, 9)


def test_many_files_are_many_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(annotations, "GROUP_BYTES", 16384)
    for i in range(40):
        (tmp_path / f"f{i}.txt").write_text("0 0.5 0.5 0.1 0.1\n" * (i + 1))
    groups = annotations.Reader("yolo", [str(tmp_path)]).partitions()
    assert len(groups) == 10 and sum(len(g.files) for g in groups) == 40
    assert labels.yolo(spark, str(tmp_path)).count() == sum(range(41))


@pytest.fixture(scope="module")
def splits(tmp_path_factory):
    """Two splits; of one image two exports; a name that is no export; a label line that is no box."""
    at = tmp_path_factory.mktemp("splits")
    names = {"train": ["MVI_1_VIS_frame7_jpg.rf.aa11", "MVI_1_VIS_frame7_jpg.rf.bb22", "plain"], "val": ["x_jpg.rf.cc33"]}
    with zipfile.ZipFile(at / "raw.zip", "w") as z:
        for i, (split, stems) in enumerate(names.items()):
            for j, stem in enumerate(stems):
                z.writestr(f"set/{split}/images/{stem}.png", pools.png(np.full((40, 60, 3), 10 * i + j + 1, np.uint8)))
                z.writestr(f"set/{split}/labels/{stem}.txt", "nothing\n0 0.5 0.5 0.5 0.5\n")
    return at


@pytest.mark.parametrize("dedup", [False, True])
def test_a_source_of_several_splits(spark, splits, tmp_path, dedup):
    folders = [[f"set/{s}/{kind}" for s in ("train", "val")] for kind in ("images", "labels")]
    archives, manifest = pools.load_source(spark, "S", str(splits / "raw.zip"), str(tmp_path / "work"), str(tmp_path / "out"), *folders, least_side=10, dedup=dedup)
    rows = {(r.image, r.box_index): (r.video, r.status, r.keep) for r in manifest.collect()}
    want = {("MVI_1_VIS_frame7_jpg.rf.aa11", 0): ("MVI_1_VIS", "ok", True), ("x_jpg.rf.cc33", 0): ("", "ok", True)}
    if not dedup:
        want |= {("MVI_1_VIS_frame7_jpg.rf.bb22", 0): ("MVI_1_VIS", "ok", True), ("plain", 0): ("", "ok", True)}
    assert rows == want and archives.first().n == len(want)
