"""Pools of crops in zip archives: from the archive of a source to one of its good crops, and from pools to
generated scenes.

Archives are unpacked into a folder that all tasks share, a task a run of members, and written from it a task an archive. Hooks:
a ``segmenter`` maps an RGB array and a box to a mask of the image's size; a ``selector`` maps a frame of
boxes to one of the same boxes with a crop's key each (null: the box stays as it is)."""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable
from contextlib import contextmanager
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.text import base_name, file_stem, video_id
from ..operators import aggregates, catalogs, gates, images, sampling
from ..operators.scratch import written
from . import annotations, labels

Segmenter = Callable[[np.ndarray, tuple[int, int, int, int]], np.ndarray]
Selector = Callable[[DataFrame], DataFrame]


def _fs(at: str):
    """File system and path of a URI; local paths need no scheme."""
    from pyarrow import fs

    if at.startswith("file:"):
        return fs.LocalFileSystem(), "/" + at.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(at) if "://" in at else (fs.LocalFileSystem(), at)


#: Members that a task unpacks and their bytes within the archive, unless one name holds more, or a share of the archive: a run reads the whole directory.
TASK_MEMBERS, TASK_BYTES, MOST_RUNS = 1000, 16 << 20, 16


@contextmanager
def _archive(path: str):
    fs, at = _fs(path)
    # the reader of archives seeks before the start of small files, which this file system refuses
    with fs.open_input_file(at) as f, zipfile.ZipFile(f if f.size() > 1 << 17 else io.BytesIO(f.read())) as z:
        yield z


def _members(z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """Files of an archive by name; of equal names in the archive's order."""
    return sorted((i for i in z.infolist() if not i.is_dir() and ".." not in i.filename.split("/")), key=lambda i: i.filename)


def unpack(spark: SparkSession, archive: str, folder: str) -> DataFrame:
    """Members of archives as files below ``folder``: archive, name (below the archive's own folder), path, bytes.

    A task reads a run of an archive's members and holds a piece of one at a time; members of equal names are of one run, and the last one stays."""

    members, size, runs_of_one = TASK_MEMBERS, TASK_BYTES, MOST_RUNS

    def cut(batches):
        for pdf in batches:
            for path in pdf["path"]:
                rows, first, held = [], 0, 0
                with _archive(path) as z:
                    every = _members(z)
                most, most_bytes = max(members, -(-len(every) // runs_of_one)), max(size, sum(i.compress_size for i in every) // runs_of_one)
                for i, info in enumerate(every):
                    if i > first and info.filename != every[i - 1].filename and (i - first >= most or held + info.compress_size > most_bytes):
                        rows.append((path, first, i))
                        first, held = i, 0
                    held += info.compress_size
                yield pd.DataFrame([*rows, *([(path, first, len(every))] if every else [])], columns=["path", "first", "last"])

    def run(batches):
        made = set()
        for pdf in batches:
            for path, first, last in pdf[["path", "first", "last"]].itertuples(index=False):
                to_fs, to = _fs(folder)
                stem, rows = path.rsplit("/", 1)[-1], []
                with _archive(path) as z:
                    for info in _members(z)[first:last]:
                        target = f"{to}/{stem}/{info.filename}"
                        if (own := target.rsplit("/", 1)[0]) not in made:
                            to_fs.create_dir(own, recursive=True)
                            made.add(own)
                        with to_fs.open_output_stream(target) as out, z.open(info) as member:
                            while piece := member.read(1 << 20):
                                out.write(piece)
                        rows.append((stem, info.filename, f"{folder}/{stem}/{info.filename}", info.file_size))
                yield pd.DataFrame(rows, columns=["archive", "name", "path", "bytes"])

    listing = spark.read.format("binaryFile").load(archive).select("path")
    runs = written(listing.mapInPandas(cut, "path string, first long, last long"), "members")
    # parts of a given number are not merged, however few bytes name them
    return runs.repartitionByRange(max(1, runs.count()), "path", "first").mapInPandas(run, "archive string, name string, path string, bytes bigint")


def write_zips(df: DataFrame, folder: str, group: str, name: str = "name", content: str = "content", parts: int = 1) -> DataFrame:
    """One archive for each group (``parts`` of them, dealt by name): group, path, n. Only the files that
    the returned rows name count: a task that runs again writes another one. Rows are streamed; of equal names
    in an archive all are written."""
    rows = df.select(F.col(group).cast("string").alias("group"), F.pmod(F.xxhash64(name), F.lit(parts)).alias("part"), F.col(name).alias("name"), F.col(content).alias("content"))

    def run(batches):
        opened, done = None, []

        def close():
            nonlocal opened
            if opened:
                opened[1].close()
                opened[2].close()
                done.append((*opened[0], opened[3], opened[4]))
                opened = None

        for pdf in batches:
            for key, part, member, data in pdf.itertuples(index=False):
                if opened and opened[0] != (key, part):
                    close()
                if not opened:
                    fs, to = _fs(folder)
                    fs.create_dir(to, recursive=True)
                    file = f"{key}-{part:04d}-{uuid.uuid4().hex}.zip"
                    stream = fs.open_output_stream(f"{to}/{file}")
                    opened = [(key, part), zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED), stream, f"{folder}/{file}", 0]
                opened[1].writestr(member, data)
                opened[4] += 1
        close()
        yield pd.DataFrame(done, columns=["group", "part", "path", "n"])

    made = rows.repartition("group", "part").sortWithinPartitions("group", "part", "name").mapInPandas(run, "group string, part bigint, path string, n bigint")
    found = made.collect()  # a row an archive
    return df.sparkSession.createDataFrame([(r["group"], r["path"], r["n"]) for r in found], f"{group} string, path string, n bigint")


def png(pixels: np.ndarray) -> bytes:
    """An RGB or RGBA image as a PNG file."""
    h, w, n = pixels.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(pixels, dtype=np.uint8).reshape(h, w * n)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if n == 3 else 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def pixels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """image (stem of the file), width, height, channels, data (RGB or RGBA bytes) of images below a folder."""

    def run(batches):
        for pdf in batches:
            out = []
            for h, w, n, data in zip(pdf["height"], pdf["width"], pdf["channels"], pdf["data"]):
                p = np.frombuffer(data, np.uint8).reshape(h, w, n)
                p = np.repeat(p, 3, axis=2) if n == 1 else p[..., [2, 1, 0, *range(3, n)]]
                out.append((p.shape[2], p.tobytes()))
            yield pd.DataFrame({"image": pdf["image"], "width": pdf["width"], "height": pdf["height"], "channels": [n for n, _ in out], "data": [d for _, d in out]})

    rows = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    return rows.select(file_stem(F.col("image.origin")).alias("image"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data")).mapInPandas(run, "image string, width int, height int, channels int, data binary")


def crops(rows: DataFrame, segmenter: Segmenter | None = None) -> DataFrame:
    """Crops of boxes inside their images: image, box_index, width, height, coverage (null without a
    segmenter), content (PNG). ``rows`` has image, box_index, x0..y1 and the image's width, height, channels, data."""

    def run(batches):
        for pdf in batches:
            out = []
            for image, i, x0, y0, x1, y1, w, h, n, data in pdf[["image", "box_index", "x0", "y0", "x1", "y1", "width", "height", "channels", "data"]].itertuples(index=False):
                rgb = np.frombuffer(data, np.uint8).reshape(h, w, n)[..., :3]
                if segmenter is None:
                    out.append((image, i, x1 - x0, y1 - y0, None, png(rgb[y0:y1, x0:x1])))
                else:
                    cut, share = images.masked_crop(rgb, (x0, y0, x1, y1), segmenter(rgb, (x0, y0, x1, y1)))
                    out.append((image, i, x1 - x0, y1 - y0, share, png(cut)))
            yield pd.DataFrame(out, columns=["image", "box_index", "width", "height", "coverage", "content"])

    return rows.mapInPandas(run, "image string, box_index int, width int, height int, coverage double, content binary")


def load_source(spark: SparkSession, source: str, archive: str, work: str, to: str, image_folder: str | list[str], label_folder: str | list[str], least_side: float, least_mask: float = 0.0, segmenter: Segmenter | None = None, read: Callable[[SparkSession, list[str], DataFrame], DataFrame] = partial(labels.yolo_pixels, how="left", number="valid_index"), dedup: bool = False) -> tuple[DataFrame, DataFrame]:
    """From a source's archive to an archive of its good crops: the archive and the manifest of all boxes.

    Several folders of images and labels, as of the splits of a source, are one. ``read`` maps folders of labels and the sizes of images
    (image, width, height) to boxes (image, box_index among the valid ones, x0..y1), those of no image too. With ``dedup``, of several exports
    of one image the first by name counts alone; images whose names aren't those of exports go too.
    The manifest has source, image, video (empty for other names), box_index, status (of ``extraction_manifest``), width, height, coverage, keep, reason."""
    folder = f"{work}/{uuid.uuid4().hex}"
    if unpack(spark, archive, folder).count() == 0:
        raise gates.Refused(f"{archive} has no members")
    stem = archive.rsplit("/", 1)[-1]
    image_folders, label_folders = ([f"{folder}/{stem}/{x}" for x in ([f] if isinstance(f, str) else f)] for f in (image_folder, label_folder))
    sizes = annotations.sizes(spark, image_folders)
    if dedup:
        sizes = aggregates.keep_first(sizes.withColumn("_name", F.regexp_extract("path", "[^/]*$", 0)), base_name("_name"), "_name").where("status = 'kept'").drop("status", "_name")
    sizes = sizes.select("image", "width", "height")
    boxes = read(spark, label_folders, sizes).withColumn("box_index", F.col("box_index").cast("int"))
    if dedup:
        boxes = boxes.join(sizes.select("image"), "image", "left_semi")
    found = pixels(spark, image_folders)
    extracted = catalogs.extraction_manifest(boxes.select("image", "box_index", "x0", "y0", "x1", "y1"), sizes)
    made = crops(extracted.where("status = 'ok'").join(found, "image"), segmenter)  # by the sizes that files state, which are those of their pixels
    at = f"{folder}/crops"
    made.write.parquet(at)
    made = spark.read.parquet(at)
    judged = catalogs.quality_manifest(made.drop("content"), made.select("image", "box_index", "coverage"), ["image", "box_index"], F.least("width", "height"), least_side, least_mask, segmenter is not None)
    manifest = extracted.select("image", video_id("image").alias("video"), "box_index", "status").join(judged.select("image", "box_index", "width", "height", "coverage", "keep", "reason"), ["image", "box_index"], "left").select(F.lit(source).alias("source"), "*")
    kept = made.join(judged.where("keep").select("image", "box_index"), ["image", "box_index"], "left_semi")
    name = F.format_string("%s_box%03d.png", "image", "box_index")
    return write_zips(kept.select(F.lit(source).alias("source"), name.alias("name"), "content"), to, "source"), manifest


def load_pool(spark: SparkSession, archives: dict[str, str], work: str) -> DataFrame:
    """source, name, width, height, data (RGBA bytes) of the crops in a few sources' archives."""
    out = None
    for source, archive in archives.items():
        folder = f"{work}/{uuid.uuid4().hex}"
        unpack(spark, archive, folder).count()
        rows = pixels(spark, folder)
        opaque = F.when(F.col("channels") == 4, F.col("data"))
        rows = rows.select(F.lit(source).alias("source"), F.col("image").alias("name"), "width", "height", opaque.alias("rgba"), "data")
        out = rows if out is None else out.unionByName(rows)

    def fill(batches):
        for pdf in batches:
            data = [r if r is not None else np.concatenate([p := np.frombuffer(d, np.uint8).reshape(-1, 3), np.full((len(p), 1), 255, np.uint8)], axis=1).tobytes() for r, d in zip(pdf["rgba"], pdf["data"])]
            yield pdf[["source", "name", "width", "height"]].assign(data=data)

    return out.mapInPandas(fill, "source string, name string, width int, height int, data binary")


def generate(scenes: DataFrame, boxes: DataFrame, pool: DataFrame, to: str, split: str, variations: int = 13, seed: int = 42, allow_train: bool = False, selector: Selector | None = None) -> tuple[DataFrame, DataFrame]:
    """Scenes with crops pasted over their boxes, in ``variations`` of each, as archives of images and
    labels, and the manifest of pastes. The training split needs a permission.

    ``scenes``: image, width, height, data (RGB); ``boxes``: image, box_index, x0..y1; ``pool``: key (unique),
    source, width, height, data (RGBA). Without a selector a crop is drawn evenly from the pool for every paste.
    Manifest: image, variation, box_index, key, source, factor, scale."""
    gates.guard_split(split, allow_train)
    each = F.explode(F.sequence(F.lit(0), F.lit(variations - 1))).alias("variation")
    asks = boxes.select("image", "box_index", "x0", "y0", "x1", "y1", each)
    picked = selector(asks) if selector else sampling.uniform_draws(asks, pool.select("key"), ["image", "variation", "box_index"], "key", seed)
    crop = pool.select("key", F.col("source"), F.col("width").alias("crop_width"), F.col("height").alias("crop_height"), F.col("data").alias("crop"))
    pastes = asks.join(picked.select("image", "variation", "box_index", "key"), ["image", "variation", "box_index"], "left").join(crop, "key", "left")
    base = scenes.select("image", "width", "height", F.col("data").alias("rgb"), each)
    done = images.composed(base, pastes.select("image", "variation", "box_index", "x0", "y0", "x1", "y1", "crop", "crop_width", "crop_height"))
    sized = done.join(scenes.select("image", "width", "height"), "image")

    def files(batches):
        for pdf in batches:
            stem = pdf["image"].astype(str) + "_v" + pdf["variation"].astype(str)
            content = [png(np.frombuffer(d, np.uint8).reshape(h, w, 3)) for d, h, w in zip(pdf["rgb"], pdf["height"], pdf["width"])]
            yield pd.DataFrame({"kind": "images", "name": stem + ".png", "content": content})
            yield pd.DataFrame({"kind": "labels", "name": stem + ".txt", "content": [t.encode() for t in pdf["label"]]})

    archives = write_zips(sized.mapInPandas(files, "kind string, name string, content binary"), to, "kind")
    factor = g.rescale_factor(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("crop_width"), F.col("crop_height"))
    manifest = pastes.where("key is not null").select("image", "variation", "box_index", "key", "source", factor.alias("factor")).withColumn("scale", g.scale_class(F.col("factor")))
    return archives, manifest
