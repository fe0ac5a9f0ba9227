"""Readers of annotation files: one row a box."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import yolo_to_pixels
from ..functions.text import file_stem
from ..operators.bounds import dealt, small
from . import annotations


def yolo(spark: SparkSession, path: str | list[str], empty: bool = False) -> DataFrame:
    """image, box_index (number of the line in its file), valid_index (number among the valid
    lines), category, cx, cy, w, h; lines of under five fields are left out. With ``empty``, a file without a valid line
    has one row, with both numbers -1."""
    rows = annotations.scan(spark, "yolo", path)
    rows = rows.select("image", F.coalesce("line", F.lit(-1)).alias("box_index"), F.col("box_index").alias("valid_index"), "category", "cx", "cy", "w", "h")
    return rows if empty else rows.where("valid_index >= 0")


def yolo_pixels(spark: SparkSession, path: str | list[str], sizes: DataFrame, how: str = "inner", number: str = "box_index") -> DataFrame:
    """The boxes in pixels; ``sizes`` has image, width, height. With ``how`` left, boxes of no image stay, without places, as
    do files without a valid line (box_index -1). ``number``: box_index counts lines, valid_index valid ones."""
    box = yolo_to_pixels(*[F.col(c) for c in ("cx", "cy", "w", "h", "width", "height")])
    return yolo(spark, path, how == "left").join(sizes.select("image", "width", "height"), "image", how).select("image", F.col(number).alias("box_index"), "category", *[c.alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"))])


def yolo_shares(spark: SparkSession, path: str) -> DataFrame:
    """image, box_index, pos_v (the centre's height) and area (share of the image) of the valid lines."""
    return yolo(spark, path).select("image", "box_index", F.col("cy").alias("pos_v"), (F.col("w") * F.col("h")).alias("area"))


def absolute_sizes(spark: SparkSession, path: str, images: DataFrame, endings: tuple[str, ...] = (".png", ".jpg", ".jpeg")) -> DataFrame:
    """Widths and heights of boxes in pixels; boxes without an extent are left out. ``images`` has name (of the
    file), width and height; of several files of one stem that of the first ending counts, others don't."""
    stem, ending = file_stem(F.col("name")), F.lower(F.regexp_extract("name", r"\.[^.]*$", 0))
    place = F.array_position(F.array(*map(F.lit, endings)), ending)
    sizes = images.where(place > 0).groupBy(stem.alias("image")).agg(F.min(F.struct(place.alias("place"), "name", "width", "height")).alias("_x")).select("image", "_x.width", "_x.height")
    rows = yolo(spark, path).join(sizes, "image")
    return rows.select("image", "box_index", F.rint(F.col("w") * F.col("width")).cast("int").alias("bw"), F.rint(F.col("h") * F.col("height")).cast("int").alias("bh")).where("bw > 0 and bh > 0")


def voc(spark: SparkSession, path: str | list[str], empty: bool = False) -> DataFrame:
    """image (the file's stem), width, height (as stated), box_index (number among the objects that have a box), category (unknown
    without a name), box. With ``empty``, a file without a box has one row, with box_index -1."""
    rows = annotations.scan(spark, "voc", path).select("image", "width", "height", "box_index", "category", "x0", "y0", "x1", "y1")
    return rows if empty else rows.where("box_index >= 0")


def box_csv(spark: SparkSession, path: str) -> DataFrame:
    """filename, width, height, class, xmin, xmax, ymin, ymax, whether width and height fit the
    box, and box_index: the place, from 0, among the rows of the file name in the order they are written."""
    rows = spark.read.schema("filename string, width int, height int, class string, xmin int, xmax int, ymin int, ymax int").csv(path, header=True)
    rows = rows.withColumn("consistent", (F.col("width") == F.col("xmax") - F.col("xmin")) & (F.col("height") == F.col("ymax") - F.col("ymin")))
    # ids grow along each file; files follow one another by name, of which rows carry the place alone
    names = rows.select(F.col("_metadata.file_path").alias("_file")).distinct()
    places = small(names.withColumn("_place", F.row_number().over(Window.orderBy("_file"))))  # a row a file
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row")).join(places, "_file").drop("_file")
    w = Window.partitionBy("filename").orderBy("_place", "_block", "_row")
    return dealt(placed, rows.count(), "filename").withColumn("box_index", F.row_number().over(w) - 1).drop("_place", "_block", "_row")
