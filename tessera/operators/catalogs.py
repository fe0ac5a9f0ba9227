"""Files, crops and manifests: lookups, states of rows, and what they resolve to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.text import quality_reason
from .bounds import MOST_ROWS, dealt
from .gates import Refused


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: of repeats, that of the highest ``order``. The rows of a key are folded
    map-side, so a key with many of them needs no task for itself."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, *[F.col("_row")[c].alias(c) for c in rest])


def ambiguous(df: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def unique_index(df: DataFrame, key: str) -> DataFrame:
    """The rows, if no key repeats; Refused with the first few repeated ones otherwise."""
    again = ambiguous(df, key).orderBy(key).limit(5).collect()
    if again:
        raise Refused(f"ambiguous: {[r[0] for r in again]}")
    return df


def computed_once(df: DataFrame, key: str, compute) -> DataFrame:
    """Adds features of the key, computed once per distinct key. ``compute`` maps a frame of
    distinct keys to one of the key and its features; rows without features keep nulls."""
    return df.join(compute(df.select(key).where(F.col(key).isNotNull()).distinct()), key, "left")


def resolved(manifest: DataFrame, files: DataFrame, key: str, content: str) -> DataFrame:
    """Manifest rows with state ok, missing (no such file) or mismatch (other content)."""
    have = files.select(key, F.col(content).alias("_have"), F.lit(True).alias("_there"))
    state = F.when(F.col("_there").isNull(), "missing").when(F.col(content).eqNullSafe(F.col("_have")), "ok").otherwise("mismatch")
    return manifest.join(have, key, "left").withColumn("state", state).drop("_have", "_there")


def sizes_agree(width: str, height: str, stated_width: str, stated_height: str) -> Column:
    """Whether an annotation states the image's own size: true, false, or null where it states none
    (or there is no image)."""
    return (F.col(width) == F.col(stated_width)) & (F.col(height) == F.col(stated_height))


def extraction_manifest(boxes: DataFrame, images: DataFrame, image: str = "image", lost: str = "image missing", stated: tuple[str, str] | None = None) -> DataFrame:
    """Boxes cut to their image, with status ok, degenerate (nothing left of it) or ``lost``;
    labels without an image, those without a box (box_index -1) too, have one row with box_index -1 and no box. ``lost`` names the reason: a lookup of files by
    path and one in an index by stem lose images in different ways.

    ``boxes`` has the image, box_index and x0..y1; ``images`` the image, width and height. ``stated`` names the columns
    of the size that an annotation states; ``size_agrees`` then says whether it is the image's (null if it
    states none or there is no image)."""
    sizes = images.select(image, "width", "height")
    if sizes.limit(MOST_ROWS + 1).count() <= MOST_ROWS:
        rows = boxes.join(F.broadcast(sizes), image, "left")
    else:
        # Dealt for the number of boxes, so that what a task sorts doesn't grow with them. Images whose rows pack into few bytes
        # would be sent to every task by their bytes alone, however many they are: a merge isn't changed to that.
        n = boxes.count()
        rows = dealt(boxes, n, image).join(dealt(sizes, n, image).hint("merge"), image, "left")
    *box, state = g.clipped(*[F.col(c) for c in ("x0", "y0", "x1", "y1", "width", "height")])
    agrees = [] if stated is None else [sizes_agree("width", "height", *stated).alias("size_agrees")]
    found = rows.where("width is not null and box_index >= 0").select(image, "box_index", *[c.alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"))], state.alias("status"), *agrees)
    none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("x0", "y0", "x1", "y1")]
    unknown = [F.lit(None).cast("boolean").alias("size_agrees")][: len(agrees)]
    missing = rows.where("width is null").select(image).distinct()
    return found.unionByName(missing.select(image, F.lit(-1).cast(found.schema["box_index"].dataType).alias("box_index"), *none, F.lit(lost).alias("status"), *unknown))


def registered_only(boxes: DataFrame, registered: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The boxes of a registered list of keys, and the others, which stay as they are."""
    keys = registered.select(*key).distinct()
    return boxes.join(keys, key, "left_semi"), boxes.join(keys, key, "left_anti")


def coverage_lookup(extracted: DataFrame, name: str, coverage: str, flag: Column, order: str) -> DataFrame:
    """Coverage by file name of rows that were extracted and have one; the later row of a name counts."""
    return last_wins(extracted.where(flag & F.col(coverage).isNotNull() & F.col(name).isNotNull()).select(name, coverage, order), name, order).select(name, coverage)


def quality_manifest(files: DataFrame, coverage: DataFrame, name: str | list[str], min_side: Column, least_side: float, least_mask: float, mask_required: bool) -> DataFrame:
    """Files with keep and reason, by side and by the coverage of their name."""
    keys = [name] if isinstance(name, str) else name
    measure = next(c for c in coverage.columns if c not in keys)
    files = files.drop(measure)
    return files.join(coverage, keys, "left").withColumn("_v", quality_reason(min_side, F.col(measure), least_side, least_mask, mask_required)).select(*files.columns, measure, "_v.keep", "_v.reason")


def kept_yield(manifest: DataFrame, by: list[str]) -> DataFrame:
    """Rows seen and kept, and their ratio (0 of nothing)."""
    n = manifest.groupBy(*by).agg(F.count("*").alias("n_seen"), F.count(F.when(F.col("keep"), 1)).alias("n_kept"))
    return n.withColumn("kept_share", F.coalesce(F.try_divide(F.col("n_kept").cast("double"), F.col("n_seen")), F.lit(0.0)))


def without_parts(outputs: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Outputs that no part belongs to: copies of their base, to be removed."""
    return outputs.join(parts.select(key).distinct(), key, "left_anti")


def label_digests(texts: DataFrame, key: str, text: str) -> DataFrame:
    """SHA-256 of each label text and its lines that aren't blank; a null text is an orphan with nulls."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda s: F.trim(s) != "")
    return texts.select(key, F.sha2(F.col(text).cast("binary"), 256).alias("sha256"), F.size(lines).alias("_n"), F.col(text).isNull().alias("orphan")).withColumn("n_boxes", F.when(~F.col("orphan"), F.col("_n"))).drop("_n")


def collapsed(labels: DataFrame, text: str, allowed: list[str], to: str = "0") -> DataFrame:
    """Label lines with their class replaced by ``to``; a class that isn't allowed is an error."""
    own = F.regexp_extract(text, r"^\s*(\S+)", 1)
    bad = F.raise_error(F.concat(F.lit("class not allowed: "), own))
    return labels.withColumn(text, F.when(own.isin(allowed), F.regexp_replace(text, r"^\s*\S+", to)).otherwise(bad))


def class_counts(labels: DataFrame, text: str, allowed: list[str]) -> DataFrame:
    """Lines of each allowed class, 0 where there are none."""
    own = F.regexp_extract(text, r"^\s*(\S+)", 1)
    one = labels.agg(*[F.count(F.when(own == c, 1)).alias(f"c{i}") for i, c in enumerate(allowed)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"c{i}").alias("n")) for i, c in enumerate(allowed)])).alias("x")).select("x.*")


def truth_boxes(boxes: DataFrame, small: float = 1024.0) -> DataFrame:
    """Boxes with their letterboxed area (of at least 1 pixel before) and whether they are small."""
    area = F.greatest(F.lit(1.0), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("double"))
    return boxes.withColumn("area", g.letterbox_area(area, F.col("width"), F.col("height"))).withColumn("small", F.col("area") < small)


def object_crops(labels: DataFrame, least: int = 2) -> DataFrame:
    """Crops of normalised boxes, cut off to whole pixels and to the image; sides of under ``least`` go.

    ``labels`` has image, box_index, cx, cy, w, h, width and height; an id is image__box_index."""
    cut = lambda c: c.cast("int")  # noqa: E731  towards zero
    zero, half_w, half_h = F.lit(0), F.col("w") / 2, F.col("h") / 2
    rows = labels.select(
        F.concat_ws("__", F.col("image").cast("string"), F.col("box_index").cast("string")).alias("crop_id"),
        F.greatest(zero, cut((F.col("cx") - half_w) * F.col("width"))).alias("x0"), F.greatest(zero, cut((F.col("cy") - half_h) * F.col("height"))).alias("y0"),
        F.least(F.col("width"), cut((F.col("cx") + half_w) * F.col("width"))).alias("x1"), F.least(F.col("height"), cut((F.col("cy") + half_h) * F.col("height"))).alias("y1"),
    )
    return rows.where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))
