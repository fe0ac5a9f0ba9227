"""Names, reasons and draws as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of file names.
EXPORT_NAME = r"(?i)^(.*)_jpg\.rf\.[a-f0-9]+\.(jpg|jpeg|png)$"
VIDEO_NAME = r"^(MVI_\d+(?:_VIS|_NIR)?(?:_Haze)?)_frame"
VARIATION_NAME = r"^(.*)_v(\d+)$"


def base_name(name) -> Column:
    """Name before an export's hash, null if it isn't an export."""
    return F.when(F.col(name).rlike(EXPORT_NAME), F.regexp_extract(name, EXPORT_NAME, 1))


def video_id(name) -> Column:
    return F.regexp_extract(name, VIDEO_NAME, 1)


def split_variation(name) -> tuple[Column, Column]:
    """Image and number of ``image_vK``; an error for other names."""
    ok = F.col(name).rlike(VARIATION_NAME)
    bad = F.raise_error(F.concat(F.lit("no variation in the name "), F.col(name)))
    return F.when(ok, F.regexp_extract(name, VARIATION_NAME, 1)).otherwise(bad), F.when(ok, F.regexp_extract(name, VARIATION_NAME, 2).cast("int"))


def file_name(path) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def quality_reason(min_side, mask, least_side: float, least_mask: float, mask_required: bool) -> Column:
    """Struct of keep and reason; the first rule that applies decides."""
    def verdict(keep: bool, reason) -> Column:
        return F.struct(F.lit(keep).alias("keep"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))

    return (
        F.when(min_side < least_side, verdict(False, F.format_string("min_side %.1f < %.1f", min_side.cast("double"), F.lit(float(least_side)))))
        .when(mask.isNull(), verdict(not mask_required, "mask missing" if mask_required else "mask not checked"))
        .when(mask < least_mask, verdict(False, F.format_string("mask %.3f < %.3f", mask.cast("double"), F.lit(float(least_mask)))))
        .otherwise(verdict(True, "ok"))
    )


def as_flag(c) -> Column:
    """Flags written as text."""
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1"), F.lit(False))


def draw(seed, *key) -> Column:
    """32 random bits of a seed and a key, the same on every engine and partitioning."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), *key), 256), 1, 8), 16, 10).cast("bigint")
