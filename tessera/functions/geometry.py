"""Boxes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: tuple, b: tuple) -> Column:
    """Overlap of boxes (x0, y0, x1, y1) by union; 0 where the union is empty."""
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return F.when(union > 0, both / union).otherwise(zero)


def yolo_to_pixels(cx, cy, w, h, width, height) -> list[Column]:
    """x0, y0, x1, y1 of a normalised box, rounded half to even; x1 counts from the rounded x0."""
    bw, bh = w * width, h * height
    x0, y0 = F.rint(cx * width - bw / 2), F.rint(cy * height - bh / 2)
    return [c.cast("int") for c in (x0, y0, F.rint(x0 + bw), F.rint(y0 + bh))]


def normalised(x0, y0, x1, y1, width, height) -> list[Column]:
    return [(x0 + x1) / 2 / width, (y0 + y1) / 2 / height, (x1 - x0) / width, (y1 - y0) / height]


def clipped(x0, y0, x1, y1, width, height) -> list[Column]:
    """The box inside the image, and whether anything is left of it."""
    zero = F.lit(0)
    box = [F.greatest(zero, x0), F.greatest(zero, y0), F.least(width, x1), F.least(height, y1)]
    status = F.when((box[2] - box[0] <= 0) | (box[3] - box[1] <= 0), "degenerate").otherwise("ok")
    return [*box, status]


def rescale_factor(bw, bh, cw, ch) -> Column:
    """Ratio of areas, sides floored at 1."""
    one = F.lit(1)
    return (F.greatest(one, bw) * F.greatest(one, bh)) / (F.greatest(one, cw) * F.greatest(one, ch)).cast("double")


def scale_class(factor) -> Column:
    return F.when(factor < 0.5, "shrunk").when(factor > 2, "enlarged").otherwise("matched")


def letterbox_area(area, width, height, side: float = 640.0) -> Column:
    return area * F.pow(F.lit(side) / F.greatest(width, height, F.lit(1)), F.lit(2.0))


def size_class(area) -> Column:
    """Of a letterboxed area in pixels."""
    return F.when(area < 32 * 32, "small").when(area < 96 * 96, "medium").otherwise("large")


def box_features(x0, y0, x1, y1, width, height, cw, ch, factor) -> dict[str, Column]:
    """Geometry of a pasted box and its crop."""
    one = F.lit(1)
    bw, bh = F.greatest(one, x1 - x0), F.greatest(one, y1 - y0)
    cw, ch = F.greatest(one, cw), F.greatest(one, ch)
    box, crop = bw / bh, cw / ch
    return {
        "pos_h": (x0 + x1) / 2 / F.greatest(one, width), "pos_v": (y0 + y1) / 2 / F.greatest(one, height),
        "area_norm": (bw * bh) / (F.greatest(one, width) * F.greatest(one, height)), "min_side": F.least(bw, bh),
        "aspect_box": box, "aspect_crop": crop, "aspect_distortion": F.ln(box / crop),
        "log_factor": F.ln(F.greatest(factor, F.lit(1e-9))), "crop_min_side": F.least(cw, ch), "upsample": (factor > 1).cast("int"),
    }
