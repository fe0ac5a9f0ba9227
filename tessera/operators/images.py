"""Features of decoded images, in Python over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crop_features(pixels: np.ndarray) -> tuple[float, float, float, float]:
    """sharpness, contrast, brightness, coverage of an RGBA image. Sharpness is the variance
    of the Laplacian where a pixel and its four neighbours are in the mask; all but the coverage are 0
    for a mask of under four pixels or a side of under three, and the coverage for an image without pixels."""
    rgb, mask = pixels[..., :3].astype(float), pixels[..., 3] > 0 if pixels.shape[-1] == 4 else np.ones(pixels.shape[:2], bool)
    if mask.sum() < 4 or min(mask.shape) < 3:
        return 0.0, 0.0, 0.0, float(mask.mean()) if mask.size else 0.0
    gray = rgb @ np.array([0.299, 0.587, 0.114])
    c = gray[1:-1, 1:-1]
    around = gray[:-2, 1:-1] + gray[2:, 1:-1] + gray[1:-1, :-2] + gray[1:-1, 2:] - 4 * c
    inside = mask[1:-1, 1:-1] & mask[:-2, 1:-1] & mask[2:, 1:-1] & mask[1:-1, :-2] & mask[1:-1, 2:]
    own = gray[mask]
    return float(around[inside].var()) if inside.any() else 0.0, float(own.std()), float(own.mean()), float(mask.mean())


def features(images: DataFrame) -> DataFrame:
    """origin and features of rows of Spark's image source (whose channels are BGR or BGRA)."""

    def run(batches):
        for pdf in batches:
            out = []
            for origin, h, w, n, data in zip(*(pdf[c] for c in ("origin", "height", "width", "channels", "data"))):
                p = np.frombuffer(data, np.uint8).reshape(h, w, n)
                p = np.repeat(p, 3, axis=2) if n == 1 else p[..., [2, 1, 0, *range(3, n)]]
                out.append((origin, *crop_features(p)))
            yield pd.DataFrame(out, columns=["origin", "sharpness", "contrast", "brightness", "coverage"])

    rows = images.select(*[F.col(f"image.{c}").alias(n) for c, n in (("origin", "origin"), ("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))])
    return rows.mapInPandas(run, "origin string, sharpness double, contrast double, brightness double, coverage double")


def masked_crop(rgb: np.ndarray, box: tuple[int, int, int, int], mask: np.ndarray) -> tuple[np.ndarray, float]:
    """RGBA crop of a box inside the image, transparent outside the mask, and the mask's share
    of it (0 for an empty box)."""
    h, w = mask.shape
    x0, y0, x1, y1 = max(0, box[0]), max(0, box[1]), min(w, box[2]), min(h, box[3])
    part = mask[y0:max(y0, y1), x0:max(x0, x1)].astype(bool)
    alpha = np.where(part, 255, 0).astype(np.uint8)
    return np.dstack([rgb[y0:max(y0, y1), x0:max(x0, x1), :3], alpha]), float(part.mean()) if part.size else 0.0


def _window(n: int, to: int) -> np.ndarray:
    """Weights (to x n) of a windowed sinc of three lobes, widened when an image shrinks."""
    scale = n / to
    wide = 3.0 * max(scale, 1.0)
    centre = (np.arange(to) + 0.5) * scale
    t = (np.arange(n)[None, :] + 0.5 - centre[:, None]) / max(scale, 1.0)
    w = np.where(np.abs(t) * max(scale, 1.0) < wide, np.sinc(t) * np.sinc(t / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resized(rgba: np.ndarray, width: int, height: int) -> np.ndarray:
    """RGBA image of exactly this size; colours count by their opacity."""
    p = rgba.astype(float)
    a = p[..., 3:] / 255
    flat = np.concatenate([p[..., :3] * a, p[..., 3:]], axis=2)
    out = np.einsum("ij,jkc->ikc", _window(flat.shape[0], height), np.einsum("ij,kjc->kic", _window(flat.shape[1], width), flat))
    alpha = np.clip(out[..., 3:], 0, 255)
    colour = np.where(alpha > 0, out[..., :3] / np.where(alpha > 0, alpha, 1) * 255, 0)
    return np.rint(np.clip(np.concatenate([colour, alpha], axis=2), 0, 255)).astype(np.uint8)


def pasted(scene: np.ndarray, crop: np.ndarray, x0: int, y0: int) -> np.ndarray:
    """The RGB scene with an RGBA crop laid over it; what lies outside is cut off."""
    out, (h, w) = scene.copy(), scene.shape[:2]
    ax, ay, bx, by = max(0, x0), max(0, y0), min(w, x0 + crop.shape[1]), min(h, y0 + crop.shape[0])
    if ax < bx and ay < by:
        c = crop[ay - y0 : by - y0, ax - x0 : bx - x0].astype(float)
        a = c[..., 3:] / 255
        out[ay:by, ax:bx] = np.rint(c[..., :3] * a + out[ay:by, ax:bx] * (1 - a)).astype(np.uint8)
    return out


def label_text(boxes: np.ndarray, width: int, height: int) -> str:
    """A line of class 0 for each box of pixels, normalised to six digits."""
    return "".join(f"0 {(x0 + x1) / 2 / width:.6f} {(y0 + y1) / 2 / height:.6f} {(x1 - x0) / width:.6f} {(y1 - y0) / height:.6f}\n" for x0, y0, x1, y1 in boxes)


def composed(scenes: DataFrame, pastes: DataFrame) -> DataFrame:
    """Scenes with crops pasted over their boxes in order of box_index, and label texts.

    ``scenes``: image, variation, width, height, rgb (bytes). ``pastes``: image, variation, box_index, x0, y0, x1, y1,
    crop (RGBA bytes, null: the box stays as it is), crop_width, crop_height. Output: image, variation, rgb, label,
    n_pasted; a scene without boxes has an empty label. Pastes of no scene are left out."""

    def run(s: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        p = p.sort_values("box_index")
        for image, variation, w, h, data in zip(*(s[c] for c in ("image", "variation", "width", "height", "rgb"))):
            rgb, n = np.frombuffer(data, np.uint8).reshape(h, w, 3), 0
            for x0, y0, x1, y1, crop, cw, ch in zip(*(p[c] for c in ("x0", "y0", "x1", "y1", "crop", "crop_width", "crop_height"))):
                if crop is not None:
                    rgb, n = pasted(rgb, resized(np.frombuffer(crop, np.uint8).reshape(int(ch), int(cw), 4), max(1, x1 - x0), max(1, y1 - y0)), x0, y0), n + 1
            out.append((image, variation, rgb.tobytes(), label_text(p[["x0", "y0", "x1", "y1"]].to_numpy(), w, h), n))
        return pd.DataFrame(out, columns=["image", "variation", "rgb", "label", "n_pasted"])

    keys = ["image", "variation"]
    kind = dict(scenes.dtypes)["image"]
    return scenes.groupBy(*keys).cogroup(pastes.groupBy(*keys)).applyInPandas(run, f"image {kind}, variation int, rgb binary, label string, n_pasted int")
