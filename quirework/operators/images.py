"""Pixel and tensor operators: similarity of images, resampling, label sequences, skew, text boxes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stabilisers of the structural similarity, its window, the side of the common grid, thresholds.
C1, C2, WINDOW, GRID_WIDTH, SIMILAR = 6.5025, 58.5225, 8, 256, 0.85
BOX_ABOVE, BOX_SCORE, BOX_SIDE, UNCLIP = 0.3, 0.5, 3, 1.6
ANGLES = [a * 0.5 for a in range(-12, 13)]


def ssim(pixels: DataFrame, *keys: str, size: int = WINDOW) -> DataFrame:
    """(keys, ssim) of rows (keys, x, y, a, b): mean over windows that do not overlap; one aggregation by window, one by image."""
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    win = pixels.groupBy(*keys, F.floor(F.col("y") / size).alias("wy"), F.floor(F.col("x") / size).alias("wx")).agg(
        F.count("*").alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"), F.sum(a * b).alias("ab")
    )
    ma, mb = F.col("sa") / F.col("n"), F.col("sb") / F.col("n")
    va, vb, cov = F.col("aa") / F.col("n") - ma * ma, F.col("bb") / F.col("n") - mb * mb, F.col("ab") / F.col("n") - ma * mb
    value = ((2 * ma * mb + C1) * (2 * cov + C2)) / ((ma * ma + mb * mb + C1) * (va + vb + C2))
    return win.select(*keys, value.alias("v")).groupBy(*keys).agg(F.avg("v").alias("ssim"))


def box_resample(pixels: DataFrame, width: int, height: int, *keys: str) -> DataFrame:
    """(keys, x, y, v): mean of the source pixels of each target cell; rows have the image's w and h."""
    x, y = F.floor(F.col("x") * width / F.col("w")), F.floor(F.col("y") * height / F.col("h"))
    return pixels.groupBy(*keys, x.alias("x"), y.alias("y")).agg(F.avg("v").alias("v"))


def argmax_labels(logits: DataFrame, *keys: str) -> DataFrame:
    """(keys, t, label, p): the best class of each step; ties go to the smaller class."""
    return logits.groupBy(*keys, "t").agg(F.max(F.struct("v", (-F.col("cls")).alias("neg"))).alias("m")).select(*keys, "t", (-F.col("m.neg")).alias("label"), F.col("m.v").alias("p"))


def ctc_decode(steps: DataFrame, *keys: str) -> DataFrame:
    """(keys, labels, confidence) of rows (keys, t, label, p): repeats fall together, then blanks (0) go."""
    w = Window.partitionBy(*keys).orderBy("t")
    kept = steps.withColumn("before", F.lag("label").over(w)).filter("label <> 0 and (before is null or before <> label)")
    labels = F.transform(F.array_sort(F.collect_list(F.struct("t", "label"))), lambda x: x.label)
    found = kept.groupBy(*keys).agg(labels.alias("labels"), F.avg("p").alias("confidence"))
    empty = F.array().cast(f"array<{dict(steps.dtypes)['label']}>")
    return steps.select(*keys).distinct().join(found, list(keys), "left").select(*keys, F.coalesce("labels", empty).alias("labels"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def skew(dark: DataFrame, *keys: str) -> DataFrame:
    """(keys, angle): of 25 angles the one whose rows vary most; ties go to the first. Rows are dark pixels (keys, x, y)."""
    tried = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("angle"), F.lit(math.sin(math.radians(a))).alias("s"), F.lit(math.cos(math.radians(a))).alias("c")) for k, a in enumerate(ANGLES)]))
    turned = dark.select(*keys, "x", "y", tried.alias("t")).select(*keys, "t.k", "t.angle", F.floor(F.col("y") * F.col("t.c") - F.col("x") * F.col("t.s") + 0.5).alias("row"))
    by_row = turned.groupBy(*keys, "k", "angle", "row").agg(F.count("*").alias("n"))
    spread = by_row.groupBy(*keys, "k", "angle").agg(F.var_pop("n").alias("spread"))
    return spread.groupBy(*keys).agg(F.max_by("angle", F.struct(F.round("spread", 9), -F.col("k"))).alias("angle"))


# --- arrays, for Arrow-batched functions --------------------------------------------------------------------


def gray(rgba: np.ndarray) -> np.ndarray:
    """Luminance of (h, w, 4) pixels, rounded half up."""
    return np.floor(rgba[..., :3] @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.uint8)


def ssim_array(a: np.ndarray, b: np.ndarray, size: int = WINDOW) -> float:
    values = []
    for y in range(0, a.shape[0], size):
        for x in range(0, a.shape[1], size):
            p, q = a[y : y + size, x : x + size].astype(float), b[y : y + size, x : x + size].astype(float)
            cov = (p * q).mean() - p.mean() * q.mean()
            values.append((2 * p.mean() * q.mean() + C1) * (2 * cov + C2) / ((p.mean() ** 2 + q.mean() ** 2 + C1) * (p.var() + q.var() + C2)))
    return float(np.mean(values)) if values else 1.0


def text_boxes(prob: np.ndarray, side: int = BOX_SIDE, unclip: float = UNCLIP) -> list[tuple[int, int, int, int, float]]:
    """(x, y, w, h, score) of 4-connected regions above the threshold, from top left on."""
    hot = prob > BOX_ABOVE
    label = np.where(hot, np.arange(1, hot.size + 1).reshape(hot.shape), 0)
    while True:  # labels spread along rows and columns of regions until none changes
        before = label
        for axis in (0, 1):
            for flip in (False, True):
                v = np.flip(label, axis) if flip else label
                moved = np.roll(v, 1, axis)
                edge = [slice(None)] * 2
                edge[axis] = 0
                moved[tuple(edge)] = 0
                v = np.where(v > 0, np.maximum(v, moved), 0)
                label = np.flip(v, axis) if flip else v
        if (label == before).all():
            break
    out = []
    for k in np.unique(label[label > 0]):
        ys, xs = np.nonzero(label == k)
        w, h = int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1
        score = float(prob[ys, xs].mean())
        if min(w, h) < side or score < BOX_SCORE:
            continue
        grow = int(round(w * h * unclip / (2 * (w + h)))) if unclip else 0
        x, y = max(0, int(xs.min()) - grow), max(0, int(ys.min()) - grow)
        out.append((x, y, min(prob.shape[1], int(xs.max()) + 1 + grow) - x, min(prob.shape[0], int(ys.max()) + 1 + grow) - y, score))
    return sorted(out, key=lambda b: (b[1], b[0]))


def noise_level(image: np.ndarray) -> float:
    """Share of pixels further than 80 from the median of their 3 by 3 neighbours."""
    padded = np.pad(image, 1, mode="edge")
    around = np.stack([padded[dy : dy + image.shape[0], dx : dx + image.shape[1]] for dy in range(3) for dx in range(3)])
    return float((np.abs(image.astype(int) - np.median(around, axis=0)) > 80).mean())


def median_filter(image: np.ndarray) -> np.ndarray:
    padded = np.pad(image, 1, mode="edge")
    around = np.stack([padded[dy : dy + image.shape[0], dx : dx + image.shape[1]] for dy in range(3) for dx in range(3)])
    return np.median(around, axis=0).astype(image.dtype)


def resize_nearest(image: np.ndarray, width: int, height: int) -> np.ndarray:
    ys, xs = (np.arange(height) * image.shape[0] // height), (np.arange(width) * image.shape[1] // width)
    return image[ys][:, xs]


def crop(image: np.ndarray, x: float, y: float, w: float, h: float) -> np.ndarray:
    """The part of an image inside a box, which may reach beyond its edges; at least one pixel."""
    left, top = min(max(int(round(x)), 0), image.shape[1] - 1), min(max(int(round(y)), 0), image.shape[0] - 1)
    right, bottom = max(left + 1, int(round(x + w))), max(top + 1, int(round(y + h)))
    return image[top:bottom, left:right]


def rotate(image: np.ndarray, degrees: float, background: int = 255) -> np.ndarray:
    """An image turned counterclockwise about its middle on a canvas that holds all of it; pixels are taken from the nearest place."""
    turn = np.deg2rad(degrees)
    c, s = np.cos(turn), np.sin(turn)
    h, w = image.shape[:2]
    width, height = int(np.ceil(abs(w * c) + abs(h * s) - 1e-9)), int(np.ceil(abs(w * s) + abs(h * c) - 1e-9))
    y, x = np.mgrid[:height, :width]
    dx, dy = x - (width - 1) / 2, y - (height - 1) / 2
    from_x = np.rint(dx * c - dy * s + (w - 1) / 2).astype(int)
    from_y = np.rint(dx * s + dy * c + (h - 1) / 2).astype(int)
    inside = (from_x >= 0) & (from_x < w) & (from_y >= 0) & (from_y < h)
    out = np.full((height, width, *image.shape[2:]), background, image.dtype)
    out[inside] = image[from_y[inside], from_x[inside]]
    return out


def normalise(image: np.ndarray, mean=(0.485, 0.456, 0.406), std=(0.229, 0.224, 0.225)) -> np.ndarray:
    """Channels first, scaled as detection models want them."""
    return ((image[..., :3] / 255.0 - mean) / std).transpose(2, 0, 1).astype(np.float32)
