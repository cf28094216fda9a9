"""Flat regions of screens, and which of them look like dead screen.

The kernel only measures: it cuts flat areas into runs of a row, joins runs of successive rows that
touch, and sums up each region from its runs. What makes a region dead is a column expression on those
measures, evaluated by Spark on one array per image, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from siltmark.functions.imaging import box_mean, decode_png, resize

# The working size and window, what is flat and what is black, the smallest parts that
# count, how far a band runs along a side and how thick it may be, the margin of a side, the weight of empty parts.
WORK, WINDOW = 480, 17
FLAT, BLACK = 7.0, 15.0
LEAST = {"black_region": 0.06, "empty_space": 0.08}
BAND_LENGTH, BAND_THICKNESS = 0.80, 0.45
MARGIN = 2
EMPTY_WEIGHT = 0.6

MEASURES = "array<struct<kind:string,part:double,light:double,sides:array<string>,tall:double,wide:double,box:array<double>>>"


def runs(mask: np.ndarray) -> np.ndarray:
    """(row, start, end) of every run of a mask, row by row."""
    h, w = mask.shape
    padded = np.zeros((h, w + 2), bool)
    padded[:, 1:-1] = mask
    row, edge = np.divmod(np.flatnonzero(padded[:, 1:] != padded[:, :-1]), w + 1)
    return np.stack([row[::2], edge[::2], edge[1::2]], axis=1)  # in a row, starts and ends take turns


def joined_runs(run: np.ndarray, width: int) -> np.ndarray:
    """The region of each run, named by its first run: runs of successive rows that share a column belong together."""
    n, stride = len(run), width + 1
    label = np.arange(n)
    if not n:
        return label
    start, end = run[:, 0] * stride + run[:, 1], run[:, 0] * stride + run[:, 2]
    # the runs of the next row that a run meets are successive
    low, high = np.searchsorted(end, start + stride, side="right"), np.searchsorted(start, end + stride, side="left")
    count = np.maximum(high - low, 0)
    a = np.repeat(np.arange(n), count)
    b = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b, label[a], label[b]):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def flat_regions(image: np.ndarray) -> list[dict]:
    """Measures of the flat regions of at least the smallest part: kind, part, mean light, sides, extent and box, as parts of the screen."""
    scale = WORK / max(image.shape[:2])
    h, w = (max(1, int(n * scale)) for n in image.shape[:2])
    red, green, blue = np.moveaxis(resize(image, h, w), 2, 0).astype(np.float32)
    light = (red + green + blue) / np.float32(3)
    spread = box_mean(light * light, WINDOW) - box_mean(light, WINDOW) ** 2
    flat = spread < FLAT**2
    total = np.pad(light.astype(np.float64).cumsum(axis=1), ((0, 0), (1, 0)))
    out = []
    for kind, mask in (("black_region", flat & (light < BLACK)), ("empty_space", flat & (light >= BLACK))):
        if np.count_nonzero(mask) < LEAST[kind] * h * w:
            continue  # no region of it can be large enough
        run = runs(mask)
        name, region = np.unique(joined_runs(run, w), return_inverse=True)
        row, start, end = run.T
        area = np.bincount(region, end - start, len(name))
        shine = np.bincount(region, total[row, end] - total[row, start], len(name))
        top, left, bottom, right = (np.full(len(name), v) for v in (h, w, -1, -1))
        for at, value, pick in ((top, row, np.minimum), (left, start, np.minimum), (bottom, row, np.maximum), (right, end - 1, np.maximum)):
            pick.at(at, region, value)
        for k in np.flatnonzero(area >= LEAST[kind] * h * w):
            near = {"left": left[k] <= MARGIN, "right": right[k] >= w - 1 - MARGIN, "top": top[k] <= MARGIN, "bottom": bottom[k] >= h - 1 - MARGIN}
            box = [round(float(v), 3) for v in (left[k] / w, top[k] / h, right[k] / w, bottom[k] / h)]
            out.append({
                "kind": kind, "part": round(float(area[k] / (h * w)), 4), "light": round(float(shine[k] / area[k]), 1), "sides": [s for s, hit in near.items() if hit],
                "tall": float((bottom[k] - top[k] + 1) / h), "wide": float((right[k] - left[k] + 1) / w), "box": box,
            })
    return out


def is_band(region: Column) -> Column:
    """It lies at a side, runs along it and is thin across."""
    along = lambda length, across, a, b: (length >= BAND_LENGTH) & (across <= BAND_THICKNESS) & (F.array_contains(region["sides"], a) | F.array_contains(region["sides"], b))
    return along(region["tall"], region["wide"], "left", "right") | along(region["wide"], region["tall"], "top", "bottom")


def is_dead(region: Column) -> Column:
    """A band, or a black block that touches two sides; other empty regions are background."""
    corner = (region["kind"] == "black_region") & (region["part"] > LEAST["black_region"]) & (F.size(region["sides"]) >= 2)
    return is_band(region) | corner


def dead_score(dead: Column) -> Column:
    """Part of the screen that is dead, empty parts by EMPTY_WEIGHT, at most 1; null for an image that cannot be read."""
    weight = lambda r: r["part"] * F.when(r["kind"] == "black_region", 1.0).otherwise(EMPTY_WEIGHT)
    total = F.aggregate(dead, F.lit(0.0), lambda s, r: s + weight(r))
    return F.when(dead.isNotNull(), F.round(F.least(total, F.lit(1.0)), 4))


def measured(images: DataFrame) -> DataFrame:
    """(path, flat): the flat regions of every image; null for what is no readable PNG."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            decoded = map(decode_png, batch.content)  # one after the other: a batch of them is large
            yield pd.DataFrame({"path": batch.path, "flat": pd.Series([None if i is None else flat_regions(i) for i in decoded], index=batch.index, dtype=object)})

    return images.select("path", "content").mapInPandas(run, f"path string, flat {MEASURES}")


def find_regions(images: DataFrame) -> DataFrame:
    """One row per dead region of every image; images without any give one row of nulls, unreadable ones no score either."""
    dead = measured(images).select("path", F.filter("flat", is_dead).alias("dead"))
    rows = dead.select("path", dead_score(F.col("dead")).alias("score"), F.explode_outer("dead").alias("r"))
    return rows.select("path", "score", "r.kind", "r.part", "r.light", F.array_join("r.sides", "+").alias("sides"), is_band(F.col("r")).alias("is_band"), "r.box")
