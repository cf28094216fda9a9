"""Planted layout errors and harmless layout changes.

Errors are plans of strokes: boxes of the screen that are filled or covered with another part of it. A plan is
plain data drawn from a screen's size and a random stream; one painter carries all plans out.
Harmless changes are target canvases: for every pane of the new screen the rows and columns of the
old one that are seen there. One sampler renders all of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from siltmark.functions.imaging import box_mean, decode_png, encode_png, resize

# Operators, weights, and the ranges that parts of a screen are drawn from.
INJECTORS = ("black_region", "empty_space", "overlay", "disorder", "cropped")
REFLOW_WEIGHTS = {"scroll_shift": 1.0, "two_pane": 0.6, "ar_relayout": 1.0, "band_jitter": 1.0}
BAR = (0.12, 0.32)
EMPTY_HEIGHT, EMPTY_WIDTH = (0.20, 0.45), (0.40, 0.95)
OVERLAY_HEIGHT, OVERLAY_WIDTH, OVERLAY_STRENGTH = (0.12, 0.30), (0.25, 0.55), (0.75, 1.0)
BANDS, BAND_HEIGHT, BAND_PUSH = (2, 4), (0.10, 0.22), (0.08, 0.25)
CROP = (0.15, 0.35)
SCROLL = (0.05, 0.25)
ASPECT_NOISE, STRETCH, CANVAS = (0.94, 1.06), (0.5, 2.0), (64, 2.0)
GAP_ROWS, GAP_STRETCH, STEP_LEVEL, ROW_LEVEL = 8, (0.7, 1.3), 1.5, 8.0
BORDER = 8

#: Images whose variants are handed on together.
BATCH = 64


@dataclass(frozen=True)
class Stroke:
    """A box of the screen (top, left, height, width) and what covers it: a fill, or the part that starts at `source`."""

    box: tuple[int, int, int, int]
    fill: str | None = None
    source: tuple[int, int] | None = None
    strength: float = 1.0


Plan = list[Stroke]


def border_colour(image: np.ndarray, width: int = BORDER) -> np.ndarray:
    """Median colour of the four border strips; corners count twice, as they lie in two strips."""
    strips = (image[:width], image[-width:], image[:, :width], image[:, -width:])
    return np.median(np.concatenate([s.reshape(-1, 3) for s in strips]), axis=0).astype(np.uint8)


def paint(image: np.ndarray, plan: Plan) -> np.ndarray:
    """Carry a plan out; parts are taken from the screen as it was. Boxes are cut at the screen's edge."""
    out, fills = image.copy(), {"black": np.zeros(3, np.uint8)}
    if any(stroke.fill == "border" for stroke in plan):
        fills["border"] = border_colour(image)
    for stroke in plan:
        top, left, height, width = stroke.box
        view = out[top : top + height, left : left + width]
        if stroke.fill:
            view[:] = fills[stroke.fill]
            continue
        y, x = stroke.source
        part = image[y : y + view.shape[0], x : x + view.shape[1]]
        view = view[: part.shape[0], : part.shape[1]]
        view[:] = np.rint(stroke.strength * part + (1 - stroke.strength) * view).astype(np.uint8)
    return out


def _part(rng: np.random.Generator, whole: int, share: tuple[float, float]) -> int:
    return max(1, int(rng.uniform(*share) * whole))


def _box(rng: np.random.Generator, h: int, w: int, tall: tuple[float, float], wide: tuple[float, float]) -> tuple[int, int, int, int]:
    bh, bw = _part(rng, h, tall), _part(rng, w, wide)
    return int(rng.integers(h - bh + 1)), int(rng.integers(w - bw + 1)), bh, bw


def plan_black_region(h: int, w: int, rng: np.random.Generator) -> Plan:
    """Black bars along one side, or along both vertical ones."""
    bars = {"left": (0, 0, h, _part(rng, w, BAR)), "top": (0, 0, _part(rng, h, BAR), w)}
    bars["right"], bars["bottom"] = (0, w - bars["left"][3], h, w), (h - bars["top"][2], 0, h, w)
    sides = [["left"], ["right"], ["top"], ["bottom"], ["left", "right"]][rng.integers(5)]
    return [Stroke(bars[s], "black") for s in sides]


def plan_empty_space(h: int, w: int, rng: np.random.Generator) -> Plan:
    """A large box in the border colour."""
    return [Stroke(_box(rng, h, w, EMPTY_HEIGHT, EMPTY_WIDTH), "border")]


def plan_overlay(h: int, w: int, rng: np.random.Generator) -> Plan:
    """One part of the screen, slightly translucent, over another."""
    top, left, bh, bw = _box(rng, h, w, OVERLAY_HEIGHT, OVERLAY_WIDTH)
    onto = (int(rng.integers(h - bh + 1)), int(rng.integers(w - bw + 1)), bh, bw)
    return [Stroke(onto, source=(top, left), strength=float(rng.uniform(*OVERLAY_STRENGTH)))]


def plan_disorder(h: int, w: int, rng: np.random.Generator) -> Plan:
    """Horizontal bands pushed sideways, the border colour behind them."""
    plan = []
    for _ in range(int(rng.integers(BANDS[0], BANDS[1] + 1))):
        top, _, bh, _ = _box(rng, h, w, BAND_HEIGHT, (1, 1))
        push = _part(rng, w, BAND_PUSH)
        left, source = (push, 0) if rng.random() < 0.5 else (0, push)
        plan += [Stroke((top, 0, bh, w), "border"), Stroke((top, left, bh, w - push), source=(top, source))]
    return plan


def plan_cropped(h: int, w: int, rng: np.random.Generator) -> Plan:
    """Content moved down or right and cut at the far side."""
    down, right = (_part(rng, h, CROP), 0) if rng.random() < 0.5 else (0, _part(rng, w, CROP))
    return [Stroke((0, 0, h, w), "border"), Stroke((down, right, h - down, w - right), source=(0, 0))]


PLANS: dict[str, Callable[[int, int, np.random.Generator], Plan]] = {name: globals()[f"plan_{name}"] for name in INJECTORS}


@dataclass(frozen=True)
class Pane:
    """A box of the target canvas by its top left corner, and the rows and columns of the screen seen in it."""

    top: int
    left: int
    rows: np.ndarray
    columns: np.ndarray


def sample(image: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The screen at (row, column) coordinates, in between values interpolated."""
    def corners(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip(at, 0, size - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, size - 1), (at - low)

    (y0, y1, fy), (x0, x1, fx) = corners(rows, image.shape[0]), corners(columns, image.shape[1])

    def between(lines: np.ndarray, low: np.ndarray, high: np.ndarray, part: np.ndarray) -> np.ndarray:
        if not part.any():
            return lines[low]  # whole coordinates
        part = part[:, None, None]
        out, far = lines[low] * (1 - part), lines[high] * part
        return np.add(out, far, out=out)

    # columns first in memory: what the columns are made of is copied whole
    lines = np.ascontiguousarray(between(image, y0, y1, fy).swapaxes(0, 1))
    out = between(lines, x0, x1, fx).swapaxes(0, 1)
    return np.ascontiguousarray(out if out.dtype == np.uint8 else np.rint(out).astype(np.uint8))


def render(image: np.ndarray, panes: list[Pane]) -> np.ndarray:
    """The target canvas that the panes make up."""
    height, width = max(p.top + len(p.rows) for p in panes), max(p.left + len(p.columns) for p in panes)
    out = np.zeros((height, width, 3), np.uint8)
    for p in panes:
        out[p.top : p.top + len(p.rows), p.left : p.left + len(p.columns)] = sample(image, p.rows, p.columns)
    return out


def stretched(start: float, end: float, n: int) -> np.ndarray:
    """Centres of n equal stretches of [start, end), as coordinates."""
    return start + (np.arange(n) + 0.5) * (end - start) / n - 0.5


def canvas_scroll_shift(image: np.ndarray, rng: np.random.Generator) -> list[Pane]:
    """The screen scrolled up or down, around its end."""
    h, w, _ = image.shape
    by = int(h * rng.uniform(*SCROLL)) * (1 if rng.random() < 0.5 else -1)
    return [Pane(0, 0, (np.arange(h) - by) % h, np.arange(w))]


def canvas_two_pane(image: np.ndarray, rng: np.random.Generator) -> list[Pane]:
    """Upper and lower half side by side, each over the whole height."""
    h, w, _ = image.shape
    middle = w // 2
    return [Pane(0, 0, stretched(0, h // 2, h), stretched(0, w, middle)), Pane(0, middle, stretched(h // 2, h, h), stretched(0, w, w - middle))]


def canvas_ar_relayout(image: np.ndarray, rng: np.random.Generator, aspects: list[float] | None = None) -> list[Pane]:
    """A canvas of the same area and another aspect ratio: near one of the given ones, or a random one."""
    h, w, _ = image.shape
    aspect = float(rng.choice(aspects)) * rng.uniform(*ASPECT_NOISE) if aspects else w / h / rng.uniform(*STRETCH)
    height = (h * w / max(aspect, 1e-3)) ** 0.5
    least, most = CANVAS
    size = [int(np.clip(round(v), least, most * old)) for v, old in ((height, h), (height * aspect, w))]
    return [Pane(0, 0, stretched(0, h, size[0]), stretched(0, w, size[1]))]


def gaps(image: np.ndarray) -> np.ndarray:
    """Number of the gap each row lies in, -1 outside: runs of more than GAP_ROWS even rows without an edge on either side."""
    plain = image.mean(axis=2, dtype=np.float32)
    step = np.abs(np.diff(plain, axis=0, prepend=plain[:1], append=plain[-1:])).mean(axis=1)
    quiet = (np.maximum(step[:-1], step[1:]) < STEP_LEVEL) & (plain.std(axis=1) < ROW_LEVEL)
    run = np.cumsum(np.diff(quiet, prepend=quiet[0]))
    long_ = quiet & (np.bincount(run)[run] > GAP_ROWS)
    return np.where(long_, run, -1)


def canvas_band_jitter(image: np.ndarray, rng: np.random.Generator) -> list[Pane]:
    """Every gap takes more or less of the height; content keeps its order. Screens without gaps are scrolled."""
    h, w, _ = image.shape
    gap = gaps(image)
    if (gap < 0).all():
        return canvas_scroll_shift(image, rng)
    weight = np.ones(h)
    for k in np.unique(gap[gap >= 0]):
        weight[gap == k] = rng.uniform(*GAP_STRETCH)
    edges = np.r_[0, np.cumsum(weight)]
    rows = np.interp((np.arange(h) + 0.5) * edges[-1] / h, edges, np.arange(h + 1)) - 0.5
    return [Pane(0, 0, rows, np.arange(w))]


#: Canvases, and the side below which a screen is left as it is.
CANVASES: dict[str, tuple[Callable[..., list[Pane]], int]] = {"scroll_shift": (canvas_scroll_shift, 1), "two_pane": (canvas_two_pane, 16), "ar_relayout": (canvas_ar_relayout, 64), "band_jitter": (canvas_band_jitter, 32)}
OPERATORS = (*INJECTORS, *CANVASES)


def least_side() -> int:
    """No screen with sides this long is left as it is by a canvas for its size, nor is its new aspect ratio cut at the least side."""
    return int(np.ceil(max(*(least for _, least in CANVASES.values()), CANVAS[0] * max(STRETCH[1], 1 / STRETCH[0]) ** 0.5)))


def apply(name: str, image: np.ndarray, rng: np.random.Generator, aspects: list[float] | None = None) -> np.ndarray:
    """One operator by name; the image stays as it is."""
    h, w, _ = image.shape
    if name in PLANS:
        return paint(image, PLANS[name](h, w, rng))
    canvas, least = CANVASES[name]
    if min(h, w) < least:
        return image.copy()
    return render(image, canvas(image, rng, aspects) if name == "ar_relayout" else canvas(image, rng))


def reflow(image: np.ndarray, rng: np.random.Generator, weights: dict[str, float] | None = None, most: int = 2, aspects: list[float] | None = None) -> tuple[np.ndarray, list[str]]:
    """One to `most` harmless layout changes, drawn by weight without repetition; a new canvas comes last."""
    weights = {k: v for k, v in (weights or REFLOW_WEIGHTS).items() if v > 0}
    if not weights:
        return image.copy(), []
    wanted = min(int(rng.integers(1, max(1, most) + 1)), len(weights))
    # the smallest -ln(u) / weight win: a weighted draw without replacement
    draws = {name: -np.log(1 - rng.random()) / weight for name, weight in weights.items()}
    chosen = sorted(sorted(draws, key=draws.get)[:wanted], key=lambda name: name == "ar_relayout")
    for name in chosen:
        image = apply(name, image, rng, aspects)
    return image, chosen


def benign(image: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A round trip through another resolution, brightness and contrast, sometimes a blur."""
    h, w, _ = image.shape
    scale = rng.uniform(0.5, 1.0)
    out = resize(resize(image, max(1, int(h * scale)), max(1, int(w * scale))), h, w).astype(np.float32)
    out = (out - out.mean()) * rng.uniform(0.9, 1.1) + out.mean() * rng.uniform(0.9, 1.1)
    if rng.random() < 0.3:
        out = box_mean(out, 3)
    return np.clip(out, 0, 255).astype(np.uint8)


def make_variants(images: DataFrame, kinds: tuple[str, ...] = INJECTORS, variants: int = 1, seed: int = 0) -> DataFrame:
    """(parent, applied, variant, content) for every readable image, operator and variant number.

    The random stream of a variant follows from seed, parent, operator and number, not from the task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), BATCH):
                rows = []
                for path, content in zip(batch.path[low : low + BATCH], batch.content[low : low + BATCH]):
                    image = decode_png(content)  # once for all of its variants
                    for applied, variant in ((a, v) for a in kinds for v in range(variants) if image is not None):
                        rng = np.random.default_rng([seed, zlib.crc32(path.encode()), zlib.crc32(applied.encode()), variant])
                        rows.append((path, applied, variant, encode_png(apply(applied, image, rng))))
                yield pd.DataFrame(rows, columns=["parent", "applied", "variant", "content"]).astype({"variant": "int32"})

    return images.select("path", "content").mapInPandas(run, "parent string, applied string, variant int, content binary")
