"""Numpy kernels on RGB images (height x width x 3, uint8) and their Arrow wrappers.

Images travel as PNG bytes; everything here is deterministic for a seed. Resizing is bilinear with
pixel centres aligned; bit parity with other imaging libraries is not promised.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# The luminance weights, the padding grey, the model's input size, channel means and deviations, and
# the level and part from which a patch counts as changed.
LUMA = (0.299, 0.587, 0.114)
PAD_GREY = (124, 116, 104)
SIZE, PATCH = 518, 14
CHANNEL_MEAN, CHANNEL_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
CHANGED_LEVEL, CHANGED_PART = 12, 0.25

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def encode_png(image: np.ndarray) -> bytes:
    h, w, _ = image.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * 3)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def decode_png(data: bytes | None) -> np.ndarray | None:
    """RGB pixels of an 8-bit grey, RGB or RGBA PNG without interlacing; None for anything else."""
    try:
        if not data or data[:8] != _SIGNATURE:
            return None
        at, body, head = 8, b"", None
        while at < len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            part = data[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", part)
            elif kind == b"IDAT":
                body += part
            at += size + 12
        w, h, depth, colour, _, _, interlaced = head
        channels = {0: 1, 2: 3, 6: 4}[colour]
        if depth != 8 or interlaced:
            return None
        raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w * channels + 1)
        if raw[:, 0].any():
            out = np.zeros((h, w * channels), np.uint8)
            above = np.zeros(w * channels, np.int32)
            for y in range(h):
                line = _unfilter(int(raw[y, 0]), raw[y, 1:].astype(np.int32), above, channels)
                out[y], above = line, line
        else:  # no line is filtered
            out = raw[:, 1:].copy()
        pixels = out.reshape(h, w, channels)
        return np.repeat(pixels, 3, axis=2) if channels == 1 else np.ascontiguousarray(pixels[:, :, :3])
    except (ValueError, KeyError, TypeError, struct.error, zlib.error, IndexError):
        return None


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return (line + above) & 255
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0).reshape(-1) & 255
    out = np.zeros(len(line) + step, np.int32)
    for i in range(len(line)):
        left, up, corner = out[i], above[i], above[i - step] if i >= step else 0
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            guess = min((left, up, corner), key=lambda v: abs(p - v))
        out[i + step] = (line[i] + guess) & 255
    return out[step:]


def resize(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear; works on grey and colour arrays."""
    def places(old: int, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
        low = np.floor(x).astype(int)
        return low, np.minimum(low + 1, old - 1), x - low

    y0, y1, fy = places(image.shape[0], h)
    x0, x1, fx = places(image.shape[1], w)
    wide = (1,) * (image.ndim - 2)
    fy, fx = fy.reshape(-1, 1, *wide), fx.reshape(1, -1, *wide)
    # columns first in memory: what the columns are made of is copied whole
    rows = np.ascontiguousarray((image[y0] * (1 - fy) + image[y1] * fy).swapaxes(0, 1))
    fx = fx.swapaxes(0, 1)
    out = rows[x0]
    out *= 1 - fx
    right = rows[x1]
    right *= fx
    out += right
    if image.dtype == np.uint8:
        out = np.rint(out, out=out).astype(np.uint8)
    return np.ascontiguousarray(out.swapaxes(0, 1))


def grey(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float32) @ np.array(LUMA, np.float32)


def dhash64(image: np.ndarray) -> int:
    """64 bits, row by row: is a cell brighter than its left neighbour; two's complement."""
    small = np.rint(resize(grey(image), 8, 9))
    bits = np.packbits((small[:, 1:] > small[:, :-1]).ravel())
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def pad_square(image: np.ndarray, fill: tuple[int, int, int] = PAD_GREY) -> np.ndarray:
    h, w, _ = image.shape
    side = max(h, w)
    out = np.empty((side, side, 3), np.uint8)
    out[:] = fill
    y, x = (side - h) // 2, (side - w) // 2
    out[y : y + h, x : x + w] = image
    return out


def preprocess(image: np.ndarray, pad: bool = True, size: int = SIZE) -> np.ndarray:
    """A square of `size`, padded or stretched, as channel-first floats with the model's means and deviations removed."""
    square = resize(pad_square(image) if pad else image, size, size)
    return ((square / np.float32(255) - np.array(CHANNEL_MEAN, np.float32)) / np.array(CHANNEL_STD, np.float32)).transpose(2, 0, 1).astype(np.float32)


def box_mean(a: np.ndarray, win: int) -> np.ndarray:
    """Mean over a win x win box, mirrored at the borders."""
    half = win // 2
    pad = [(half, win - 1 - half), (half, win - 1 - half), *[(0, 0)] * (a.ndim - 2)]
    padded = np.pad(a, pad, mode="symmetric")
    sums = np.zeros((padded.shape[0] + 1, padded.shape[1] + 1, *padded.shape[2:]))
    inner = sums[1:, 1:]
    np.cumsum(padded, axis=0, dtype=np.float64, out=inner)
    np.cumsum(inner, axis=1, out=inner)
    out = sums[win:, win:] - sums[:-win, win:]
    out -= sums[win:, :-win]
    out += sums[:-win, :-win]
    out /= win * win
    return out


def changed_patches(before: np.ndarray, after: np.ndarray, size: int = SIZE, patch: int = PATCH) -> np.ndarray:
    """Row-major flags of the patches of the padded square of which more than CHANGED_PART differs by more than CHANGED_LEVEL on the channels' mean.

    Images of different sizes are compared after both are padded and sampled.
    """
    def sampled(image: np.ndarray) -> np.ndarray:
        side = max(image.shape[:2])
        at = np.arange(size) * side // size
        return pad_square(image)[at][:, at].astype(int)

    differs = np.abs(sampled(before) - sampled(after)).mean(axis=2) > CHANGED_LEVEL
    n = size // patch
    return (differs[: n * patch, : n * patch].reshape(n, patch, n, patch).mean(axis=(1, 3)) > CHANGED_PART).ravel()


def hash_images(images: DataFrame) -> DataFrame:
    """(path, w, h, phash) of rows (path, content); -1 and null for what is no readable PNG."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content):
                image = decode_png(content)
                rows.append((path, -1, -1, None) if image is None else (path, image.shape[1], image.shape[0], dhash64(image)))
            yield pd.DataFrame(rows, columns=["path", "w", "h", "phash"]).astype({"phash": "Int64", "w": "int32", "h": "int32"})

    return images.select("path", "content").mapInPandas(run, "path string, w int, h int, phash long")
