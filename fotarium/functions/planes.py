"""Decoded image planes (row by row, width x height): orientation, reduction, colour fingerprints, look codes.

All work is numpy on one Arrow batch at a time; planes are bytes or arrays. Planes of a wrong length give null."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _plane(data: object, width: int | None, height: int | None) -> np.ndarray | None:
    if data is None or not width or not height or width < 0 or height < 0:
        return None
    flat = np.frombuffer(data, np.uint8) if isinstance(data, (bytes, bytearray)) else np.asarray(data)
    return flat.reshape(height, width) if flat.size == width * height else None


def turned(plane: np.ndarray, orientation: int | None) -> np.ndarray:
    """A stored plane as it is displayed: orientations 3 (half turn), 6 (right), 8 (left); others stay."""
    return np.rot90(plane, {3: 2, 6: -1, 8: 1}.get(orientation or 1, 0))


def oriented(plane: Column, width: Column, height: Column, orientation: Column) -> Column:
    """(width, height, plane): a stored 8-bit plane in display orientation, as bytes."""

    @F.pandas_udf("width int, height int, plane binary")
    def run(data: pd.Series, w: pd.Series, h: pd.Series, o: pd.Series) -> pd.DataFrame:
        rows = []
        for d, x, y, turn in zip(data, w, h, o, strict=True):
            p = _plane(d, None if pd.isna(x) else int(x), None if pd.isna(y) else int(y))
            p = None if p is None else np.ascontiguousarray(turned(p, None if pd.isna(turn) else int(turn)), np.uint8)
            rows.append((None, None, None) if p is None else (p.shape[1], p.shape[0], p.tobytes()))
        out = pd.DataFrame(rows, columns=["width", "height", "plane"], dtype=object)
        return out.astype({"width": "Int32", "height": "Int32"})

    return run(plane, width, height, orientation)


def edges(n: int, scale: float, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end source index of each of n output cells of `scale` source cells; one cell at least."""
    first = np.floor(np.arange(n) * scale).astype(np.int64)
    end = np.minimum(np.floor(np.arange(1, n + 1) * scale).astype(np.int64), limit)
    return first, np.maximum(end, first + 1)


def shrunk(plane: np.ndarray, most: int) -> np.ndarray:
    """A plane with its long edge at most `most`: each cell the whole mean of the box it covers."""
    height, width = plane.shape
    if most <= 0 or max(width, height) <= most:
        return plane
    scale = max(width, height) / most
    high, wide = int(np.floor(height / scale + 0.5)), int(np.floor(width / scale + 0.5))
    sums = np.zeros((height + 1, width + 1), np.int64)
    sums[1:, 1:] = plane.astype(np.int64).cumsum(0).cumsum(1)
    (y0, y1), (x0, x1) = edges(high, scale, height), edges(wide, scale, width)
    boxes = sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]
    return boxes // ((y1 - y0)[:, None] * (x1 - x0)[None, :])


def box_shrunk(plane: Column, width: Column, height: Column, most: int) -> Column:
    """(width, height, plane): an 8-bit plane reduced so that its long edge is at most `most`."""

    @F.pandas_udf("width int, height int, plane binary")
    def run(data: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        rows = []
        for d, x, y in zip(data, w, h, strict=True):
            p = _plane(d, None if pd.isna(x) else int(x), None if pd.isna(y) else int(y))
            p = None if p is None else shrunk(p, most).astype(np.uint8)
            rows.append((None, None, None) if p is None else (p.shape[1], p.shape[0], p.tobytes()))
        out = pd.DataFrame(rows, columns=["width", "height", "plane"], dtype=object)
        return out.astype({"width": "Int32", "height": "Int32"})

    return run(plane, width, height)


# 16-bit weights of full-range YCbCr (ITU-R BT.601) to RGB, as image libraries round them.
Y_WEIGHT, CR_RED, CB_GREEN, CR_GREEN, CB_BLUE = 65_793, 91_881, 22_554, 46_802, 116_130


def rgb(y: int, cb: int, cr: int) -> tuple[int, int, int]:
    """Eight-bit RGB of full-range YCbCr, fractions cut off."""
    b, r = cb - 128, cr - 128
    parts = (CR_RED * r, -CB_GREEN * b - CR_GREEN * r, CB_BLUE * b)
    return tuple(min(255, max(0, (Y_WEIGHT * y + p) >> 16)) for p in parts)  # type: ignore[return-value]


def fingerprint(y: np.ndarray, cb: np.ndarray, cr: np.ndarray, n: int) -> bytes:
    """n x n mean colours, row by row, from every fourth pixel each way; whole means of Y, Cb and Cr first."""
    height, width = y.shape
    out = bytearray()
    for cy in range(n):
        for cx in range(n):
            box = (slice(cy * height // n, (cy + 1) * height // n, 4), slice(cx * width // n, (cx + 1) * width // n, 4))
            cells = [p[box] for p in (y, cb, cr)]
            out += bytes(rgb(*[int(c.sum(dtype=np.int64)) // c.size for c in cells]) if cells[0].size else (0, 0, 0))
    return bytes(out)


def grid_fingerprint(y: Column, cb: Column, cr: Column, width: Column, height: Column, n: int = 8) -> Column:
    """The n x n colour grid of a frame as displayed (3 n² bytes); planes of one size, in display orientation."""

    @F.pandas_udf("binary")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for ya, ba, ra, x, z in zip(a, b, c, w, h, strict=True):
            planes = [_plane(d, None if pd.isna(x) else int(x), None if pd.isna(z) else int(z)) for d in (ya, ba, ra)]
            out.append(None if any(p is None for p in planes) else fingerprint(*planes, n))
        return pd.Series(out, dtype=object)

    return run(y, cb, cr, width, height)


def encode_look(look: Column) -> Column:
    return F.base64(look)


def decode_look(text: Column) -> Column:
    """The bytes of a stored look as numbers from 0 to 255; null for '', null, or what is no base64."""
    data = F.try_to_binary(text, F.lit("base64"))
    digits = F.hex(data)
    cells = F.transform(F.sequence(F.lit(0), F.length(data) - 1), lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("double"))
    return F.when(F.length(data) > 0, cells)
