"""Distances and statistics over planes held as arrays of numbers, in Arrow batches: one numpy pass a batch.

A null plane, or one of another length than stated, gives null unless said otherwise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def stacked(values: pd.Series, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a plane of this length, these planes as a matrix)."""
    ok = np.flatnonzero([v is not None and len(v) == length for v in values])
    return ok, np.array([values.iloc[i] for i in ok], np.float64).reshape(len(ok), length)


def _placed(n: int, ok: np.ndarray, found: np.ndarray, other: float | None = None) -> pd.Series:
    out = np.full(n, np.nan if other is None else other)
    out[ok] = found
    return pd.Series(out).astype(object).where(~np.isnan(out), None) if other is None else pd.Series(out)


def levelled(plane: Column) -> Column:
    """Each value over its plane's mean (1 at least), a quarter being even grey; at most 1."""

    @F.pandas_udf("array<double>")
    def run(planes: pd.Series) -> pd.Series:
        level = lambda v: np.minimum(1.0, v / max(1.0, v.mean() if len(v) else 1.0) / 4)
        return planes.map(lambda p: None if p is None else level(np.asarray(p, np.float64)))

    return run(plane)


def grid_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The look distances of two stacks of grids (n, side, side, channels)."""
    n, side = a.shape[:2]
    best = np.full(n, 1.0)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            here = a[:, max(0, -dy) : side - max(0, dy), max(0, -dx) : side - max(0, dx)]
            there = b[:, max(0, dy) : side - max(0, -dy), max(0, dx) : side - max(0, -dx)]
            cells = np.abs(here - there).mean(axis=3).reshape(n, -1)
            most = -(-cells.shape[1] // 4)
            top = np.partition(cells, cells.shape[1] - most, axis=1)[:, cells.shape[1] - most :]
            best = np.minimum(best, top.mean(axis=1))
    return best


def look_distance(a: Column, b: Column, side: int = 8, channels: int = 1) -> Column:
    """The least distance of two levelled grids over shifts of up to one cell each way: for a shift, the
    mean of the largest quarter of the cells' mean channel differences. At most 1, and 1 for a grid
    that is null or of a wrong length."""
    size = side * side * channels

    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        ok = np.flatnonzero([x is not None and y is not None and len(x) == size and len(y) == size for x, y in zip(left, right, strict=True)])
        grids = [np.array([s.iloc[i] for i in ok], np.float64).reshape(len(ok), side, side, channels) for s in (left, right)]
        return _placed(len(left), ok, grid_distance(*grids) if len(ok) else np.zeros(0), 1.0)

    return run(a, b)


def laplacians(planes: np.ndarray) -> np.ndarray:
    """Population variance of the 4-neighbour Laplacian over the inner cells of a stack (n, height, width); 0
    where there are none."""
    if min(planes.shape[1:]) < 3:
        return np.zeros(len(planes))
    inner = 4 * planes[:, 1:-1, 1:-1] - planes[:, 1:-1, :-2] - planes[:, 1:-1, 2:] - planes[:, :-2, 1:-1] - planes[:, 2:, 1:-1]
    return inner.reshape(len(planes), inner.shape[1] * inner.shape[2]).var(axis=1)


def reduced(planes: np.ndarray, factor: int) -> np.ndarray:
    """A stack with each whole factor x factor block as its mean."""
    n, high, wide = len(planes), planes.shape[1] // factor, planes.shape[2] // factor
    return planes[:, : high * factor, : wide * factor].reshape(n, high, factor, wide, factor).mean(axis=(2, 4))


def laplacian_variance(plane: Column, side: int) -> Column:
    """Population variance of the 4-neighbour Laplacian over a square plane's inner cells."""

    @F.pandas_udf("double")
    def run(planes: pd.Series) -> pd.Series:
        ok, data = stacked(planes, side * side)
        return _placed(len(planes), ok, laplacians(data.reshape(-1, side, side)))

    return run(plane)


def box_down(plane: Column, side: int, factor: int) -> Column:
    """A square plane with each factor x factor block as its mean."""

    @F.pandas_udf("array<double>")
    def run(planes: pd.Series) -> pd.Series:
        ok, data = stacked(planes, side * side)
        small = reduced(data.reshape(-1, side, side), factor).reshape(len(ok), (side // factor) ** 2)
        out: list = [None] * len(planes)
        for i, p in zip(ok, small, strict=True):
            out[i] = p
        return pd.Series(out)

    return run(plane)


def deviation(plane: Column) -> Column:
    """Population standard deviation of an array; null for an empty one."""

    @F.pandas_udf("double")
    def run(planes: pd.Series) -> pd.Series:
        return planes.map(lambda p: None if p is None or not len(p) else float(np.std(np.asarray(p, np.float64))))

    return run(plane)


def fine_coarse(plane: Column, side: int) -> Column:
    """(fine, coarse, mean): Laplacian variance of a square cell, that of the cell reduced four times, and its mean."""

    @F.pandas_udf("fine double, coarse double, mean double")
    def run(planes: pd.Series) -> pd.DataFrame:
        ok, data = stacked(planes, side * side)
        cells = data.reshape(-1, side, side)
        small = reduced(cells, 4)
        found = {"fine": laplacians(cells), "coarse": laplacians(small), "mean": small.mean(axis=(1, 2)) if side >= 4 and len(ok) else np.zeros(len(ok))}
        return pd.DataFrame({k: _placed(len(planes), ok, v) for k, v in found.items()})

    return run(plane)
