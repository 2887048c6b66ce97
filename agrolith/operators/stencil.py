"""Neighbourhood operators on pixel relations.

3 x 3 kernels and rectangles are windows along rows and columns of chunks with a margin: pixels are shuffled once, by chunk, and both
windows stay in it. Convolution and morphology run on arrays of such chunks. Rasters of one table (grid.RASTER) don't mix.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from agrolith.operators.grid import keys, moved, on_arrays, with_margin

#: Rows and columns of a chunk.
CHUNK = 128


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(raw) for x in raw]


def _summed(cells: np.ndarray, there: np.ndarray, weights: list[float], first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sums along the first axis and whether anything was added; beyond 0 and n lie the reflected cells, the edge repeated."""
    at = np.arange(first, first + len(cells))
    mirror = np.where(at < 0, -1 - at, np.where(at >= n, 2 * n - 1 - at, at))
    near = (mirror >= 0) & (mirror < n) & (mirror - first >= 0) & (mirror - first < len(cells))
    v, some = (np.where(near[:, None], x[np.clip(mirror - first, 0, len(x) - 1)], 0) for x in (cells, there))
    out, found, radius = np.zeros(cells.shape), np.zeros(cells.shape, bool), len(weights) // 2
    for k, w in enumerate(weights):
        out += w * moved(v, radius - k, 0)
        found |= moved(some, radius - k, 0).astype(bool)
    return out, found


def convolve(grid: DataFrame, weights: list[float], height: Column, width: Column, value: str = "v") -> DataFrame:
    """Weighted sum over an odd window along both axes; edges are reflected with the edge pixel repeated, and absent pixels add nothing."""

    def run(known: list[np.ndarray], top: int, left: int, height: int, width: int) -> list[np.ndarray]:
        there, cells = known
        null, parts = np.isnan(cells), []
        for v, some in ((np.where(null, 0.0, cells), there & ~null), (np.zeros(cells.shape), there)):
            v, some = (x.T for x in _summed(v.T, some.T, weights, left, width))
            parts.append(_summed(v, some, weights, top, height))
        (v, real), (_, some) = parts
        return [some, np.where(real, v, np.nan)]

    return on_arrays(grid, height, width, len(weights) // 2, run, value)


def gaussian(grid: DataFrame, sigma: float, height: Column, width: Column, value: str = "v") -> DataFrame:
    return convolve(grid, gaussian_weights(sigma), height, width, value)


def _chunks(grid: DataFrame, pad: int, value: str) -> tuple[DataFrame, Callable[[str], WindowSpec], list[str]]:
    """Pixels by chunks with a margin, windows along an axis inside chunks, and the raster's columns."""
    held = keys(grid)
    by = [*held, "cy", "cx"]
    placed = with_margin(grid.select(*held, "row", "col", value), max(CHUNK, pad), pad).repartition(*by)
    return placed, lambda axis: Window.partitionBy(*by, "col" if axis == "row" else "row").orderBy(axis), held


def neighbours(grid: DataFrame, value: str = "v") -> DataFrame:
    """The pixel and its eight neighbours, edge pixels repeated: columns n_<row step>_<column step> with m for -1, z for 0, p for 1."""
    placed, along, held = _chunks(grid, 1, value)
    by_col, by_row = along("col"), along("row")
    across = placed.select(*held, "row", "col", "cy", "cx", "own", F.col(value).alias("z"), F.coalesce(F.lag(value).over(by_col), value).alias("m"), F.coalesce(F.lead(value).over(by_col), value).alias("p"))
    out = [*held, "row", "col", "own"]
    for step, move in (("m", F.lag), ("z", None), ("p", F.lead)):
        for c in "mzp":
            out.append((F.col(c) if move is None else F.coalesce(move(c).over(by_row), F.col(c))).alias(f"n_{step}_{c}"))
    return across.select(*out).where("own").drop("own")


def sobel(grid: DataFrame, value: str = "v") -> DataFrame:
    """(row, col, gx, gy, gradient)."""
    n = neighbours(grid, value)
    c = lambda name: F.col(f"n_{name}")
    gx = (c("m_p") - c("m_m")) + 2 * (c("z_p") - c("z_m")) + (c("p_p") - c("p_m"))
    gy = (c("p_m") - c("m_m")) + 2 * (c("p_z") - c("m_z")) + (c("p_p") - c("m_p"))
    return n.select(*keys(grid), "row", "col", gx.alias("gx"), gy.alias("gy"), F.sqrt(gx * gx + gy * gy).alias("gradient"))


def gradient_uint8(grid: DataFrame, value: str = "v") -> DataFrame:
    """(row, col, gradient): the gradient's length as a share of the raster's largest, 0 to 255 cut to whole numbers; a flat raster is 0."""
    g, held = sobel(grid, value), keys(grid)
    top = g.groupBy(*held).agg(F.max("gradient").alias("_top"))
    both = g.join(top, held) if held else g.join(F.broadcast(top))  # one row
    share = F.when(F.col("_top") > 0, F.floor(F.col("gradient") / F.col("_top") * 255)).otherwise(0)
    return both.select(*held, "row", "col", share.cast("int").alias("gradient"))


def directional_edges(grid: DataFrame, value: str = "v") -> DataFrame:
    """(row, col, edge): mean of the absolute responses of four line kernels, cut to 0..255."""
    n = neighbours(grid, value)
    c = lambda name: F.col(f"n_{name}")
    middle = 2 * (c("z_m") + c("z_z") + c("z_p"))
    rows = -(c("m_m") + c("m_z") + c("m_p")) + middle - (c("p_m") + c("p_z") + c("p_p"))
    cols = 2 * (c("m_z") + c("z_z") + c("p_z")) - (c("m_m") + c("z_m") + c("p_m")) - (c("m_p") + c("z_p") + c("p_p"))
    falling = 2 * (c("m_m") + c("z_z") + c("p_p")) - (c("m_z") + c("m_p") + c("z_m") + c("z_p") + c("p_m") + c("p_z"))
    rising = 2 * (c("m_p") + c("z_z") + c("p_m")) - (c("m_m") + c("m_z") + c("z_m") + c("z_p") + c("p_z") + c("p_p"))
    mean = (F.abs(rows) + F.abs(cols) + F.abs(falling) + F.abs(rising)) / 4
    return n.select(*keys(grid), "row", "col", F.greatest(F.lit(0.0), F.least(F.lit(255.0), mean)).alias("edge"))


def windowed(grid: DataFrame, how: str, before: int, after: int, value: str = "v") -> DataFrame:
    """Largest ("max") or least ("min") value of a rectangle, from `before` pixels before to `after` pixels after along both axes."""
    take = F.max if how == "max" else F.min
    placed, along, held = _chunks(grid, max(before, after), value)
    across = placed.withColumn(value, take(value).over(along("col").rangeBetween(-before, after)))
    return across.withColumn(value, take(value).over(along("row").rangeBetween(-before, after))).where("own").select(*held, "row", "col", value)


#: A 5 x 5 ellipse: the offsets of its cells.
ELLIPSE_5 = [(0, 0), *((r, c) for r in (-1, 0, 1) for c in range(-2, 3) if (r, c) != (0, 0)), (-2, 0), (2, 0)]


def morph(mask: DataFrame, steps: list[str], offsets: list[tuple[int, int]], height: Column, width: Column) -> DataFrame:
    """(row, col) after some steps "dilate" and "erode" of marked pixels; mask: (row, col) of them.

    A pixel is dilated to all that it reaches; one stays in erosion if all of its window is marked, where beyond the raster counts as marked.
    """
    reach = max(max(abs(r), abs(c)) for r, c in offsets) * len(steps)

    def run(known: list[np.ndarray], top: int, left: int, height: int, width: int) -> list[np.ndarray]:
        (marked,) = known
        row, col = np.arange(top, top + marked.shape[0])[:, None], np.arange(left, left + marked.shape[1])
        inside = (row >= 0) & (row < height) & (col >= 0) & (col < width)
        for step in steps:
            way = 1 if step == "dilate" else -1
            spread = marked if way == 1 else inside & ~marked
            spread = np.logical_or.reduce([moved(spread, way * r, way * c) for r, c in offsets])
            marked = inside & (spread if way == 1 else ~spread)
        return [marked]

    return on_arrays(mask, height, width, reach, run, None)


def close_open(mask: DataFrame, height: Column, width: Column, turns: int = 2, offsets: list[tuple[int, int]] = ELLIPSE_5) -> DataFrame:
    """Morphological closing, then opening, of `turns` iterations each."""
    return morph(mask, [step for step in ("dilate", "erode", "erode", "dilate") for _ in range(turns)], offsets, height, width)


def ring(mask: DataFrame, steps: int, height: Column, width: Column) -> DataFrame:
    """Pixels within `steps` moves along the axes of a marked pixel that aren't marked themselves."""
    reach = [(r, c) for r in range(-steps, steps + 1) for c in range(-steps, steps + 1) if abs(r) + abs(c) <= steps]

    def run(known: list[np.ndarray], top: int, left: int, height: int, width: int) -> list[np.ndarray]:
        (marked,) = known
        return [np.logical_or.reduce([moved(marked, r, c) for r, c in reach]) & ~marked]

    return on_arrays(mask, height, width, steps, run, None)


def unsharp(grid: DataFrame, amount: float, sigma: float, height: Column, width: Column, value: str = "v") -> DataFrame:
    """(1 + amount) times the pixel less amount times the blurred one, cut to 0..255."""
    soft = gaussian(grid, sigma, height, width, value).withColumnRenamed(value, "_soft")
    sharp = (1 + amount) * F.col(value) - amount * F.col("_soft")
    held = keys(grid)
    return grid.join(soft, [*held, "row", "col"]).select(*held, "row", "col", F.greatest(F.lit(0.0), F.least(F.lit(255.0), sharp)).alias(value))


def adaptive_threshold(grid: DataFrame, height: Column, width: Column, size: int = 11, offset: float = 2.0, value: str = "v") -> DataFrame:
    """255 where a pixel is brighter than the Gaussian mean of the size x size pixels around it less `offset`, else 0; edges are repeated.

    The Gaussian has the width that goes with the size: 0.3 ((size - 1) / 2 - 1) + 0.8.
    """
    sigma, radius = 0.3 * ((size - 1) * 0.5 - 1) + 0.8, size // 2
    raw = [exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    weights, held = [x / sum(raw) for x in raw], keys(grid)
    mean = convolve(grid, weights, height, width, value).withColumnRenamed(value, "_mean")
    return grid.join(mean, [*held, "row", "col"]).select(*held, "row", "col", F.when(F.col(value) > F.col("_mean") - offset, 255).otherwise(0).alias(value))
