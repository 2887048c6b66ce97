"""Rasters as pixel relations: arrays to pixels and back, down-sampling, resampling, cropping, tiles with a margin.

A table of one raster has columns row, col and bands. A table of several has raster_id, too, and every operator on pixels then works
raster by raster; where their sizes differ, columns height and width can go with them, to be named as sizes. With a column zone, masks of
several zones that may overlap are handled zone by zone.
"""

from __future__ import annotations

from collections.abc import Callable
from math import pi, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolith.functions.geometry import bounds, contains
from agrolith.operators.scratch import ship


#: Columns that tell a table's rasters apart or belong to a raster; operators carry those that are there.
RASTER = ("raster_id", "zone", "height", "width")
#: Rows and columns of a chunk that is handled as an array.
ARRAY = 256


def keys(grid: DataFrame) -> list[str]:
    """Which of the columns RASTER a pixel relation has."""
    return [c for c in RASTER if c in grid.columns]


def pixels(rows: DataFrame, row: str, values: str, name: str = "v") -> DataFrame:
    """(row, col, v) from one array of values for each row."""
    return rows.select(F.col(row).cast("bigint").alias("row"), F.posexplode(values).alias("col", name)).withColumn(name, F.col(name).cast("double"))


def downsample(grid: DataFrame, factor: int, mean: list[str], first: list[str] = ()) -> DataFrame:
    """Blocks of factor x factor pixels: means of bands, and for class bands the value of the first pixel."""
    order = F.struct("row", "col")
    block = (F.floor(F.col(axis) / factor).cast("bigint").alias(axis) for axis in ("row", "col"))
    return grid.groupBy(*keys(grid), *block).agg(*(F.avg(c).alias(c) for c in mean), *(F.min_by(c, order).alias(c) for c in first))


def upsample_nearest(grid: DataFrame, factor: int) -> DataFrame:
    """Each pixel becomes a block of factor x factor."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(factor) for j in range(factor)))
    rest = [c for c in grid.columns if c not in ("row", "col")]
    wide = grid.select("row", "col", *rest, F.explode(steps).alias("s"))
    return wide.select((F.col("row") * factor + F.col("s.i")).alias("row"), (F.col("col") * factor + F.col("s.j")).alias("col"), *rest)


def upsample(grid: DataFrame, factor: int, height: Column, width: Column, shares: list[tuple[int, float]], value: str = "v") -> DataFrame:
    """Enlargement in which a source pixel gives its share to target pixels near it along each axis; edges are repeated.

    shares: (k, weight) for target factor * at + k, added up in arrays of chunks. A target near an edge gets the shares of the pixels that would lie beyond it from the edge pixel.
    """
    reach = max(abs(k) for k, _ in shares) // factor + 1

    def enlarged(cells: np.ndarray, there: np.ndarray, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        # Along the first axis; the edge pixel stands for those beyond it, too.
        at = np.arange(first, first + len(cells))
        edge = np.clip(at, 0, n - 1) - first
        near = (edge >= 0) & (edge < len(cells)) & (np.abs(at - edge - first) <= reach)
        v, some = (np.where(near[:, None], x[np.clip(edge, 0, len(x) - 1)], 0) for x in (cells, there))
        out, found = np.zeros((len(v) * factor, v.shape[1])), np.zeros((len(v) * factor, v.shape[1]), bool)
        for k, w in shares:
            phase, step = k % factor, k // factor
            out[phase::factor] += w * moved(v, step, 0)
            found[phase::factor] |= moved(some, step, 0).astype(bool)
        return out, found

    def run(known: list[np.ndarray], top: int, left: int, height: int, width: int) -> list[np.ndarray]:
        there, cells = known
        null = np.isnan(cells)
        parts = []
        for v, some in ((np.where(null, 0.0, cells), there & ~null), (np.zeros(cells.shape), there)):
            v, some = (x.T for x in enlarged(v.T, some.T, left, width))
            parts.append(enlarged(v, some, top, height))
        (v, real), (_, some) = parts
        return [some, np.where(real, v, np.nan)]

    return on_arrays(grid, height, width, reach, run, value, factor)


def moved(x: np.ndarray, down: int, right: int) -> np.ndarray:
    """The array moved by some rows and columns, zeros where nothing comes."""
    out = np.zeros_like(x)
    n, m = x.shape
    if abs(down) < n and abs(right) < m:
        out[max(down, 0) : n + min(down, 0), max(right, 0) : m + min(right, 0)] = x[max(-down, 0) : n + min(-down, 0), max(-right, 0) : m + min(-right, 0)]
    return out


def on_arrays(grid: DataFrame, height: Column, width: Column, pad: int, run: Callable[..., list[np.ndarray]], value: str | None = "v", factor: int = 1) -> DataFrame:
    """(row, col, value) from chunks of pixels as arrays with a margin of `pad`; each pixel is shuffled once, to the chunks that read it.

    run gets which pixels are there and, with a value, the values (NaN for null), the row and column of the arrays' first pixel, and the raster's height and
    width; it returns the same of the result, factor times as large. What lies outside the chunk or the raster is cut off. A task holds one chunk.
    """
    held, names = keys(grid), [value] if value else []
    size = max(ARRAY, pad)
    wide = grid.select(*held, "row", "col", *(F.col(c).cast("double").alias(c) for c in names), height.cast("bigint").alias("_h"), width.cast("bigint").alias("_w"))
    placed, by = with_margin(wide, size, pad).drop("own"), [*held, "cy", "cx"]
    schema = T.StructType([*(grid.schema[c] for c in held), *(T.StructField(c, grid.schema[c].dataType) for c in ("row", "col")), *(T.StructField(c, T.DoubleType()) for c in names)])

    def chunk(table: pa.Table) -> pa.Table:
        cy, cx, h, w = (table[c][0].as_py() for c in ("cy", "cx", "_h", "_w"))
        row, col = table["row"].to_numpy().astype(np.int64), table["col"].to_numpy().astype(np.int64)
        # As far as pixels lie, and what they reach.
        top, left = row.min() - pad, col.min() - pad
        there = np.zeros((row.max() + pad + 1 - top, col.max() + pad + 1 - left), bool)
        there[row - top, col - left] = True
        known = [there]
        if value:
            cells = np.full(there.shape, np.nan)
            cells[row - top, col - left] = table[value].to_numpy()
            known.append(cells)
        some, *rest = run(known, int(top), int(left), h, w)
        r, c = np.nonzero(some)
        to_row, to_col = r + top * factor, c + left * factor
        own = (to_row >= max(cy * size, 0) * factor) & (to_row < min((cy + 1) * size, h) * factor) & (to_col >= max(cx * size, 0) * factor) & (to_col < min((cx + 1) * size, w) * factor)
        r, c = r[own], c[own]
        same = {k: pa.array([table[k][0].as_py()] * len(r), table.schema.field(k).type) for k in held}
        at = {k: pa.array(x[own], table.schema.field(k).type) for k, x in (("row", to_row), ("col", to_col))}
        return pa.table(same | at | {k: pa.array(x[r, c], from_pandas=True) for k, x in zip(names, rest, strict=True)})

    ship(grid.sparkSession)
    return placed.groupBy(*by).applyInArrow(chunk, schema)


def upsample_bilinear(grid: DataFrame, factor: int, height: Column, width: Column, value: str = "v") -> DataFrame:
    """Bilinear enlargement with pixel centres aligned and edges repeated."""
    reach = [(k, max(0.0, 1 - abs(k + 0.5 - factor / 2) / factor)) for k in range(-factor, 2 * factor)]
    return upsample(grid, factor, height, width, [(k, w) for k, w in reach if w > 0], value)


def lanczos_shares(factor: int, lobes: int = 3) -> list[tuple[int, float]]:
    """Shares of the windowed sinc; those that a target pixel gets add up to 1."""
    raw = {}
    for k in range(-lobes * factor, (lobes + 1) * factor):
        x = pi * (k + 0.5 - factor / 2) / factor
        if abs(x) < lobes * pi:
            raw[k] = 1.0 if abs(x) < 1e-12 else lobes * sin(x) * sin(x / lobes) / (x * x)
    total = [sum(w for k, w in raw.items() if k % factor == phase) for phase in range(factor)]
    return [(k, w / total[k % factor]) for k, w in raw.items()]


def upsample_lanczos(grid: DataFrame, factor: int, height: Column, width: Column, value: str = "v") -> DataFrame:
    """Enlargement with the Lanczos kernel of three lobes, pixel centres aligned and edges repeated."""
    return upsample(grid, factor, height, width, lanczos_shares(factor), value)


def reduction_shares(factor: int, lobes: int = 3) -> tuple[int, list[float]]:
    """The first offset and the weights of the source pixels factor * target + offset in a reduction with the windowed sinc; they add up to 1."""
    x = {k: pi * (k + 0.5 - factor / 2) / factor for k in range(-lobes * factor, (lobes + 1) * factor)}
    raw = {k: 1.0 if abs(v) < 1e-12 else lobes * sin(v) * sin(v / lobes) / (v * v) for k, v in x.items() if abs(v) < lobes * pi}
    return min(raw), [w / sum(raw.values()) for _, w in sorted(raw.items())]


def reduce_lanczos(grid: DataFrame, factor: int, height: Column, width: Column, origin: tuple[int, int] = (0, 0), value: str = "v") -> DataFrame:
    """Reduction with the Lanczos kernel of three lobes, edges repeated; its rows and columns are those of the whole plane, divided by the factor.

    origin: the plane's row and column of the grid's first pixel. Shares are added up with partial aggregation, so blocks need no margins.
    """
    held = keys(grid)
    least, weights = reduction_shares(factor)
    most, reach = least + len(weights) - 1, max(-least, least + len(weights) - 1)

    def spread(df: DataFrame, axis: str, first: int, size: Column) -> DataFrame:
        other, at = "col" if axis == "row" else "row", F.col(axis) + first
        low, high = F.lit(first).cast("bigint"), first + size - 1
        before = F.when(at == low, F.sequence(low - reach, low)).otherwise(F.array(at))
        after = F.when(at == high, F.sequence(high, high + reach)).otherwise(F.array(at))
        moved = df.select(*held, other, value, low.alias("_low"), high.alias("_high"), F.explode(F.array_distinct(F.concat(before, after))).alias("_at"))
        to = F.sequence(F.ceil((F.col("_at") - most) / factor), F.floor((F.col("_at") - least) / factor))
        sent = moved.select(*held, other, value, "_low", "_high", "_at", F.explode(to).alias(axis)).where(F.col(axis).between(F.floor(F.col("_low") / factor), F.floor(F.col("_high") / factor)))
        share = F.get(F.lit(weights), (F.col("_at") - factor * F.col(axis) - least).cast("int"))
        return sent.groupBy(*held, other, axis).agg(F.sum(F.col(value) * share).alias(value))

    across = spread(grid.select(*held, F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), value), "col", origin[1], width)
    return spread(across, "row", origin[0], height)


def crop(grid: DataFrame, inside: Column) -> DataFrame:
    """Pixels for which a predicate holds; of a raster without any, all."""
    if held := keys(grid):
        some = grid.groupBy(*held).agg(F.coalesce(F.max(inside), F.lit(False)).alias("_some"))
        return grid.join(some, held).where(inside | ~F.col("_some")).select(grid.columns)
    kept = grid.where(inside)
    none_left = kept.limit(1).agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(True).alias("none"))
    whole = grid.join(F.broadcast(none_left))  # one row or none
    return kept.unionByName(whole.select(grid.columns))


def crop_to_ring(grid: DataFrame, x: Column, y: Column, ring: Column) -> DataFrame:
    """Pixels whose centre (x, y) lies in a closed ring, by its bounds first; of a raster without any, all."""
    west, south, east, north = (F.get(bounds(ring), k) for k in range(4))
    return crop(grid, x.between(west, east) & y.between(south, north) & contains(ring, x, y))


def align(base: DataFrame, **others: DataFrame) -> DataFrame:
    """Bands on the grid of the first one; the class band, which may be missing, becomes 0."""
    joined, held = base, keys(base)
    for name, band in others.items():
        how = "left" if name == "scl" else "inner"
        joined = joined.join(band.select(*held, "row", "col", F.col(band.columns[-1]).alias(name)), [*held, "row", "col"], how)
    return joined.withColumn("scl", F.coalesce("scl", F.lit(0))) if "scl" in others else joined


def with_margin(grid: DataFrame, size: int, pad: int) -> DataFrame:
    """Overlapping chunks: (cy, cx) for each chunk a pixel takes part in, and whether it is the pixel's own.

    A pixel inside a chunk goes to one, and to at most 9 as long as pad <= size.
    """
    near = [F.array_distinct(F.filter(F.array(*(F.floor((F.col(axis) + d) / size).cast("bigint") for d in (-pad, 0, pad))), lambda c: c >= 0)) for axis in ("row", "col")]
    placed = grid.withColumn("cy", F.explode(near[0])).withColumn("cx", F.explode(near[1]))
    return placed.withColumn("own", (F.col("cy") == F.floor(F.col("row") / size)) & (F.col("cx") == F.floor(F.col("col") / size)))


def world(row: Column, col: Column, affine: dict[str, float]) -> tuple[Column, Column]:
    """Coordinates of a pixel's centre."""
    return F.lit(affine["c"]) + affine["a"] * (col + 0.5), F.lit(affine["f"]) + affine["e"] * (row + 0.5)


def rescaled(affine: dict[str, float], scale: int) -> dict[str, float]:
    """The transform of an enlarged raster."""
    return affine | {"a": affine["a"] / scale, "e": affine["e"] / scale}
