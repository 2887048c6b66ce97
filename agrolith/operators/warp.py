"""Rasters from one reference system to another, by inverse mapping.

Each target pixel's centre is mapped back to the source, by column expressions; it goes to the source chunk that holds it, an equi-join by
(raster, chunk), and gets its value from the chunk's array. Chunks have a margin of a pixel, so no pixel needs a second one, and they are the
smaller the more a raster is enlarged: a task's group is bounded in source and target pixels.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import hypot

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolith.functions import geometry as geo
from agrolith.operators.grid import keys, with_margin
from agrolith.operators.scratch import ship

#: Largest side of a chunk, and of its image in the target.
CHUNK, IMAGE = 256, 512


@dataclass(frozen=True)
class Georef:
    """Where a raster lies: pixel (row, col) has its upper left corner at (c + a * col, f + e * row)."""

    a: float
    c: float
    e: float
    f: float
    height: int
    width: int
    epsg: int = 4326

    def x(self, col: Column) -> Column:
        return F.lit(self.c) + col * self.a

    def y(self, row: Column) -> Column:
        return F.lit(self.f) + row * self.e

    def affine(self) -> dict[str, float]:
        return {"a": self.a, "c": self.c, "e": self.e, "f": self.f}


def mapped(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """A point from one reference system to another."""
    return (x, y) if source == target else geo.from_lonlat(target, *geo.to_lonlat(source, x, y))


def default_target(spark: SparkSession, source: Georef, epsg: int, steps: int = 64) -> Georef:
    """The grid that covers the source's outline, with square pixels, as many along the diagonal as the source has."""
    along = F.col("id") % (steps + 1) / steps
    side = F.expr(f"id div {steps + 1}")
    col = F.when(side < 2, along * source.width).when(side == 2, 0.0).otherwise(float(source.width))
    row = F.when(side == 0, 0.0).when(side == 1, float(source.height)).otherwise(along * source.height)
    x, y = mapped(source.x(col), source.y(row), source.epsg, epsg)
    west, south, east, north = spark.range(4 * (steps + 1)).select(x.alias("x"), y.alias("y")).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    size = hypot(east - west, north - south) / hypot(source.width, source.height)
    return Georef(size, west, -size, north, max(1, round((north - south) / size)), max(1, round((east - west) / size)), epsg)


def _targets(grid: DataFrame, source: Georef, target: Georef) -> DataFrame:
    """(row, col, u, v): the target pixels whose centre lies in the source, with its place there in source columns and rows."""
    held = keys(grid)
    base = grid.select(*held).distinct() if held else grid.sparkSession.range(1).select()
    rows = base.select(*held, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(target.height - 1).cast("bigint"))).alias("row")).repartition(*held, "row")
    pixels = rows.select(*held, "row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(target.width - 1).cast("bigint"))).alias("col"))
    x, y = mapped(target.x(F.col("col") + 0.5), target.y(F.col("row") + 0.5), target.epsg, source.epsg)
    at = pixels.select(*held, "row", "col", ((x - source.c) / source.a - 0.5).alias("u"), ((y - source.f) / source.e - 0.5).alias("v"))
    return at.where((F.col("u") >= -0.5) & (F.col("u") < source.width - 0.5) & (F.col("v") >= -0.5) & (F.col("v") < source.height - 0.5))


def warp(grid: DataFrame, source: Georef, target: Georef, bands: list[str], classes: tuple[str, ...] = ()) -> DataFrame:
    """(row, col, bands, classes) of the target's pixels whose centre lies in the source: bands bilinear, class bands from the nearest pixel.

    Beyond the source's edge, and where a pixel is absent or null, the weights go to the pixels that are there; without any the value is null.
    """
    held = [k for k in keys(grid) if k not in ("height", "width")]
    grid = grid.select(*held, "row", "col", *bands, *classes)
    enlarged = max(1.0, (target.height * target.width / (source.height * source.width)) ** 0.5)
    size = max(8, min(CHUNK, int(IMAGE / enlarged)))
    u, v = (F.greatest(F.floor(c), F.lit(0)) for c in ("u", "v"))
    wanted = _targets(grid, source, target).withColumn("cy", F.floor(v / size)).withColumn("cx", F.floor(u / size))
    chunks = with_margin(grid, size, 1).drop("own")
    by = [*held, "cy", "cx"]
    kinds = {f.name: f.dataType.simpleString() for f in grid.schema}

    def run(there: pa.Table, own: pa.Table) -> pa.Table:
        if not there.num_rows:  # a source chunk that no target pixel falls in
            return pa.table({c: pa.array([], pa.float64() if c in (*bands, *classes) else there[c].type) for c in (*held, "row", "col", *bands, *classes)})
        top, left = there["cy"][0].as_py() * size - 1, there["cx"][0].as_py() * size - 1
        u, v = there["u"].to_numpy() - left, there["v"].to_numpy() - top
        place = own["row"].to_numpy() - top, own["col"].to_numpy() - left
        out = {c: there[c] for c in (*held, "row", "col")}
        for name in (*bands, *classes):
            block = np.full((size + 3, size + 3), np.nan)
            block[place] = own[name].cast(pa.float64()).to_numpy(zero_copy_only=False)
            if name in classes:
                # A centre just beyond the last row or column is nearest to it.
                near = block[np.clip(np.floor(v + 0.5).astype(int), 0, source.height - 1 - top), np.clip(np.floor(u + 0.5).astype(int), 0, source.width - 1 - left)]
                out[name] = pa.array(near, mask=np.isnan(near))
                continue
            r, c = np.floor(v).astype(int), np.floor(u).astype(int)
            total, weight = np.zeros(len(u)), np.zeros(len(u))
            for dr, wr in ((0, 1 - (v - r)), (1, v - r)):
                for dc, wc in ((0, 1 - (u - c)), (1, u - c)):
                    x, w = block[r + dr, c + dc], wr * wc
                    known = ~np.isnan(x)
                    total[known] += (w * x)[known]
                    weight[known] += w[known]
            some = weight > 1e-12
            out[name] = pa.array(np.divide(total, weight, out=np.zeros(len(u)), where=some), mask=~some)
        return pa.table(out)

    ship(grid.sparkSession)
    fields = ", ".join([*(f"{c} {kinds[c]}" for c in held), "row bigint, col bigint", *(f"{b} double" for b in (*bands, *classes))])
    return wanted.groupBy(*by).cogroup(chunks.groupBy(*by)).applyInArrow(run, fields)
