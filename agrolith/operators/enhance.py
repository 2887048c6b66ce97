"""Image enhancement: local contrast, up-scaling by chunks with a margin, and the pluggable up-scaler."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolith.functions import bandmath as bm
from agrolith.operators.grid import keys, with_margin
from agrolith.operators.scratch import ship, written
from agrolith.operators.stencil import unsharp

Upscaler = Callable[[np.ndarray, int], np.ndarray]

#: The models that a request can name. Weights are not part of this package.
MODELS = [("realesrgan_x4", 4, 23), ("realesrgan_anime", 4, 6), ("bilinear", 4, 0)]


def clahe(grid: DataFrame, height: Column, width: Column, tiles: int = 8, clip: float = 2.5, value: str = "v") -> DataFrame:
    """Contrast-limited adaptive histogram equalisation of 0..255 integers.

    Each of tiles x tiles parts has a histogram, cut at `clip` times its mean height with the excess dealt out evenly; its running sum is
    a table of new values. A pixel blends the tables of the four nearest parts. Tables have 256 rows for each part.
    """
    held, part = keys(grid), ["ty", "tx"]
    tile_h, tile_w = F.ceil(height / tiles), F.ceil(width / tiles)
    fy, fx = (F.col("row") + 0.5) / tile_h - 0.5, (F.col("col") + 0.5) / tile_w - 0.5
    corners = F.array(*(F.struct((F.floor(fy) + i).alias("y"), (F.floor(fx) + j).alias("x"), (F.abs(1 - i - (fy - F.floor(fy))) * F.abs(1 - j - (fx - F.floor(fx)))).alias("w")) for i in (0, 1) for j in (0, 1)))
    last_y, last_x = F.ceil(height / tile_h) - 1, F.ceil(width / tile_w) - 1
    placed = grid.select(*held, "row", "col", F.col(value).cast("int").alias("g"), F.floor(F.col("row") / tile_h).alias("ty"), F.floor(F.col("col") / tile_w).alias("tx"))
    counts = placed.groupBy(*held, *part, "g").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(*held, *part).agg(F.sum("n").alias("all"))
    full = sizes.select(*held, *part, "all", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("g")).join(counts, [*held, *part, "g"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    limit = F.greatest(F.lit(1.0), clip * F.col("all") / 256)
    own = Window.partitionBy(*held, *part)
    cut = full.withColumn("spare", F.sum(F.greatest(F.col("n") - limit, F.lit(0.0))).over(own) / 256).withColumn("h", F.least(F.col("n").cast("double"), limit) + F.col("spare"))
    table = cut.select(*held, *part, "g", F.least(F.lit(255.0), F.sum("h").over(own.orderBy("g")) * 255 / F.col("all")).alias("new"))
    table = table.groupBy(*held, *part).agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "new"))), lambda x: x["new"]).alias("new"))
    table = table if held else F.broadcast(table)  # one raster has tiles ** 2 parts, each an array of 256
    found = placed.select(*held, "row", "col", "g", corners.alias("c"), last_y.alias("last_y"), last_x.alias("last_x"))
    for k in range(4):
        at = {"ty": F.least(F.greatest(F.col("c")[k]["y"], F.lit(0)), "last_y"), "tx": F.least(F.greatest(F.col("c")[k]["x"], F.lit(0)), "last_x")}
        found = found.withColumns(at).join(table.withColumnRenamed("new", f"new_{k}"), [*held, *part])
    total = sum(F.col("c")[k]["w"] * F.get(f"new_{k}", F.col("g")) for k in range(4))
    return found.select(*held, "row", "col", F.round(total).alias(value)).where(F.col(value).isNotNull())


def bilinear(values: np.ndarray, scale: int) -> np.ndarray:
    """The default up-scaler: bilinear with aligned pixel centres."""

    def along(x: np.ndarray) -> np.ndarray:
        at = np.clip((np.arange(x.shape[0] * scale) + 0.5) / scale - 0.5, 0, x.shape[0] - 1)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, x.shape[0] - 1)
        part = (at - low)[:, None]
        return x[low] * (1 - part) + x[high] * part

    return along(along(values).T).T


def convolve3(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """3 x 3 convolution of (channels, h, w) with (out, channels, 3, 3) and zeros around."""
    padded = np.pad(x, ((0, 0), (1, 1), (1, 1)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, (3, 3), axis=(1, 2))
    return np.einsum("chwij,ocij->ohw", windows, weight, optimize=True) + bias[:, None, None]


@dataclass
class ResidualDenseNet:
    """A residual-in-residual dense network for x4 up-scaling of (3, h, w) in 0..1, from given weights.

    weights: name -> array; first, then for each block b, dense unit u and layer k (1..5) "b.u.k", trunk, up1, up2, high, last, each
    with ".w" and ".b".
    """

    weights: dict[str, np.ndarray]
    blocks: int

    def _conv(self, name: str, x: np.ndarray) -> np.ndarray:
        return convolve3(x, self.weights[f"{name}.w"], self.weights[f"{name}.b"])

    @staticmethod
    def _leaky(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x, 0.2 * x)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        first = self._conv("first", x)
        body = first
        for b in range(self.blocks):
            inner = body
            for u in range(3):
                seen = [inner]
                for k in range(1, 5):
                    seen.append(self._leaky(self._conv(f"{b}.{u}.{k}", np.concatenate(seen))))
                inner = inner + 0.2 * self._conv(f"{b}.{u}.5", np.concatenate(seen))
            body = body + 0.2 * inner
        out = first + self._conv("trunk", body)
        for name in ("up1", "up2"):
            out = self._leaky(self._conv(name, out.repeat(2, axis=1).repeat(2, axis=2)))
        return np.clip(self._conv("last", self._leaky(self._conv("high", out))), 0, 1)


def upscale_tiled(grid: DataFrame, scale: int, size: int = 256, pad: int = 10, upscaler: Upscaler = bilinear, value: str = "v") -> DataFrame:
    """Enlarge by chunks: each chunk of size x size pixels is read with a margin of `pad`, up-scaled, and cut to its own pixels.

    A task holds one chunk. Edges of the raster have no margin.
    """
    held = keys(grid)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cy, cx = int(pdf["cy"].iloc[0]), int(pdf["cx"].iloc[0])
        top, left = int(pdf["row"].min()), int(pdf["col"].min())
        cells = np.zeros((int(pdf["row"].max()) - top + 1, int(pdf["col"].max()) - left + 1))
        cells[pdf["row"].to_numpy() - top, pdf["col"].to_numpy() - left] = pdf[value].to_numpy()
        large = upscaler(cells, scale)
        r, c = (x.ravel() for x in np.indices(large.shape))
        own = (r // scale + top >= cy * size) & (r // scale + top < (cy + 1) * size) & (c // scale + left >= cx * size) & (c // scale + left < (cx + 1) * size)
        same = {k: pdf[k].iloc[0] for k in held}
        return pd.DataFrame({"row": r[own] + top * scale, "col": c[own] + left * scale, value: large.ravel()[own]}).assign(**same)[[*held, "row", "col", value]]

    placed = with_margin(grid.select(*held, "row", "col", value), size, pad)
    by = [*held, "cy", "cx"]
    kept = placed.join(placed.where("own").select(*by).distinct(), by, "left_semi")
    schema = T.StructType([*(grid.schema[k] for k in held), *(T.StructField(c, T.LongType()) for c in ("row", "col")), T.StructField(value, T.DoubleType())])
    ship(kept.sparkSession)
    return kept.groupBy(*by).applyInPandas(run, schema)


def checked_models(requests: DataFrame, model: str = "model") -> DataFrame:
    """Requests with their model's scale and blocks; known is false for models that aren't registered."""
    table = requests.sparkSession.createDataFrame(MODELS, f"{model} string, scale int, blocks int")
    joined = requests.join(F.broadcast(table), model, "left")  # a row for each registered model
    return joined.withColumn("known", F.col("scale").isNotNull())


# How much each chain sharpens and boosts greens.
@dataclass(frozen=True)
class Style:
    amount: float
    sigma: float
    boost: float
    clip: float = 2.5
    tiles: int = 8


STYLES = {"wow": Style(0.4, 1.2, 1.2), "farm": Style(1.2, 1.5, 1.3)}


def by_band(rgb: DataFrame) -> DataFrame:
    """(zone, row, col, v): the bands r, g and b as zones of one relation, so that an operator handles all three at once."""
    bands = F.array(*(F.struct(F.lit(c).alias("zone"), F.col(c).cast("double").alias("v")) for c in "rgb"))
    return rgb.select(*keys(rgb), "row", "col", F.explode(bands).alias("x")).select(*keys(rgb), "x.zone", "row", "col", "x.v")


def of_bands(long: DataFrame) -> DataFrame:
    """(row, col, r, g, b) of by_band's rows."""
    held = [c for c in keys(long) if c != "zone"]
    return long.groupBy(*held, "row", "col").agg(*(F.max(F.when(F.col("zone") == c, F.col("v"))).alias(c) for c in "rgb"))


def enhance_colour(rgb: DataFrame, height: Column, width: Column, style: Style) -> DataFrame:
    """(row, col, r, g, b) of 8-bit colours: local contrast of the lightness, sharper bands, more saturated greens.

    What a step reads more than once is written first.
    """
    held = keys(rgb)
    lab = written(rgb.select(*held, "row", "col", bm.lab(F.col("r"), F.col("g"), F.col("b")).alias("x")))
    light = clahe(lab.select(*held, "row", "col", F.col("x.l").alias("v")), height, width, style.tiles, style.clip)
    even = lab.join(light, [*held, "row", "col"]).select(*held, "row", "col", bm.rgb_of_lab(F.col("v"), F.col("x.a"), F.col("x.b")).alias("c")).select(*held, "row", "col", "c.*")
    sharp = of_bands(unsharp(by_band(written(even)), style.amount, style.sigma, height, width).withColumn("v", F.floor(F.col("v") + 0.5)))
    x = sharp.select(*held, "row", "col", bm.hsv(F.col("r"), F.col("g"), F.col("b")).alias("x"))
    green = x.select(*held, "row", "col", bm.rgb_of_hsv(F.col("x.h"), F.floor(bm.boosted_saturation(F.col("x.h"), F.col("x.s"), style.boost)), F.col("x.v")).alias("c"))
    return green.select(*held, "row", "col", "c.*")


def super_resolve(rgb: DataFrame, height: Column, width: Column, style: Style | None, scale: int = 4, upscaler: Upscaler = bilinear, size: int = 256, pad: int = 10) -> DataFrame:
    """(row, col, r, g, b): 8-bit colours enlarged by chunks with a margin, rounded, then enhanced unless style is None."""
    large = of_bands(upscale_tiled(by_band(rgb), scale, size, pad, upscaler).withColumn("v", bm.clip(F.floor(F.col("v") + 0.5).cast("double"), 0.0, 255.0)))
    return enhance_colour(large, height * scale, width * scale, style) if style else large


def fallback_models(requests: DataFrame, available: DataFrame, model: str = "model") -> DataFrame:
    """Requests with the model to use: the one asked for if it is available, else the first available one of the same family, else the first of all.

    A family is what stands before the first underscore. available: (model), a row for each registered model that is there.
    """
    family = F.regexp_extract(model, "^[^_]*", 0)
    table = F.broadcast(available.select(model).distinct())  # registered models are few
    exact = table.select(model, F.col(model).alias("_exact"))
    by_family = F.broadcast(table.groupBy(family.alias("_family")).agg(F.min(model).alias("_near")))
    first = F.broadcast(table.agg(F.min(model).alias("_first")))
    joined = requests.join(exact, model, "left").withColumn("_family", family).join(by_family, "_family", "left").crossJoin(first)  # one row
    return joined.withColumn("used", F.coalesce("_exact", "_near", "_first")).drop("_exact", "_near", "_first", "_family")
