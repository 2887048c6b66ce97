"""Statistics of zones, and management zones by value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from agrolith.functions.geometry import bounds, contains
from agrolith.operators.grid import keys
from agrolith.operators.scratch import ship


def statistics(pixels: DataFrame, zone: str, value: str) -> DataFrame:
    """(zone, n, mean, std, p10, p90, range) with population deviation and interpolated percentiles, raster by raster."""
    p10, p90 = F.percentile(value, 0.1), F.percentile(value, 0.9)
    return pixels.groupBy(*(c for c in keys(pixels) if c != zone), zone).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), p10.alias("p10"), p90.alias("p90"), (p90 - p10).alias("range")
    )


def edge_strength(field_ring: DataFrame, gradients: DataFrame, zone: str) -> DataFrame:
    """(zone, edge): mean gradient on a zone's ring of pixels, 0 where it has none. field_ring: (zone, row, col)."""
    held = keys(gradients)
    return field_ring.join(gradients, [*held, "row", "col"], "left").groupBy(*held, zone).agg(F.coalesce(F.avg("gradient"), F.lit(0.0)).alias("edge"))


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """Points joined with the boxes (west, south, east, north) that hold them, by cells of a grid: an equi-join, not a product."""

    def cells(low: str, high: str) -> object:
        return F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))

    wide = boxes.withColumn("_cx", F.explode(cells("west", "east"))).withColumn("_cy", F.explode(cells("south", "north")))
    placed = points.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    inside = F.col("x").between(F.col("west"), F.col("east")) & F.col("y").between(F.col("south"), F.col("north"))
    return placed.join(wide, ["_cx", "_cy"]).where(inside).drop("_cx", "_cy")


def points_in_polygons(points: DataFrame, outlines: DataFrame, cell: float, by: list[str] = ()) -> DataFrame:
    """Points (x, y) joined with the polygons that hold them, by ray casting inside cells of a grid that polygons' bounds touch.

    outlines: (..., rings array<array<struct<x, y>>>), closed; a point in a hole isn't inside. by: columns that both have and that must be equal.
    """
    box = bounds(F.flatten("rings"))
    span = lambda low, high: F.sequence(F.floor(F.get(box, low) / cell), F.floor(F.get(box, high) / cell))
    wide = outlines.withColumn("_cx", F.explode(span(0, 2))).withColumn("_cy", F.explode(span(1, 3)))
    placed = points.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    inside = F.aggregate("rings", F.lit(False), lambda odd, r: odd != contains(r, F.col("x"), F.col("y")))
    # No broadcast: outlines are small as files, but there is a row of them for each cell.
    return placed.join(wide.hint("merge"), [*by, "_cx", "_cy"]).where(inside).drop("_cx", "_cy")


def _runs(rings: pa.ListArray, west: float, north: float, dx: float, dy: float) -> tuple[np.ndarray, ...]:
    """Runs of pixels whose centres lie in outlines, in the numbers of contains: the outline's place, the row, the first column and the last."""
    loops = rings.flatten()
    points, sizes = loops.flatten(), loops.value_lengths().to_numpy()
    x, y = (pc.struct_field(points, c).to_numpy(zero_copy_only=False) for c in "xy")
    loop = np.repeat(np.arange(len(sizes)), sizes)
    of = np.repeat(np.arange(len(rings)), rings.value_lengths().fill_null(0).to_numpy())
    a = np.flatnonzero((loop[1:] == loop[:-1]) & (y[1:] != y[:-1]))
    # The rows that an edge may meet, one to spare at both ends, and of them those that it does.
    low, high = np.minimum(y[a], y[a + 1]), np.maximum(y[a], y[a + 1])
    first, last = (np.floor((north - v) / dy - 0.5).astype(np.int64) for v in (high, low))
    many = last - first + 3
    a, row = np.repeat(a, many), np.repeat(first - 1, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = north - (row + 0.5) * dy
    met = (y[a] > at) != (y[a + 1] > at)
    a, row, at = a[met], row[met], at[met]
    cut, of = (x[a + 1] - x[a]) * (at - y[a]) / (y[a + 1] - y[a]) + x[a], of[loop[a]]
    order = np.lexsort((cut, row, of))
    of, row, cut = of[order][::2], row[order][::2], cut[order]

    def least(v: np.ndarray) -> np.ndarray:
        """The least column whose centre isn't before v."""
        c = np.ceil((v - west) / dx - 0.5).astype(np.int64) - 1
        for _ in range(2):
            c += west + (c + 0.5) * dx < v
        return c

    start, stop = least(cut[::2]), least(cut[1::2]) - 1
    some = start <= stop
    return of[some], row[some], start[some], stop[some]


def pixels_in_polygons(pixels: DataFrame, outlines: DataFrame, west: float, north: float, dx: float, dy: float, by: list[str] = ()) -> DataFrame:
    """Pixels (row, col) of a frame joined with the polygons that hold their centres, as points_in_polygons finds them.

    A polygon is cut into runs of pixels row by row, so the work is that of its edges' rows and of its pixels, and pixels are joined by row and col.
    """
    kept = [c for c in outlines.columns if c != "rings"]
    schema = T.StructType([*(outlines.schema[c] for c in kept), *(T.StructField(c, T.LongType()) for c in ("row", "_first", "_last"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                of, *found = _runs(part.column("rings"), west, north, dx, dy)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(of)) for c in kept), *(pa.array(v) for v in found)], schema=to_arrow_schema(schema))

    spark = outlines.sparkSession
    ship(spark)
    spread = outlines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *kept)  # few bytes with much work
    runs = spread.select(*kept, "rings").mapInArrow(run, schema)
    runs = runs.select(*kept, "row", F.explode(F.sequence("_first", "_last")).alias("col"))
    return pixels.join(runs.hint("merge"), [*by, "row", "col"])


def quantile_zones(pixels: DataFrame, zone: str, value: str, zones: int = 3) -> DataFrame:
    """Each pixel's class 1..zones by exact quantiles of its field's values."""
    cuts = pixels.groupBy(zone).agg(F.percentile(value, F.lit([k / zones for k in range(1, zones)])).alias("_cuts"))
    over = F.aggregate("_cuts", F.lit(1), lambda n, c: n + (F.col(value) > c).cast("int"))
    return pixels.join(cuts, zone).withColumn("zone_id", over).drop("_cuts")


def kmeans_zones(pixels: DataFrame, zone: str, value: str, zones: int = 3, bins: int = 4_096, turns: int = 100) -> DataFrame:
    """Each pixel's class 1..zones by one-dimensional k-means of its field, centres in rising order.

    Lloyd's iterations run on a histogram of `bins` bins with exact sums, so a field's size doesn't bound the task. Centres start at
    quantiles. Fields with fewer than 10 pixels a zone are left out.
    """
    kind = pixels.schema[zone].dataType.simpleString()
    ends = pixels.groupBy(zone).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n")).where(F.col("_n") >= 10 * zones).drop("_n")
    binned = pixels.join(ends, zone).withColumn("_bin", F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0) * bins)))
    table = binned.groupBy(zone, "_bin").agg(F.count(value).alias("_n"), F.sum(value).alias("_s"))

    def centres(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_bin")
        n, s = pdf["_n"].to_numpy(float), pdf["_s"].to_numpy(float)
        mean, share = s / n, (np.cumsum(n) - n / 2) / n.sum()
        c = np.interp([(k + 0.5) / zones for k in range(zones)], share, mean)
        for _ in range(turns):
            own = np.abs(mean[:, None] - c[None, :]).argmin(axis=1)
            new = np.array([s[own == k].sum() / n[own == k].sum() if (own == k).any() else c[k] for k in range(zones)])
            if np.allclose(new, c, rtol=0, atol=1e-12):
                break
            c = new
        return pd.DataFrame({zone: [pdf[zone].iloc[0]], "centres": [sorted(c.tolist())]})

    ship(pixels.sparkSession)
    found = table.groupBy(zone).applyInPandas(centres, f"{zone} {kind}, centres array<double>")
    gaps = F.transform("centres", lambda c: F.abs(F.col(value) - c))
    return pixels.join(found, zone).withColumn("zone_id", F.array_position(gaps, F.array_min(gaps)).cast("int")).drop("centres")


def zone_means(pixels: DataFrame, zone: str, value: str) -> DataFrame:
    """(zone, zone_id, n, mean) over whole classes."""
    return pixels.groupBy(zone, "zone_id").agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def numbered(features: DataFrame, key: str, bucket: str) -> DataFrame:
    """Features with a 1-based field_index in the order of (bucket, key), raster by raster: ranked within buckets, then moved by the buckets' counts.

    bucket is a column that rises with the order and divides it into bounded parts, such as a row of blocks.
    """
    held = keys(features)
    before = Window.partitionBy(*held).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = features.groupBy(*held, bucket).agg(F.count(F.lit(1)).alias("_n")).select(*held, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = features.withColumn("_rank", F.row_number().over(Window.partitionBy(*held, bucket).orderBy(key)))
    return ranked.join(starts, [*held, bucket]).withColumn("field_index", F.col("_start") + F.col("_rank")).drop("_start", "_rank")
