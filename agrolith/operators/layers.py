"""What a server answers from its tables: layers that are there, features as a collection, exports, synthetic rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolith.functions.geometry import closed


def availability(tiles: DataFrame, vectors: DataFrame, layers: list[str], kinds: list[str]) -> DataFrame:
    """One row: has_<layer> for tile layers with a tile, n_<kind> for kinds of vectors. tiles: (layer, ...); vectors: (kind, ...)."""
    some = tiles.agg(*(F.coalesce(F.max(F.col("layer") == x), F.lit(False)).alias(f"has_{x}") for x in layers))
    counts = vectors.agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds))
    one = tiles.sparkSession.range(1).select(F.lit(1).alias("_k"))
    return one.join(F.broadcast(some.withColumn("_k", F.lit(1))), "_k").join(F.broadcast(counts.withColumn("_k", F.lit(1))), "_k").drop("_k")  # one row each


def collection(features: DataFrame, group: str, order: str, properties: list[str]) -> DataFrame:
    """(group, n, features): GeoJSON text of each group's features in an order. A group is one document, so it must fit one row."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), feature.alias("f"))))
    made = features.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.transform(ordered, lambda x: x["f"]).alias("f"))
    return made.select(group, "n", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.col("f").alias("features"))).alias("features"))


def drawn_polygons(layers: DataFrame, first: str, second: str) -> DataFrame:
    """Polygons of the first layer that isn't empty, with closed rings and defaults for what is missing."""
    rings = F.when(F.size(first) > 0, F.col(first)).otherwise(F.coalesce(F.col(second), F.array().cast(layers.schema[second].dataType)))
    rest = [c for c in layers.columns if c not in (first, second)]
    return layers.select(*rest, F.posexplode(rings).alias("polygon", "ring")).withColumn("ring", closed(F.col("ring")))


def synthetic_raster(spark: SparkSession, size: int = 512) -> DataFrame:
    """(row, col, red, green, blue): greenish noise, the same on every run. Green is 80..179, the others 40..119.

    Noise is the middle of the square of a multiple of the pixel's number, by bands.
    """
    cell = spark.range(size * size).select(F.expr(f"id div {size}").alias("row"), (F.col("id") % size).alias("col"), "id")

    def noise(band: int, low: int, high: int) -> Column:
        x = ((F.col("id") * 3 + band + 1) * 40_503_019) % 2_147_483_647
        return (F.shiftright(x * x, 16) % (high - low) + low).cast("int")

    return cell.select("row", "col", noise(0, 40, 120).alias("red"), noise(1, 80, 180).alias("green"), noise(2, 40, 120).alias("blue"))


def rgb_of(bands: DataFrame, red: str, green: str | None = None, blue: str | None = None) -> DataFrame:
    """Three bands; a raster of one band has it three times."""
    return bands.select("row", "col", F.col(red).alias("red"), F.col(green or red).alias("green"), F.col(blue or red).alias("blue"))
