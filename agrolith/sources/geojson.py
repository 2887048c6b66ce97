"""GeoJSON in and out: areas of interest, features, catalogues of scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolith.functions.records import is_road

_GEOMETRY = "struct<type:string,coordinates:array<array<array<double>>>>"
AREA = f"struct<type:string,geometry:{_GEOMETRY},features:array<struct<geometry:{_GEOMETRY}>>,coordinates:array<array<array<double>>>>"


def area_ring(json: Column) -> Column:
    """The outer ring array<struct<x, y>> of the first feature, the feature or the geometry that a text holds; null if it holds none."""
    parsed = F.from_json(json, AREA)
    coordinates = F.coalesce(F.get(parsed["features"], 0)["geometry"]["coordinates"], parsed["geometry"]["coordinates"], parsed["coordinates"])
    return F.transform(F.get(coordinates, 0), lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))


#: What a text of an area can be.
AREA_TYPES = ("FeatureCollection", "Feature", "Polygon", "MultiPolygon")
_NESTED = "array<array<array<array<double>>>>"


def checked_ring(json: Column) -> Column:
    """The outer ring of a text's area, of a MultiPolygon's first part; an error for an unknown type, an empty collection or no ring."""
    kind = F.get_json_object(json, "$.type")
    first = F.coalesce(F.get_json_object(json, "$.features[0].geometry"), F.get_json_object(json, "$.geometry"), json)
    parts = F.from_json(F.get_json_object(first, "$.coordinates"), _NESTED)
    multi = F.transform(F.get(F.get(parts, 0), 0), lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
    ring = F.when(F.get_json_object(first, "$.type") == "MultiPolygon", multi).otherwise(area_ring(json))
    empty = (kind == "FeatureCollection") & F.get_json_object(json, "$.features[0]").isNull()
    return (
        F.when(kind.isNull() | ~kind.isin(*AREA_TYPES), F.raise_error(F.concat(F.lit("not an area: "), F.coalesce(kind, F.lit("no type")))))
        .when(empty, F.raise_error(F.lit("an empty collection")))
        .when(ring.isNull(), F.raise_error(F.lit("an area without a ring")))
        .otherwise(ring)
    )


_WAY = "array<struct<type:string,geometry:array<struct<lat:double,lon:double>>,tags:map<string,string>>>"


def ways(answers: DataFrame, column: str = "value") -> DataFrame:
    """(highway, line) of the roads in answers of a map server, one JSON text a row: ways of a road class with two points at least.

    Texts that can't be read have none.
    """
    each = answers.select(F.explode(F.from_json(F.get_json_object(F.col(column), "$.elements"), _WAY)).alias("e"))
    line = F.transform("e.geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    kept = each.where((F.col("e.type") == "way") & is_road(F.try_element_at("e.tags", F.lit("highway")), F.col("e.geometry")))
    return kept.select(F.try_element_at("e.tags", F.lit("highway")).alias("highway"), line.alias("line"))


def segments(roads: DataFrame) -> DataFrame:
    """(ax, ay, bx, by) of lines' neighbouring points."""
    pairs = F.zip_with(F.slice("line", 1, F.size("line") - 1), F.slice("line", 2, F.size("line") - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    return roads.select(F.inline(pairs))


def read_area(spark: SparkSession, path: str) -> DataFrame:
    """(ring) of each file of a path; an error for a file that holds no area."""
    return spark.read.text(path, wholetext=True).select(checked_ring(F.col("value")).alias("ring"))


def feature(identity: Column, ring: Column, properties: Column) -> Column:
    """GeoJSON text of a polygon feature."""
    coordinates = F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), identity.alias("id"), properties.alias("properties"), geometry.alias("geometry")))


def write_features(features: DataFrame, path: str, column: str = "feature") -> None:
    """One feature a line, in as many files as there are partitions."""
    features.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
