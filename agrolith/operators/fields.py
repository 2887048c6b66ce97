"""Field extraction: from an index raster to field polygons with statistics, confidence and management zones.

pixels: (row, col, ndvi, valid), with raster_id if the table holds several rasters. The steps are those of the other operators: smoothing and
gradient, interior and seeds, flooding, region size, outlines, area, simplification of shared borders, cut by roads, pixels inside by ray
casting, statistics. Roads are cut out of the outlines, so a cut is as fine as the road.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrolith.functions import bandmath as bm
from agrolith.functions import geometry as geo
from agrolith.operators import overlay, segment, stencil, zonal
from agrolith.operators.grid import keys
from agrolith.operators.scratch import written

#: Metres of a degree that lengths and areas go by.
METRES = 111_000


# The limits of the extraction.
@dataclass(frozen=True)
class Rules:
    sigma: float = 1.5
    most_gradient: float = 0.05
    seed_distance: float = 5.0
    least_pixels: int = 100
    least_ha: float = 0.5
    most_ha: float = 500.0
    tolerance_m: float = 3.0
    road_m: float = 5.0
    zones: int = 3
    area_first: bool = True


@dataclass(frozen=True)
class Frame:
    """Where a raster lies: the corner (west, north) and a pixel's size in degrees; height and width in pixels."""

    west: float
    north: float
    dx: float
    dy: float
    height: Column
    width: Column

    def x(self, col: Column) -> Column:
        return F.lit(self.west) + col * self.dx

    def y(self, row: Column) -> Column:
        return F.lit(self.north) - row * self.dy


def interior(pixels: DataFrame, frame: Frame, rules: Rules) -> DataFrame:
    """(row, col, gradient, valid, inside): the smoothed index's gradient, and whether a valid pixel lies inside a field."""
    held = keys(pixels)
    smooth = stencil.gaussian(pixels.select(*held, "row", "col", F.col("ndvi").alias("v")), rules.sigma, frame.height, frame.width)
    edges = stencil.sobel(smooth).join(pixels.select(*held, "row", "col", "valid"), [*held, "row", "col"])
    return edges.select(*held, "row", "col", "gradient", "valid", ((F.col("gradient") < rules.most_gradient) & F.col("valid")).alias("inside"))


def seeds(marked: DataFrame, rules: Rules) -> DataFrame:
    """(row, col) of the pixels deep inside. marked: as interior gives it."""
    return segment.distance_seeds(segment.distances(marked.where("inside"), marked.where("not inside")), rules.seed_distance)


def regions(pixels: DataFrame, frame: Frame, rules: Rules) -> DataFrame:
    """(row, col, label): fields grown from seeds over the gradient; invalid pixels are a basin of their own that is no field."""
    held = keys(pixels)
    marked = written(interior(pixels, frame, rules))
    seeded = segment.components(seeds(marked, rules), frame.width)
    cost = marked.join(seeded, [*held, "row", "col"], "left").select(*held, "row", "col", F.col("gradient").alias("cost"), F.when(~F.col("valid"), -1).otherwise(F.col("label")).cast("bigint").alias("seed"))
    return segment.min_regions(segment.flood_raster(cost).where("label >= 0"), rules.least_pixels)


def polygons(labels: DataFrame, frame: Frame, rules: Rules) -> DataFrame:
    """(label, rings): outlines in coordinates, the outer ring first, of the regions whose area is within the limits.

    Borders that two regions share are simplified once. rules.area_first tells whether the limits hold before or after that.
    """
    by = [*keys(labels), "label"]
    limits = lambda area: bm.area_ha(area).between(rules.least_ha, rules.most_ha)
    if rules.area_first:
        kept = labels.groupBy(*by).count().where(limits(F.col("count") * (frame.dx * frame.dy))).select(*by)
        labels = labels.join(kept, by)
    ring = F.transform("ring", lambda p: F.struct(frame.x(p["x"]).alias("x"), frame.y(p["y"]).alias("y")))
    rings = segment.simplify_shared(labels.select(*by, "row", "col"), rules.tolerance_m / METRES, (frame.dx, frame.dy)).select(*by, ring.alias("ring"))
    ordered = F.array_sort(F.collect_list(F.struct((-geo.area(F.col("ring"))).alias("a"), "ring")))
    found = rings.groupBy(*by).agg(F.abs(F.sum(geo.signed_area(F.col("ring")))).alias("_area"), F.transform(ordered, lambda r: r["ring"]).alias("rings")).where(geo.valid_ring(F.get("rings", 0)))
    return written((found if rules.area_first else found.where(limits(F.col("_area")))).drop("_area"))


#: Parts of an outline that roads may leave.
MOST_PARTS = 1 << 12


def cut_outlines(outlines: DataFrame, roads: DataFrame, rules: Rules) -> DataFrame:
    """(label, rings): the outlines without what lies within rules.road_m of a road; each part has a label of its own, in the order of labels."""
    by = [*keys(outlines), "label"]
    cut = overlay.cut_by_roads(outlines.select(*by, "rings"), roads, rules.road_m / METRES, by)
    number = F.when(F.col("part") < MOST_PARTS, F.col("label") * MOST_PARTS + F.col("part")).otherwise(F.raise_error(F.lit("roads leave too many parts of an outline")).cast("bigint"))
    return cut.withColumn("label", number.cast("bigint")).drop("part")


def members(pixels: DataFrame, outlines: DataFrame, frame: Frame) -> DataFrame:
    """The pixels, columns as they were, with the label of each outline that their centre lies in."""
    return zonal.pixels_in_polygons(pixels, outlines, frame.west, frame.north, frame.dx, frame.dy, keys(pixels))


def features(pixels: DataFrame, outlines: DataFrame, frame: Frame, source: str, has_ndvi: bool) -> DataFrame:
    """(id, field_index, label, rings, area_ha, source, confidence, statistics) of each outline with a pixel in it, per raster in the order of labels."""
    held = keys(pixels)
    by = [*held, "label"]
    inside = written(members(pixels.select(*held, "row", "col", "ndvi"), outlines, frame))
    gradient = stencil.sobel(pixels.select(*held, "row", "col", F.col("ndvi").alias("v"))).select(*held, "row", "col", "gradient")
    ring = stencil.ring(inside.select(*held, F.col("label").alias("zone"), "row", "col"), 2, frame.height, frame.width)
    edge = zonal.edge_strength(ring, gradient, "zone").withColumnRenamed("zone", "label")
    found = zonal.statistics(inside, "label", "ndvi").join(edge, by, "left").join(outlines, by)
    area = F.abs(F.aggregate("rings", F.lit(0.0), lambda s, r: s + geo.signed_area(r)))
    length = F.aggregate("rings", F.lit(0.0), lambda s, r: s + geo.perimeter(r))
    found = found.withColumn("edge", F.coalesce("edge", F.lit(0.0))).withColumn("area_ha", bm.area_ha(area)).withColumn("compactness", bm.compactness(area, length))
    found = found.withColumn("confidence", F.round(bm.confidence_v2(F.col("edge"), F.col("compactness"), F.col("std"), has_ndvi), 2))
    numbered = zonal.numbered(found.withColumn("_bucket", F.floor(F.col("label") / (1 << 20))), "label", "_bucket").drop("_bucket")
    return numbered.withColumn("id", geo.feature_id(geo.wkt(F.get("rings", 0)))).withColumn("source", F.lit(source))


def zones(pixels: DataFrame, fields: DataFrame, frame: Frame, rules: Rules) -> DataFrame:
    """(id, parent_field, zone_id, zone_class, mean_ndvi, ring): a feature for each outline of each field's zones. fields: as features gives them."""
    held = keys(pixels)
    fields = written(fields.select(*held, "label", "id", "rings"))
    whole = members(pixels.select(*held, "row", "col", "ndvi"), fields.select(*held, "label", "rings"), frame)
    field = F.concat_ws(":", *(F.col(c).cast("string") for c in (*held[:1], "label")))
    zoned = written(zonal.kmeans_zones(whole.withColumn("field", field), "field", "ndvi", rules.zones))
    means = zonal.zone_means(zoned, "field", "ndvi")
    parts = segment.components(zoned.select(*held, "row", "col", F.concat_ws("/", "field", "zone_id").alias("part")), frame.width, within="part")
    parts = written(parts.join(zoned.select(*held, "row", "col", field.alias("field"), "zone_id"), [*held, "row", "col"]))
    of = parts.select(*held, "label", "field", "zone_id").distinct()
    outlines = segment.polygonize(parts.select(*held, "label", "row", "col")).where(geo.signed_area(F.col("ring")) != 0).join(of, [*held, "label"])
    parents = fields.select(F.col("id").alias("parent_field"), field.alias("field"))
    named = outlines.join(means, ["field", "zone_id"]).join(parents, "field")
    ring = F.transform("ring", lambda p: F.struct(frame.x(p["x"]).alias("x"), frame.y(p["y"]).alias("y")))
    return named.select(
        *held, F.concat("parent_field", F.lit("_z"), F.col("zone_id").cast("string")).alias("id"), "parent_field", "zone_id", geo.zone_name(F.col("zone_id"), rules.zones).alias("zone_class"), F.col("mean").alias("mean_ndvi"), "ring_no", ring.alias("ring")
    )


def extract(pixels: DataFrame, frame: Frame, roads: DataFrame | None = None, rules: Rules = Rules(), source: str = "ndvi_bands") -> DataFrame:
    """Fields of each raster, as features gives them."""
    pixels = written(pixels)
    outlines = polygons(written(regions(pixels, frame, rules)), frame, rules)
    if roads is not None:
        outlines = written(cut_outlines(outlines, roads, rules))
    return features(pixels, outlines, frame, source, source == "ndvi_bands")
