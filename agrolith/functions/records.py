"""Records of requests, metadata and clients as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What requests may ask for, and limits.
SCALES, SR_MODELS, ENHANCE_MODELS = (2, 3, 4), ("edsr", "espcn", "lapsrn"), ("realesrgan_x4", "realesrgan_anime")
UPLOAD_LIMIT = 50 * 1024 * 1024
ROAD_CLASSES = "primary|secondary|tertiary|unclassified|residential|service|track|path"
GOOD_ENDS, BAD_ENDS = ("completed", "fulfilled", "delivered"), ("failed", "cancelled", "error")

#: The parts of a raster description (JSON of an information tool) that count.
INFO = (
    "size array<int>, coordinateSystem struct<wkt:string>, cornerCoordinates struct<upperLeft:array<double>,lowerRight:array<double>>, "
    "wgs84Extent struct<coordinates:array<array<array<double>>>>, bands array<struct<type:string>>"
)


def request_status(scale: Column, model: Column, exists: Column) -> Column:
    """HTTP status of an up-scaling request: 400 for what can't be asked for, 404 for a missing input, else 200."""
    return F.when(~scale.isin(*SCALES) | ~model.isin(*SR_MODELS), 400).when(~exists, 404).otherwise(200)


def upload_status(kind: Column, size: Column) -> Column:
    """415 for what isn't an image, 413 beyond the limit, else 200."""
    return F.when(~kind.startswith("image/"), 415).when(size > UPLOAD_LIMIT, 413).otherwise(200)


def order_end(status: Column) -> Column:
    """good, bad or open, whatever the case of letters."""
    low = F.lower(status)
    return F.when(low.isin(*GOOD_ENDS), "good").when(low.isin(*BAD_ENDS), "bad").otherwise("open")


def raster_info(json: Column) -> Column:
    """struct<epsg, width, height, bands, dtype, west, south, east, north> from a raster's description."""
    from agrolith.functions.text import epsg_code

    i = F.from_json(json, INFO)
    ring = F.get(i["wgs84Extent"]["coordinates"], 0)
    xs, ys = F.transform(ring, lambda p: F.get(p, 0)), F.transform(ring, lambda p: F.get(p, 1))
    return F.struct(
        epsg_code(i["coordinateSystem"]["wkt"]).alias("epsg"), F.get(i["size"], 0).alias("width"), F.get(i["size"], 1).alias("height"), F.size(i["bands"]).alias("bands"), F.get(i["bands"], 0)["type"].alias("dtype"),
        F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"),
    )


def parsed_date(text: Column, otherwise: Column) -> Column:
    """A timestamp in UTC from ISO text with Z or an offset; `otherwise` if it is none."""
    return F.coalesce(F.try_to_timestamp(text), otherwise)


def is_road(highway: Column, points: Column) -> Column:
    """Ways of the road classes, links of them included, with two points at least."""
    return highway.rlike(ROAD_CLASSES) & (F.size(points) >= 2)


def colour_of(kind: Column) -> Column:
    return F.when(kind == "field", "#22c55e").when(kind == "zone", "#f59e0b").otherwise("#3b82f6")


def tile_source(wow: Column, original: Column, default: Column) -> Column:
    """The best tile layer there is."""
    return F.coalesce(wow, original, default)


def zoom_range(least: Column, most: Column, over: int = 22) -> Column:
    """struct<minzoom, maxzoom, overzoom> with defaults 10 and 18."""
    return F.struct(F.coalesce(least, F.lit(10)).alias("minzoom"), F.coalesce(most, F.lit(18)).alias("maxzoom"), F.greatest(F.lit(over), F.coalesce(most, F.lit(18))).alias("overzoom"))


def corner_pairs(bounds: Column) -> Column:
    """[[south, west], [north, east]] from [west, south, east, north]."""
    return F.array(F.array(F.get(bounds, 1), F.get(bounds, 0)), F.array(F.get(bounds, 3), F.get(bounds, 2)))


def serial_read(qr: Column, first: Column, first_confidence: Column, second: Column) -> Column:
    """struct<serial, by>: the code if there is one, else a good first reading, else the reading of the enhanced image, else the first anyway."""
    from agrolith.functions.text import needs_retry

    good = ~needs_retry(first, first_confidence)
    return F.struct(
        F.coalesce(qr, F.when(good, first), second, first).alias("serial"),
        F.when(qr.isNotNull(), "code").when(good, "text").when(second.isNotNull(), "enhanced").when(first.isNotNull(), "low confidence").otherwise("none").alias("by"),
    )


def word_confidence(words: Column, candidate: Column) -> Column:
    """Mean confidence of the words array<struct<text, confidence>> that, in capitals, hold the candidate or lie in it."""
    near = F.filter(words, lambda w: F.contains(candidate, F.upper(w["text"])) | F.contains(F.upper(w["text"]), candidate))
    return F.when(F.size(near) > 0, F.aggregate(near, F.lit(0.0), lambda s, w: s + w["confidence"]) / F.size(near))


def coordinates_text(lat: Column, lon: Column) -> Column:
    side = lambda x, a, b: F.concat(F.format_string("%.6f°", F.abs(x)), F.when(x < 0, b).otherwise(a))
    return F.concat_ws(", ", side(lat, "N", "S"), side(lon, "E", "W"))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def long_date(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy")


def resolution(metres: Column, scale: Column) -> Column:
    """Metres of a pixel after enlargement."""
    return metres / scale


def token_valid_until(issued: Column, seconds: Column, spare: int = 30) -> Column:
    return issued + F.make_dt_interval(secs=(seconds - spare).cast("decimal(18,6)"))
