"""Per-pixel band arithmetic as column expressions. Divisions are guarded, so ANSI mode never raises."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scene classes that count as clear land: vegetation, bare soil, water, unclassified.
CLEAR_CLASSES = (4, 5, 6, 7)
#: Least size of a denominator in vegetation indices.
FLOOR = 0.01


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ndvi(nir: Column, red: Column) -> Column:
    """(nir - red) / (nir + red), 0 where the sum isn't positive."""
    return F.when(nir + red > 0, (nir - red) / (nir + red)).otherwise(0.0)


def ndvi_clipped(nir: Column, red: Column) -> Column:
    return clip(ndvi(nir, red), -1.0, 1.0)


def clear_land(scl: Column, red: Column, nir: Column) -> Column:
    """Pixels of a clear class with light in both bands."""
    return scl.isin(*CLEAR_CLASSES) & (red > 0) & (nir > 0)


def lit_pixels(red: Column, nir: Column) -> Column:
    return (red > 0) & (nir > 0)


def vari(red: Column, green: Column, blue: Column) -> Column:
    den = green + red - blue
    return (green - red) / F.when(F.abs(den) > FLOOR, den).otherwise(FLOOR)


def excess_green(red: Column, green: Column, blue: Column) -> Column:
    total = F.greatest(red + green + blue, F.lit(FLOOR))
    return 2 * green / total - red / total - blue / total


def vegetation_index(red: Column, green: Column, blue: Column) -> Column:
    """The visible-light index: six parts VARI, four parts doubled excess green, each and all clipped to [-1, 1]."""
    return clip(0.6 * clip(vari(red, green, blue), -1.0, 1.0) + 0.4 * clip(2 * excess_green(red, green, blue), -1.0, 1.0), -1.0, 1.0)


def brightness(red: Column, green: Column, blue: Column) -> Column:
    return (red + green + blue) / 3


def well_lit(value: Column) -> Column:
    return (value > 0.05) & (value < 0.95)


def reflectance(digital: Column, band: Column) -> Column:
    """Digital numbers over 10000, but for the class band."""
    return F.when(band == "scl", digital).otherwise(digital / 10000)


def stretch_uint8(value: Column, least: Column, most: Column) -> Column:
    """To 0..255, truncated, if the raster goes beyond 255; else the value cut to an integer. A flat raster becomes 0."""
    span = F.nullif(most - least, F.lit(0.0))
    return F.when(most > 255, F.floor(F.coalesce((value - least) / span, F.lit(0.0)) * 255)).otherwise(F.floor(value)).cast("int")


def unit_range(value: Column, most: Column, beyond: float = 1.5) -> Column:
    """0..255 values as 0..1, if the raster's largest value tells so."""
    return F.when(most > beyond, value / 255.0).otherwise(value)


def scaled_rgb(value: Column, most: Column) -> Column:
    """Values of deep rasters as a share of the largest, times 255."""
    return F.when(most > 255, value / most * 255).otherwise(value)


def gray(red: Column, green: Column, blue: Column) -> Column:
    return 0.299 * red + 0.587 * green + 0.114 * blue


def hsv(red: Column, green: Column, blue: Column) -> Column:
    """struct<h, s, v> of 8-bit colours: hue 0..179, saturation and value 0..255, halves rounded up."""
    high, low = F.greatest(red, green, blue), F.least(red, green, blue)
    span = high - low
    safe = F.when(span > 0, span).otherwise(1.0)
    turn = F.when(span <= 0, 0.0).when(high == red, 60 * (green - blue) / safe).when(high == green, 120 + 60 * (blue - red) / safe).otherwise(240 + 60 * (red - green) / safe)
    hue = F.floor(F.when(turn < 0, turn + 360).otherwise(turn) / 2 + 0.5)
    saturation = F.floor(F.when(high > 0, span * 255 / F.when(high > 0, high).otherwise(1.0)).otherwise(0.0) + 0.5)
    return F.struct(F.when(hue >= 180, hue - 180).otherwise(hue).cast("int").alias("h"), saturation.cast("int").alias("s"), F.floor(high + 0.5).cast("int").alias("v"))


def rgb_of_hsv(h: Column, s: Column, v: Column) -> Column:
    """struct<r, g, b> of hsv, cut to whole numbers as 8-bit images are."""
    sector, chroma = h * 2 / 60.0, v * s / 255.0
    low = v - chroma
    # Each channel rises and falls with the hue around its own place.
    channel = lambda at: F.floor(low + chroma * clip(F.abs(F.pmod(sector + at, F.lit(6.0)) - 3) - 1, 0.0, 1.0) + 0.5).cast("int")
    return F.struct(channel(0.0).alias("r"), channel(4.0).alias("g"), channel(2.0).alias("b"))


# The sRGB primaries under D65, its transfer curve, and CIE LAB's.
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
FROM_XYZ = ((3.240479, -1.53715, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311))
WHITE = (0.950456, 1.0, 1.088754)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for each row, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _mixed(rows: tuple[tuple[float, ...], ...], v: Column) -> list[Column]:
    return [sum(F.get(v, k) * row[k] for k in range(3)) for row in rows]


def lab(red: Column, green: Column, blue: Column) -> Column:
    """struct<l, a, b> of 8-bit colours, in 8 bits: lightness 0..255 for 0..100, a and b with 128 added, halves rounded up."""
    whole = lambda v: F.floor(clip(v, 0.0, 255.0) + 0.5).cast("int")
    linear = F.transform(F.array(red, green, blue), lambda c: F.when(c / 255.0 > 0.04045, F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 255.0 / 12.92))
    xyz = _let(linear, lambda v: F.array(*(x / white for x, white in zip(_mixed(TO_XYZ, v), WHITE, strict=True))))
    curved = F.transform(xyz, lambda t: F.struct(t.alias("t"), F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116).alias("f")))

    def coded(v: Column) -> Column:
        x, y, z = (F.get(v, k)["f"] for k in range(3))
        t = F.get(v, 1)["t"]
        lightness = F.when(t > 0.008856, 116 * y - 16).otherwise(903.3 * t)
        return F.struct(whole(lightness * 255 / 100).alias("l"), whole(500 * (x - y) + 128).alias("a"), whole(200 * (y - z) + 128).alias("b"))

    return _let(curved, coded)


def rgb_of_lab(lightness: Column, a: Column, b: Column) -> Column:
    """struct<r, g, b> of 8-bit lab."""
    light, dark = lightness * 100 / 255.0, 903.3 * 0.008856
    y = F.when(light > dark, F.pow((light + 16) / 116, F.lit(3.0))).otherwise(light / 903.3)
    middle = F.when(light > dark, (light + 16) / 116).otherwise(7.787 * light / 903.3 + 16 / 116)
    back = lambda t: F.when(t * t * t > 0.008856, t * t * t).otherwise((t - 16 / 116) / 7.787)
    far = _let(middle, lambda m: F.transform(F.array(m + (a - 128) / 500.0, m - (b - 128) / 200.0), back))
    xyz = _let(far, lambda v: F.array(F.get(v, 0) * WHITE[0], y, F.get(v, 1) * WHITE[2]))
    linear = _let(xyz, lambda v: F.array(*(clip(x, 0.0, 1.0) for x in _mixed(FROM_XYZ, v))))
    curved = F.transform(linear, lambda x: F.when(x > 0.0031308, 1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * x))
    coded = F.transform(curved, lambda x: F.floor(clip(x, 0.0, 1.0) * 255 + 0.5).cast("int"))
    return _let(coded, lambda v: F.struct(*(F.get(v, k).alias(name) for k, name in enumerate("rgb"))))


def green_or_brown(h: Column, s: Column, v: Column) -> Column:
    """Growing crops or bare soil by colour."""
    return (h.between(35, 85) & (s >= 30) & (v >= 30)) | (h.between(10, 35) & s.between(20, 200) & v.between(40, 200))


def boosted_saturation(h: Column, s: Column, factor: float = 1.2) -> Column:
    """More colour for green hues, strictly between 35 and 85."""
    return F.when((h > 35) & (h < 85), F.least(F.lit(255.0), s * factor)).otherwise(s.cast("double"))


def area_ha(square_degrees: Column, metres_lon: float = 87_000.0, metres_lat: float = 111_000.0) -> Column:
    """Hectares of an area in degrees, with the constant metres of a degree that the data model uses."""
    return square_degrees * metres_lon * metres_lat / 10_000


def compactness(area: Column, perimeter: Column, without: float = 0.0) -> Column:
    """4 pi A / P^2, and `without` where there is no perimeter."""
    return F.when(perimeter > 0, 4 * F.pi() * area / (perimeter * perimeter)).otherwise(without)


def confidence_v1(hectares: Column, compact: Column, has_ndvi: bool) -> Column:
    base = F.lit(0.7 if has_ndvi else 0.5)
    size = F.when(hectares.between(1, 50), 1.0).when(hectares.between(0.5, 100), 0.8).otherwise(0.6)
    return clip(base * size * (0.7 + 0.3 * F.least(compact, F.lit(1.0))), 0.1, 1.0)


def confidence_v2(edge: Column, compact: Column, deviation: Column, has_ndvi: bool) -> Column:
    std = F.coalesce(deviation, F.lit(0.5))
    steady = F.when(std < 0.1, 0.15).when(std < 0.2, 0.1).when(std < 0.3, 0.05).otherwise(0.0)
    return clip(0.5 + F.least(2 * edge, F.lit(0.2)) + 0.15 * compact + steady + F.lit(0.1 if has_ndvi else 0.0), 0.1, 1.0)
