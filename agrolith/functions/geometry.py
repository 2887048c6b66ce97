"""Rings, points and tile numbers as column expressions. A ring is array<struct<x, y>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def closed(ring: Column) -> Column:
    """The ring with its first point again at the end, unless it is there."""
    return F.when(F.size(ring) == 0, ring).when(F.get(ring, 0) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def _steps(ring: Column) -> Column:
    """Pairs of neighbouring points of a closed ring."""
    return F.slice(F.zip_with(ring, F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), 1, F.greatest(F.size(ring) - 1, F.lit(0)))


def signed_area(ring: Column) -> Column:
    """Shoelace formula; positive if counter-clockwise."""
    return F.aggregate(_steps(ring), F.lit(0.0), lambda s, p: s + (p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"])) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return F.aggregate(_steps(ring), F.lit(0.0), lambda s, p: s + F.sqrt(F.pow(p["b"]["x"] - p["a"]["x"], F.lit(2.0)) + F.pow(p["b"]["y"] - p["a"]["y"], F.lit(2.0))))


def bounds(ring: Column) -> Column:
    """[least x, least y, most x, most y]."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a closed ring, by crossings of a ray to the right."""

    def crosses(p: Column) -> Column:
        (ax, ay), (bx, by) = ((p[k]["x"], p[k]["y"]) for k in "ab")
        return F.when((ay > y) != (by > y), x < (bx - ax) * (y - ay) / F.when(by == ay, 1.0).otherwise(by - ay) + ax).otherwise(F.lit(False)).cast("int")

    return F.aggregate(_steps(ring), F.lit(0), lambda n, p: n + crosses(p)) % 2 == 1


def valid_ring(ring: Column) -> Column:
    return (F.size(ring) >= 4) & (area(ring) > 0)


def wkt(ring: Column) -> Column:
    """POLYGON text of a ring."""
    points = F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return F.concat(F.lit("POLYGON (("), F.array_join(points, ", "), F.lit("))"))


def feature_id(text: Column) -> Column:
    """12 hex digits from the first 100 characters of a geometry's text."""
    return F.substring(F.md5(F.substring(text, 1, 100).cast("binary")), 1, 12)


def zone_name(zone: Column, zones: int) -> Column:
    names = {1: "low", 2: "medium", 3: "high"}
    return F.element_at(F.lit([names[k] for k in (1, 2, 3)]), zone) if zones == 3 else F.concat(F.lit("zone_"), zone.cast("string"))


def box(west: Column, south: Column, east: Column, north: Column) -> Column:
    """A closed rectangle, counter-clockwise."""
    corners = ((west, south), (east, south), (east, north), (west, north), (west, south))
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in corners))


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * 6_378_137.0


def mercator_y(lat: Column) -> Column:
    return F.asinh(F.tan(F.radians(lat))) * 6_378_137.0


def tile_x(lon: Column, zoom: Column) -> Column:
    """Column of the XYZ tile, kept within the zoom's range."""
    n = F.pow(F.lit(2.0), zoom)
    return F.least(F.greatest(F.floor((lon + 180) / 360 * n), F.lit(0)), (n - 1).cast("bigint")).cast("bigint")


def tile_y(lat: Column, zoom: Column) -> Column:
    n = F.pow(F.lit(2.0), zoom)
    y = F.floor((1 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2 * n)
    return F.least(F.greatest(y, F.lit(0)), (n - 1).cast("bigint")).cast("bigint")


def distance_to_segment(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Of a point to a segment; a segment without length is a point."""
    length2 = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.when(length2 > 0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / F.when(length2 > 0, length2).otherwise(1.0)).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    dx, dy = x - (ax + t * (bx - ax)), y - (ay + t * (by - ay))
    return F.sqrt(dx * dx + dy * dy)


def box_touches(area: list[tuple[float, float]], west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether a box and the area within a closed ring of (x, y) have a point in common.

    An edge that touches the box has a part of it inside: its clipped range (Liang and Barsky) isn't empty. If no edge touches, the box
    lies in the area as a whole or not at all.
    """
    touched, inside = F.lit(False), F.lit(False)
    for (ax, ay), (bx, by) in zip(area, area[1:], strict=False):
        low, high, possible = F.lit(0.0), F.lit(1.0), F.lit(True)
        for a, d, least, most in ((ax, bx - ax, west, east), (ay, by - ay, south, north)):
            if d:
                low, high = F.greatest(low, F.least((least - a) / d, (most - a) / d)), F.least(high, F.greatest((least - a) / d, (most - a) / d))
            else:
                possible = possible & F.lit(a).between(least, most)
        touched = touched | (possible & (low <= high))
        if ay != by:
            crosses = ((F.lit(ay) > south) != (F.lit(by) > south)) & (west < F.lit((bx - ax) / (by - ay)) * (south - ay) + ax)
            inside = inside != crosses
    return touched | inside


# The WGS 84 ellipsoid and the UTM grid.
SEMI_MAJOR, FLATTENING, UTM_SCALE = 6_378_137.0, 1 / 298.257223563, 0.9996


def utm_zone(lon: Column) -> Column:
    return (F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1).cast("int")


# The third flattening, the rectifying radius, and the series of Krueger in it up to its fourth power, there and back.
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def utm_in(lon: Column, lat: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Easting and northing in metres in a given zone."""
    e = 2 * _N**0.5 / (1 + _N)
    away = F.radians(lon - (zone * 6 - 183))
    sin_lat = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sin_lat) - e * F.atanh(e * sin_lat))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    east = eta + sum(a * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, a in enumerate(_ALPHA, 1))
    north = xi + sum(a * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, a in enumerate(_ALPHA, 1))
    scale = UTM_SCALE * _RADIUS
    return 500_000 + scale * east, F.when(south, 10_000_000.0).otherwise(0.0) + scale * north


def utm(lon: Column, lat: Column) -> Column:
    """struct<zone, easting, northing> in the zone of the longitude."""
    zone = utm_zone(lon)
    east, north = utm_in(lon, lat, zone, lat < 0)
    return F.struct(zone.alias("zone"), east.alias("easting"), north.alias("northing"))


def utm_inverse(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a point of a UTM zone."""
    scale = UTM_SCALE * _RADIUS
    xi, eta = (north - F.when(south, 10_000_000.0).otherwise(0.0)) / scale, (east - 500_000) / scale
    x = xi - sum(b * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, b in enumerate(_BETA, 1))
    y = eta - sum(b * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, b in enumerate(_BETA, 1))
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi + sum(d * F.sin(2 * k * chi) for k, d in enumerate(_DELTA, 1))
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(lat)


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / SEMI_MAJOR)


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(y / SEMI_MAJOR)))


def to_lonlat(epsg: int, x: Column, y: Column) -> tuple[Column, Column]:
    """A point of a reference system in degrees: 4326, 3857, 32601 to 32660 and 32701 to 32760."""
    if epsg == 4326:
        return x, y
    if epsg == 3857:
        return mercator_lon(x), mercator_lat(y)
    return utm_inverse(x, y, *_utm_of(epsg))


def from_lonlat(epsg: int, lon: Column, lat: Column) -> tuple[Column, Column]:
    if epsg == 4326:
        return lon, lat
    if epsg == 3857:
        return mercator_x(lon), mercator_y(lat)
    return utm_in(lon, lat, *_utm_of(epsg))


def _utm_of(epsg: int) -> tuple[Column, Column]:
    if epsg // 100 not in (326, 327) or not 1 <= epsg % 100 <= 60:
        raise ValueError(f"EPSG:{epsg} is unknown")
    return F.lit(epsg % 100), F.lit(epsg // 100 == 327)
