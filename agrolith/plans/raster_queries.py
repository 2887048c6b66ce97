"""Queries on raster files, warping and vector overlays, each with SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from agrolith.functions import geometry as geo
from agrolith.functions import records
from agrolith.operators import fields as extraction
from agrolith.operators import grid, overlay, segment, stencil, tiles, warp
from agrolith.operators.scratch import shared_dir
from agrolith.plans.field_queries import MARKED, frame, plots
from agrolith.plans.queries import GRADIENT, PIX, POINTS, WIDTH, height, neighbour_ctes, pix, points, query, r6, table
from agrolith.sources import geojson, geotiff

# --- files -----------------------------------------------------------------------------------------------------------------------------

COLS = 100
BANDS = f"px AS (SELECT event_id // {COLS} AS row, event_id % {COLS} AS col, floor(value / 2) AS x, CAST(user_id AS DOUBLE) AS y, CAST(length(event_type) * 20 AS DOUBLE) AS z FROM events)"


def bands(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.expr(f"event_id div {COLS}").alias("row"), (F.col("event_id") % COLS).alias("col"), F.floor(F.col("value") / 2).alias("x"), F.col("user_id").alias("y"), (F.length("event_type") * 20).alias("z"))


def rows_of(spark, sf_dir) -> int:
    return (table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0) // COLS + 1


def new_folder(spark) -> str:
    return f"{shared_dir(spark)}/tif-{uuid.uuid4().hex}"


@query(f"WITH {BANDS} SELECT row, col, x AS b1, y AS b2, z AS b3 FROM px WHERE row >= 3 AND row < 60 AND col BETWEEN 20 AND 69")
def geotiff_window(spark, sf_dir):
    """A window of a file that Spark has written from the events."""
    at, px, names = new_folder(spark), bands(spark, sf_dir), ["x", "y", "z"]
    geotiff.write_geotiff(px, at, names, rows_of(spark, sf_dir), COLS, {"a": 0.0014, "c": -121.7, "e": -0.0008, "f": 36.7}, dtype=geotiff.holding(px, names), tile=32)
    return geotiff.read_geotiff(spark, at).where("row >= 3 AND row < 60 AND col BETWEEN 20 AND 69").select("row", "col", "b1", "b2", "b3")


@query(f"WITH {BANDS} SELECT row, col, x AS red, x AS green, x AS blue FROM px")
def geotiff_three_bands(spark, sf_dir):
    """A file of one band as three."""
    at, px = new_folder(spark), bands(spark, sf_dir)
    geotiff.write_geotiff(px, at, ["x"], rows_of(spark, sf_dir), COLS, {"a": 1.0, "c": 0.0, "e": -1.0, "f": 0.0}, dtype=geotiff.holding(px, ["x"]), tile=64, compression="deflate")
    return geotiff.three_bands(spark, at).select("row", "col", "red", "green", "blue")


@query(
    f"""WITH {BANDS}, h AS (SELECT max(row) + 1 AS n FROM px) SELECT 'raster' AS raster_id, CAST(2 * n AS BIGINT) AS height, CAST(2 * {COLS} AS BIGINT) AS width, 3 AS bands, 'uint8' AS dtype, 0.0007 AS a, -121.7 AS c, -0.0004 AS e, 36.7 AS f, 4326 AS epsg,
 CAST(ceil(2 * n / 64) * ceil(2 * {COLS} / 64) AS INTEGER) AS blocks FROM h"""
)
def geotiff_enlarged_info(spark, sf_dir):
    """The directory of an enlarged raster's file: its size doubled, its pixels halved."""
    at, affine = new_folder(spark), {"a": 0.0014, "c": -121.7, "e": -0.0008, "f": 36.7}
    geotiff.write_geotiff(grid.upsample_nearest(bands(spark, sf_dir), 2), at, ["x", "y", "z"], 2 * rows_of(spark, sf_dir), 2 * COLS, grid.rescaled(affine, 2), tile=64)
    info = spark.read.format("geotiff_info").option("path", at).load()
    return info.select("raster_id", "height", "width", "bands", "dtype", *(F.col(f"affine.{k}").alias(k) for k in "acef"), "epsg", "blocks")


@query(f"WITH {POINTS} SELECT row, col, floor(v / 2) AS b1 FROM pts WHERE lon BETWEEN -121.70 AND -121.65 AND lat BETWEEN 36.62 AND 36.64")
def geotiff_area_sink(spark, sf_dir):
    """A raster cut to an area, as a file of its own, read again; pixels beyond the area are no data, 0."""
    at, p = new_folder(spark), points(spark, sf_dir)
    inside = p.lon.between(-121.70, -121.65) & p.lat.between(36.62, 36.64)
    geotiff.write_geotiff(grid.crop(p.withColumn("b", F.floor(F.col("v") / 2)), inside), at, ["b"], rows_of(spark, sf_dir), COLS, {"a": 0.0014, "c": -121.7327, "e": 0.00083, "f": 36.6132}, tile=16)
    back = geotiff.read_geotiff(spark, at)
    lon, lat = -121.7327 + F.col("col") * 0.0014, 36.6132 + F.col("row") * 0.00083
    return back.where(lon.between(-121.70, -121.65) & lat.between(36.62, 36.64)).select("row", "col", "b1")


# --- warping ---------------------------------------------------------------------------------------------------------------------------

R, A, C, E, NORTH = 6378137.0, 0.0014, -121.7327, -0.001, 36.6958
SIZE = 120.0
WARPED = f"""src AS (SELECT event_id // {COLS} AS row, event_id % {COLS} AS col, value AS v, user_id % 7 AS k FROM events), h AS (SELECT max(row) + 1 AS n FROM src),
 o AS (SELECT n, radians({C}) * {R} AS west, asinh(tan(radians({NORTH}))) * {R} AS north, CAST(ceil(({COLS} * radians({A})) * {R} / {SIZE}) AS BIGINT) AS w,
 CAST(ceil((asinh(tan(radians({NORTH}))) - asinh(tan(radians({NORTH} + n * {E})))) * {R} / {SIZE}) AS BIGINT) AS hh FROM h),
 t AS (SELECT o.*, row, unnest(range(w)) AS col FROM (SELECT *, unnest(range(hh)) AS row FROM o) o),
 m AS (SELECT n, row, col, (degrees((west + (col + 0.5) * {SIZE}) / {R}) - ({C})) / {A} - 0.5 AS u, (degrees(atan(sinh((north - (row + 0.5) * {SIZE}) / {R}))) - {NORTH}) / ({E}) - 0.5 AS v FROM t),
 f AS (SELECT *, CAST(floor(u) AS BIGINT) AS c0, CAST(floor(v) AS BIGINT) AS r0 FROM m WHERE u >= -0.5 AND u < {COLS} - 0.5 AND v >= -0.5 AND v < n - 0.5)"""


def mercator(spark, sf_dir) -> tuple[warp.Georef, warp.Georef]:
    """The events' raster in degrees, and a grid of 120 m over it."""
    from math import asinh, ceil, radians, tan

    n = rows_of(spark, sf_dir)
    y = lambda lat: asinh(tan(radians(lat))) * R
    source = warp.Georef(A, C, E, NORTH, n, COLS)
    return source, warp.Georef(SIZE, radians(C) * R, -SIZE, y(NORTH), ceil((y(NORTH) - y(NORTH + n * E)) / SIZE), ceil(COLS * radians(A) * R / SIZE), 3857)


def raster(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.expr(f"event_id div {COLS}").alias("row"), (F.col("event_id") % COLS).alias("col"), F.col("value").alias("v"), (F.col("user_id") % 7).alias("k"))


@query(
    f"""WITH {WARPED}, x(dr, dc) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1)), s AS (SELECT f.row, f.col, sum(w * src.v) / sum(w) AS v FROM (SELECT f.*, r0 + dr AS sr, c0 + dc AS sc, CASE dr WHEN 1 THEN v - r0 ELSE 1 - (v - r0) END * CASE dc WHEN 1 THEN u - c0 ELSE 1 - (u - c0) END AS w FROM f CROSS JOIN x) f
 JOIN src ON src.row = sr AND src.col = sc GROUP BY 1, 2), k AS (SELECT f.row, f.col, CAST(k AS DOUBLE) AS k FROM f JOIN src ON src.row = least(n - 1, CAST(floor(v + 0.5) AS BIGINT)) AND src.col = least({COLS} - 1, CAST(floor(u + 0.5) AS BIGINT))) SELECT row, col, round(s.v, 6) AS v, k FROM s JOIN k USING (row, col)""".replace("f.row, f.col, CAST(k AS DOUBLE) AS k FROM f", "f.row, f.col, CAST(src.k AS DOUBLE) AS k FROM f").replace("CAST(floor(v + 0.5)", "CAST(floor(f.v + 0.5)").replace("CAST(floor(u + 0.5)", "CAST(floor(f.u + 0.5)")
)
def warp_to_mercator(spark, sf_dir):
    """Degrees to Web Mercator: values bilinear, classes from the nearest pixel."""
    source, target = mercator(spark, sf_dir)
    return warp.warp(raster(spark, sf_dir), source, target, ["v"], ("k",)).select("row", "col", r6("v").alias("v"), "k")


@query(
    f"""WITH {WARPED}, q AS (SELECT f.row, f.col, src.k FROM f JOIN src ON src.row = least(n - 1, CAST(floor(f.v + 0.5) AS BIGINT)) AND src.col = least({COLS} - 1, CAST(floor(f.u + 0.5) AS BIGINT))),
 b AS (SELECT src.row, src.col, CAST(floor((radians({C} + (src.col + 0.5) * {A}) * {R} - west) / {SIZE}) AS BIGINT) AS qc, CAST(floor((north - asinh(tan(radians({NORTH} + (src.row + 0.5) * ({E})))) * {R}) / {SIZE}) AS BIGINT) AS qr FROM src CROSS JOIN o)
 SELECT b.row, b.col, CAST(q.k AS DOUBLE) AS k FROM b JOIN q ON q.row = b.qr AND q.col = b.qc"""
)
def warp_there_and_back(spark, sf_dir):
    """Classes to Web Mercator and back to degrees."""
    source, target = mercator(spark, sf_dir)
    there = warp.warp(raster(spark, sf_dir), source, target, [], ("k",))
    return warp.warp(there, target, source, [], ("k",)).where("k IS NOT NULL").select("row", "col", "k")


# --- overlays --------------------------------------------------------------------------------------------------------------------------

#: Fields and strips as boxes on whole numbers, some fields with a hole, from suppliers and customers; a strip belongs to the field of its number.
BOXES = """f AS (SELECT s_suppkey AS id, s_suppkey % 7 * 10 AS w, s_nationkey % 5 * 10 AS s, s_suppkey % 7 * 10 + 20 + s_nationkey AS e, s_nationkey % 5 * 10 + 15 + s_suppkey % 9 AS n FROM supplier),
 g AS (SELECT c_custkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS id, c_custkey % 43 AS w, c_custkey * 7 % 41 - 5 AS s, c_custkey % 43 + 2 + c_nationkey % 4 AS e, c_custkey * 7 % 41 + 3 + c_nationkey AS n FROM customer),
 c AS (SELECT id, unnest(range(120)) AS x FROM f), p AS (SELECT id, x, unnest(range(-5, 100)) AS y FROM c),
 i AS (SELECT p.id, x, y, x >= w AND x < e AND y >= s AND y < n AND NOT (id % 2 = 0 AND x >= w + 2 AND x < w + 9 AND y >= s + 3 AND y < s + 11) AS a FROM p JOIN f USING (id)),
 j AS (SELECT id, x, y, a, EXISTS (SELECT 1 FROM g WHERE g.id = i.id AND x >= w AND x < e AND y >= s AND y < n) AS b FROM i)"""


def _box(w, s, e, n):
    return geo.box(*(c.cast("double") for c in (w, s, e, n)))


def boxes(spark, sf_dir):
    """The fields, and the strips."""
    s = table(spark, sf_dir, "supplier")
    west, south = F.col("s_suppkey") % 7 * 10, F.col("s_nationkey") % 5 * 10
    outer = _box(west, south, west + 20 + F.col("s_nationkey"), south + 15 + F.col("s_suppkey") % 9)
    hole = _box(west + 2, south + 3, west + 9, south + 11)
    fields = s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.array(outer, hole)).otherwise(F.array(outer)).alias("rings"))
    most = s.agg(F.max("s_suppkey")).first()[0] or 1
    c = table(spark, sf_dir, "customer")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    strip = _box(key % 43, key * 7 % 41 - 5, key % 43 + 2 + nation % 4, key * 7 % 41 + 3 + nation)
    return fields, c.select((key % most + 1).alias("id"), F.array(strip).alias("rings"))


def _area(found):
    total = F.aggregate("rings", F.lit(0.0), lambda s, r: s + geo.signed_area(r))
    return found.select("id", total.alias("a")).groupBy("id").agg(r6(F.sum("a")).alias("area"))


@query(
    f"""WITH {BOXES}, t AS (SELECT id, unnest(['difference', 'intersection', 'union']) AS result, unnest([count(*) FILTER (a AND NOT b), count(*) FILTER (a AND b), count(*) FILTER (a OR b)]) AS area FROM j GROUP BY id)
 SELECT id, result, CAST(area AS DOUBLE) AS area FROM t WHERE area > 0"""
)
def overlay_areas(spark, sf_dir):
    """Areas of fields without their strips, under them, and with them; unit squares are counted by the SQL."""
    fields, strips = boxes(spark, sf_dir)
    strips = strips.join(fields.select("id"), "id", "left_semi")
    found = None
    for name, polygons in overlay.overlay(fields, strips, ["id"], ("difference", "intersection", "union"), 1000.0, 8.0).items():
        own = _area(polygons).select("id", F.lit(name).alias("result"), "area")
        found = own if found is None else found.unionByName(own)
    return found


@query(
    f"""WITH {BOXES}, u AS (SELECT g.id, x, y FROM g, (SELECT unnest(range(-5, 60)) AS x), (SELECT unnest(range(-10, 90)) AS y) WHERE x >= w AND x < e AND y >= s AND y < n GROUP BY ALL)
 SELECT id, CAST(count(*) AS DOUBLE) AS area FROM u GROUP BY id"""
)
def union_areas(spark, sf_dir):
    """Areas of each field's strips as one."""
    return _area(overlay.union(boxes(spark, sf_dir)[1], ["id"], 1000.0, 8.0))


@query(
    """SELECT o_orderkey AS id, CAST(2 AS BIGINT) AS parts, CAST(8 AS BIGINT) AS points, CAST(2 * (5 + o_orderkey % 11) * (4 + o_custkey % 13) AS DOUBLE) AS area FROM orders WHERE o_orderkey % 3 <> 0
 UNION ALL SELECT o_orderkey, 1, 5, CAST(4 * (5 + o_orderkey % 11) * (4 + o_custkey % 13) AS DOUBLE) FROM orders WHERE o_orderkey % 3 = 0"""
)
def valid_parts(spark, sf_dir):
    """Bow-ties become two triangles, rings with a spike and repeated points a rectangle."""
    o = table(spark, sf_dir, "orders")
    w, h = 2.0 * (5 + F.col("o_orderkey") % 11), 2.0 * (4 + F.col("o_custkey") % 13)
    ring = lambda *at: F.array(*(F.struct((F.lit(0.0) + x * w).alias("x"), (F.lit(0.0) + y * h).alias("y")) for x, y in at))
    tie = ring((0, 0), (1, 1), (1, 0), (0, 1), (0, 0))
    spike = ring((0, 0), (1, 0), (1, 0), (1.5, 0), (1, 0), (1, 1), (0.5, 1), (0, 1), (0, 0))
    bad = o.select(F.col("o_orderkey").alias("id"), F.array(F.when(F.col("o_orderkey") % 3 == 0, spike).otherwise(tie)).alias("rings"))
    found = overlay.make_valid(bad, ["id"], 1000.0, 64.0)
    area = F.aggregate("rings", F.lit(0.0), lambda s, r: s + geo.signed_area(r))
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.size(F.flatten("rings"))).alias("points"), r6(F.sum(area)).alias("area"))


# --- outlines, cores, scaled gradients -------------------------------------------------------------------------------------------------


@query(
    f"""WITH {MARKED}, d AS (SELECT i.row, i.col, sqrt(min((i.row - o.row) ** 2 + (i.col - o.col) ** 2)) AS d FROM (SELECT * FROM marked WHERE inside) i CROSS JOIN (SELECT * FROM marked WHERE NOT inside) o GROUP BY i.row, i.col)
 SELECT row, col FROM d WHERE d > 0.3 * (SELECT max(d) FROM d)""")
def distance_cores(spark, sf_dir):
    """What lies deeper inside than three tenths of the deepest pixel, by exact distances."""
    marked = extraction.interior(plots(spark, sf_dir), frame(spark, sf_dir), extraction.Rules())
    return segment.cores(segment.distances(marked.where("inside"), marked.where("not inside"))).select("row", "col")


@query(
    f"""WITH {PIX}, m AS (SELECT row, col, row // 9 * 8 + col // 9 AS label FROM pix WHERE v > -0.1), c AS (SELECT label, row + dr AS y, col + dc AS x, CASE WHEN count(*) = 2 AND abs(min(row * 2 + col) - max(row * 2 + col)) IN (1, 3) AND count(DISTINCT row) = 2 AND count(DISTINCT col) = 2 THEN 2 WHEN count(*) IN (1, 3) THEN 1 ELSE 0 END AS n
 FROM m, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) s(dr, dc) GROUP BY label, row + dr, col + dc) SELECT label, CAST(any_value(area) AS DOUBLE) AS area, CAST(sum(n) AS BIGINT) AS corners FROM c JOIN (SELECT label, count(*) AS area FROM m GROUP BY label) USING (label) GROUP BY label""")
def outline_corners(spark, sf_dir):
    """Area and corners of each region's outlines; the SQL counts pixels, and corners by the four pixels at a point."""
    label = F.expr("row div 9 * 8 + col div 9")
    rings = segment.polygonize(pix(spark, sf_dir).where("v > -0.1").select(label.cast("bigint").alias("label"), "row", "col"))
    return rings.groupBy("label").agg(r6(F.sum(geo.signed_area(F.col("ring")))).alias("area"), F.sum(F.size("ring") - 1).alias("corners"))


@query(f"WITH {PIX}, {neighbour_ctes()}, g AS ({GRADIENT}) SELECT row, col, CAST(floor(gradient / (SELECT max(gradient) FROM g) * 255) AS INTEGER) AS gradient FROM g")
def gradient_uint8(spark, sf_dir):
    return stencil.gradient_uint8(pix(spark, sf_dir))


@query("SELECT o_orderkey, strftime(o_orderdate, '%b %-d, %Y') AS day FROM orders")
def long_date(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", records.long_date(F.col("o_orderdate")).alias("day"))


_TOP, _ORIGIN = 20, (4_092_700, 1_729_131)


def _kernel_sql(z: int) -> str:
    f = 1 << (_TOP - z)
    if f == 1:
        return f"SELECT {z} AS z, row + {_ORIGIN[0]} AS row, col + {_ORIGIN[1]} AS col, v FROM pix"
    least, weights = grid.reduction_shares(f)
    k = ", ".join(f"({least + n}, CAST({w!r} AS DOUBLE))" for n, w in enumerate(weights))
    reach = lambda axis, first, last: f"greatest({first}, least({last}, {f} * t.{axis} + k))"
    r0, c0 = _ORIGIN
    return f"""SELECT {z} AS z, b.row, b.col, b.v FROM (WITH k(k, w) AS (VALUES {k}), tc AS (SELECT unnest(range({c0 // f}, {(c0 + WIDTH - 1) // f} + 1)) AS col), tr AS (SELECT unnest(range({r0} // {f}, ({r0} + n - 1) // {f} + 1)) AS row, n FROM h),
 a AS (SELECT s.row, t.col, sum(s.v * w) AS v FROM tc t CROSS JOIN k JOIN pix s ON s.col + {c0} = {reach("col", c0, c0 + WIDTH - 1)} GROUP BY 1, 2)
 SELECT t.row, a.col, sum(a.v * w) AS v FROM tr t CROSS JOIN k JOIN a ON a.row + {r0} = {reach("row", r0, f"{r0} + n - 1")} GROUP BY 1, 2) b"""


@query(
    f"""WITH {PIX}, h AS (SELECT max(row) + 1 AS n FROM pix), l AS ({" UNION ALL ".join(_kernel_sql(z) for z in (18, 19, 20))})
 SELECT z, col // 256 AS x, row // 256 AS y, col % 256 AS px, row % 256 AS py, round(v, 6) AS v FROM l""")
def tile_pyramid_lanczos(spark, sf_dir):
    """Zooms 18 to 20 of a raster that lies across tiles, by the Lanczos kernel."""
    found = tiles.kernel_pyramid(pix(spark, sf_dir), _TOP, range(18, 21), _ORIGIN, height(spark, sf_dir), F.lit(WIDTH))
    return found.select("z", "x", "y", "px", "py", r6("v").alias("v"))


# --- vector files ----------------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {BOXES} SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 2 = 0 THEN 'holed' ELSE 'whole' END AS kind, CAST((e - w) * (n - s) AS DOUBLE) AS area FROM f"""
)
def features_written(spark, sf_dir):
    """Outer rings as GeoJSON lines, written and read again as areas."""
    at, fields = f"{shared_dir(spark)}/geojson-{uuid.uuid4().hex}", boxes(spark, sf_dir)[0]
    kind = F.when(F.col("id") % 2 == 0, "holed").otherwise("whole")
    lines = fields.select(geojson.feature(F.col("id").cast("string"), F.get("rings", 0), F.struct(kind.alias("kind"))).alias("feature"))
    geojson.write_features(lines, at)
    back, read = spark.read.text(at), lambda name: F.get_json_object("value", name)
    return back.select(read("$.id").alias("id"), read("$.properties.kind").alias("kind"), r6(geo.area(geojson.checked_ring(F.col("value")))).alias("area"))
