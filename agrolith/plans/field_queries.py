"""Queries on field extraction, areas, resampling and colour chains, each with SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from agrolith.functions import bandmath as bm
from agrolith.functions import geometry as geo
from agrolith.operators import catalog, enhance, fields, grid, stencil, zonal
from agrolith.operators.scratch import shared_dir
from agrolith.plans.more_queries import NOW, SCENES, now, scenes
from agrolith.plans.queries import GRADIENT, PIX, POINTS, RGB8, WIDTH, blur_ctes, height, neighbour_ctes, pix, points, query, r6, rgb, table
from agrolith.sources import pages

# --- a raster with fields: plots of 25 x 25 pixels with a little noise, from the events table ------------------------------------------

COLS, PLOT, DX, DY, WEST, NORTH = 100, 25, 0.0005, 0.0004, -121.7327, 36.6958
PLOTS = f"""fp AS (SELECT event_id // {COLS} AS row, event_id % {COLS} AS col, (event_id // {COLS} // {PLOT} * 7 + event_id % {COLS} // {PLOT} * 3) % 5 / 5.0 + value / 490200 AS v,
 event_id % {COLS} < {COLS - 3} AS valid, event_id // {COLS} // {PLOT} * {COLS // PLOT} + event_id % {COLS} // {PLOT} AS label FROM events)"""
MARKED = f"{PLOTS}, {blur_ctes(stencil.gaussian_weights(fields.Rules.sigma), 'fp', COLS)}, {neighbour_ctes('g')}, marked AS (SELECT row, col, gradient, valid, gradient < {fields.Rules.most_gradient} AND valid AS inside FROM ({GRADIENT}) JOIN fp USING (row, col))"


def plots(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    row, col = F.expr(f"event_id div {COLS}"), F.col("event_id") % COLS
    plot_row, plot_col = F.expr(f"event_id div {COLS * PLOT}"), F.floor(col / PLOT)
    return e.select(row.alias("row"), col.alias("col"), ((plot_row * 7 + plot_col * 3) % 5 / 5.0 + F.col("value") / 490200).alias("ndvi"), (col < COLS - 3).alias("valid"), (plot_row * (COLS // PLOT) + plot_col).alias("label"))


def frame(spark, sf_dir):
    last = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0
    return fields.Frame(WEST, NORTH, DX, DY, F.lit(last // COLS + 1), F.lit(COLS))


def roads(spark):
    """Two roads, along a column and along a row of pixels."""
    x, y = WEST + 40.5 * DX, NORTH - 60.5 * DY
    return spark.createDataFrame([(x, NORTH, x, NORTH - 10_000 * DY), (WEST, y, WEST + COLS * DX, y)], "ax double, ay double, bx double, by double")


@query(f"WITH {MARKED} SELECT row, col, round(gradient, 6) AS gradient, inside FROM marked")
def field_interior(spark, sf_dir):
    return fields.interior(plots(spark, sf_dir), frame(spark, sf_dir), fields.Rules()).select("row", "col", r6("gradient").alias("gradient"), "inside")


@query(
    f"""WITH {MARKED}, d AS (SELECT i.row, i.col, min((i.row - o.row) ** 2 + (i.col - o.col) ** 2) AS d FROM (SELECT * FROM marked WHERE inside) i CROSS JOIN (SELECT * FROM marked WHERE NOT inside) o GROUP BY i.row, i.col),
 t AS (SELECT d.row, d.col, d.d, max(e.d) AS top FROM d JOIN d e ON e.row BETWEEN d.row - 10 AND d.row + 9 AND e.col BETWEEN d.col - 10 AND d.col + 9 GROUP BY 1, 2, 3) SELECT row, col FROM t WHERE d = top AND d > 25"""
)
def field_seeds(spark, sf_dir):
    rules = fields.Rules()
    return fields.seeds(fields.interior(plots(spark, sf_dir), frame(spark, sf_dir), rules), rules).select("row", "col")


@query(
    f"""WITH {PLOTS}, {neighbour_ctes("fp")}, grad AS ({GRADIENT}), x(r, c) AS (VALUES {", ".join(f"({r}, {c})" for r in range(-2, 3) for c in range(-2, 3) if abs(r) + abs(c) <= 2)}),
 ring AS (SELECT DISTINCT label, row + r AS row, col + c AS col FROM fp, x EXCEPT SELECT label, row, col FROM fp), e AS (SELECT label, avg(gradient) AS edge FROM ring JOIN grad USING (row, col) GROUP BY label),
 z AS (SELECT label, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.9) AS p90, (max(row) - min(row) + 1) * {DY} AS h, (max(col) - min(col) + 1) * {DX} AS w FROM fp GROUP BY label),
 f AS (SELECT *, h * w * 87000 * 111000 / 10000 AS ha, 4 * pi() * h * w / (4 * (h + w) * (h + w)) AS compactness FROM z LEFT JOIN e USING (label) WHERE h * w * 87000 * 111000 / 10000 BETWEEN {fields.Rules.least_ha} AND {fields.Rules.most_ha})
 SELECT label, row_number() OVER (ORDER BY label) AS field_index, n, round(mean, 6) AS mean, round(p10, 6) AS p10, round(p90, 6) AS p90, round(ha, 4) AS area_ha, round(coalesce(edge, 0), 6) AS edge, round(compactness, 6) AS compactness,
 round(greatest(0.1, least(1.0, 0.5 + least(2 * coalesce(edge, 0), 0.2) + 0.15 * compactness + CASE WHEN std < 0.1 THEN 0.15 WHEN std < 0.2 THEN 0.1 WHEN std < 0.3 THEN 0.05 ELSE 0 END + 0.1)), 2) AS confidence FROM f"""
)
def field_plot_features(spark, sf_dir):
    """Outlines, ray casting, statistics, edge strength and confidence of given regions: the plots."""
    px, at = plots(spark, sf_dir), frame(spark, sf_dir)
    outlines = fields.polygons(px.select("row", "col", "label"), at, fields.Rules())
    found = fields.features(px.select("row", "col", "ndvi", "valid"), outlines, at, "ndvi_bands", True)
    return found.select("label", "field_index", "n", *(r6(c).alias(c) for c in ("mean", "p10", "p90")), F.round("area_ha", 4).alias("area_ha"), r6("edge").alias("edge"), r6("compactness").alias("compactness"), "confidence")


@query()
def field_features(spark, sf_dir):
    """Field extraction end to end: interior, seeds, flooding, roads, outlines, statistics."""
    found = fields.extract(plots(spark, sf_dir).drop("label"), frame(spark, sf_dir), roads(spark))
    return found.select("id", "field_index", "label", "n", r6("mean").alias("mean"), F.round("area_ha", 4).alias("area_ha"), r6("edge").alias("edge"), r6("compactness").alias("compactness"), "confidence", F.size("rings").alias("rings"))


@query()
def field_zone_features(spark, sf_dir):
    """Management zones of the plots, a row for each outline."""
    px, at, rules = plots(spark, sf_dir), frame(spark, sf_dir), fields.Rules()
    found = fields.features(px.select("row", "col", "ndvi", "valid"), fields.polygons(px.select("row", "col", "label"), at, rules), at, "ndvi_bands", True)
    z = fields.zones(px.select("row", "col", "ndvi"), found, at, rules)
    return z.select("id", "parent_field", "zone_id", "zone_class", r6("mean_ndvi").alias("mean_ndvi"), "ring_no", F.size("ring").alias("points"))


# --- areas -----------------------------------------------------------------------------------------------------------------------------

#: The corners of an area, closed.
AREA = [(-121.72031, 36.62017), (-121.62013, 36.63029), (-121.60037, 36.67011), (-121.66007, 36.65023), (-121.71019, 36.69041), (-121.72031, 36.62017)]
_EDGES = "edges(ax, ay, ex, ey) AS (VALUES " + ", ".join(f"({ax}, {ay}, {bx}, {by})" for (ax, ay), (bx, by) in zip(AREA, AREA[1:], strict=False)) + ")"


def area_ring():
    return F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in AREA))


@query(f"WITH {POINTS}, {_EDGES} SELECT row, col, round(any_value(v), 6) AS v FROM pts, edges GROUP BY row, col HAVING count(*) FILTER ((ay > lat) <> (ey > lat) AND lon < (ex - ax) * (lat - ay) / (ey - ay) + ax) % 2 = 1")
def aoi_polygon_crop(spark, sf_dir):
    p = points(spark, sf_dir)
    return grid.crop_to_ring(p, p.lon, p.lat, area_ring()).select("row", "col", r6("v").alias("v"))


_TRIANGLES = "tri AS (SELECT s_suppkey AS id, -121.73 + s_suppkey % 10 * 0.0131 AS x, 36.615 + s_suppkey % 7 * 0.0107 AS y, 0.01 + s_nationkey * 0.0003 AS d FROM supplier)"


@query(
    f"""WITH {POINTS}, {_TRIANGLES}, t(k, ax, ay, ex, ey) AS (VALUES (0, 0, 0, 1, 0.3), (1, 1, 0.3, 0.4, 1), (2, 0.4, 1, 0, 0)),
 e AS (SELECT id, x + ax * d AS ax, y + ay * d AS ay, x + ex * d AS ex, y + ey * d AS ey, x, y, d FROM tri, t),
 m AS (SELECT id, row, col, any_value(v) AS v FROM e JOIN pts ON lon BETWEEN x - 0.001 AND x + d + 0.001 AND lat BETWEEN y - 0.001 AND y + d + 0.001 GROUP BY id, row, col
 HAVING count(*) FILTER ((ay > lat) <> (ey > lat) AND lon < (ex - ax) * (lat - ay) / (ey - ay) + ax) % 2 = 1) SELECT id, count(*) AS n, round(sum(v), 4) AS total FROM m GROUP BY id"""
)
def points_in_polygons(spark, sf_dir):
    # Coordinates are decimals, as they are written: points lie exactly at the height of corners and on edges.
    s = table(spark, sf_dir, "supplier")
    exact = lambda text: F.expr(f"CAST({text} AS DECIMAL(12, 5))")
    x, y, d = "-121.73BD + s_suppkey % 10 * 0.0131BD", "36.615BD + s_suppkey % 7 * 0.0107BD", "(0.01BD + s_nationkey * 0.0003BD)"
    ring = F.array(*(F.struct(exact(f"{x} + {a}BD * {d}").alias("x"), exact(f"{y} + {b}BD * {d}").alias("y")) for a, b in ((0.0, 0.0), (1.0, 0.3), (0.4, 1.0), (0.0, 0.0))))
    p = points(spark, sf_dir).select(exact("-121.7327BD + col * 0.0014BD").alias("x"), exact("36.6132BD + row * 0.00083BD").alias("y"), "v")
    return zonal.points_in_polygons(p, s.select(F.col("s_suppkey").alias("id"), F.array(ring).alias("rings")), 0.004).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query(
    f"""WITH {SCENES}, {_EDGES}, b AS (SELECT *, -121.80 + CAST(scene_id AS BIGINT) % 40 * 0.007 AS west, 36.55 + CAST(scene_id AS BIGINT) % 23 * 0.009 AS south FROM scenes WHERE acquired >= {NOW} - INTERVAL 365 DAY AND acquired <= {NOW} AND cloud <= 30 AND source IN ('1-URGENT', '2-HIGH')),
 c AS (SELECT *, west + 0.006 AS east, south + 0.004 AS north FROM b),
 l AS (SELECT scene_id, cloud, (ay > south) <> (ey > south) AND west < (ex - ax) / (ey - ay) * (south - ay) + ax AS crosses,
 greatest(0, least((west - ax) / (ex - ax), (east - ax) / (ex - ax)), least((south - ay) / (ey - ay), (north - ay) / (ey - ay))) <= least(1, greatest((west - ax) / (ex - ax), (east - ax) / (ex - ax)), greatest((south - ay) / (ey - ay), (north - ay) / (ey - ay))) AS touches FROM c, edges)
 SELECT scene_id, round(any_value(cloud), 6) AS cloud FROM l GROUP BY scene_id HAVING bool_or(touches) OR count(*) FILTER (crosses) % 2 = 1"""
)
def catalog_area_search(spark, sf_dir):
    """Scenes of two collections that touch an area."""
    k = F.col("scene_id").cast("bigint")
    s = scenes(spark, sf_dir).withColumnRenamed("source", "collection").withColumn("west", F.lit(-121.80) + k % 40 * 0.007).withColumn("south", F.lit(36.55) + k % 23 * 0.009)
    s = s.withColumn("east", F.col("west") + 0.006).withColumn("north", F.col("south") + 0.004)
    return catalog.search(s, now(), 365, 30.0, ["1-URGENT", "2-HIGH"], AREA).select("scene_id", r6("cloud").alias("cloud"))


def scene_pages(spark, sf_dir, limit=None):
    """The orders as a catalogue of pages, and a search's frame on it."""
    s = scenes(spark, sf_dir).withColumnRenamed("source", "collection")
    at = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    pages.write_pages(s.withColumn("assets", F.when(F.col("cloud") < 15, F.create_map(F.lit("visual"), F.concat("scene_id", F.lit(".tif"))))), at)
    return catalog.search(pages.read_pages(spark, at, limit), now(), 365, 30.0, ["1-URGENT", "2-HIGH"])


_PAGED = f"WITH {SCENES}, p AS (SELECT * FROM scenes WHERE acquired >= {NOW} - INTERVAL 365 DAY AND acquired <= {NOW} AND cloud <= 30 AND source IN ('1-URGENT', '2-HIGH'))"


@query(f"{_PAGED} SELECT scene_id, source AS collection, round(cloud, 6) AS cloud FROM p")
def paged_search(spark, sf_dir):
    """Scenes of two collections from pages; filters reach the source."""
    return scene_pages(spark, sf_dir).select("scene_id", "collection", r6("cloud").alias("cloud"))


@query(f"{_PAGED}, b AS (SELECT * FROM p ORDER BY p.cloud, acquired DESC, scene_id LIMIT 50) SELECT scene_id, asset, CASE WHEN asset = 'visual' AND cloud < 15 THEN scene_id || '.tif' END AS href FROM b, (VALUES ('visual'), ('scl')) a(asset)")
def paged_best_assets(spark, sf_dir):
    """The 50 best scenes from pages, reading stops at them, and the assets that a download wants."""
    return catalog.wanted_assets(catalog.best(scene_pages(spark, sf_dir, 50), 50), ["visual", "scl"])


@query(f"WITH {POINTS} SELECT row, col, round(radians(lon) * 6378137.0, 3) AS x, round(asinh(tan(radians(lat))) * 6378137.0, 3) AS y FROM pts")
def web_mercator(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select("row", "col", F.round(geo.mercator_x(p.lon), 3).alias("x"), F.round(geo.mercator_y(p.lat), 3).alias("y"))


# --- resampling and colour -------------------------------------------------------------------------------------------------------------

_SHARES = "k(k, w) AS (VALUES " + ", ".join(f"({k}, CAST({w!r} AS DOUBLE))" for k, w in grid.lanczos_shares(2)) + ")"


@query(
    f"""WITH {PIX}, {_SHARES}, h AS (SELECT max(row) + 1 AS n FROM pix), t AS (SELECT unnest(range(128)) AS col),
 a AS (SELECT s.row, t.col, sum(s.v * w) AS v FROM t CROSS JOIN k JOIN pix s ON (t.col - k) % 2 = 0 AND s.col = greatest(0, least(63, (t.col - k) // 2)) GROUP BY 1, 2),
 u AS (SELECT unnest(range(2 * n)) AS row, n FROM h), b AS (SELECT u.row, s.col, sum(s.v * w) AS v FROM u CROSS JOIN k JOIN a s ON (u.row - k) % 2 = 0 AND s.row = greatest(0, least(n - 1, (u.row - k) // 2)) GROUP BY 1, 2) SELECT row, col, round(v, 6) AS v FROM b"""
)
def resample_lanczos(spark, sf_dir):
    up = grid.upsample_lanczos(pix(spark, sf_dir), 2, height(spark, sf_dir), F.lit(WIDTH))
    return up.select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), r6("v").alias("v"))


def _window(size: int) -> list[float]:
    sigma, radius = 0.3 * ((size - 1) * 0.5 - 1) + 0.8, size // 2
    return stencil.gaussian_weights(sigma, (radius + 0.01) / sigma)


@query(f"WITH {PIX}, big AS (SELECT row, col, v * 1000 AS v FROM pix), {blur_ctes(_window(11), 'big')} SELECT row, col, CASE WHEN b.v > g.v - 2 THEN 255 ELSE 0 END AS v FROM g JOIN big b USING (row, col)")
def adaptive_threshold(spark, sf_dir):
    big = pix(spark, sf_dir).withColumn("v", F.col("v") * 1000)
    return stencil.adaptive_threshold(big, height(spark, sf_dir), F.lit(WIDTH))


def _lab_sql() -> str:
    linear = ", ".join(f"CASE WHEN {c} / 255.0 > 0.04045 THEN (({c} / 255.0 + 0.055) / 1.055) ** 2.4 ELSE {c} / 255.0 / 12.92 END AS l{c}" for c in "rgb")
    xyz = ", ".join(f"({' + '.join(f'l{c} * {w}' for c, w in zip('rgb', row, strict=True))}) / {white} AS {axis}" for axis, row, white in zip("xyz", bm.TO_XYZ, bm.WHITE, strict=True))
    f = ", ".join(f"CASE WHEN {a} > 0.008856 THEN {a} ** (1 / 3.0) ELSE 7.787 * {a} + 16 / 116.0 END AS f{a}" for a in "xyz")
    whole = lambda v: f"CAST(floor(greatest(0, least(255, {v})) + 0.5) AS INTEGER)"
    return f"""WITH {RGB8}, li AS (SELECT row, col, {linear} FROM rgb), xyz AS (SELECT row, col, {xyz} FROM li), f AS (SELECT row, col, y, {f} FROM xyz)
 SELECT row, col, {whole("(CASE WHEN y > 0.008856 THEN 116 * fy - 16 ELSE 903.3 * y END) * 255 / 100")} AS l, {whole("500 * (fx - fy) + 128")} AS a, {whole("200 * (fy - fz) + 128")} AS b FROM f"""


@query(_lab_sql())
def rgb_to_lab(spark, sf_dir):
    c = rgb(spark, sf_dir)
    return c.withColumn("x", bm.lab(c.r, c.g, c.b)).select("row", "col", "x.l", "x.a", "x.b")


@query()
def wow_chain(spark, sf_dir):
    """Enlargement, local contrast of the lightness, sharpening, saturated greens."""
    return enhance.super_resolve(rgb(spark, sf_dir).select("row", "col", "r", "g", "b"), height(spark, sf_dir), F.lit(16), enhance.STYLES["wow"], 2)


@query()
def farm_chain(spark, sf_dir):
    return enhance.super_resolve(rgb(spark, sf_dir).select("row", "col", "r", "g", "b"), height(spark, sf_dir), F.lit(16), enhance.STYLES["farm"], 2)
