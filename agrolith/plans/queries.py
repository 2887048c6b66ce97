"""Registered queries over the driver's tables with their DuckDB forms. Rasters, catalogues and jobs are derived from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolith.functions import bandmath as bm
from agrolith.functions import geometry as geo
from agrolith.operators import grid, segment, stencil, zonal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column) -> Column:
    return F.round(x, 6)


# --- rasters ---------------------------------------------------------------------------------------------------------------------------

WIDTH = 64
PIX = "pix AS (SELECT vec_id AS row, p AS col, CAST(embedding[p + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(64)) AS p))"
STACK = """stack AS (SELECT vec_id AS row, p AS col, abs(CAST(embedding[p + 1] AS DOUBLE)) AS red, abs(CAST(embedding[p + 17] AS DOUBLE)) AS nir,
 abs(CAST(embedding[p + 33] AS DOUBLE)) AS green, abs(CAST(embedding[p + 49] AS DOUBLE)) AS blue, label AS scl FROM embeddings, (SELECT unnest(range(16)) AS p))"""
RGB8 = f"""{STACK}, rgb AS (SELECT row, col, scl, floor(least(1.0, red) * 255) AS r, floor(least(1.0, green) * 255) AS g, floor(least(1.0, blue) * 255) AS b FROM stack)"""
POINTS = "pts AS (SELECT event_id % 100 AS col, event_id // 100 AS row, -121.7327 + (event_id % 100) * 0.0014 AS lon, 36.6132 + (event_id // 100) * 0.00083 AS lat, value AS v FROM events)"


def neighbour_ctes(source: str = "pix") -> str:
    """CTE n: each pixel of a CTE (row, col, v) with its neighbours."""
    return f"""nb AS (SELECT row, col, v, coalesce(lag(v) OVER r, v) AS m, coalesce(lead(v) OVER r, v) AS p FROM {source} WINDOW r AS (PARTITION BY row ORDER BY col)),
 n AS (SELECT row, col, v AS zz, m AS zm, p AS zp, coalesce(lag(v) OVER c, v) AS mz, coalesce(lag(m) OVER c, m) AS mm, coalesce(lag(p) OVER c, p) AS mp,
 coalesce(lead(v) OVER c, v) AS pz, coalesce(lead(m) OVER c, m) AS pm, coalesce(lead(p) OVER c, p) AS pp FROM nb WINDOW c AS (PARTITION BY col ORDER BY row))"""


GRADIENT = "SELECT row, col, sqrt(gx * gx + gy * gy) AS gradient FROM (SELECT row, col, (mp - mm) + 2 * (zp - zm) + (pp - pm) AS gx, (pm - mm) + 2 * (pz - mz) + (pp - mp) AS gy FROM n)"


def blur_ctes(weights: list[float], source: str = "pix", width: int = WIDTH) -> str:
    """CTE g: a CTE (row, col, v) under a separable kernel, edges reflected."""
    values = ", ".join(f"({k - len(weights) // 2}, CAST({w!r} AS DOUBLE))" for k, w in enumerate(weights))
    return f"""k(k, w) AS (VALUES {values}), h AS (SELECT max(row) + 1 AS n FROM {source}),
 a AS (SELECT t.row, t.col, sum(s.v * w) AS v FROM {source} t CROSS JOIN k JOIN {source} s ON s.row = t.row AND s.col = CASE WHEN t.col + k < 0 THEN -1 - t.col - k WHEN t.col + k >= {width} THEN {2 * width - 1} - t.col - k ELSE t.col + k END GROUP BY 1, 2),
 g AS (SELECT t.row, t.col, sum(s.v * w) AS v FROM a t CROSS JOIN h CROSS JOIN k JOIN a s ON s.col = t.col AND s.row = CASE WHEN t.row + k < 0 THEN -1 - t.row - k WHEN t.row + k >= n THEN 2 * n - 1 - t.row - k ELSE t.row + k END GROUP BY 1, 2)"""


def pix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.pixels(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def height(spark: SparkSession, sf_dir: str) -> Column:
    return F.lit((table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1)


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """red, nir, green and blue from 16 dimensions each, the class from the label."""
    bands = F.arrays_zip(*(F.slice("embedding", k * 16 + 1, 16).alias(n) for k, n in enumerate(("red", "nir", "green", "blue"))))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.col("label").alias("scl"), F.posexplode(bands).alias("col", "b"))
    return rows.select("row", "col", *(F.abs(F.col(f"b.{n}").cast("double")).alias(n) for n in ("red", "nir", "green", "blue")), "scl")


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = lambda c: F.floor(F.least(F.lit(1.0), F.col(c)) * 255).cast("double")
    return stack(spark, sf_dir).select("row", "col", "scl", byte("red").alias("r"), byte("green").alias("g"), byte("blue").alias("b"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    col, row = F.col("event_id") % 100, F.expr("event_id div 100")
    return e.select(col.alias("col"), row.alias("row"), (F.lit(-121.7327) + col * 0.0014).alias("lon"), (F.lit(36.6132) + row * 0.00083).alias("lat"), F.col("value").alias("v"))


NDVI = "CASE WHEN nir + red > 0 THEN (nir - red) / (nir + red) ELSE 0 END"


@query(f"WITH {STACK} SELECT row, col, round({NDVI}, 6) AS ndvi FROM stack")
def ndvi(spark, sf_dir):
    return stack(spark, sf_dir).select("row", "col", r6(bm.ndvi(F.col("nir"), F.col("red"))).alias("ndvi"))


@query(f"WITH {STACK} SELECT row, col, round({NDVI}, 6) AS ndvi FROM stack WHERE scl IN (4, 5, 6, 7) AND red > 0 AND nir > 0")
def valid_mask_scl(spark, sf_dir):
    s = stack(spark, sf_dir)
    return s.where(bm.clear_land(s.scl, s.red, s.nir)).select("row", "col", r6(bm.ndvi_clipped(s.nir, s.red)).alias("ndvi"))


_VARI = "(green - red) / CASE WHEN abs(green + red - blue) > 0.01 THEN green + red - blue ELSE 0.01 END"
_EXG = "(2 * green - red - blue) / greatest(red + green + blue, 0.01)"


@query(
    f"""WITH {STACK} SELECT row, col, round({_VARI}, 6) AS vari, round({_EXG}, 6) AS exg,
 round(greatest(-1, least(1, 0.6 * greatest(-1, least(1, {_VARI})) + 0.4 * greatest(-1, least(1, 2 * {_EXG})))), 6) AS veg FROM stack
 WHERE (red + green + blue) / 3 > 0.05 AND (red + green + blue) / 3 < 0.95"""
)
def vari_exg_index(spark, sf_dir):
    s = stack(spark, sf_dir)
    rgb_ = (s.red, s.green, s.blue)
    return s.where(bm.well_lit(bm.brightness(*rgb_))).select("row", "col", r6(bm.vari(*rgb_)).alias("vari"), r6(bm.excess_green(*rgb_)).alias("exg"), r6(bm.vegetation_index(*rgb_)).alias("veg"))


@query(f"WITH {STACK} SELECT row, col, band, round(CASE WHEN band = 'scl' THEN v ELSE v / 10000 END, 6) AS v FROM (SELECT row, col, unnest(['red', 'nir', 'scl']) AS band, unnest([red * 10000, nir * 10000, scl]) AS v FROM stack)")
def reflectance_scale(spark, sf_dir):
    long = stack(spark, sf_dir).select("row", "col", F.explode(F.map_from_arrays(F.lit(["red", "nir", "scl"]), F.array(F.col("red") * 10000, F.col("nir") * 10000, F.col("scl").cast("double")))).alias("band", "v"))
    return long.select("row", "col", "band", r6(bm.reflectance(F.col("v"), F.col("band"))).alias("v"))


@query("WITH s AS (SELECT event_id, value, min(value) OVER () AS lo, max(value) OVER () AS hi FROM events) SELECT event_id, CAST(CASE WHEN hi > 255 THEN floor((value - lo) / (hi - lo) * 255) ELSE floor(value) END AS INTEGER) AS v FROM s")
def uint8_stretch(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value")
    ends = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return e.crossJoin(F.broadcast(ends)).select("event_id", bm.stretch_uint8(F.col("value"), F.col("lo"), F.col("hi")).alias("v"))


@query(
    f"""WITH {STACK}, m AS (SELECT max(greatest(red, green, blue)) AS hi FROM stack) SELECT row, col,
 round(CASE WHEN hi > 1.5 THEN red / 255 ELSE red END, 6) AS unit, round(CASE WHEN hi > 255 THEN red / hi * 255 ELSE red END, 6) AS scaled FROM stack, m"""
)
def global_normalise(spark, sf_dir):
    s = stack(spark, sf_dir)
    top = s.agg(F.max(F.greatest("red", "green", "blue")).alias("hi"))
    return s.crossJoin(F.broadcast(top)).select("row", "col", r6(bm.unit_range(s.red, F.col("hi"))).alias("unit"), r6(bm.scaled_rgb(s.red, F.col("hi"))).alias("scaled"))


_ZSTAT = "count(n) AS n, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, round(quantile_cont(n, 0.1), 6) AS p10, round(quantile_cont(n, 0.9), 6) AS p90"


def field_ndvi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDVI of clear pixels with the field they lie in: blocks of 10 rows and 8 columns."""
    s = stack(spark, sf_dir)
    kept = s.where(bm.clear_land(s.scl, s.red, s.nir))
    return kept.select((F.floor(F.col("row") / 10) * 100 + F.floor(F.col("col") / 8)).cast("bigint").alias("field"), "row", "col", bm.ndvi(s.nir, s.red).alias("n"))


FIELDS = f"{STACK}, f AS (SELECT row // 10 * 100 + col // 8 AS field, row, col, {NDVI} AS n FROM stack WHERE scl IN (4, 5, 6, 7) AND red > 0 AND nir > 0)"


@query(f"WITH {FIELDS} SELECT field, {_ZSTAT}, round(quantile_cont(n, 0.9) - quantile_cont(n, 0.1), 6) AS range FROM f GROUP BY field")
def zonal_stats(spark, sf_dir):
    z = zonal.statistics(field_ndvi(spark, sf_dir), "field", "n")
    return z.select("field", "n", *(r6(F.col(c)).alias(c) for c in ("mean", "std", "p10", "p90", "range")))


_STEADY = "CASE WHEN std < 0.1 THEN 0.15 WHEN std < 0.2 THEN 0.1 WHEN std < 0.3 THEN 0.05 ELSE 0 END"


_CROSS2 = "x(r, c) AS (VALUES " + ", ".join(f"({r}, {c})" for r in range(-2, 3) for c in range(-2, 3) if abs(r) + abs(c) <= 2) + ")"


@query(
    f"""WITH {FIELDS}, nd AS (SELECT row, col, greatest(-1, least(1, {NDVI})) AS v, row // 10 * 100 + col // 8 AS field FROM stack), {neighbour_ctes("nd")}, grad AS ({GRADIENT}), {_CROSS2},
 m AS (SELECT nd.* FROM nd SEMI JOIN f USING (field)), ring AS (SELECT DISTINCT field, row + r AS row, col + c AS col FROM m, x EXCEPT SELECT field, row, col FROM m),
 e AS (SELECT field, avg(gradient) AS edge FROM ring JOIN grad USING (row, col) GROUP BY field), s AS (SELECT field, max(row) - min(row) + 1 AS h, max(col) - min(col) + 1 AS w FROM m GROUP BY field),
 z AS (SELECT field, count(n) AS n, avg(n) AS mean, stddev_pop(n) AS std FROM f GROUP BY field) SELECT field, n, round(mean, 6) AS mean, round(coalesce(edge, 0), 6) AS edge,
 round(greatest(0.1, least(1.0, 0.5 + least(2 * coalesce(edge, 0), 0.2) + 0.15 * (4 * pi() * h * w / (4.0 * (h + w) * (h + w))) + {_STEADY} + 0.1)), 6) AS confidence FROM z JOIN s USING (field) LEFT JOIN e USING (field)"""
)
def ndvi_zonal_confidence(spark, sf_dir):
    """Flagship: bands to NDVI; by field the statistics of clear pixels, the gradient on the ring around it, its shape, and the confidence."""
    s = stack(spark, sf_dir)
    zone = (F.floor(F.col("row") / 10) * 100 + F.floor(F.col("col") / 8)).cast("bigint")
    index = s.select("row", "col", bm.ndvi_clipped(s.nir, s.red).alias("v"))
    z = zonal.statistics(field_ndvi(spark, sf_dir), "field", "n")
    members = index.select(zone.alias("field"), "row", "col").join(z.select("field"), "field", "left_semi")
    ring = stencil.ring(members.withColumnRenamed("field", "zone"), 2, height(spark, sf_dir), F.lit(16))
    edge = zonal.edge_strength(ring, stencil.sobel(index).select("row", "col", "gradient"), "zone").withColumnRenamed("zone", "field")
    outline = geo.box(*(x.cast("double") for x in (F.min("col"), F.min("row"), F.max("col") + 1, F.max("row") + 1)))
    shape = members.groupBy("field").agg(outline.alias("ring")).select("field", bm.compactness(geo.area(F.col("ring")), geo.perimeter(F.col("ring"))).alias("compact"))
    found = z.join(shape, "field").join(edge, "field", "left").withColumn("edge", F.coalesce("edge", F.lit(0.0)))
    return found.select("field", "n", r6("mean").alias("mean"), r6("edge").alias("edge"), r6(bm.confidence_v2(F.col("edge"), F.col("compact"), F.col("std"), True)).alias("confidence"))


@query("SELECT p_partkey, round(greatest(0.1, least(1.0, 0.7 * CASE WHEN ha BETWEEN 1 AND 50 THEN 1.0 WHEN ha BETWEEN 0.5 AND 100 THEN 0.8 ELSE 0.6 END * (0.7 + 0.3 * least(c, 1.0)))), 6) AS confidence FROM (SELECT p_partkey, p_retailprice / 20 AS ha, p_size / 50.0 AS c FROM part)")
def field_confidence_v1(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", r6(bm.confidence_v1(p.p_retailprice / 20, p.p_size / 50.0, True)).alias("confidence"))


@query(f"WITH {STACK} SELECT row // 4 AS row, col // 4 AS col, round(avg(red), 6) AS red, arg_min(scl, row * 1000 + col) AS scl FROM stack GROUP BY row // 4, col // 4")
def downsample(spark, sf_dir):
    return grid.downsample(stack(spark, sf_dir), 4, ["red"], ["scl"]).select("row", "col", r6("red").alias("red"), "scl")


@query(f"WITH {STACK} SELECT a.row, a.col, round(a.red, 6) AS red, round(b.nir, 6) AS nir, coalesce(c.scl, 0) AS scl FROM stack a JOIN stack b USING (row, col) LEFT JOIN (SELECT row, col, scl FROM stack WHERE scl < 5) c USING (row, col)")
def band_alignment(spark, sf_dir):
    s = stack(spark, sf_dir)
    a = grid.align(s.select("row", "col", "red"), nir=s.select("row", "col", "nir"), scl=s.where("scl < 5").select("row", "col", "scl"))
    return a.select("row", "col", r6("red").alias("red"), r6("nir").alias("nir"), "scl")


@query(f"WITH {STACK} SELECT row * 2 + i AS row, col * 2 + j AS col, round(red, 6) AS red FROM stack, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)")
def resample_nearest(spark, sf_dir):
    return grid.upsample_nearest(stack(spark, sf_dir).select("row", "col", "red"), 2).select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), r6("red").alias("red"))


@query(f"WITH {POINTS} SELECT row, col, round(v, 6) AS v FROM pts WHERE lon BETWEEN -121.70 AND -121.65 AND lat BETWEEN 36.62 AND 36.66")
def aoi_crop(spark, sf_dir):
    p = points(spark, sf_dir)
    return grid.crop(p, p.lon.between(-121.70, -121.65) & p.lat.between(36.62, 36.66)).select("row", "col", r6("v").alias("v"))


@query(f"WITH {PIX}, w AS (SELECT *, row // 64 + i AS cy, col // 64 + j AS cx, i = 0 AND j = 0 AS own FROM pix, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)) SELECT cy, cx, count(*) AS pixels, count(*) FILTER (own) AS own_pixels FROM w WHERE cy >= 0 AND cx >= 0 AND row >= cy * 64 - 10 AND row < (cy + 1) * 64 + 10 AND col >= cx * 64 - 10 AND col < (cx + 1) * 64 + 10 GROUP BY cy, cx")
def halo_tiles(spark, sf_dir):
    return grid.with_margin(pix(spark, sf_dir), 64, 10).groupBy("cy", "cx").agg(F.count(F.lit(1)).alias("pixels"), F.count_if("own").alias("own_pixels"))


# --- stencils --------------------------------------------------------------------------------------------------------------------------


def _neighbour_sql(pairs: str) -> str:
    return f"WITH {PIX}, {neighbour_ctes()} {pairs}"


@query(_neighbour_sql(f"SELECT row, col, round(gradient, 6) AS gradient FROM ({GRADIENT})"))
def sobel_gradient(spark, sf_dir):
    return stencil.sobel(pix(spark, sf_dir)).select("row", "col", r6("gradient").alias("gradient"))


@query(
    _neighbour_sql(
        """SELECT row, col, round(greatest(0, least(255, (abs(2 * (zm + zz + zp) - mm - mz - mp - pm - pz - pp) + abs(2 * (mz + zz + pz) - mm - zm - pm - mp - zp - pp)
 + abs(2 * (mm + zz + pp) - mz - mp - zm - zp - pm - pz) + abs(2 * (mp + zz + pm) - mm - mz - zm - zp - pz - pp)) / 4)), 6) AS edge FROM n"""
    )
)
def directional_edges(spark, sf_dir):
    return stencil.directional_edges(pix(spark, sf_dir)).select("row", "col", r6("edge").alias("edge"))


@query(f"WITH {PIX}, {blur_ctes(stencil.gaussian_weights(1.5))} SELECT row, col, round(v, 6) AS v FROM g")
def gaussian_blur(spark, sf_dir):
    return stencil.gaussian(pix(spark, sf_dir), 1.5, height(spark, sf_dir), F.lit(WIDTH)).select("row", "col", r6("v").alias("v"))


@query(f"WITH {PIX}, {blur_ctes(stencil.gaussian_weights(1.2))} SELECT row, col, round(greatest(0, least(255, 1.4 * p.v - 0.4 * g.v)), 6) AS v FROM g JOIN pix p USING (row, col)")
def unsharp(spark, sf_dir):
    return stencil.unsharp(pix(spark, sf_dir), 0.4, 1.2, height(spark, sf_dir), F.lit(WIDTH)).select("row", "col", r6("v").alias("v"))


@query(f"WITH {PIX}, a AS (SELECT row, col, max(v) OVER (PARTITION BY row ORDER BY col RANGE BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS v FROM pix) SELECT row, col, round(max(v) OVER (PARTITION BY col ORDER BY row RANGE BETWEEN 10 PRECEDING AND 9 FOLLOWING), 6) AS v FROM a")
def max_filter(spark, sf_dir):
    return stencil.windowed(pix(spark, sf_dir), "max", 10, 9).select("row", "col", r6("v").alias("v"))


def mask(spark: SparkSession, sf_dir: str, least: float = 0.15) -> DataFrame:
    return pix(spark, sf_dir).where(F.col("v") > least).select("row", "col")


def _mask_sql(least: float = 0.15) -> str:
    return f"{PIX}, mask AS (SELECT row, col FROM pix WHERE v > {least}), h AS (SELECT max(row) + 1 AS n FROM pix)"


_RING2 = ", ".join(f"({r}, {c})" for r in range(-2, 3) for c in range(-2, 3) if abs(r) + abs(c) <= 2)


@query(f"WITH {_mask_sql()}, o(r, c) AS (VALUES {_RING2}), d AS (SELECT DISTINCT row + r AS row, col + c AS col FROM mask, o, h WHERE row + r BETWEEN 0 AND n - 1 AND col + c BETWEEN 0 AND 63) SELECT row, col FROM d EXCEPT SELECT row, col FROM mask")
def dilate_ring(spark, sf_dir):
    return stencil.ring(mask(spark, sf_dir), 2, height(spark, sf_dir), F.lit(WIDTH))


_ELL = ", ".join(f"({r}, {c})" for r, c in stencil.ELLIPSE_5)


def _morph_sql() -> str:
    ctes, last = [_mask_sql(), f"o(r, c) AS (VALUES {_ELL})", "full_ AS (SELECT row, col FROM pix)"], "mask"
    for k, step in enumerate("ddeeeedd"):
        if step == "d":
            ctes.append(f"s{k} AS (SELECT DISTINCT row + r AS row, col + c AS col FROM {last}, o, h WHERE row + r BETWEEN 0 AND n - 1 AND col + c BETWEEN 0 AND 63)")
        else:
            ctes.append(f"u{k} AS (SELECT row, col FROM full_ EXCEPT SELECT row, col FROM {last})")
            ctes.append(f"s{k} AS (SELECT row, col FROM full_ EXCEPT SELECT row - r, col - c FROM u{k}, o)")
        last = f"s{k}"
    return f"WITH {', '.join(ctes)} SELECT row, col FROM {last}"


@query(_morph_sql())
def morph_open_close(spark, sf_dir):
    return stencil.close_open(mask(spark, sf_dir), height(spark, sf_dir), F.lit(WIDTH))


# --- colour ----------------------------------------------------------------------------------------------------------------------------

_HSV = f"""{RGB8}, x AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d FROM rgb), y AS (SELECT *, CASE WHEN d <= 0 THEN 0 WHEN hi = r THEN 60 * (g - b) / d WHEN hi = g THEN 120 + 60 * (b - r) / d
 ELSE 240 + 60 * (r - g) / d END AS t FROM x), hsv AS (SELECT row, col, scl, CAST(floor(CASE WHEN t < 0 THEN t + 360 ELSE t END / 2 + 0.5) AS INTEGER) % 180 AS h, CAST(floor(CASE WHEN hi > 0 THEN d * 255 / hi ELSE 0 END + 0.5) AS INTEGER) AS s, CAST(hi AS INTEGER) AS v FROM y)"""


def hsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rgb(spark, sf_dir)
    return c.withColumn("x", bm.hsv(c.r, c.g, c.b)).select("row", "col", "scl", "x.h", "x.s", "x.v")


@query(f"WITH {_HSV} SELECT row, col, h, s, v FROM hsv")
def rgb_to_hsv(spark, sf_dir):
    return hsv(spark, sf_dir).select("row", "col", "h", "s", "v")


@query(f"WITH {_HSV} SELECT scl, count(*) AS n, count(*) FILTER ((h BETWEEN 35 AND 85 AND s >= 30 AND v >= 30) OR (h BETWEEN 10 AND 35 AND s BETWEEN 20 AND 200 AND v BETWEEN 40 AND 200)) AS crops FROM hsv GROUP BY scl")
def hsv_vegetation_mask(spark, sf_dir):
    c = hsv(spark, sf_dir)
    return c.groupBy("scl").agg(F.count(F.lit(1)).alias("n"), F.count_if(bm.green_or_brown(c.h, c.s, c.v)).alias("crops"))


@query(f"WITH {_HSV} SELECT row, col, round(CASE WHEN h > 35 AND h < 85 THEN least(255.0, s * 1.2) ELSE s END, 6) AS s FROM hsv")
def vegetation_boost(spark, sf_dir):
    c = hsv(spark, sf_dir)
    return c.select("row", "col", r6(bm.boosted_saturation(c.h, c.s)).alias("s"))


@query(f"WITH {RGB8} SELECT row, col, round(0.299 * r + 0.587 * g + 0.114 * b, 6) AS gray FROM rgb")
def gray(spark, sf_dir):
    c = rgb(spark, sf_dir)
    return c.select("row", "col", r6(bm.gray(c.r, c.g, c.b)).alias("gray"))


# --- segments and zones ----------------------------------------------------------------------------------------------------------------

_COMP = f"""WITH RECURSIVE {_mask_sql(0.27)}, m AS (SELECT row, col, row * 64 + col AS id FROM mask),
 e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON abs(a.row - b.row) + abs(a.col - b.col) = 1),
 r(id, root) AS (SELECT id, id FROM m UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b), l AS (SELECT id // 64 AS row, id % 64 AS col, min(root) AS label FROM r GROUP BY id)"""


@query(_COMP + " SELECT row, col, label FROM l")
def connected_components(spark, sf_dir):
    return segment.components(mask(spark, sf_dir, 0.27), F.lit(WIDTH)).select("row", "col", "label")


@query(_COMP.replace("v > 0.27", "v > 0.2") + " SELECT row, col, label FROM l WHERE label IN (SELECT label FROM l GROUP BY label HAVING count(*) >= 3)")
def min_region_filter(spark, sf_dir):
    return segment.min_regions(segment.components(mask(spark, sf_dir, 0.2), F.lit(WIDTH)), 3)


_DISK = ", ".join(f"({r}, {c}, {r * r + c * c})" for r in range(-4, 5) for c in range(-4, 5) if 0 < r * r + c * c <= 16)


@query(f"WITH {_mask_sql(0.0)}, o(r, c, d) AS (VALUES {_DISK}), g AS (SELECT row, col FROM pix WHERE v <= 0.0), s AS (SELECT row + r AS row, col + c AS col, min(d) AS d FROM g, o GROUP BY 1, 2) SELECT row, col, round(coalesce(sqrt(d), 5.0), 6) AS distance FROM mask LEFT JOIN s USING (row, col)")
def distance_transform(spark, sf_dir):
    p = pix(spark, sf_dir)
    return segment.distances(p.where("v > 0.0"), p.where("v <= 0.0")).select("row", "col", r6("distance").alias("distance"))


@query(
    f"""WITH RECURSIVE {_mask_sql(-0.1)}, ground AS (SELECT row, col FROM pix WHERE v <= -0.1), s(r, c) AS (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)),
 open_ AS (SELECT row, col FROM ground, h WHERE row = 0 OR col = 0 OR row = n - 1 OR col = 63 UNION SELECT g.row, g.col FROM open_ o CROSS JOIN s JOIN ground g ON g.row = o.row + r AND g.col = o.col + c)
 SELECT row, col FROM pix EXCEPT SELECT row, col FROM open_"""
)
def fill_holes(spark, sf_dir):
    p = pix(spark, sf_dir)
    return segment.fill_holes(p.where("v > -0.1").select("row", "col"), p, height(spark, sf_dir), F.lit(WIDTH))


@query()
def polygonize(spark, sf_dir):
    """Outlines of regions with their area in pixels."""
    rings = segment.polygonize(segment.min_regions(segment.components(mask(spark, sf_dir, 0.2), F.lit(WIDTH)), 3))
    return rings.select("label", "ring_no", r6(geo.signed_area(F.col("ring"))).alias("area"), F.size("ring").cast("bigint").alias("points"))


@query()
def simplify(spark, sf_dir):
    rings = segment.simplify(segment.polygonize(segment.min_regions(segment.components(mask(spark, sf_dir, 0.2), F.lit(WIDTH)), 3)), 1.0)
    return rings.select("label", "ring_no", F.size("ring").cast("bigint").alias("points"), r6(geo.area(F.col("ring"))).alias("area"))


@query()
def watershed_fields(spark, sf_dir):
    """Seeds are local maxima of the value; the whole raster is flooded over the gradient."""
    p = pix(spark, sf_dir)
    seeds = p.join(stencil.windowed(p, "max", 4, 4).withColumnRenamed("v", "top"), ["row", "col"]).where("v = top").select("row", "col", (F.col("row") * WIDTH + F.col("col")).alias("seed"))
    return segment.flood_raster(stencil.sobel(p).join(seeds, ["row", "col"], "left").select("row", "col", F.col("gradient").alias("cost"), "seed"))


@query(f"WITH {FIELDS}, q AS (SELECT field, quantile_cont(n, 1 / 3.0) AS a, quantile_cont(n, 2 / 3.0) AS b FROM f GROUP BY field), z AS (SELECT field, n, 1 + CAST(n > a AS INTEGER) + CAST(n > b AS INTEGER) AS zone_id FROM f JOIN q USING (field)) SELECT field, ['low', 'medium', 'high'][zone_id] AS zone_class, count(n) AS n, round(avg(n), 6) AS mean FROM z GROUP BY field, zone_id")
def zone_quantile_classes(spark, sf_dir):
    z = zonal.zone_means(zonal.quantile_zones(field_ndvi(spark, sf_dir), "field", "n"), "field", "n")
    return z.select("field", geo.zone_name(F.col("zone_id"), 3).alias("zone_class"), "n", r6("mean").alias("mean"))


@query()
def kmeans_zones(spark, sf_dir):
    z = zonal.zone_means(zonal.kmeans_zones(field_ndvi(spark, sf_dir), "field", "n"), "field", "n")
    return z.select("field", geo.zone_name(F.col("zone_id"), 3).alias("zone_class"), "n", r6("mean").alias("mean"))


@query(f"WITH {FIELDS}, z AS (SELECT field // 100 AS block, field, avg(n) AS mean FROM f GROUP BY field) SELECT field, row_number() OVER (ORDER BY block, field) AS field_index, round(mean, 6) AS mean FROM z")
def field_index(spark, sf_dir):
    z = field_ndvi(spark, sf_dir).groupBy("field").agg(F.avg("n").alias("mean")).withColumn("block", F.expr("field div 100"))
    return zonal.numbered(z, "field", "block").select("field", "field_index", r6("mean").alias("mean"))
