"""Queries on what the services around the rasters do: areas and roads from JSON, orders, polling, queues, models, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolith.functions import bandmath as bm
from agrolith.operators import catalog, enhance, grid, jobs, layers
from agrolith.plans.more_queries import JOBS, job_events
from agrolith.plans.queries import NDVI, STACK, query, r6, stack, table
from agrolith.sources import geojson

_KINDS = """CASE n_nationkey % 4 WHEN 0 THEN 'FeatureCollection' WHEN 1 THEN 'Feature' WHEN 2 THEN 'Polygon' ELSE 'MultiPolygon' END"""


@query(f"SELECT n_nationkey, {_KINDS} AS kind, 4 AS points, CAST(n_nationkey + 1 AS DOUBLE) AS east FROM nation")
def area_from_json(spark, sf_dir):
    """An area in each form that a request can have."""
    n = table(spark, sf_dir, "nation")
    k = (n.n_nationkey + 1).cast("string")
    ring = F.concat(F.lit("[[[0,0],["), k, F.lit(",0],["), k, F.lit(",1],[0,0]]]"))
    polygon = F.concat(F.lit('{"type":"Polygon","coordinates":'), ring, F.lit("}"))
    feature = F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), polygon, F.lit("}"))
    whole = F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit("]}"))
    many = F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), ring, F.lit("]}"))
    text = F.when(n.n_nationkey % 4 == 0, whole).when(n.n_nationkey % 4 == 1, feature).when(n.n_nationkey % 4 == 2, polygon).otherwise(many)
    rings = n.select("n_nationkey", F.get_json_object(text, "$.type").alias("kind"), geojson.checked_ring(text).alias("ring"))
    return rings.select("n_nationkey", "kind", F.size("ring").alias("points"), F.array_max(F.transform("ring", lambda p: p["x"])).alias("east"))


_CLASS = "['primary', 'footway', 'residential', 'track'][s_suppkey % 4 + 1]"


@query(f"WITH w AS (SELECT {_CLASS} AS highway, s_suppkey % 3 + 1 AS points FROM supplier) SELECT highway, count(*) AS ways, CAST(sum(points - 1) AS BIGINT) AS segments FROM w WHERE points >= 2 AND highway <> 'footway' GROUP BY highway")
def road_ways(spark, sf_dir):
    """Ways of road classes with two points at least, and their segments."""
    s = table(spark, sf_dir, "supplier")
    highway = F.element_at(F.lit(["primary", "footway", "residential", "track"]), (s.s_suppkey % 4 + 1).cast("int"))
    points = F.transform(F.sequence(F.lit(0), (s.s_suppkey % 3).cast("int")), lambda i: F.struct(i.cast("double").alias("lat"), s.s_suppkey.cast("double").alias("lon")))
    element = F.struct(F.lit("way").alias("type"), points.alias("geometry"), F.create_map(F.lit("highway"), highway).alias("tags"))
    found = geojson.ways(s.select(F.to_json(F.struct(F.array(element).alias("elements"))).alias("value")))
    each = found.withColumn("n", F.size("line") - 1)
    return each.groupBy("highway").agg(F.count(F.lit(1)).alias("ways"), F.sum("n").alias("segments"))


_MOVES = ", ".join(f"'{k}>{a}>{b}'" for k, moves in jobs.MOVES.items() for a, b in moves)


@query(
    f"""WITH {JOBS}, l AS (SELECT ['sr', 'wow', 'vectors', 'pipeline'][job_id % 4 + 1] AS kind, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS before, status AS after FROM ev)
 SELECT kind, before, after, count(*) AS n, after IN ('failed', 'cancelled', 'error') OR kind || '>' || before || '>' || after IN ({_MOVES}) AS legal FROM l WHERE before IS NOT NULL GROUP BY kind, before, after"""
)
def job_kind_transitions(spark, sf_dir):
    e = job_events(spark, sf_dir)
    return jobs.transitions_by_kind(e.withColumn("kind", F.element_at(F.lit(["sr", "wow", "vectors", "pipeline"]), (F.col("job_id") % 4 + 1).cast("int"))), "kind")


@query(
    f"""WITH {JOBS}, j AS (SELECT job_id, min(ts) AS a, min(ts) FILTER (status IN ('completed', 'failed')) AS b, arg_min(status, (ts, event_id)) FILTER (status IN ('completed', 'failed')) AS status FROM ev GROUP BY job_id),
 k AS (SELECT *, CASE WHEN b IS NOT NULL THEN greatest(CAST(ceil((epoch_us(b) - epoch_us(a)) / 1e6 / 3600) AS BIGINT), 0) END AS needed FROM j), t AS (SELECT *, coalesce(needed <= 48, false) AS ok FROM k)
 SELECT job_id, CASE WHEN ok THEN needed ELSE 48 END + 1 AS polls, CASE WHEN ok THEN needed * 3600.0 ELSE 172800.0 END AS waited, CASE WHEN ok THEN status ELSE 'timeout' END AS seen FROM t"""
)
def order_polls(spark, sf_dir):
    """Orders that a client asks for every hour, two days long."""
    e = job_events(spark, sf_dir)
    done = F.col("status").isin("completed", "failed")
    ends = e.groupBy("job_id").agg(F.min("ts").alias("started"), F.min(F.when(done, F.col("ts"))).alias("ended"), F.min(F.when(done, F.struct("ts", "event_id", "status"))).alias("m"))
    return jobs.polled(ends.select("job_id", "started", "ended", F.col("m.status").alias("status")), 3600.0, 172_800.0).select("job_id", "polls", "waited", "seen")


@query(
    f"""WITH {JOBS}, q AS (SELECT event_id, job_id % 5 AS queue, epoch_us(ts) / 1e6 AS arrived, 1000.0 + event_id % 7 * 600 AS seconds FROM ev WHERE status = 'queued'),
 t AS (SELECT *, sum(seconds) OVER w AS total FROM q WINDOW w AS (PARTITION BY queue ORDER BY arrived, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT event_id, queue, round(total + max(arrived - total + seconds) OVER w - seconds, 3) AS begins, round(total + max(arrived - total + seconds) OVER w, 3) AS ends FROM t WINDOW w AS (PARTITION BY queue ORDER BY arrived, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def queue_times(spark, sf_dir):
    """When queued requests begin and end if each queue runs one at a time."""
    e = job_events(spark, sf_dir).where("status = 'queued'")
    q = e.select("event_id", (F.col("job_id") % 5).alias("queue"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("arrived"), (F.lit(1000.0) + F.col("event_id") % 7 * 600).alias("seconds"))
    return jobs.one_at_a_time(q, "queue").select("event_id", "queue", F.round("begins", 3).alias("begins"), F.round("ends", 3).alias("ends"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'edsr_x4' WHEN 1 THEN 'realesrgan_anime' WHEN 2 THEN 'bilinear' ELSE 'bilinear' END AS used FROM part")
def model_fallback(spark, sf_dir):
    """A model that is there; one of a family that is there; one of no family."""
    asked = F.element_at(F.lit(["edsr_x4", "realesrgan_x8", "bilinear", "swinir_large"]), (F.col("p_size") % 4 + 1).cast("int"))
    available = spark.createDataFrame([("edsr_x4",), ("realesrgan_anime",), ("realesrgan_x4",), ("bilinear",)], "model string")
    return enhance.fallback_models(table(spark, sf_dir, "part").select("p_partkey", asked.alias("model")), available).select("p_partkey", "used")


@query("SELECT o_custkey, max(o_orderpriority || '/' || o_orderkey || '.tif') AS path FROM orders GROUP BY o_custkey")
def last_source_file(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return catalog.last_path(o.select("o_custkey", F.concat("o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".tif")).alias("path")), "o_custkey")


@query("SELECT p_brand, p_partkey AS part, p_retailprice AS area FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1")
def largest_part(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return catalog.largest_part(p.select("p_brand", F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("area")), "p_brand")


@query(f"WITH {STACK} SELECT row, col, round({NDVI}, 6) AS ndvi FROM stack WHERE red > 0 AND nir > 0")
def valid_mask_bands(spark, sf_dir):
    """Without a class band, pixels with light in both bands are valid."""
    s = stack(spark, sf_dir)
    return s.where(bm.lit_pixels(s.red, s.nir)).select("row", "col", r6(bm.ndvi_clipped(s.nir, s.red)).alias("ndvi"))


@query(f"WITH {STACK} SELECT row, col, round(red, 6) AS red, round(CASE WHEN row % 2 = 0 THEN green ELSE red END, 6) AS green, round(CASE WHEN row % 2 = 0 THEN blue ELSE red END, 6) AS blue FROM stack")
def rgb_composite(spark, sf_dir):
    """Rasters of three bands, and of one band three times."""
    s = stack(spark, sf_dir)
    both = layers.rgb_of(s.where("row % 2 = 0"), "red", "green", "blue").unionByName(layers.rgb_of(s.where("row % 2 = 1"), "red"))
    return both.select("row", "col", *(r6(c).alias(c) for c in ("red", "green", "blue")))


@query(f"WITH {STACK} SELECT row, col, round(-121.7 + 0.0125 * (col + 0.5) / 4, 9) AS x, round(36.7 - 0.0075 * (row + 0.5) / 4, 9) AS y FROM stack")
def pixel_coordinates(spark, sf_dir):
    """Centres of an enlarged raster's pixels."""
    affine = grid.rescaled({"a": 0.0125, "c": -121.7, "e": -0.0075, "f": 36.7}, 4)
    x, y = grid.world(F.col("row"), F.col("col"), affine)
    return stack(spark, sf_dir).select("row", "col", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"))


@query("SELECT event_id, event_id % 3 = 0 AS is_pipeline FROM events")
def pipeline_jobs(spark, sf_dir):
    """Jobs of a pipeline have ids of their own kind."""
    e = table(spark, sf_dir, "events")
    job = F.concat(F.when(e.event_id % 3 == 0, "pipeline_").otherwise("sr_"), F.date_format("ts", "yyyyMMdd_HHmmss"))
    return e.select("event_id", job.startswith("pipeline_").alias("is_pipeline"))
