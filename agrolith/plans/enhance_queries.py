"""Queries on enhancement and on streams."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from agrolith.operators import enhance, grid
from agrolith.operators import jobs as batch
from agrolith.plans.more_queries import JOBS
from agrolith.plans.queries import PIX, WIDTH, height, pix, query, r6, rgb, table
from agrolith.streaming import jobs, rasters


@query()
def clahe(spark, sf_dir):
    g = rgb(spark, sf_dir).select("row", "col", F.col("g").alias("v"))
    return enhance.clahe(g, height(spark, sf_dir), F.lit(16)).select("row", "col", r6("v").alias("v"))


@query(
    f"""WITH {PIX}, k(k, w) AS (VALUES (-1, CAST(0.25 AS DOUBLE)), (0, CAST(0.75 AS DOUBLE)), (1, CAST(0.75 AS DOUBLE)), (2, CAST(0.25 AS DOUBLE))), h AS (SELECT max(row) + 1 AS n FROM pix),
 a AS (SELECT row, CASE WHEN col * 2 + k < 0 THEN 0 WHEN col * 2 + k > 127 THEN 127 ELSE col * 2 + k END AS col, sum(v * w) AS v FROM pix, k GROUP BY 1, 2),
 b AS (SELECT CASE WHEN row * 2 + k < 0 THEN 0 WHEN row * 2 + k > 2 * n - 1 THEN 2 * n - 1 ELSE row * 2 + k END AS row, col, sum(v * w) AS v FROM a, k, h GROUP BY 1, 2) SELECT row, col, round(v, 6) AS v FROM b"""
)
def upscale_tiled(spark, sf_dir):
    return enhance.upscale_tiled(pix(spark, sf_dir), 2, 64, 10).select("row", "col", r6("v").alias("v"))


@query(
    f"""WITH {PIX}, k(k, w) AS (VALUES (-1, CAST(0.25 AS DOUBLE)), (0, CAST(0.75 AS DOUBLE)), (1, CAST(0.75 AS DOUBLE)), (2, CAST(0.25 AS DOUBLE))), h AS (SELECT max(row) + 1 AS n FROM pix),
 a AS (SELECT row, CASE WHEN col * 2 + k < 0 THEN 0 WHEN col * 2 + k > 127 THEN 127 ELSE col * 2 + k END AS col, sum(v * w) AS v FROM pix, k GROUP BY 1, 2),
 b AS (SELECT CASE WHEN row * 2 + k < 0 THEN 0 WHEN row * 2 + k > 2 * n - 1 THEN 2 * n - 1 ELSE row * 2 + k END AS row, col, sum(v * w) AS v FROM a, k, h GROUP BY 1, 2) SELECT row, col, round(v, 6) AS v FROM b"""
)
def resample_bilinear(spark, sf_dir):
    up = grid.upsample_bilinear(pix(spark, sf_dir), 2, height(spark, sf_dir), F.lit(WIDTH))
    return up.select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), r6("v").alias("v"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 4 END AS scale, p_size % 3 = 0 AS known FROM part")
def model_registry(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "realesrgan_x4").otherwise("realesrgan_x2").alias("model"))
    return enhance.checked_models(p).select("p_partkey", "scale", "known")


def event_stream(spark, sf_dir):
    """The events table as a file stream with the statuses of job_events."""
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    names = F.lit(["queued", "processing", "tiling", "completed", "failed"])
    at = F.array_position(F.lit(["signup", "view", "click", "purchase", "error"]), F.col("event_type"))
    return raw.select("event_id", F.col("user_id").alias("job_id"), "ts", F.element_at(names, at.cast("int")).alias("status"))


@query(f"WITH {JOBS} SELECT job_id, max(struct_pack(t := ts, e := event_id, s := status)).s AS status, count(*) AS n FROM ev GROUP BY job_id")
def stream_job_latest(spark, sf_dir):
    return jobs.run_available(jobs.latest(event_stream(spark, sf_dir)), "complete")


@query(f"WITH {JOBS} SELECT CAST(date_trunc('day', ts) AS VARCHAR)[1:10] AS day, status, count(*) AS n FROM ev GROUP BY 1, 2")
def stream_status_windows(spark, sf_dir):
    found = jobs.run_available(jobs.by_window(event_stream(spark, sf_dir)), "complete")
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "status", "n")


@query(
    f"""WITH {JOBS}, l AS (SELECT job_id, status, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS before FROM ev) SELECT job_id, count(*) AS events,
 count(*) FILTER (before IS NOT NULL AND status <> 'failed' AND before || '>' || status NOT IN ('queued>processing', 'processing>tiling', 'tiling>completed')) AS illegal FROM l GROUP BY job_id"""
)
def stream_job_machine(spark, sf_dir):
    return jobs.run_available(jobs.checked(event_stream(spark, sf_dir), batch.MOVES["sr"]), "update", "job_id").select("job_id", "events", "illegal")


def order_stream(spark, sf_dir):
    """The orders table as a stream of files: customers' rasters, modified on the order's date, and seen some days later."""
    schema = table(spark, sf_dir, "orders").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    return raw.select("o_custkey", F.col("o_orderkey").alias("path"), F.col("o_orderdate").cast("timestamp").alias("modified"), (F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 5).cast("int"))).cast("timestamp").alias("seen"))


@query("SELECT o_custkey, max(struct_pack(d := o_orderdate, k := o_orderkey)).k AS newest FROM orders GROUP BY o_custkey")
def stream_newest_file(spark, sf_dir):
    found = jobs.run_available(rasters.newest(order_stream(spark, sf_dir), "o_custkey"), "update", "o_custkey", rasters.ROCKS)
    return found.select("o_custkey", F.col("path").alias("newest"))


@query(
    """WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER) AS seen FROM orders)
 SELECT o_custkey, max(struct_pack(d := o_orderdate, k := o_orderkey)).k AS newest, max(seen) + 200 <= (SELECT max(seen) FROM s) - 30 AS expired FROM s GROUP BY o_custkey"""
)
def stream_idle_rasters(spark, sf_dir):
    """Customers without a new raster for 200 days, 30 days of them for late ones, expire."""
    found = jobs.run_available(rasters.newest(order_stream(spark, sf_dir), "o_custkey", "30 days", timedelta(days=200)), "update", "o_custkey", rasters.ROCKS)
    return found.select("o_custkey", F.col("path").alias("newest"), "expired")
