"""Queries on requests, metadata, layers and clients."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolith.functions import geometry as geo
from agrolith.functions import records as rec
from agrolith.operators import layers
from agrolith.plans.queries import query, r6, table


@query("SELECT p_partkey, CASE WHEN p_size % 6 NOT IN (2, 3, 4) OR p_brand = 'Brand#1' THEN 400 WHEN p_partkey % 5 = 0 THEN 404 ELSE 200 END AS status FROM part")
def request_validation(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    model = F.when(p.p_brand == "Brand#1", "other").otherwise("edsr")
    return p.select("p_partkey", rec.request_status(p.p_size % 6, model, p.p_partkey % 5 != 0).alias("status"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 415 WHEN n_chars * 1000 > 52428800 THEN 413 ELSE 200 END AS status FROM documents")
def upload_validation(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", rec.upload_status(F.when(d.doc_id % 7 == 0, "text/plain").otherwise("image/png"), d.n_chars * 1000).alias("status"))


@query("SELECT o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'good' WHEN 'O' THEN 'open' ELSE 'bad' END AS \"end\", count(*) AS n FROM orders GROUP BY 1, 2")
def order_ends(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(o.o_orderstatus == "F", "FULFILLED").when(o.o_orderstatus == "O", "RUNNING").otherwise("Failed")
    return o.groupBy("o_orderstatus", rec.order_end(status).alias("end")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, 'EPSG:' || (32600 + n_nationkey) AS epsg, 100 + n_nationkey AS width, 50 AS height, 2 AS bands, 'UInt16' AS dtype, CAST(n_nationkey AS DOUBLE) AS west, CAST(n_nationkey + 2 AS DOUBLE) AS east FROM nation")
def raster_info(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = n.n_nationkey
    text = F.format_string(
        '{"size":[%d,50],"coordinateSystem":{"wkt":"PROJCS[\\"x\\",AUTHORITY[\\"EPSG\\",\\"%d\\"]]"},"bands":[{"type":"UInt16"},{"type":"UInt16"}],"wgs84Extent":{"coordinates":[[[%d,0],[%d,0],[%d,3],[%d,3]]]}}',
        k + 100, k + 32600, k, k + 2, k + 2, k,
    )
    return n.select("n_nationkey", rec.raster_info(text).alias("i")).select("n_nationkey", "i.epsg", "i.width", "i.height", "i.bands", "i.dtype", "i.west", "i.east")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '2000-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp FROM orders")
def date_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.when(o.o_orderkey % 3 == 0, "garbage").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return o.select("o_orderkey", F.date_format(rec.parsed_date(text, F.lit("2000-01-01").cast("timestamp")), "yyyy-MM-dd").alias("day"), rec.stamp(F.col("o_orderdate")).alias("stamp"))


@query("SELECT p_partkey FROM part WHERE p_size % 4 IN (0, 1) AND p_partkey % 3 >= 2")
def road_filter(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.lit(["primary", "residential", "footway", "steps"]), (p.p_size % 4 + 1).cast("int"))
    at = F.array_repeat(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), (p.p_partkey % 3).cast("int"))
    return p.where(rec.is_road(kind, at)).select("p_partkey")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '#22c55e' WHEN 1 THEN '#f59e0b' ELSE '#3b82f6' END AS colour, CASE WHEN p_size % 2 = 0 THEN '/tiles_wow' WHEN p_size % 3 = 0 THEN '/tiles_sr' ELSE '/tiles' END AS source FROM part")
def client_styles(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kind = F.when(p.p_size % 3 == 0, "field").when(p.p_size % 3 == 1, "zone").otherwise("other")
    source = rec.tile_source(F.when(p.p_size % 2 == 0, "/tiles_wow"), F.when(p.p_size % 3 == 0, "/tiles_sr"), F.lit("/tiles"))
    return p.select("p_partkey", rec.colour_of(kind).alias("colour"), source.alias("source"))


@query("SELECT s_suppkey, 10 AS minzoom, CASE WHEN s_nationkey % 2 = 0 THEN 18 ELSE s_nationkey END AS maxzoom, greatest(22, CASE WHEN s_nationkey % 2 = 0 THEN 18 ELSE s_nationkey END) AS overzoom, CAST(s_nationkey AS DOUBLE) AS west FROM supplier")
def map_view(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = s.s_nationkey
    z = rec.zoom_range(F.lit(None).cast("int"), F.when(k % 2 != 0, k))
    pairs = rec.corner_pairs(F.array(k.cast("double"), F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return s.select("s_suppkey", z.alias("z"), F.get(F.get(pairs, 0), 1).alias("west")).select("s_suppkey", "z.minzoom", "z.maxzoom", "z.overzoom", "west")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'code' WHEN event_id % 3 = 0 AND value >= 60 THEN 'text' WHEN event_id % 2 = 0 THEN 'enhanced' WHEN event_id % 3 = 0 THEN 'low confidence' ELSE 'none' END AS \"by\", count(*) OVER () AS n FROM events")
def read_cascade(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = e.event_id
    serial = F.lit("1HGCM82633A004352")
    read = rec.serial_read(F.when(k % 5 == 0, serial), F.when(k % 3 == 0, serial), e.value, F.when(k % 2 == 0, serial))
    total = e.agg(F.count(F.lit(1)).alias("n"))
    return e.select("event_id", read["by"].alias("by")).join(F.broadcast(total))


@query("SELECT p_partkey, round(CASE WHEN p_size % 2 = 0 THEN (p_size + 80.0) / 2 ELSE 80.0 END, 6) AS confidence FROM part")
def word_confidence(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    word = lambda text, c: F.struct(F.lit(text).alias("text"), c.cast("double").alias("confidence"))
    words = F.when(p.p_size % 2 == 0, F.array(word("aBc", p.p_size), word("abc123DEF", F.lit(80)), word("zzz", F.lit(1)))).otherwise(F.array(word("ABC123DEF", F.lit(80)), word("zzz", F.lit(1))))
    return p.select("p_partkey", r6(rec.word_confidence(words, F.lit("ABC123"))).alias("confidence"))


@query("SELECT s_suppkey, printf('%.6f°', 36.0 + s_nationkey) || 'N, ' || printf('%.6f°', 120.0 + s_nationkey) || 'W' AS place FROM supplier")
def coordinates_text(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", rec.coordinates_text(s.s_nationkey + 36.0, -(s.s_nationkey + 120.0)).alias("place"))


@query("SELECT (SELECT count(*) > 0 FROM orders WHERE o_orderpriority = '1-URGENT') AS has_sr, (SELECT count(*) > 0 FROM orders WHERE o_orderpriority = 'none') AS has_wow, (SELECT count(*) FROM part WHERE p_size % 2 = 0) AS n_fields, (SELECT count(*) FROM part WHERE p_size % 2 = 1) AS n_zones")
def layer_availability(spark, sf_dir):
    tiles = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderpriority") == "1-URGENT", "sr").when(F.col("o_orderpriority") == "none", "wow").otherwise("original").alias("layer"))
    vectors = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 2 == 0, "fields").otherwise("zones").alias("kind"))
    return layers.availability(tiles, vectors, ["sr", "wow"], ["fields", "zones"])


@query("SELECT n_regionkey, count(*) AS n, '{\"type\":\"FeatureCollection\",\"features\":[' || string_agg('{\"type\":\"Feature\",\"properties\":{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}}', ',' ORDER BY n_nationkey) || ']}' AS features FROM nation GROUP BY n_regionkey")
def feature_collection(spark, sf_dir):
    return layers.collection(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", ["n_nationkey", "n_name"])


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 0.5 ELSE 1.0 END AS area FROM supplier")
def drawn_export(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    at = lambda *ps: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ps))
    square, triangle = F.array(at((0, 0), (1, 0), (1, 1), (0, 1))), F.array(at((0, 0), (1, 0), (1, 1)))
    drawn = s.select("s_suppkey", F.when(s.s_nationkey % 2 == 0, triangle).otherwise(F.slice(triangle, 1, 0)).alias("edited"), square.alias("drawn"))
    return layers.drawn_polygons(drawn, "edited", "drawn").select("s_suppkey", r6(geo.area(F.col("ring"))).alias("area"))


@query("SELECT p_partkey, round(10.0 / (1 + p_size % 4), 6) AS metres FROM part")
def effective_resolution(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", r6(rec.resolution(F.lit(10.0), 1 + p.p_size % 4)).alias("metres"))


@query("SELECT event_id, strftime(ts + to_seconds(3570), '%Y-%m-%d %H:%M:%S') AS until FROM events")
def token_expiry(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.date_format(rec.token_valid_until(F.col("ts"), F.lit(3600)), "yyyy-MM-dd HH:mm:ss").alias("until"))


@query(
    """WITH c AS (SELECT unnest(range(262144)) AS id), n AS (SELECT id, band, (id * 3 + band + 1) * 40503019 % 2147483647 AS x FROM c, (SELECT unnest([0, 1, 2]) AS band))
 SELECT id // 512 AS row, id % 512 AS col, max(CAST(x * x // 65536 % 80 + 40 AS INTEGER)) FILTER (band = 0) AS red, max(CAST(x * x // 65536 % 100 + 80 AS INTEGER)) FILTER (band = 1) AS green,
 max(CAST(x * x // 65536 % 80 + 40 AS INTEGER)) FILTER (band = 2) AS blue FROM n GROUP BY id"""
)
def synthetic_raster(spark, sf_dir):
    return layers.synthetic_raster(spark)
