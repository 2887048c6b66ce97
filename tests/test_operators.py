"""Operators on hand-made fixtures and invariants."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrolith.functions import bandmath as bm
from agrolith.functions import geometry as geo
from agrolith.functions import text as tx
from agrolith.operators import catalog, enhance, grid, jobs, segment, stencil, tiles, zonal
from agrolith.sources import geojson, rasters


def raster(spark, values):
    cells = [(r, c, float(v)) for r, row in enumerate(values) for c, v in enumerate(row)]
    return spark.createDataFrame(cells, "row bigint, col bigint, v double")


def array(df, shape, value="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = r[value]
    return out


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_zero_denominators(spark):
    r = one(spark, a=bm.ndvi(F.lit(0.0), F.lit(0.0)), b=bm.vari(F.lit(0.2), F.lit(0.1), F.lit(0.3)), c=bm.compactness(F.lit(1.0), F.lit(0.0), 0.5), d=bm.stretch_uint8(F.lit(300.0), F.lit(300.0), F.lit(300.0)))
    assert (r.a, round(r.b, 6), r.c, r.d) == (0.0, -10.0, 0.5, 0)


def test_confidence_steps(spark):
    v1 = [(0.4, 0.6), (0.5, 0.8), (1.0, 1.0), (50.0, 1.0), (100.0, 0.8), (100.1, 0.6)]
    for hectares, factor in v1:
        assert one(spark, c=bm.confidence_v1(F.lit(hectares), F.lit(1.0), True)).c == pytest.approx(0.7 * factor)
    for std, step in ((0.05, 0.15), (0.1, 0.1), (0.2, 0.05), (0.3, 0.0), (None, 0.0)):
        got = one(spark, c=bm.confidence_v2(F.lit(0.0), F.lit(0.0), F.lit(std).cast("double"), False)).c
        assert got == pytest.approx(0.5 + step)


def test_constant_raster_has_no_gradient_and_keeps_its_blur(spark):
    flat = raster(spark, np.full((5, 5), 7.0))
    assert np.allclose(array(stencil.sobel(flat), (5, 5), "gradient"), 0)
    assert np.allclose(array(stencil.gaussian(flat, 1.0, F.lit(5), F.lit(5)), (5, 5)), 7)


def test_gaussian_equals_reflection(spark):
    v = np.random.default_rng(0).random((9, 12))
    w = np.array(stencil.gaussian_weights(0.8))
    radius = len(w) // 2
    padded = np.pad(v, radius, mode="symmetric")
    want = np.array([[(padded[r : r + len(w), c : c + len(w)] * np.outer(w, w)).sum() for c in range(12)] for r in range(9)])
    assert np.allclose(array(stencil.gaussian(raster(spark, v), 0.8, F.lit(9), F.lit(12)), v.shape), want)


def test_components_and_holes(spark):
    shape = np.array([[1, 1, 1, 0, 0], [1, 0, 1, 0, 1], [1, 1, 1, 1, 0], [0, 0, 0, 0, 1]])
    cells = raster(spark, shape)
    marked = cells.where("v = 1").select("row", "col")
    assert segment.components(marked, F.lit(5), 4).select("label").distinct().count() == 3
    assert segment.components(marked, F.lit(5), 8).select("label").distinct().count() == 1
    filled = segment.fill_holes(marked, cells, F.lit(4), F.lit(5))
    assert filled.count() == int(shape.sum()) + 1


def test_outlines_have_the_regions_area(spark):
    shape = np.array([[1, 1, 1, 0], [1, 0, 1, 0], [1, 1, 1, 2], [0, 0, 2, 2]])
    labels = raster(spark, shape).where("v > 0").select(F.col("v").cast("bigint").alias("label"), "row", "col")
    rings = segment.polygonize(labels).select("label", geo.signed_area(F.col("ring")).alias("a"), (F.get("ring", 0) == F.element_at("ring", -1)).alias("closed")).collect()
    assert all(r.closed for r in rings)
    assert {k: abs(sum(r.a for r in rings if r.label == k)) for k in (1, 2)} == {1: 8.0, 2: 3.0}
    assert segment.simplified_path(np.array([(0, 0), (1, 0.01), (2, 0), (2, 2)]), 0.1) == [0, 2, 3]


def test_distances_are_exact(spark):
    r = np.random.default_rng(5)
    marked = r.random((90, 40)) < 0.998
    marked[:, 30] = True
    ground = np.argwhere(~marked)
    want = {(i, j): float(np.sqrt(((ground - (i, j)) ** 2).sum(axis=1).min())) for i, j in np.argwhere(marked).tolist()}
    p = raster(spark, marked)
    found = segment.distances(p.where("v = 1"), p.where("v = 0"))
    assert {(x.row, x.col): x.distance for x in found.collect()} == pytest.approx(want)
    top = max(want.values())
    assert top > 9
    assert {(x.row, x.col) for x in segment.cores(found).collect()} == {at for at, d in want.items() if d > 0.3 * top}
    seeds = {(i, j) for (i, j), d in want.items() if d > 5 and d >= max(want.get((a, b), 0) for a in range(i - 10, i + 10) for b in range(j - 10, j + 10))}
    assert {(x.row, x.col) for x in segment.distance_seeds(found).collect()} == seeds
    assert [x.distance for x in segment.distances(p.where("row = 0 and v = 1"), p.limit(0)).collect()] == [None] * int(marked[0].sum())


def test_flood_reaches_all_and_separates_basins(spark):
    cost = [[0, 0, 9, 0, 0]] * 3
    cells = raster(spark, cost).select(F.lit(1).alias("k"), "row", "col", F.col("v").alias("cost"), F.when((F.col("row") == 1) & F.col("col").isin(0, 4), F.col("col")).alias("seed"))
    got = {(r.row, r.col): r.label for r in segment.flood_raster(cells).collect()}
    assert all(got[r, 0] == got[r, 1] == 0 and got[r, 3] == got[r, 4] == 4 for r in range(3))
    assert None not in got.values()


def test_flood_crosses_chunk_borders(spark):
    r = np.random.default_rng(8)
    cost = r.integers(0, 6, (50, 9)).astype(float)
    cost[10] = 9.0
    cells = raster(spark, cost).where("row != 20 or col > 0").select("row", "col", F.col("v").alias("cost"), F.when((F.col("row") % 17 == 3) & (F.col("col") == 4), F.col("row") * 9 + 4).alias("seed"))
    one_chunk = {(x.row, x.col): x.label for x in segment.flood_raster(cells).collect()}
    assert None not in one_chunk.values()
    assert {(x.row, x.col): x.label for x in segment.flood_raster(cells, 7).collect()} == one_chunk
    assert {x.label for x in segment.flood_raster(cells.withColumn("seed", F.lit(None).cast("bigint")), 7).collect()} == {None}


def test_rings(spark):
    at = lambda *p: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p))
    ell = at((0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2))
    r = one(spark, a=geo.area(geo.closed(ell)), p=geo.perimeter(geo.closed(ell)), i=geo.contains(geo.closed(ell), F.lit(0.5), F.lit(1.5)), o=geo.contains(geo.closed(ell), F.lit(1.5), F.lit(1.5)), v=geo.valid_ring(geo.closed(at((0, 0), (1, 1)))), b=geo.bounds(ell))
    assert (r.a, r.p, r.i, r.o, r.v, r.b) == (3.0, 8.0, True, False, False, [0, 0, 2, 2])


def test_tile_numbers(spark):
    r = one(spark, x=geo.tile_x(F.lit(-180.0), F.lit(3)), e=geo.tile_x(F.lit(180.0), F.lit(3)), n=geo.tile_y(F.lit(85.0511), F.lit(3)), s=geo.tile_y(F.lit(-85.06), F.lit(3)))
    assert (r.x, r.e, r.n, r.s) == (0, 7, 0, 7)


def test_pyramid_means_come_from_all_points(spark):
    pts = spark.createDataFrame([(i, -121.7 + i * 0.0003, 36.6 + i * 0.0002, float(i)) for i in range(200)], "k int, lon double, lat double, v double")
    p = tiles.pyramid(pts, "v", range(10, 17))
    sums = {r.z: (round(r.s, 6), r.n) for r in p.groupBy("z").agg(F.sum(F.col("v") * F.col("n")).alias("s"), F.sum("n").alias("n")).collect()}
    assert set(sums.values()) == {(19900.0, 200)} and len(sums) == 7


def scene(spark, *rows):
    return spark.createDataFrame(list(rows), "scene_id string, d string, cloud double").select("scene_id", F.col("d").cast("timestamp_ntz").alias("acquired"), "cloud")


@pytest.mark.parametrize(
    ("cloud", "date", "reason"),
    [(5.0, "2024-01-01", "local is good"), (4.9, "2024-01-01", "clearer"), (10.0, "2024-01-04 00:00:00", "local is good"), (10.0, "2024-01-04 00:00:01", "newer"), (10.1, "2024-02-01", "local is good")],
)
def test_choice_at_its_borders(spark, cloud, date, reason):
    local = scene(spark, ("a", "2024-01-01", 10.0))
    assert catalog.choose_source(local, scene(spark, ("b", date, cloud))).first().reason == reason


def test_choice_without_scenes(spark):
    none = scene(spark, ("x", "2024-01-01", 1.0)).limit(0)
    some = scene(spark, ("a", "2024-01-01", 10.0))
    assert catalog.choose_source(none, none).first().reason == "none"
    assert catalog.choose_source(none, some).first().choice == "remote"
    assert catalog.choose_source(some, none, force=True).first().choice == "local"
    assert catalog.choose_source(some, some).first().reason == "same scene"


def test_text(spark):
    serial = one(spark, c=tx.serial_candidates(tx.ocr_normal(F.lit("vin: 1hgcm-82633a 004352!")))).c
    assert serial == ["1HGCM-82633A", "1HGCM82633A"]
    for message, status, want in (("Stage 1/2", "x", 25), ("stage 2 / 2", "x", 75), ("", "queued", 5), ("garbage", "x", 50), ("Stage 1/0", "x", 50)):
        assert one(spark, p=tx.progress_percent(F.lit(status), F.lit(message))).p == want


def test_upscaling_by_chunks_equals_the_whole(spark):
    v = np.random.default_rng(3).random((20, 30))
    got = array(enhance.upscale_tiled(raster(spark, v), 2, size=8, pad=2), (40, 60))
    assert np.allclose(got, enhance.bilinear(v, 2))
    assert np.allclose(array(grid.upsample_bilinear(raster(spark, v), 2, F.lit(20), F.lit(30)), (40, 60)), enhance.bilinear(v, 2))


def test_clahe_of_a_flat_raster_is_flat(spark):
    flat = raster(spark, np.full((16, 16), 90.0))
    assert enhance.clahe(flat, F.lit(16), F.lit(16), tiles=4).select("v").distinct().count() == 1


def test_dense_network_shapes():
    rng, n, g = np.random.default_rng(0), 4, 2
    names = {"first": (n, 3), "trunk": (n, n), "up1": (n, n), "up2": (n, n), "high": (n, n), "last": (3, n)} | {f"0.{u}.{k}": (g if k < 5 else n, n + g * (k - 1)) for u in range(3) for k in range(1, 6)}
    weights = {f"{k}.w": rng.normal(size=(o, i, 3, 3)) * 0.05 for k, (o, i) in names.items()} | {f"{k}.b": np.zeros(o) for k, (o, _) in names.items()}
    out = enhance.ResidualDenseNet(weights, 1)(rng.random((3, 5, 6)))
    assert out.shape == (3, 20, 24) and out.min() >= 0 and out.max() <= 1


def test_kmeans_zones_are_ordered(spark):
    rows = [(f, float(m + d)) for f in (1, 2) for m in (0, 10, 20) for d in np.linspace(-1, 1, 20)] + [(3, 1.0)]
    z = zonal.zone_means(zonal.kmeans_zones(spark.createDataFrame(rows, "field int, n double"), "field", "n"), "field", "n").collect()
    assert {(r.field, r.zone_id): round(r["mean"], 6) for r in z} == {(f, k + 1): 10.0 * k for f in (1, 2) for k in range(3)}


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"type":"FeatureCollection","features":[{"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,1],[0,0]]]}}]}')
    (tmp_path / "b.json").write_text('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}')
    areas = sorted(r.a for r in geojson.read_area(spark, str(tmp_path / "*.json")).select(geo.area(F.col("ring")).alias("a")).collect())
    assert areas == [0.5, 1.0]
    values = np.arange(12, dtype="<f4").reshape(3, 4)
    values.tofile(tmp_path / "r.bin")
    rasters.register(spark)
    got = spark.read.format("raw_raster").option("path", str(tmp_path / "r.bin")).option("width", 4).option("rows_per_part", 2).load()
    assert np.array_equal(array(got, (3, 4)), values)
    rasters.write_chunks(got, str(tmp_path / "chunks"), 2)
    assert rasters.read_chunks(spark, str(tmp_path / "chunks")).count() == 12


def test_crop_falls_back_to_the_whole(spark):
    cells = raster(spark, np.ones((2, 2)))
    assert grid.crop(cells, F.col("row") == 0).count() == 2
    assert grid.crop(cells, F.col("row") > 9).count() == 4


def test_areas_that_are_none(spark):
    for text in ('{"type":"FeatureCollection","features":[]}', '{"type":"Point","coordinates":[0,0]}', "{}", "no json"):
        with pytest.raises(Exception, match="area|collection"):
            spark.createDataFrame([(text,)], "value string").select(geojson.checked_ring(F.col("value")).alias("r")).collect()
    assert geojson.ways(spark.createDataFrame([("broken",), (None,), ('{"elements":[]}',)], "value string")).count() == 0


def test_polling_and_queues(spark):
    rows = [(1, 0.0, 5.0), (2, 1.0, 5.0), (3, 20.0, 1.0)]
    got = jobs.one_at_a_time(spark.createDataFrame([(k, "q", a, s) for k, a, s in rows], "event_id int, queue string, arrived double, seconds double"), "queue").orderBy("event_id").collect()
    assert [(x.begins, x.ends) for x in got] == [(0.0, 5.0), (5.0, 10.0), (20.0, 21.0)]
    made = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS started, x.ended, x.status FROM VALUES (timestamp'2024-01-01 00:00:00', 'a'), (timestamp'2024-01-01 00:00:11', 'b'), (timestamp'2024-01-01 01:00:00', 'c'), (null, null) AS x(ended, status)")
    assert [(x.polls, x.waited, x.seen) for x in jobs.polled(made, 10.0, 600.0).collect()] == [(1, 0.0, "a"), (3, 20.0, "b"), (61, 600.0, "timeout"), (61, 600.0, "timeout")]
