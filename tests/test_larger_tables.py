"""Queries against their SQL on slices of larger tables: values, keys and places that the smallest tables don't have."""

from __future__ import annotations

import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from agrolith.operators import noding, overlay, rings, segment, stencil, zonal
from agrolith.plans import field_queries, more_queries, raster_queries  # noqa: F401  they register themselves
from agrolith.plans import queries as plans

SF = "/root/testdata/sf0.1"
POLYGONS = "id int, rings array<array<struct<x double,y double>>>"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def agrees(spark, at, name, **slices):
    """Whether a query and its SQL have the same rows on these tables, each given by SQL on a table of SF."""
    db = duckdb.connect()
    for table, sql in slices.items():
        db.sql(f"COPY (SELECT {sql.format(f"FROM '{SF}/{table}.parquet'")}) TO '{at}/{table}.parquet'")
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet'")
    found = plans.QUERIES[name](spark, str(at)).toPandas()
    want = db.sql(plans.ORACLES[name]).df()[list(found.columns)]
    rows = lambda df: sorted(map(tuple, df.astype(float).round(6).fillna(-1e9).itertuples(index=False)))
    assert len(found)
    assert rows(found) == rows(want)


@pytest.mark.parametrize("name", ["geotiff_three_bands", "geotiff_window"])
def test_bands_beyond_a_byte(spark, tmp_path, name):
    agrees(spark, tmp_path, name, events="* REPLACE (value + 300 AS value) {} WHERE event_id < 1000")


def test_points_at_the_height_of_corners(spark, tmp_path):
    agrees(spark, tmp_path, "points_in_polygons", events="* {}", supplier="* {} WHERE s_suppkey IN (137, 162, 179, 302)")


@pytest.mark.parametrize("name", ["tile_index", "pyramid_rollup", "tile_pyramid_avg"])
def test_tiles_beyond_the_square(spark, tmp_path, name):
    agrees(spark, tmp_path, name, events="* REPLACE (event_id + 5881800 AS event_id) {} WHERE event_id < 2000")


def test_keys_of_one_block_keep_their_chains():
    """Many cells and keys are linked at once; equal rings of two keys are two chains."""
    ring = [(0, 0), (2, 0), (2, 2), (0, 2)]
    steps = [(*ring[k], *ring[(k + 1) % 4], *ring[(k + 2) % 4]) for k in range(4)]
    rows = [{"id": key} | dict(zip(("x1", "y1", "x2", "y2", "nx", "ny"), s, strict=True)) for key in (1, 2) for s in steps]
    found = rings._chains(pa.Table.from_pylist(rows), ["id"]).to_pylist()
    assert [(r["id"], r["closed"], len(r["points"])) for r in found] == [(1, True, 4), (2, True, 4)]


def test_noding_broadcasts_no_edges(spark, tmp_path):
    """Written edges are small as files and large in memory, however few bytes Spark counts."""
    square = "array(array(named_struct('x', {0}, 'y', {0}), named_struct('x', {1}, 'y', {0}), named_struct('x', {1}, 'y', {1}), named_struct('x', {0}, 'y', {1})))"
    polygons = spark.sql(f"SELECT 1 AS id, {square.format('0.0D', '3.0D')} AS rings UNION ALL SELECT 1, {square.format('1.0D', '5.0D')}")
    overlay.edges_of(polygons, ["id"], "a", 1.0).withColumn("new", F.lit(True)).write.parquet(f"{tmp_path}/edges")
    met = overlay.crossings(spark.read.parquet(f"{tmp_path}/edges"), ["id"], 2)
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()
    assert {(r.p.x, r.p.y) for r in met.collect()} == {(1, 3), (3, 1)}


def star(r, n, steps):
    """A ring that crosses and touches itself, on 1 / steps."""
    ring = [{c: round(r.uniform(0, 10) * steps) / steps for c in "xy"} for _ in range(n)]
    return [*ring, ring[0]]


def test_keys_of_few_edges_are_shuffled_once(spark):
    """Neither joins nor a row for each cell: one shuffle by key, and arrays of many keys."""
    r = random.Random(1)
    stars = spark.createDataFrame([(k, [star(r, 9, 1)]) for k in range(50)], POLYGONS)
    found = overlay.make_valid(stars, ["id"], 1000.0, 2.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan, plan
    assert found.select("id").distinct().count() == 50


def test_keys_of_few_edges_and_of_many_agree(spark, monkeypatch):
    """Arrays and joins on cells make the same polygons: crossings, touching points, equal edges, holes; of 24 edges and fewer on arrays alone."""
    r = random.Random(5)
    a, b = (spark.createDataFrame([(k, [star(r, n, 1000 if k % 2 else 1) for _ in range(1 + k % 3)]) for k in range(12)], POLYGONS) for n in (10, 6))

    def found(held):
        monkeypatch.setattr(noding, "HELD", held)
        made = overlay.overlay(a, b, ["id"], ("difference", "union", "merged"), 1000.0, 2.0)
        return {n: sorted((x.id, x.part, [[tuple(p) for p in ring] for ring in x.rings]) for x in d.collect()) for n, d in made.items()}

    few = found(1_024)
    assert any(len(rings) > 1 for _, _, rings in few["union"]) and all(few.values())
    assert few == found(24)


@pytest.mark.parametrize("held", [1_024, 0])
def test_overlays_broadcast_no_rings(spark, monkeypatch, held):
    """Whether keys are done on arrays or on cells, the driver holds none of their rings."""
    monkeypatch.setattr(noding, "HELD", held)
    r = random.Random(7)
    a, b = (spark.createDataFrame([(k, [star(r, 6, 1)]) for k in range(4)], POLYGONS) for _ in range(2))
    for found in overlay.overlay(a, b, ["id"], ("difference", "union"), 1000.0, 4.0).values():
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan, plan
        assert found.count()


@pytest.mark.parametrize("held", [1_024, 0])
def test_unions_broadcast_no_rings(spark, monkeypatch, held):
    """A frame around a field of its own, and a strip across its border: three outer rings and a hole become two and one."""
    monkeypatch.setattr(noding, "HELD", held)
    box = lambda w, s, e, n: [{"x": float(x), "y": float(y)} for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))]
    sides = [box(0, 0, 9, 2), box(7, 0, 9, 9), box(0, 7, 9, 9), box(0, 0, 2, 9), box(4, 4, 5, 5), box(8, 3, 12, 4)]
    found = overlay.union(spark.createDataFrame([(k, [b]) for k in range(3) for b in sides], POLYGONS), ["id"], 1000.0, 4.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan, plan
    size = lambda ring: sum(p.x * q.y - q.x * p.y for p, q in zip(ring, ring[1:], strict=False)) / 2
    assert sorted((x.id, x.part, [size(ring) for ring in x.rings]) for x in found.collect()) == [(k, *part) for k in range(3) for part in ((0, [84.0, -25.0]), (1, [1.0]))]


def test_blocks_of_keys_make_no_difference(monkeypatch):
    """A block has one key or all, and pairs are compared at once or a few at a time, far from the origin, too."""
    r = random.Random(3)
    rows = []
    for k in range(9):
        ring = star(r, 12, 1)
        ends = [tuple(int(p[c] * 3) + (k % 2) * 2**40 for c in "xy") for p in ring]
        rows += [(k, *min(p, q), *max(p, q), 1 if p < q else -1, 0, 1) for p, q in zip(ends, ends[1:], strict=False) if p != q]
    e = np.array(rows).T.copy()
    inside = lambda a, b: a % 2 != 0
    ((_, key, part, rings),) = noding._found(e.copy(), [inside], 1.0)
    monkeypatch.setattr(noding, "PAIRS", 5)
    one = []
    for k in range(9):
        own = e[:, e[0] == k].copy()
        own[0] = 0
        ((_, _, p, q),) = noding._found(own, [inside], 1.0)
        one += [(k, *v) for v in zip(p.tolist(), q.to_pylist(), strict=True)]
    assert list(zip(key.tolist(), part.tolist(), rings.to_pylist(), strict=True)) == one


def test_stencils_shuffle_pixels_once(spark):
    """Convolution, morphology and enlargement shuffle about as many rows as there are pixels, not as many as kernels have cells."""
    from agrolith.operators import grid, stencil

    g = spark.range(128 * 300).selectExpr("id div 128 AS row", "id % 128 AS col", "cast(id % 17 AS double) AS v")
    size = F.lit(300), F.lit(128)
    for found in (stencil.gaussian(g, 1.5, *size), grid.upsample_lanczos(g, 2, *size), stencil.close_open(g.where("v > 6").drop("v"), *size)):
        assert found.count() > 0
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FlatMapGroupsInArrow") == 1 and "HashAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1, plan


def test_flooding_shuffles_no_old_states(spark):
    """Each round shuffles the last states of the chunks that it floods, and the end shuffles none."""
    from agrolith.operators import segment

    g = spark.range(60 * 40).selectExpr("id div 40 AS row", "id % 40 AS col", "cast(id * 7 % 13 AS double) AS cost", "if(id = 3, 5, null) AS seed")
    found = segment.flood_raster(g, 16)
    assert "FlatMapGroupsInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.label, r["count"]) for r in found.groupBy("label").count().collect()} == {(5, 2_400)}


def test_pixels_in_polygons_are_those_of_ray_casting(spark):
    """Runs of pixels and points one by one agree: slanted edges, holes, centres on edges and corners, outlines that overlap and lie outside."""
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in (*p, p[0])]
    shapes = [
        (1, [ring((0.5, 9.5), (9.25, 8.1), (7.5, 1.5), (2.5, 2.5)), ring((3.5, 7.5), (3.5, 5.5), (5.5, 5.5), (5.5, 7.5))]),
        (2, [ring((4.5, 12.0), (15.5, 6.5), (4.5, -3.0))]), (3, [ring((-9.0, -9.0), (-8.0, -9.0), (-8.0, -8.0))]), (4, [ring((1.1, 3.2), (1.2, 3.2), (1.2, 3.3))]), (5, []),
    ]
    outlines = spark.createDataFrame(shapes, "label long, rings array<array<struct<x: double, y: double>>>")
    px = spark.range(144).select((F.col("id") / 12).cast("bigint").alias("row"), (F.col("id") % 12).alias("col"))
    found = zonal.pixels_in_polygons(px, outlines, 0.0, 12.0, 1.0, 1.0).select("label", "row", "col").collect()
    points = px.withColumn("x", F.col("col") + 0.5).withColumn("y", 12.0 - (F.col("row") + 0.5))
    plain = zonal.points_in_polygons(points, outlines, 4.0).select("label", "row", "col").collect()
    assert len(found) == len(set(found)) > 60 and set(found) == set(plain)


def test_points_in_polygons_broadcast_no_outlines(spark):
    """An outline has a row for each cell that it touches, however small its table is."""
    outlines = spark.createDataFrame([(1, [[{"x": float(x), "y": float(y)} for x, y in ((0, 0), (9, 0), (9, 9), (0, 0))]])], POLYGONS)
    found = zonal.points_in_polygons(spark.range(9).selectExpr("id + 0.5D AS x", "id / 4.0D AS y"), outlines, 1.0)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 9


def test_rings_of_pixels_are_read_once(spark):
    """The ring around each zone's pixels, without a row for each of its steps; zones may touch and lie at the raster's border and a chunk's."""
    mask = spark.createDataFrame([(z, r, c) for z, at in ((1, 0), (2, 3), (3, 254)) for r in range(at, at + 4) for c in range(3)], "zone long, row long, col long")
    made = stencil.ring(mask, 2, F.lit(300), F.lit(60))
    assert "Generate explode(array(struct" not in made._jdf.queryExecution().optimizedPlan().toString()
    own = {tuple(r) for r in mask.collect()}
    near = {(z, r + i, c + j) for z, r, c in own for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) <= 2} - own
    assert sorted(map(tuple, made.select("zone", "row", "col").collect())) == sorted(k for k in near if 0 <= k[1] < 300 and 0 <= k[2] < 60)


def test_simplified_borders_are_compared_in_small_cells(spark, monkeypatch):
    """Edges of simplified borders are short: the cells in which all pairs meet must not be as wide as chunks."""
    cells = []
    plain = segment.crossings
    monkeypatch.setattr(segment, "crossings", lambda edges, by, cell: (cells.append(cell), plain(edges, by, cell))[1])
    px = spark.range(1600).select((F.col("id") / 40).cast("bigint").alias("row"), (F.col("id") % 40).alias("col")).withColumn("label", F.floor(F.col("row") / 7) * 6 + F.floor(F.col("col") / 7))
    assert segment.simplify_shared(px, 0.5).count() == 36
    assert cells and max(cells) <= 32
