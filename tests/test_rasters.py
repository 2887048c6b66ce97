"""Rasters in one table don't mix; field extraction, resampling, colour and areas against brute force."""

from __future__ import annotations

import colorsys
import heapq
import random
from functools import reduce
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrolith.functions import bandmath as bm
from agrolith.functions import geometry as geo
from agrolith.operators import enhance, fields, grid, segment, stencil, tiles, zonal

H, W = 18, 23


def size():
    return F.lit(H), F.lit(W)


def cells(spark, *values):
    rows = [(k, r, c, float(v)) for k, a in enumerate(values) for r, row in enumerate(a) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, "raster_id int, row bigint, col bigint, v double")


def array(df, shape, value="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = r[value]
    return out


def marked(g):
    return g.where("v > 0.6").drop("v")


def halves(g):
    return g.withColumn("label", F.floor(F.col("col") / 9) + 10 * F.floor(F.col("row") / 7)).drop("v").where("(row + col) % 11 > 0")


OPERATORS = {
    "gaussian": lambda g: stencil.gaussian(g, 1.1, *size()),
    "sobel": stencil.sobel,
    "directional_edges": stencil.directional_edges,
    "windowed": lambda g: stencil.windowed(g, "max", 5, 4),
    "close_open": lambda g: stencil.close_open(marked(g), *size(), turns=1),
    "ring": lambda g: stencil.ring(marked(g), 2, *size()),
    "unsharp": lambda g: stencil.unsharp(g, 0.4, 1.2, *size()),
    "adaptive_threshold": lambda g: stencil.adaptive_threshold(g, *size(), 5, 0.1),
    "downsample": lambda g: grid.downsample(g, 4, ["v"]),
    "nearest": lambda g: grid.upsample_nearest(g, 2),
    "bilinear": lambda g: grid.upsample_bilinear(g, 2, *size()),
    "lanczos": lambda g: grid.upsample_lanczos(g, 2, *size()),
    "crop": lambda g: grid.crop(g, (F.col("v") > 1.2) & (F.col("row") > 3)),
    "align": lambda g: grid.align(g.withColumnRenamed("v", "a"), b=g, scl=g.where("v > 0.5")),
    "components": lambda g: segment.components(marked(g), F.lit(W)),
    "fill_holes": lambda g: segment.fill_holes(marked(g), g, *size()),
    "distances": lambda g: segment.distances(g.where("v > 0.02"), g.where("v <= 0.02")),
    "seeds": lambda g: segment.distance_seeds(segment.distances(g.where("v > 0.02"), g.where("v <= 0.02")), 2.0),
    "cores": lambda g: segment.cores(segment.distances(g.where("v > 0.02"), g.where("v <= 0.02"))),
    "flood_raster": lambda g: segment.flood_raster(g.select(*grid.keys(g), "row", "col", F.round("v", 1).alias("cost"), F.when((F.col("row") % 6 == 2) & (F.col("col") % 7 == 3), F.col("row") * W + F.col("col")).alias("seed")), 5),
    "min_regions": lambda g: segment.min_regions(halves(g), 20),
    "polygonize": lambda g: segment.polygonize(halves(g)),
    "clahe": lambda g: enhance.clahe(g.withColumn("v", F.floor(F.col("v") * 100)), *size(), tiles=3),
    "upscale_tiled": lambda g: enhance.upscale_tiled(g, 2, 8, 2),
    "pyramid": lambda g: tiles.pyramid(g.withColumn("lon", F.col("col") * 0.01).withColumn("lat", F.col("row") * 0.01), "v", range(12, 15)),
}


def rows_of(df, by=None):
    """Rows as texts, sorted; of each raster, if by is its column."""
    rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c).cast("string").alias(c) for c, t in df.dtypes]
    rest = sorted(c for c in df.columns if c != by)
    found = {}
    for row in df.select(*rounded).collect():
        found.setdefault(row[by] if by else None, []).append(str([row[c] for c in rest]))
    return {k: sorted(x) for k, x in found.items()}


@pytest.mark.parametrize("name", OPERATORS)
def test_rasters_of_one_table_do_not_mix(spark, name):
    r = np.random.default_rng(3)
    both = cells(spark, r.random((H, W)), r.random((H, W)) * 1.5)
    found = rows_of(OPERATORS[name](both), "raster_id")
    alone = rows_of(OPERATORS[name](both.where("raster_id = 1").drop("raster_id")))
    assert set(found) == {"0", "1"} and found["1"] == alone[None]


def test_rasters_of_other_sizes(spark):
    r = np.random.default_rng(4)
    small, large = r.random((6, 7)), r.random((H, W))
    both = reduce(lambda a, b: a.unionByName(b), [cells(spark, a).withColumns({"raster_id": F.lit(k), "height": F.lit(a.shape[0]), "width": F.lit(a.shape[1])}) for k, a in enumerate((small, large))])
    found = stencil.gaussian(both, 0.7, F.col("height"), F.col("width"))
    for k, a in enumerate((small, large)):
        alone = stencil.gaussian(cells(spark, a).drop("raster_id"), 0.7, F.lit(a.shape[0]), F.lit(a.shape[1]))
        assert np.allclose(array(found.where(F.col("raster_id") == k), a.shape), array(alone, a.shape))


def test_stencils_cross_chunk_borders(spark, monkeypatch):
    v = np.random.default_rng(5).random((H, W))
    g = cells(spark, v).drop("raster_id")
    whole = array(stencil.sobel(g), v.shape, "gradient"), array(stencil.windowed(g, "min", 3, 2), v.shape)
    monkeypatch.setattr(stencil, "CHUNK", 4)
    assert np.allclose(array(stencil.sobel(g), v.shape, "gradient"), whole[0]) and np.allclose(array(stencil.windowed(g, "min", 3, 2), v.shape), whole[1])
    assert np.allclose(whole[1], [[v[max(0, i - 3) : i + 3, max(0, j - 3) : j + 3].min() for j in range(W)] for i in range(H)])


@pytest.mark.parametrize("factor", [2, 3])
def test_lanczos_equals_its_definition(spark, factor):
    v = np.random.default_rng(6).random((5, 9))

    def along(x):
        n, out = len(x), []
        for t in range(n * factor):
            at = (t + 0.5) / factor - 0.5
            near = np.arange(int(np.floor(at)) - 3, int(np.floor(at)) + 5)
            w = np.where(np.abs(at - near) < 3, np.sinc(at - near) * np.sinc((at - near) / 3), 0)
            out.append((w / w.sum()) @ x[np.clip(near, 0, n - 1)])
        return np.array(out)

    got = array(grid.upsample_lanczos(cells(spark, v).drop("raster_id"), factor, F.lit(5), F.lit(9)), (5 * factor, 9 * factor))
    assert np.allclose(got, along(along(v).T).T)


def test_flood_equals_least_levels(spark):
    r = np.random.default_rng(8)
    cost = r.integers(0, 9, (H, W)).astype(float)
    seeds = {(2, 3): 5, (9, 20): 1, (15, 4): 3}
    best = {}
    heap = [(0.0, s, at) for at, s in seeds.items()]
    while heap:
        level, s, at = heapq.heappop(heap)
        if at in best:
            continue
        best[at] = s
        for step in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            to = (at[0] + step[0], at[1] + step[1])
            if 0 <= to[0] < H and 0 <= to[1] < W and to not in best:
                heapq.heappush(heap, (max(level, cost[to]), s, to))
    seed = reduce(lambda c, x: c.when((F.col("row") == x[0][0]) & (F.col("col") == x[0][1]), x[1]), list(seeds.items())[1:], F.when((F.col("row") == 2) & (F.col("col") == 3), 5))
    found = segment.flood_raster(cells(spark, cost).drop("raster_id").select("row", "col", F.col("v").alias("cost"), seed.alias("seed")), 7)
    got = {(x.row, x.col): x.label for x in found.collect()}
    assert got == best, [(k, got.get(k), best[k], cost[k]) for k in best if got.get(k) != best[k]][:9]


def plots(h=60, w=75):
    r = np.random.default_rng(1)
    return np.array([[((i // 30 * 2 + j // 25 * 3) % 5) / 5 + float(r.random()) * 0.002 for j in range(w)] for i in range(h)])


def test_field_extraction(spark):
    """Plots come out as fields; roads cut them; statistics are those of the pixels inside the outline."""
    v = plots()
    px = cells(spark, v, v + 0.01).withColumn("valid", (F.col("col") < 72) | (F.col("raster_id") == 0)).withColumnRenamed("v", "ndvi")
    at = fields.Frame(-121.0, 36.0, 0.0005, 0.0004, F.lit(60), F.lit(75))
    roads = spark.createDataFrame([(-121.0 + 12.5 * 0.0005, 36.0, -121.0 + 12.5 * 0.0005, 35.0)], "ax double, ay double, bx double, by double")
    found = fields.extract(px, at, roads).cache()
    rows = found.collect()
    by_raster = {k: [x for x in rows if x.raster_id == k] for k in (0, 1)}
    assert [len(x) for x in by_raster.values()] == [8, 8]
    for k, own in by_raster.items():
        assert sorted(x.field_index for x in own) == list(range(1, 9))
        assert all(0.1 <= x.confidence <= 1 and 0 < x.compactness <= 1 and x.edge > 0 for x in own)
        assert sum(x.n for x in own) <= (60 * 72 if k else 60 * 75) - 60
        assert max(x.std for x in own) < 0.15
    alone = fields.extract(px.where("raster_id = 1").drop("raster_id"), at, roads).collect()
    assert sorted((x.field_index, x.id, x.n) for x in alone) == sorted((x.field_index, x.id, x.n) for x in by_raster[1])
    # Statistics by brute force over pixel centres inside the rings.
    one = by_raster[0][0]

    def inside(ring, x, y):
        odd = False
        for a, b in zip(ring, ring[1:]):
            if (a.y > y) != (b.y > y) and x < (b.x - a.x) * (y - a.y) / (b.y - a.y) + a.x:
                odd = not odd
        return odd

    own = [v[i, j] for i in range(60) for j in range(75) if sum(inside(r, -121.0 + (j + 0.5) * 0.0005, 36.0 - (i + 0.5) * 0.0004) for r in one.rings) % 2]
    assert one.n == len(own) and np.allclose((one.mean, one.std, one.p10, one.p90), (np.mean(own), np.std(own), *np.percentile(own, [10, 90])))
    z = fields.zones(px.where("raster_id = 0"), found.where("raster_id = 0"), at, fields.Rules()).collect()
    assert {x.zone_class for x in z} == {"low", "medium", "high"} and {x.parent_field for x in z} <= {x.id for x in by_raster[0]}


def test_kmeans_zones_are_near_the_best(spark):
    r = random.Random(2)
    for seed in range(3):
        values = sorted(r.gauss(r.choice((0, 4, 9)), 1) for _ in range(40))

        def spread(a, b):
            return float(np.var(values[a:b]) * (b - a)) if b > a else 0.0

        best = min(spread(0, a) + spread(a, b) + spread(b, 40) for a, b in combinations(range(1, 40), 2))
        found = zonal.kmeans_zones(spark.createDataFrame([(1, x) for x in values], "field int, n double"), "field", "n").collect()
        got = sum(float(np.var(own) * len(own)) for z in (1, 2, 3) for own in [[x.n for x in found if x.zone_id == z]])
        assert got <= best * 1.1 + 1e-9


def test_colours_round_trip(spark):
    colours = [(float(r), float(g), float(b)) for r in range(0, 256, 51) for g in range(0, 256, 51) for b in range(0, 256, 51)]
    df = spark.createDataFrame(colours, "r double, g double, b double")
    x = df.withColumn("h", bm.hsv(F.col("r"), F.col("g"), F.col("b"))).withColumn("l", bm.lab(F.col("r"), F.col("g"), F.col("b")))
    x = x.withColumn("from_h", bm.rgb_of_hsv(F.col("h.h"), F.col("h.s"), F.col("h.v"))).withColumn("from_l", bm.rgb_of_lab(F.col("l.l"), F.col("l.a"), F.col("l.b")))
    x = x.withColumn("again", bm.lab(*(F.col(f"from_l.{c}").cast("double") for c in "rgb")))
    for row in x.collect():
        want = (row.r, row.g, row.b)
        # Eight bits of lab don't tell dark shares of a saturated colour apart, but they come back as they were.
        assert np.abs(np.array(row.from_h) - want).max() <= 6 and np.abs(np.array(row.again) - np.array(row.l)).max() <= 2, row
        exact = colorsys.hsv_to_rgb(row.h.h / 180, row.h.s / 255, row.h.v / 255)
        assert np.abs(np.array(row.from_h) - np.array(exact) * 255).max() <= 1
    # Published values of the primaries, in 8 bits.
    known = {(255.0, 0.0, 0.0): (136, 208, 195), (0.0, 255.0, 0.0): (224, 42, 211), (0.0, 0.0, 255.0): (82, 207, 20), (255.0, 255.0, 255.0): (255, 128, 128), (0.0, 0.0, 0.0): (0, 128, 128)}
    got = {(row.r, row.g, row.b): tuple(row.l) for row in x.collect()}
    assert {k: got[k] for k in known} == known


def test_chains_keep_flat_colours_and_shapes(spark):
    flat = cells(spark, np.full((8, 8), 90.0)).select("row", "col", F.lit(90.0).alias("r"), F.lit(90.0).alias("g"), F.lit(90.0).alias("b"))
    for style in enhance.STYLES.values():
        out = enhance.super_resolve(flat, F.lit(8), F.lit(8), style, 2)
        assert out.count() == 16 * 16 and out.select("r", "g", "b").distinct().count() == 1
    r = np.random.default_rng(2)
    rows = [(i, j, *(float(x) for x in r.integers(0, 256, 3))) for i in range(16) for j in range(16)]
    rgb = spark.createDataFrame(rows, "row bigint, col bigint, r double, g double, b double")
    plain = {(x.row, x.col): (x.r, x.g, x.b) for x in enhance.super_resolve(rgb, F.lit(16), F.lit(16), None, 1).collect()}
    assert plain == {(i, j): c for i, j, *c in ((a, b, *c) for a, b, *c in rows) for c in [tuple(c)]}
    # Each step against the chain by hand.
    style = enhance.STYLES["farm"]
    light = enhance.clahe(rgb.select("row", "col", bm.lab(F.col("r"), F.col("g"), F.col("b"))["l"].alias("v")), F.lit(16), F.lit(16), 8, 2.5)
    even = rgb.join(light, ["row", "col"]).withColumn("x", bm.lab(F.col("r"), F.col("g"), F.col("b"))).withColumn("c", bm.rgb_of_lab(F.col("v"), F.col("x.a"), F.col("x.b")))
    sharp = [stencil.unsharp(even.select("row", "col", F.col(f"c.{c}").cast("double").alias("v")), style.amount, style.sigma, F.lit(16), F.lit(16)).select("row", "col", F.floor(F.col("v") + 0.5).alias(c)) for c in "rgb"]
    joined = reduce(lambda a, b: a.join(b, ["row", "col"]), sharp).withColumn("x", bm.hsv(F.col("r"), F.col("g"), F.col("b")))
    want = joined.select("row", "col", bm.rgb_of_hsv(F.col("x.h"), F.floor(bm.boosted_saturation(F.col("x.h"), F.col("x.s"), 1.3)), F.col("x.v")).alias("c")).select("row", "col", "c.*")
    assert rows_of(enhance.enhance_colour(rgb, F.lit(16), F.lit(16), style)) == rows_of(want)


def test_utm(spark):
    places = [(3.0, 0.0, 31, 500_000.0, 0.0), (-73.9857, 40.7484, 18, 585_628.0, 4_511_322.0), (151.2153, -33.8568, 56, 334_900.0, 6_252_300.0)]
    for lon, lat, zone, east, north in places:
        u = spark.range(1).select(geo.utm(F.lit(lon), F.lit(lat)).alias("u")).first().u
        assert u.zone == zone and abs(u.easting - east) < 60 and abs(u.northing - north) < 60, u


def test_box_touches_area(spark):
    area = [(0.0, 0.0), (6.0, 0.5), (5.0, 5.0), (3.0, 2.0), (1.0, 6.0), (0.0, 0.0)]
    r = random.Random(1)
    boxes = [(x, y, x + r.random() * 3, y + r.random() * 3) for x, y in ((r.uniform(-3, 7), r.uniform(-3, 7)) for _ in range(200))] + [(2.5, 3.4, 3.2, 3.9), (0.9, 0.9, 1.2, 1.2), (-9.0, -9.0, 9.0, 9.0)]

    def inside(x, y):
        odd = False
        for (ax, ay), (bx, by) in zip(area, area[1:]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
        return odd

    df = spark.createDataFrame([(k, *b) for k, b in enumerate(boxes)], "k int, w double, s double, e double, n double")
    got = {x.k: x.t for x in df.select("k", geo.box_touches(area, *(F.col(c) for c in "wsen")).alias("t")).collect()}
    for k, (w, s, e, n) in enumerate(boxes):
        steps = np.linspace(0, 1, 60)
        want = any(inside(w + a * (e - w), s + b * (n - s)) for a in steps for b in steps) or any(w <= ax + t * (bx - ax) <= e and s <= ay + t * (by - ay) <= n for (ax, ay), (bx, by) in zip(area, area[1:]) for t in np.linspace(0, 1, 400))
        assert got[k] == want, boxes[k]
