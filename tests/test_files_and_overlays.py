"""Raster files, warping, rings, overlays and shared borders against brute force and definitions."""

from __future__ import annotations

import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from agrolith.functions import geometry as geo
from agrolith.operators import overlay, segment, warp
from agrolith.sources import geotiff

POLYGONS = "id int, rings array<array<struct<x double,y double>>>"


def pts(*at):
    return [{"x": float(x), "y": float(y)} for x, y in at]


def area(rings) -> float:
    return sum(sum(p.x * q.y - q.x * p.y for p, q in zip(r, r[1:], strict=False)) / 2 for r in rings)


def areas(df) -> dict[int, float]:
    found = Counter()
    for r in df.collect():
        assert area(r.rings[:1]) > 0 and all(area([h]) < 0 for h in r.rings[1:])
        found[r.id] += area(r.rings)
    return found


# --- files -----------------------------------------------------------------------------------------------------------------------------


def test_codecs():
    r = np.random.default_rng(1)
    for data in (b"", b"a", bytes(r.integers(0, 3, 9000, dtype=np.uint8)), bytes(r.integers(0, 256, 20_000, dtype=np.uint8)), bytes(100_000)):
        assert geotiff.lzw_decoded(geotiff.lzw_encoded(data)) == data
    # Codes of 9 bits by hand: clear, 7, 258 (7 7), 259 (7 7 7), end.
    assert geotiff.lzw_decoded(int("100000000" "000000111" "100000010" "100000011" "100000001" "000", 2).to_bytes(6, "big")) == bytes([7] * 6)
    assert geotiff.packbits_decoded(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0x80, 0xFD, 0xAA])) == bytes.fromhex("aaaaaa80002aaaaaaaaa")


def old_tiff(values: np.ndarray, order: str, planar: bool, deflate: bool, predictor: bool, strip: int) -> bytes:
    """A file in strips with 32-bit offsets, written by hand."""
    h, w, n = values.shape
    data, strips = values.astype(values.dtype.newbyteorder(order)), []
    for layer in [data[..., k : k + 1] for k in range(n)] if planar else [data]:
        for top in range(0, h, strip):
            own = layer[top : top + strip]
            if predictor:
                own = np.concatenate([own[:, :1], own[:, 1:] - own[:, :-1]], axis=1).astype(data.dtype)
            raw = own.tobytes()
            strips.append(zlib.compress(raw) if deflate else raw)
    bits, kind = values.dtype.itemsize * 8, {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    entries = [(256, "I", [w]), (257, "I", [h]), (258, "H", [bits] * n), (259, "H", [8 if deflate else 1]), (273, "I", [0] * len(strips)), (277, "H", [n]), (278, "I", [strip]), (279, "I", list(map(len, strips))), (284, "H", [2 if planar else 1]), (317, "H", [2 if predictor else 1]),
               (339, "H", [kind] * n), (33550, "d", [0.5, 0.25, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 10.0, 50.0, 0.0]), (34735, "H", [1, 1, 0, 1, 3072, 0, 1, 32633]), (42113, "c", list(b"7\0"))]
    code, far, out, begin = {"H": 3, "I": 4, "d": 12, "c": 2}, b"", b"", 8 + 2 + 12 * len(entries) + 4
    first = begin + sum(struct.calcsize(f"={len(v)}{k}") for _, k, v in entries if struct.calcsize(f"={len(v)}{k}") > 4)
    for tag, form, v in entries:
        if tag == 273:
            v = [first + sum(map(len, strips[:k])) for k in range(len(strips))]
        raw = bytes(v) if form == "c" else struct.pack(f"{order}{len(v)}{form}", *v)
        if len(raw) > 4:
            place, far = struct.pack(order + "I", begin + len(far)), far + raw
        else:
            place = raw.ljust(4, b"\0")
        out += struct.pack(order + "HHI", tag, code[form], len(v)) + place
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(entries)) + out + struct.pack(order + "I", 0) + far + b"".join(strips)


@pytest.mark.parametrize(("order", "planar", "deflate", "predictor", "dtype"), [("<", False, False, False, "f4"), (">", True, True, True, "u2"), (">", False, True, True, "u1"), ("<", True, False, False, "i4")])
def test_strips_of_either_kind(tmp_path, order, planar, deflate, predictor, dtype):
    values = np.random.default_rng(2).integers(0, 200, (11, 7, 2)).astype(dtype)
    (tmp_path / "x.tif").write_bytes(old_tiff(values, order, planar, deflate, predictor, 4))
    raster = geotiff.directory(str(tmp_path / "x.tif"))
    assert (raster.height, raster.width, raster.bands, raster.epsg, raster.no_data, raster.affine) == (11, 7, 2, 32633, 7.0, (0.5, 0.0, 10.0, 0.0, -0.25, 50.0))
    reader = geotiff.GeoTiffReader({"path": str(tmp_path / "x.tif"), "part_bytes": "1"})
    assert len(reader.partitions()) == 3
    found = np.full(values.shape, np.nan)
    for part in reader.partitions():
        for batch in reader.read(part):
            at = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            for k in (0, 1):
                found[(*at, k)] = batch.column(5 + k).to_numpy(zero_copy_only=False)
    assert np.array_equal(found, np.where(values == 7, np.nan, values.astype(float)), equal_nan=True)


def test_windows_open_only_their_tiles(spark, tmp_path):
    grid = spark.range(200 * 150).select(F.expr("id div 150").alias("row"), (F.col("id") % 150).alias("col")).withColumn("a", F.col("row") % 256).withColumn("b", F.col("col") * 3 % 256)
    both = grid.withColumn("raster_id", F.lit("one")).unionByName(grid.withColumn("raster_id", F.lit("two")).withColumn("a", F.col("a") + 1).where("row < 100"))
    geotiff.write_geotiff(both, str(tmp_path), ["a", "b"], 200, 150, {"a": 0.5, "c": 3.0, "e": -0.5, "f": 9.0}, epsg=3857, tile=32, compression="deflate")
    back = geotiff.read_geotiff(spark, f"file://{tmp_path}")
    assert back.join(both, ["raster_id", "row", "col"]).where("b1 = a AND b2 = b").count() == 200 * 150 + 100 * 150
    assert back.where("raster_id = 'two' AND row >= 100 AND (b1 <> 0 OR b2 <> 0)").count() == 0
    reader = geotiff.GeoTiffReader({"path": str(tmp_path), "part_bytes": "1"})
    left = list(reader.pushFilters([GreaterThan(("row",), 31), LessThanOrEqual(("row",), 40), EqualTo(("col",), 70), In(("raster_id",), ("two", "three")), EqualTo(("b1",), 5.0)]))
    parts = reader.partitions()
    assert len(left) == 1 and [p.raster.raster_id for p in parts] == ["two"] and parts[0].places == [5 + 2]
    # The other tiles may be broken: nobody reads them.
    path = tmp_path / "one.tif"
    raster, data = geotiff.directory(str(path)), bytearray(path.read_bytes())
    for k, (at, size) in enumerate(zip(raster.offsets, raster.sizes, strict=True)):
        if k != 7:
            data[at : at + size] = b"\xff" * size
    path.write_bytes(data)
    assert back.where("raster_id = 'one' AND row BETWEEN 32 AND 63 AND col BETWEEN 64 AND 95").join(grid, ["row", "col"]).where("b1 = a AND b2 = b").count() == 32 * 32
    info = spark.read.format("geotiff_info").option("path", str(tmp_path)).load().orderBy("raster_id").collect()
    assert [(r.raster_id, r.height, r.width, r.bands, r.dtype, r.affine.a, r.affine.f, r.epsg, r.blocks) for r in info] == [(n, 200, 150, 2, "uint8", 0.5, 9.0, 3857, 35) for n in ("one", "two")]


# --- warping ---------------------------------------------------------------------------------------------------------------------------


def test_projections_go_there_and_back(spark):
    points = spark.createDataFrame([(lon, lat) for lon in (9.1, 12.0, 14.9) for lat in (-55.0, 0.0, 36.6, 79.0)], "lon double, lat double")
    for epsg in (4326, 3857, 32633, 32733):
        x, y = geo.from_lonlat(epsg, F.col("lon"), F.col("lat"))
        lon, lat = geo.to_lonlat(epsg, F.col("x"), F.col("y"))
        far = points.withColumn("x", x).withColumn("y", y).select(F.greatest(F.abs(lon - F.col("lon")), F.abs(lat - F.col("lat"))).alias("d")).agg(F.max("d")).first()[0]
        assert far < 1e-9, epsg
    with pytest.raises(ValueError, match="unknown"):
        geo.to_lonlat(2154, F.lit(0.0), F.lit(0.0))


def test_warp_of_a_plane_is_exact(spark):
    """A plane in map coordinates, with a hole, warped from UTM to degrees: bilinear values are the plane's, whatever the chunks' size."""
    source = warp.Georef(20.0, 500_000.0, -20.0, 4_060_000.0, 300, 280, 32633)
    g = spark.range(300 * 280).select(F.expr("id div 280").alias("row"), (F.col("id") % 280).alias("col"), (F.col("id") % 5).cast("int").alias("k")).withColumn("v", source.x(F.col("col") + 0.5) * 0.001 + source.y(F.col("row") + 0.5) * 0.002)
    g = g.where("NOT (row BETWEEN 100 AND 140 AND col BETWEEN 100 AND 140)")
    target = warp.default_target(spark, source, 4326)
    assert 250 < target.height < 350 and 250 < target.width < 350
    found = warp.warp(g, source, target, ["v"], ("k",))
    x, y = geo.from_lonlat(32633, target.x(F.col("col") + 0.5), target.y(F.col("row") + 0.5))
    u, v = (x - source.c) / source.a - 0.5, (y - source.f) / source.e - 0.5
    inner = u.between(0, 278.9) & v.between(0, 298.9) & ~(u.between(98.5, 141.5) & v.between(98.5, 141.5))
    r = found.where(inner).agg(F.count("*").alias("n"), F.count("v").alias("known"), F.max(F.abs(F.col("v") - (x * 0.001 + y * 0.002))).alias("far")).first()
    assert r.n == r.known > 60_000 and r.far < 1e-6
    assert found.where(u.between(102, 138) & v.between(102, 138) & F.col("v").isNotNull()).count() == 0
    assert found.where(inner).join(g.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("k").alias("want")), (F.floor(v + 0.5) == F.col("r")) & (F.floor(u + 0.5) == F.col("c"))).where("k = want").count() == r.n


# --- overlays --------------------------------------------------------------------------------------------------------------------------


def test_overlays_of_stars(spark):
    """Random self-crossing polygons: areas by counting points; difference and intersection add up exactly."""
    r = random.Random(2)
    star = lambda n: (lambda p: [*p, p[0]])(pts(*[(r.uniform(0, 10), r.uniform(0, 10)) for _ in range(n)]))
    a, b = ([(k, [star(n)]) for k in range(5)] for n in (12, 7))
    found = {n: areas(d) for n, d in overlay.overlay(spark.createDataFrame(a, POLYGONS), spark.createDataFrame(b, POLYGONS), ["id"], ("difference", "intersection", "union", "valid"), 1e6, 2.0).items()}

    def windings(ring, x, y):
        c = 0
        for p, q in zip(ring, ring[1:], strict=False):
            if (p["y"] > y) != (q["y"] > y) and x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]:
                c += 1 if q["y"] > p["y"] else -1
        return c

    n = 20_000
    at = [(r.uniform(0, 10), r.uniform(0, 10)) for _ in range(n)]
    for k in range(5):
        marks = [(windings(a[k][1][0], *p) % 2 == 1, windings(b[k][1][0], *p) != 0) for p in at]
        want = {"difference": sum(x and not y for x, y in marks), "intersection": sum(x and y for x, y in marks), "union": sum(x or y for x, y in marks), "valid": sum(x for x, _ in marks)}
        assert all(abs(found[m][k] - c * 100 / n) < 1.0 for m, c in want.items()), (k, want, {m: f[k] for m, f in found.items()})
        assert abs(found["difference"][k] + found["intersection"][k] - found["valid"][k]) < 1e-9


def test_validity_by_hand(spark):
    """A bow-tie, a spike with repeated points, a hole that touches the outer ring in a point, and a ring without area."""
    rings = [
        (1, [pts((0, 0), (2, 2), (2, 0), (0, 2), (0, 0))]), (2, [pts((0, 0), (4, 0), (4, 0), (6, 0), (4, 0), (4, 4), (0, 4), (0, 0))]),
        (3, [pts((0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (1, 1), (3, 1), (3, 3), (1, 3), (1, 1), (0, 0))]), (4, [pts((0, 0), (1, 0), (0, 0))]), (5, []),
        (6, [pts((0, 0), (4, 0), (4, 4), (0, 4)), pts((0, 0), (2, 1), (1, 2), (0, 0))]),
    ]
    found = sorted((r.id, r.part, [[(p.x, p.y) for p in ring] for ring in r.rings]) for r in overlay.make_valid(spark.createDataFrame(rings, POLYGONS), ["id"], 1000.0, 1.0).collect())
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    assert found == [
        (1, 0, [[(0.0, 0.0), (1.0, 1.0), (0.0, 2.0), (0.0, 0.0)]]), (1, 1, [[(1.0, 1.0), (2.0, 0.0), (2.0, 2.0), (1.0, 1.0)]]), (2, 0, [square]), (3, 0, [square, [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0), (1.0, 1.0)]]),
        (6, 0, [square, [(0.0, 0.0), (1.0, 2.0), (2.0, 1.0), (0.0, 0.0)]]),
    ]


def test_roads_cut_outlines(spark):
    """A road across a square leaves two parts less its strip; one that ends inside leaves one part; far outlines stay."""
    squares = [(k, [pts((x, 0), (x + 4, 0), (x + 4, 4), (x, 4), (x, 0))]) for k, x in ((1, 0), (2, 10), (3, 20))]
    roads = spark.createDataFrame([(-1.0, 2.0, 5.0, 2.0), (12.0, -3.0, 12.0, 2.0)], "ax double, ay double, bx double, by double")
    cut = overlay.cut_by_roads(spark.createDataFrame(squares, POLYGONS), roads, 0.5, ["id"], 1e6, 1.0).collect()
    by = {k: sorted(area(r.rings) for r in cut if r.id == k) for k in (1, 2, 3)}
    assert [round(a, 6) for a in by[1]] == [6.0, 6.0] and by[3] == [16.0]
    cap = sum(0.5 * 0.25 * np.sin(np.pi / 16) for _ in range(16))
    assert len(by[2]) == 1 and abs(by[2][0] - (16 - 2.0 - cap)) < 1e-5


# --- outlines --------------------------------------------------------------------------------------------------------------------------


def labelled(spark):
    r = np.random.default_rng(3)
    h, w, at = 30, 36, r.uniform(0, 1, (7, 2)) * [30, 36]
    y, x = np.mgrid[:h, :w]
    found = ((y[..., None] - at[:, 0]) ** 2 + (x[..., None] - at[:, 1]) ** 2 + r.normal(0, 6, (h, w, 7))).argmin(-1)
    return found, spark.createDataFrame([(int(found[i, j]), i, j) for i in range(h) for j in range(w)], "label long, row long, col long")


def test_outlines_and_shared_borders(spark):
    """Outlines are the same whatever the cells; simplified ones share each border's edges with the neighbour, and areas add up to the raster."""
    found, df = labelled(spark)
    rings = {size: sorted((r.label, r.ring_no, [tuple(p) for p in r.ring]) for r in segment.polygonize(df, size).collect()) for size in (512, 7)}
    assert rings[512] == rings[7]
    total = Counter()
    for label, _, ring in rings[7]:
        total[label] += sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2
    assert total == Counter(found.ravel().tolist())
    short = segment.simplify_shared(df, 1.5, cell=11).collect()
    edges = Counter((a.x, a.y, b.x, b.y) for r in short for a, b in zip(r.ring, r.ring[1:], strict=False))
    alone = [e for e in edges if (e[2], e[3], e[0], e[1]) not in edges]
    assert max(edges.values()) == 1 and len(edges) < sum(len(r[2]) for r in rings[7]) / 2
    # What no neighbour has is the raster's own border, so the areas add up to what it encloses.
    frame = sum(a * d - c * b for a, b, c, d in alone) / 2
    assert abs(sum(area([r.ring]) for r in short) - frame) < 1e-9 and frame > 0.97 * found.size
