"""Overlays of polygons as joins of their edges: union, intersection, difference, and validity.

Coordinates are snapped to a grid of whole numbers. Edges that meet inside a cell are split at each other until none cross (noding); equal pieces
are merged to one with a net direction for each operand. What lies on both sides of a piece is told by winding numbers: the directed pieces that a
ray from its middle crosses, found by a join on bands. A piece is kept where the result lies on one side only, directed with the result on its left,
and kept pieces are joined to rings. Results of one overlay share their pieces, so areas add up exactly on the snapped grid.

Polygons are rows (by..., rings array<array<struct<x, y>>>), closed rings in any order and direction. Polygons of one key make one operand.
Keys of few edges are shuffled once and done on arrays, many in one (operators/noding.py). Those of more are keyed by `by` and by cells, so
neither a polygon nor its ring has to fit in a task before the last step.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import cos, pi, sin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolith.functions import geometry as geo
from agrolith.operators import noding
from agrolith.operators.rings import rings as rings_of
from agrolith.operators.scratch import forget, written
from agrolith.operators.zonal import points_in_polygons

#: Steps of the snapped grid for a degree, and a cell's side in degrees.
SCALE, CELL = 1e9, 0.01

Inside = Callable[[Column, Column], Column]
odd = lambda w: w % 2 != 0
some = lambda w: w != 0

#: What belongs to a result, by the winding numbers (columns or arrays) of a point in the operands a and b; a by the even-odd rule, b by the non-zero rule.
RESULTS: dict[str, Inside] = {
    "difference": lambda a, b: odd(a) & ~some(b),
    "intersection": lambda a, b: odd(a) & some(b),
    "union": lambda a, b: odd(a) | some(b),
    "valid": lambda a, b: odd(a),
    "merged": lambda a, b: some(a),
}
_AT = ["x1", "y1", "x2", "y2"]


def edges_of(polygons: DataFrame, by: list[str], operand: str, scale: float = SCALE) -> DataFrame:
    """(by..., x1, y1, x2, y2, a, b): snapped edges, each from its lesser to its greater point; a or b is 1, or -1 where the ring goes the other way."""
    ring = F.transform("_r", lambda p: F.struct(F.round(p["x"] * scale).cast("bigint").alias("x"), F.round(p["y"] * scale).cast("bigint").alias("y")))
    r = polygons.select(*by, F.explode("rings").alias("_r")).select(*by, ring.alias("_r"))
    r = r.select(*by, geo.closed(F.col("_r")).alias("_r"))
    step = F.zip_with("_r", F.slice("_r", 2, F.greatest(F.size("_r"), F.lit(1))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    e = r.select(*by, F.explode(step).alias("e")).where("e.q IS NOT NULL AND e.p <> e.q")
    way = F.when(F.col("e.p") < F.col("e.q"), 1).otherwise(-1)
    low, high = F.least("e.p", "e.q"), F.greatest("e.p", "e.q")
    e = e.select(*by, low.alias("p"), high.alias("q"), way.alias("w"))
    return e.select(*by, *(F.col(f"{n}.{axis}").alias(f"{axis}{k}") for k, n in ((1, "p"), (2, "q")) for axis in "xy"), *(F.col("w").cast("bigint").alias(c) if c == operand else F.lit(0).cast("bigint").alias(c) for c in "ab"))


def _net(edges: DataFrame, by: list[str]) -> DataFrame:
    """Equal edges as one; those that cancel out go. One that is new to the noding stays new."""
    return edges.groupBy(*by, *_AT).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.bool_or("new").alias("new")).where("a <> 0 OR b <> 0")


def _cross(ox: Column, oy: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Exact while differences stay below 2^31; beyond it the job ends with an overflow error."""
    return (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)


def crossings(edges: DataFrame, by: list[str], cell: int) -> DataFrame:
    """(by..., edge, p): points inside edges at which they meet others; of two edges one at least must be new.

    Two edges meet in many cells; they are compared in the one that holds the least corner of what their bounds share.
    """
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell))
    one = edges.select(*by, F.struct(*_AT).alias("e"), "new", F.explode(span(F.col("x1"), F.col("x2"))).alias("_cx"), "y1", "y2").withColumn("_cy", F.explode(span(F.col("y1"), F.col("y2")))).select(*by, "e", "new", "_cx", "_cy")
    # Written tables compress well, so their size misleads Spark to broadcast what the driver can't hold.
    near = one.where("new").join(one.withColumnsRenamed({"e": "f", "new": "_new"}).hint("merge"), [*by, "_cx", "_cy"]).where(~F.col("_new") & (F.col("e") != F.col("f")) | (F.col("e") < F.col("f")))
    e, f = ({c: F.col(f"{n}.{c}") for c in _AT} for n in "ef")
    apart = (e["x2"] < f["x1"]) | (f["x2"] < e["x1"]) | (F.greatest(e["y1"], e["y2"]) < F.least(f["y1"], f["y2"])) | (F.greatest(f["y1"], f["y2"]) < F.least(e["y1"], e["y2"]))
    low = lambda axis: F.floor(F.greatest(*(F.least(n[f"{axis}1"], n[f"{axis}2"]) for n in (e, f))) / cell)
    near = near.where(~apart & (F.col("_cx") == low("x")) & (F.col("_cy") == low("y"))).select(*by, "e", "f")
    d = {"f1": _cross(*(e[c] for c in _AT), f["x1"], f["y1"]), "f2": _cross(*(e[c] for c in _AT), f["x2"], f["y2"]), "e1": _cross(*(f[c] for c in _AT), e["x1"], e["y1"]), "e2": _cross(*(f[c] for c in _AT), e["x2"], e["y2"])}
    near = near.select(*by, "e", "f", *(v.alias(k) for k, v in d.items()))
    proper = (F.signum("f1") * F.signum("f2") < 0) & (F.signum("e1") * F.signum("e2") < 0)
    t = F.col("e1") / (F.col("e1") - F.col("e2")).cast("double")
    whole = lambda axis: F.round(e[f"{axis}1"] + t * (e[f"{axis}2"] - e[f"{axis}1"])).cast("bigint")
    meet = F.when(proper, F.struct(whole("x").alias("x"), whole("y").alias("y")))
    ends = {f"{n}{k}": F.struct(F.col(f"{n}.x{k}").alias("x"), F.col(f"{n}.y{k}").alias("y")) for n in "ef" for k in (1, 2)}

    def on(side: str, other: dict) -> Column:
        """The end of one edge, if it lies on the other."""
        p = ends[side]
        within = p["x"].between(other["x1"], other["x2"]) & p["y"].between(F.least(other["y1"], other["y2"]), F.greatest(other["y1"], other["y2"]))
        return F.when((F.col(side) == 0) & within, p)

    points = near.select(*by, "e", "f", F.array(meet, on("f1", e), on("f2", e)).alias("pe"), F.array(meet, on("e1", f), on("e2", f)).alias("pf"))
    both = points.select(*by, F.col("e").alias("edge"), F.explode("pe").alias("p")).unionByName(points.select(*by, F.col("f").alias("edge"), F.explode("pf").alias("p")))
    inner = both.where("p IS NOT NULL").where(~(((F.col("p.x") == F.col("edge.x1")) & (F.col("p.y") == F.col("edge.y1"))) | ((F.col("p.x") == F.col("edge.x2")) & (F.col("p.y") == F.col("edge.y2")))))
    return inner.select(*by, "edge", "p").distinct()


def noded(edges: DataFrame, by: list[str], cell: int) -> DataFrame:
    """The edges' pieces between all points where they meet, as a written table.

    Snapped points may move a piece onto another, so it is repeated for pieces that moved, which are new; others are split where they meet already.
    """
    now = written(_net(edges.withColumn("new", F.lit(True)), by))
    while not now.where("new").isEmpty():
        found = written(crossings(now, by, cell))
        if found.isEmpty():
            forget(found)
            break
        split = now.withColumn("edge", F.struct(*_AT)).join(found.groupBy(*by, "edge").agg(F.collect_list("p").alias("inner")).hint("merge"), [*by, "edge"], "left")
        # Along an edge: by how far a point lies in the edge's direction.
        along = lambda p: (p["x"] - F.col("x1")).cast("double") * (F.col("x2") - F.col("x1")) + (p["y"] - F.col("y1")).cast("double") * (F.col("y2") - F.col("y1"))
        ordered = F.transform(F.array_sort(F.transform("inner", lambda p: F.struct(along(p).alias("k"), p.alias("p")))), lambda s: s["p"])
        path = F.concat(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))), F.coalesce(ordered, F.array().cast("array<struct<x:bigint,y:bigint>>")), F.array(F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))
        moved = F.exists(F.coalesce("inner", F.array().cast("array<struct<x:bigint,y:bigint>>")), lambda p: _cross(*(F.col(c) for c in _AT), p["x"], p["y"]) != 0)
        split = split.select(*by, "a", "b", moved.alias("new"), path.alias("path"))
        pieces = split.select(*by, "a", "b", "new", F.explode(F.zip_with("path", F.slice("path", 2, F.size("path")), lambda p, q: F.struct(p.alias("p"), q.alias("q")))).alias("s")).where("s.q IS NOT NULL AND s.p <> s.q")
        turned = F.col("s.p") > F.col("s.q")  # a snapped point may lie a little before the one it follows
        low, high = F.least("s.p", "s.q"), F.greatest("s.p", "s.q")
        pieces = pieces.select(*by, low["x"].alias("x1"), low["y"].alias("y1"), high["x"].alias("x2"), high["y"].alias("y2"), "new", *(F.when(turned, -F.col(c)).otherwise(F.col(c)).alias(c) for c in "ab"))
        new = written(_net(pieces, by))
        forget(now)
        forget(found)
        now = new
    return now.drop("new")


def windings(pieces: DataFrame, by: list[str], cell: int) -> DataFrame:
    """The pieces with la, ra, lb, rb: the winding numbers of both operands on their left and right hand, looking from the lesser point.

    From the middle of a steep piece a ray goes along x, from that of a flat one along y, so neither is parallel to its own ray. Coordinates are
    doubled, which makes middles whole numbers.
    """
    steep = F.abs(F.col("y2") - F.col("y1")) >= (F.col("x2") - F.col("x1"))
    found = None
    for own, (x1, y1, x2, y2), sign in ((steep, ("x1", "y1", "x2", "y2"), 1), (~steep, ("y1", "x1", "y2", "x2"), -1)):
        rays = pieces.where(own).select(*by, *_AT, "a", "b", (F.col(x1) + F.col(x2)).alias("mx"), (F.col(y1) + F.col(y2)).alias("my"))
        rays = rays.withColumn("_band", F.floor(F.col("my") / (2 * cell)))
        low, high = F.least(y1, y2), F.greatest(y1, y2)
        rising = F.col(y1) < F.col(y2)
        walls = pieces.where(F.col(y1) != F.col(y2)).select(
            *by, *((2 * F.when(rising, F.col(p)).otherwise(F.col(q))).alias(n) for n, p, q in (("ux", x1, x2), ("uy", y1, y2), ("vx", x2, x1), ("vy", y2, y1))),
            *((F.col(c) * F.when(rising, 1).otherwise(-1)).alias(f"w{c}") for c in "ab"), F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))).alias("_band"),
        )
        crossed = (F.col("uy") <= F.col("my")) & (F.col("vy") > F.col("my")) & (_cross(F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy"), F.col("mx"), F.col("my")) > 0)
        sums = rays.join(walls.hint("merge"), [*by, "_band"]).where(crossed).groupBy(*by, *_AT).agg(*((sign * F.sum(f"w{c}")).alias(f"s{c}") for c in "ab"))
        both = rays.join(sums.hint("merge"), [*by, *_AT], "left")
        way = F.when(F.col(y1) < F.col(y2), 1).otherwise(-1)
        plus = {c: F.coalesce(F.col(f"s{c}"), F.lit(0)) for c in "ab"}
        minus = {c: plus[c] + sign * way * F.col(c) for c in "ab"}
        # Beyond a steep piece lies its right hand if it rises; beyond a flat one, which runs along x, its left hand.
        beyond_is_left = (way < 0) if sign == 1 else F.lit(True)
        sides = [F.when(beyond_is_left, (plus if left else minus)[c]).otherwise((minus if left else plus)[c]).alias(f"{'l' if left else 'r'}{c}") for left in (True, False) for c in "ab"]
        part = both.select(*by, *_AT, *sides)
        found = part if found is None else found.unionByName(part)
    return found


def _rings(wound: DataFrame, by: list[str], cell: int, inside: Inside) -> DataFrame:
    left, right = inside(F.col("la"), F.col("lb")), inside(F.col("ra"), F.col("rb"))
    kept = wound.where(left != right).withColumn("_left", left)
    ends = [F.when(F.col("_left"), F.col(p)).otherwise(F.col(q)).alias(p) for p, q in zip(_AT, ("x2", "y2", "x1", "y1"), strict=True)]
    return rings_of(kept.select(*by, *ends), by, cell, split=True)


def parts(loops: DataFrame, by: list[str], cell: float) -> DataFrame:
    """(by..., part, rings): each outer ring with its holes, from rings (by..., ring) that don't cross."""
    near = F.transform("ring", lambda p: F.struct((p["x"] - F.get("ring", 0)["x"]).alias("x"), (p["y"] - F.get("ring", 0)["y"]).alias("y")))  # products stay small
    loops = written(loops.withColumn("_area", geo.signed_area(near)).withColumn("_id", F.struct(*by, F.get("ring", 0).alias("p"), F.get("ring", 1).alias("q"), F.col("_area").alias("s"))))
    outer = loops.where("_area > 0")
    p, q = (F.get("ring", k) for k in (0, 1))
    holes = loops.where("_area < 0").select(*by, F.col("_id").alias("_hole"), F.col("ring").alias("_hole_ring"), ((p["x"] + q["x"]) / 2).alias("x"), ((p["y"] + q["y"]) / 2).alias("y"))
    around = points_in_polygons(holes, outer.select(*by, "_id", "_area", F.array("ring").alias("rings")), cell, by)
    owned = around.groupBy(*by, "_hole").agg(F.min_by("_id", "_area").alias("_id"), F.first("_hole_ring").alias("_hole_ring")).groupBy(*by, "_id").agg(F.array_sort(F.collect_list("_hole_ring")).alias("_holes"))
    whole = outer.join(owned.hint("merge"), [*by, "_id"], "left").withColumn("rings", F.concat(F.array("ring"), F.coalesce("_holes", F.array().cast("array<array<struct<x:double,y:double>>>"))))
    first = Window.partitionBy(*by).orderBy("_id")
    return whole.withColumn("part", F.row_number().over(first) - 1).select(*by, "part", "rings")


def scaled(polygons: DataFrame, scale: float) -> DataFrame:
    """Rings of the snapped grid in coordinates again."""
    point = lambda p: F.struct((p["x"] / scale).alias("x"), (p["y"] / scale).alias("y"))
    return polygons.withColumn("rings", F.transform("rings", lambda r: F.transform(r, point)))


def overlay(a: DataFrame, b: DataFrame | None, by: list[str], results: tuple[str, ...], scale: float = SCALE, cell: float = CELL) -> dict[str, DataFrame]:
    """For each of the results (RESULTS), its polygons (by..., part, rings). a, b: polygons; those of b that have a key of a take part."""
    step = max(1, int(cell * scale))
    operands = {"a": a} if b is None else {"a": a, "b": b}
    sizes = reduce(DataFrame.unionByName, (p.select(*by, F.coalesce(F.size(F.flatten("rings")), F.lit(0)).alias("n")) for p in operands.values()))
    many = written(sizes.groupBy(*by).agg(F.sum("n").alias("n")).where(F.col("n") > noding.HELD).select(*by))
    some_many = not many.isEmpty()

    def edges(kind: str | None) -> DataFrame:
        """Of keys with many edges or few, or of all."""
        kept = ((p.join(many.hint("merge"), by, kind) if kind else p, name) for name, p in operands.items())
        return reduce(DataFrame.unionByName, (edges_of(p, by, name, scale) for p, name in kept))

    few = noding.polygons_of_keys(edges("left_anti" if some_many else None), by, [RESULTS[name] for name in results], scale)
    few = written(few) if len(results) > 1 else few
    found = {name: few.where(F.col("result") == k).select(*by, "part", "rings") for k, name in enumerate(results)}
    if some_many:
        pieces = noded(edges("left_semi"), by, step)
        wound = written(windings(pieces, by, step)) if len(results) > 1 else windings(pieces, by, step)
        found = {name: own.unionByName(scaled(parts(_rings(wound, by, step, RESULTS[name]), by, step), scale)) for name, own in found.items()}
    return found


def make_valid(polygons: DataFrame, by: list[str], scale: float = SCALE, cell: float = CELL) -> DataFrame:
    """(by..., part, rings): the even-odd area of each key's rings as simple outer rings with their holes; spikes and repeated points go."""
    return overlay(polygons, None, by, ("valid",), scale, cell)["valid"]


def union(polygons: DataFrame, by: list[str], scale: float = SCALE, cell: float = CELL) -> DataFrame:
    """(by..., part, rings): polygons of one key, whose outer rings all turn the same way, as one."""
    return overlay(polygons, None, by, ("merged",), scale, cell)["merged"]


def capsules(lines: DataFrame, reach: float, quarter: int = 8) -> DataFrame:
    """The lines (ax, ay, bx, by) with rings: what lies within `reach` of each, with round ends of `quarter` steps a quarter turn."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    length = F.sqrt(dx * dx + dy * dy)
    ux, uy = (F.when(length > 0, d / F.when(length > 0, length).otherwise(1.0)).otherwise(z) for d, z in ((dx, 1.0), (dy, 0.0)))
    at = []
    for x, y, turned in (("bx", "by", -pi / 2), ("ax", "ay", pi / 2)):
        for k in range(2 * quarter + 1):
            c, s = cos(turned + k * pi / 2 / quarter) * reach, sin(turned + k * pi / 2 / quarter) * reach
            at.append(F.struct((F.col(x) + c * ux - s * uy).alias("x"), (F.col(y) + c * uy + s * ux).alias("y")))
    return lines.withColumn("rings", F.array(F.array(*at, at[0])))


def cut_by_roads(outlines: DataFrame, roads: DataFrame, reach: float, by: list[str], scale: float = SCALE, cell: float = CELL) -> DataFrame:
    """(by..., part, rings): the outlines without what lies within `reach` of a road (ax, ay, bx, by), each part a polygon of its own.

    A road meets an outline where their bounds touch a common cell; outlines without a road near keep their rings as they are.
    """
    span = lambda box, low, high: F.sequence(F.floor(F.get(box, low) / cell), F.floor(F.get(box, high) / cell))

    def placed(df: DataFrame, keep: list) -> DataFrame:
        box = geo.bounds(F.flatten("rings"))
        return df.select(*keep, F.explode(span(box, 0, 2)).alias("_cx"), span(box, 1, 3).alias("_ys")).withColumn("_cy", F.explode("_ys")).drop("_ys")

    strips = placed(written(capsules(roads.select("ax", "ay", "bx", "by"), reach)), [F.struct("ax", "ay", "bx", "by").alias("_road"), F.col("rings").alias("_strip")])
    boxes = placed(outlines, [*by, geo.bounds(F.flatten("rings")).alias("_box")])
    near = boxes.join(strips, ["_cx", "_cy"])
    own, other = (lambda k: F.get("_box", k)), (lambda k: F.get(geo.bounds(F.flatten("_strip")), k))
    near = near.where((own(0) <= other(2)) & (other(0) <= own(2)) & (own(1) <= other(3)) & (other(1) <= own(3)))
    met = written(near.groupBy(*by, "_road").agg(F.first("_strip").alias("rings")).select(*by, "rings"))
    touched = met.select(*by).distinct()
    cut = overlay(outlines.join(touched, by, "left_semi").select(*by, "rings"), met, by, ("difference",), scale, cell)["difference"]
    return outlines.join(touched, by, "left_anti").select(*by, F.lit(0).alias("part"), "rings").unionByName(cut)
