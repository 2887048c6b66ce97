"""Closed rings from directed boundary edges, whatever their number: chains inside cells, joined across cells by components.

edges: (by..., x1, y1, x2, y2) with the interior on the left hand, as many into each point as out of it. An edge's successor is found by a join
on its end point; where several begin there, the sharpest left turn is taken, so a ring goes around one face. A task links a block of edges, in the
order of keys and cells, to chains; only chains that leave their block take part in the components. A ring, at last, is one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import pi

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolith.operators.graph import connected_components
from agrolith.operators.scratch import ship, written

_AT = ["x1", "y1", "x2", "y2"]
#: Edges that a task links at once, and the side, in cells, of what goes to one task.
BLOCK, WIDE = 65_536, 16


def turn(x1: Column, y1: Column, x2: Column, y2: Column, x3: Column, y3: Column) -> Column:
    """The angle at (x2, y2) from the way on to (x3, y3) to the way back, clockwise from the way back: the least is the sharpest left turn."""
    back, on = F.atan2((y1 - y2).cast("double"), (x1 - x2).cast("double")), F.atan2((y3 - y2).cast("double"), (x3 - x2).cast("double"))
    angle = F.pmod(back - on, F.lit(2 * pi))
    return F.when(angle < 1e-12, 2 * pi).otherwise(angle)


def successors(edges: DataFrame, by: list[str], stops: DataFrame | None = None) -> DataFrame:
    """The edges with nx, ny: the end of the edge that follows. stops: (by..., x2, y2), points at which an edge has no successor (nulls)."""
    out = edges.select(*by, F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("x2").alias("nx"), F.col("y2").alias("ny"))
    if stops is not None:
        out = out.join(stops, [*by, "x2", "y2"], "left_anti")
    near = edges.select(*by, *_AT).join(out.hint("merge"), [*by, "x2", "y2"], "inner" if stops is None else "left")
    first = Window.partitionBy(*by, *_AT).orderBy(turn(*(F.col(c) for c in (*_AT, "nx", "ny"))), "nx", "ny")
    return near.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").select(*by, *_AT, "nx", "ny")


def corners(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """A ring's points without straight ones, from the least on; the first isn't repeated."""
    n = len(points)
    kept = [p for k, p in enumerate(points) if (p[0] - points[k - 1][0]) * (points[(k + 1) % n][1] - p[1]) != (p[1] - points[k - 1][1]) * (points[(k + 1) % n][0] - p[0])]
    if not kept:
        return []
    at = kept.index(min(kept))
    return kept[at:] + kept[:at]


def simple_loops(points: list[tuple]) -> list[list[tuple]]:
    """A ring cut at points that it visits again, so that no loop touches itself."""
    return [[points[k] for k in loop] for loop in loops_at(points)]


def loops_at(points: list) -> list[list[int]]:
    """The places of the points of each simple loop of a ring."""
    loops, path, place = [], [], {}
    for n, p in enumerate(points):
        if p in place:
            k = place[p]
            loops.append(path[k:])
            for m in path[k:]:
                del place[points[m]]
            del path[k:]
        place[p] = len(path)
        path.append(n)
    return [*loops, path]


def _linked(after: dict[tuple, tuple]) -> list[tuple[bool, tuple, tuple, list[tuple]]]:
    """Chains of edges, open ones first: whether closed, the first edge, what follows the last, and the edges in order."""
    inner = {n for n in after.values() if n in after}
    found = []
    for closed, starts in ((False, [e for e in after if e not in inner]), (True, list(after))):
        for start in starts:
            here, own = start, []
            while here in after:
                own.append(here)
                here = after.pop(here)
            if own:
                found.append((closed, start, here, own))
    return found


def _chains(table: pa.Table, by: list[str]) -> pa.Table:
    """Chains of some edges: whether they are closed, their first edge, the edge that follows the last (null: none), and their points but the last."""
    key = list(zip(*(table[c].to_pylist() for c in by), strict=True)) if by else [()] * len(table)
    ends = list(zip(*(table[c].to_pylist() for c in (*_AT, "nx", "ny")), strict=True))
    # Edges of one key lie together; equal edges of other keys are others.
    run = list(accumulate((k > 0 and key[k] != key[k - 1] for k in range(len(key))), initial=0))[1:]
    after = {(n, a, b, c, d): (n, c, d, e, f) for n, (a, b, c, d, e, f) in zip(run, ends, strict=True)}
    at = {n: k for k, n in reversed(list(enumerate(run)))}
    rows = _linked(after)
    edge = pa.struct([(c, table.schema.field(c).type) for c in _AT])
    point = pa.list_(pa.struct([("x", table.schema.field("x1").type), ("y", table.schema.field("x1").type)]))
    named = [[None if r[k][3] is None else dict(zip(_AT, r[k][1:], strict=True)) for r in rows] for k in (1, 2)]
    points = [[{"x": e[1], "y": e[2]} for e in own] + ([{"x": own[-1][3], "y": own[-1][4]}] if following[3] is None else []) for _, _, following, own in rows]
    own = pa.array([at[r[1][0]] for r in rows], pa.int64())
    return pa.table({c: table[c].take(own) for c in by} | {"closed": pa.array([r[0] for r in rows], pa.bool_()), "first": pa.array(named[0], edge), "following": pa.array(named[1], edge), "points": pa.array(points, point)})


def chains(edges: DataFrame, by: list[str], cell: float, stops: DataFrame | None = None) -> DataFrame:
    """(by..., closed, points array<struct<x, y>>): edges (each once) joined to closed chains, and to open ones between stops.

    A closed chain doesn't repeat its first point; an open one has both ends. Tasks make chains of a block of edges, many cells and keys in one,
    and chains that leave their block are joined by components.
    """
    ship(edges.sparkSession)
    kind = edges.schema["x1"].dataType
    edge, point = T.StructType([T.StructField(c, kind) for c in _AT]), T.ArrayType(T.StructType([T.StructField("x", kind), T.StructField("y", kind)]))
    held = [edges.schema[c] for c in by]
    placed = successors(edges, by, stops).withColumn("_cx", F.floor(F.col("x1") / (WIDE * cell))).withColumn("_cy", F.floor(F.col("y1") / (WIDE * cell)))
    placed = placed.repartition(*by, "_cx", "_cy").sortWithinPartitions(*by, "_cx", "_cy")
    schema = T.StructType([*held, T.StructField("closed", T.BooleanType()), T.StructField("first", edge), T.StructField("following", edge), T.StructField("points", point)])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                yield from _chains(pa.Table.from_batches(held), by).to_batches()
                held = []
        if held:
            yield from _chains(pa.Table.from_batches(held), by).to_batches()

    found = written(placed.mapInArrow(linked, schema))
    ended = F.col("following").isNull()
    whole, open_ = found.where("closed").select(*by, "closed", "points"), found.where("not closed")
    if open_.where(~ended).isEmpty():
        return whole.unionByName(open_.select(*by, "closed", "points"))
    node = F.struct(*by, "first").alias("node")
    links = open_.where(~ended).select(node.alias("a"), F.struct(*by, F.col("following").alias("first")).alias("b"))
    parts = open_.withColumn("node", node).join(connected_components(open_.select(node), links), "node").select(*by, "component", "first", "following", "points")

    def joined(table: pa.Table) -> pa.Table:
        rows = {tuple(r["first"].values()): r for r in table.select(["first", "following", "points"]).to_pylist()}
        ((closed, _, _, own),) = _linked({k: tuple(r["following"].values()) if r["following"] else (None,) * 4 for k, r in rows.items()})
        points = [p for k in own for p in rows[k]["points"]]
        return table.slice(0, 1).select(by).append_column("closed", pa.array([closed])).append_column("points", pa.array([points], table.schema.field("points").type))

    return whole.unionByName(parts.groupBy(*by, "component").applyInArrow(joined, T.StructType([*held, T.StructField("closed", T.BooleanType()), T.StructField("points", point)])))


def rings(edges: DataFrame, by: list[str], cell: float, split: bool = False, straight: bool = False) -> DataFrame:
    """(by..., ring array<struct<x, y>>): closed rings that begin at their least corner. cell: the side of a cell.

    split: rings are cut where they touch themselves, so that outer rings and holes are simple. straight: points in straight runs stay.
    """
    whole = chains(edges, by, cell).select(*by, "points")

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for k, points in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                path = [(p["x"], p["y"]) for p in points]
                for loop in simple_loops(path) if split else [path]:
                    if ring := corners(loop):
                        if straight:
                            n = loop.index(ring[0])
                            ring = loop[n:] + loop[:n]
                        at.append(k)
                        out.append([{"x": float(x), "y": float(y)} for x, y in (*ring, ring[0])])
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array(out, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))], [*by, "ring"])

    double = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
    return whole.mapInArrow(shaped, T.StructType([*(edges.schema[c] for c in by), T.StructField("ring", double)]))
