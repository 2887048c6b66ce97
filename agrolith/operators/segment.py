"""Segmentation of pixel masks: components, holes, distances, flooding, region filters, outlines."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from agrolith.operators.graph import star_components
from agrolith.operators.grid import keys
from agrolith.operators.overlay import crossings
from agrolith.operators.rings import chains, rings
from agrolith.operators.scratch import ship, written
from agrolith.operators.stencil import windowed

_FORWARD = {4: [(0, 1), (1, 0)], 8: [(0, 1), (1, -1), (1, 0), (1, 1)]}
#: Rows and columns of a chunk, whose pixels are labelled as arrays.
CHUNK = 256
#: The side, in pixels, of a cell in which edges of simplified borders are compared; edges are short.
NEAR = 16


def least_labels(number: np.ndarray, kind: np.ndarray, connectivity: int) -> np.ndarray:
    """The least number of each pixel's component; kind: -1 beyond the mask, and only pixels of one kind are neighbours. Sweeps in four directions until nothing changes."""
    label, before = number.copy(), None
    while before is None or not np.array_equal(before, label):
        before = label.copy()
        for turn in range(4):
            v, k = np.rot90(label, turn), np.rot90(kind, turn)
            for row in range(1, len(v)):
                for a, b in ((slice(None), slice(None)), *(((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))) if connectivity == 8 else ())):
                    same = (k[row, a] == k[row - 1, b]) & (k[row, a] >= 0)
                    v[row, a][same] = np.minimum(v[row, a][same], v[row - 1, b][same])
    return label


def components(mask: DataFrame, width: Column, connectivity: int = 4, within: str | None = None) -> DataFrame:
    """(row, col, label): label is the least row * width + col of the pixel's component. mask: (row, col) of marked pixels.

    within: a column of the mask; only pixels that are equal in it are neighbours. Chunks are labelled in tasks; labels that meet across chunks'
    borders are joined by components of a graph of labels.
    """
    held = keys(mask)
    same = [within] if within else []
    at = F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col")
    marked = mask.select(*held, *(F.col(c).alias("_same") for c in same), *at, (F.col("row") * width + F.col("col")).cast("bigint").alias("n"))
    placed = marked.withColumn("_cy", F.floor(F.col("row") / CHUNK)).withColumn("_cx", F.floor(F.col("col") / CHUNK))

    def run(table: pa.Table) -> pa.Table:
        kind, number = np.full((CHUNK, CHUNK), -1), np.zeros((CHUNK, CHUNK), np.int64)
        place = table["row"].to_numpy() % CHUNK, table["col"].to_numpy() % CHUNK
        kind[place] = table["_same"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy() if same else 0
        number[place] = table["n"].to_numpy()
        label = least_labels(number, kind, connectivity)[place]
        return table.select([*held, *("_same" for _ in same), "row", "col"]).append_column("label", pa.array(label))

    ship(mask.sparkSession)
    fields = [placed.schema[c] for c in (*held, *("_same" for _ in same), "row", "col")]
    labelled = written(placed.groupBy(*held, "_cy", "_cx").applyInArrow(run, T.StructType([*fields, T.StructField("label", T.LongType())])))
    # Pixels on the borders of chunks meet those beyond.
    by = [*held, *("_same" for _ in same)]
    border = labelled.where(F.pmod("row", F.lit(CHUNK)).isin(0, CHUNK - 1) | F.pmod("col", F.lit(CHUNK)).isin(0, CHUNK - 1))
    steps = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in _FORWARD[connectivity]))
    near = border.select(*by, F.col("label").alias("_a"), "row", "col", F.explode(steps).alias("s"))
    other = lambda axis, step: F.floor(F.col(axis) / CHUNK) != F.floor((F.col(axis) + F.col(step)) / CHUNK)
    near = near.where(other("row", "s.r") | other("col", "s.c")).select(*by, "_a", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))
    node = lambda label: F.struct(*held, F.col(label).alias("n"))
    edges = written(near.join(border, [*by, "row", "col"]).where(F.col("_a") != F.col("label")).select(node("_a").alias("a"), node("label").alias("b")).distinct())
    if edges.isEmpty():
        return labelled.select(*held, "row", "col", "label")
    joined = star_components(edges)
    return labelled.withColumn("node", node("label")).join(joined, "node", "left").select(*held, "row", "col", F.coalesce("component.n", "label").alias("label"))


def min_regions(labels: DataFrame, least: int) -> DataFrame:
    """Pixels of regions with at least `least` pixels."""
    by = [*keys(labels), "label"]
    return labels.join(labels.groupBy(*by).count().where(F.col("count") >= least).select(*by), by).select(*keys(labels), "row", "col", "label")


def fill_holes(mask: DataFrame, frame: DataFrame, height: Column, width: Column) -> DataFrame:
    """The mask and its holes: components of the background (4-connected) that don't touch the border."""
    held = keys(mask)
    ground = components(frame.select(*held, "row", "col").join(mask, [*held, "row", "col"], "left_anti"), width)
    at_border = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == height - 1) | (F.col("col") == width - 1)
    holes = ground.join(ground.where(at_border).select(*held, "label").distinct(), [*held, "label"], "left_anti")
    return mask.select(*held, "row", "col").unionByName(holes.select(*held, "row", "col"))


def distances(mask: DataFrame, ground: DataFrame) -> DataFrame:
    """(row, col, distance) of marked pixels to the nearest unmarked one, exact whatever the distance; null if nothing is unmarked.

    Two separable passes: the nearest unmarked pixel of each row by windows, then along each column the least of its square plus the
    square of the rows between (lower envelope of parabolas). A task of the second pass holds one column.
    """
    held = keys(mask)
    before = Window.partitionBy(*held, "row").orderBy("col")
    both = mask.select(*held, "row", "col", F.lit(True).alias("marked")).unionByName(ground.select(*held, "row", "col", F.lit(False).alias("marked")))
    at = F.when(~F.col("marked"), F.col("col"))
    left = F.col("col") - F.last(at, True).over(before.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(at, True).over(before.rowsBetween(0, Window.unboundedFollowing)) - F.col("col")
    across = both.select(*held, F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), "marked", F.least(left, right).cast("bigint").alias("d"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[pdf["d"].notna()].sort_values("row")
        own = pdf[pdf["marked"]]
        d2 = lowest_parabolas(known["row"].tolist(), [int(d) ** 2 for d in known["d"]], own["row"].tolist())
        return own[[*held, "row", "col"]].assign(distance=pd.array([None if d is None else d**0.5 for d in d2], "Float64"))

    # Columns in which no row has an unmarked pixel stay in: their distance is null.
    schema = T.StructType([*(across.schema[c] for c in (*held, "row", "col")), T.StructField("distance", T.DoubleType())])
    ship(across.sparkSession)
    return across.groupBy(*held, "col").applyInPandas(run, schema)


def distance_seeds(distance: DataFrame, least: float = 5.0) -> DataFrame:
    """(row, col) of the pixels farther than `least` that are the largest of 20 x 20, from 10 before to 9 after. distance: as `distances` gives it."""
    held = keys(distance)
    top = windowed(distance, "max", 10, 9, "distance").withColumnRenamed("distance", "top")
    return distance.join(top, [*held, "row", "col"]).where((F.col("distance") == F.col("top")) & (F.col("distance") > least)).select(*held, "row", "col")


def cores(distance: DataFrame, share: float = 0.3) -> DataFrame:
    """(row, col) of the pixels whose distance is over `share` of their raster's largest one."""
    if held := keys(distance):
        return distance.join(distance.groupBy(*held).agg(F.max("distance").alias("top")), held).where(F.col("distance") > share * F.col("top")).select(*held, "row", "col")
    return distance.crossJoin(F.broadcast(distance.agg(F.max("distance").alias("top")))).where(F.col("distance") > share * F.col("top")).select("row", "col")


def lowest_parabolas(centres: list[int], heights: list[int], places: list[int]) -> list[int | None]:
    """min over k of (place - centres[k]) ** 2 + heights[k] for each place, None without centres; centres rise."""
    if not centres:
        return [None] * len(places)
    hull, starts = [0], [float("-inf")]
    for k in range(1, len(centres)):
        while True:
            j = hull[-1]
            cut = (heights[k] + centres[k] ** 2 - heights[j] - centres[j] ** 2) / (2 * (centres[k] - centres[j]))
            if cut > starts[-1]:
                break
            hull.pop()
            starts.pop()
        hull.append(k)
        starts.append(cut)
    found = []
    for x in places:
        k = hull[bisect_right(starts, x) - 1]
        found.append((x - centres[k]) ** 2 + heights[k])
    return found


#: No label, and the sides of a chunk: which of its rows or columns lies there, and the way to the next chunk.
NO_LABEL = 1 << 62
SIDES = ((0, None, -1, 0), (-1, None, 1, 0), (None, 0, 0, -1), (None, -1, 0, 1))


class Chunk:
    """A square of pixels with what lies around it. Absent pixels have infinite cost. halo: the four rows and columns beyond its sides."""

    def __init__(self, size: int, data: bytes | None = None) -> None:
        self.size, n = size, size * size
        if data is None:
            self.cost, self.level = np.full((size, size), np.inf), np.full((size, size), np.inf)
            self.label = np.full((size, size), NO_LABEL)
            self.halo_level, self.halo_label = np.full((4, size), np.inf), np.full((4, size), NO_LABEL)
            return
        real, whole = np.frombuffer(data, float), np.frombuffer(data, np.int64)
        self.cost, self.level, self.label = real[:n].reshape(size, size), real[n : 2 * n].reshape(size, size).copy(), whole[2 * n : 3 * n].reshape(size, size).copy()
        self.halo_level, self.halo_label = real[3 * n : 3 * n + 4 * size].reshape(4, size).copy(), whole[3 * n + 4 * size :].reshape(4, size).copy()

    def data(self) -> bytes:
        return b"".join(x.tobytes() for x in (self.cost, self.level, self.label, self.halo_level, self.halo_label))

    def side(self, k: int, values: np.ndarray) -> np.ndarray:
        row, col, _, _ = SIDES[k]
        return values[row] if row is not None else values[:, col]

    def framed(self, inner: np.ndarray, halo: np.ndarray, none: float) -> np.ndarray:
        wide = np.full((self.size + 2, self.size + 2), none, inner.dtype)
        wide[1:-1, 1:-1] = inner
        wide[0, 1:-1], wide[-1, 1:-1], wide[1:-1, 0], wide[1:-1, -1] = halo
        return wide

    def relax(self, name: str) -> bool:
        """Spread levels, or labels along ways that give pixels their levels, by sweeps in four directions until nothing changes; whether anything did."""
        level = self.framed(self.level, self.halo_level, np.inf)
        value = level if name == "level" else self.framed(self.label, self.halo_label, NO_LABEL)
        cost, before = self.framed(self.cost, np.full((4, self.size), np.inf), np.inf), None
        start = value.copy()
        while before is None or not np.array_equal(before, value):
            before = value.copy()
            for v, lv, c in ((value, level, cost), (value[::-1], level[::-1], cost[::-1]), (value.T, level.T, cost.T), (value.T[::-1], level.T[::-1], cost.T[::-1])):
                for k in range(1, self.size + 1):
                    if name == "level":
                        v[k, 1:-1] = np.minimum(v[k, 1:-1], np.maximum(v[k - 1, 1:-1], c[k, 1:-1]))
                    else:
                        way = (np.maximum(lv[k - 1, 1:-1], c[k, 1:-1]) == lv[k, 1:-1]) & (v[k - 1, 1:-1] < v[k, 1:-1]) & (c[k, 1:-1] < np.inf)
                        v[k, 1:-1][way] = v[k - 1, 1:-1][way]
        setattr(self, name, value[1:-1, 1:-1].copy())
        return not np.array_equal(start[1:-1, 1:-1], value[1:-1, 1:-1])


def flood_raster(pixels: DataFrame, size: int = 256, cost: str = "cost", seed: str = "seed") -> DataFrame:
    """(row, col, label): seeded flooding of a whole raster. Absent pixels aren't flooded, unreached ones have label null.

    First each pixel's level is found, the least of the largest costs on ways from a seed; then labels run from seeds along ways that give
    pixels their levels, and a pixel takes the least label that comes. Both are least fixed points, so the result doesn't depend on
    chunks, and regions hang together. Chunks of size x size pixels are flooded on arrays; after that only chunks whose neighbours' borders have
    changed are, so the rounds are as many as the chunks that a seed's region spans, and a round reads and writes what it changes.
    """
    held = keys(pixels)
    at = [F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col")]
    placed = pixels.select(*held, *at, F.col(cost).cast("double").alias("cost"), F.col(seed).cast("bigint").alias("seed")).withColumn("cy", F.floor(F.col("row") / size)).withColumn("cx", F.floor(F.col("col") / size))
    by = [*held, "cy", "cx"]
    schema = T.StructType([*(placed.schema[c] for c in by), T.StructField("side", T.IntegerType()), T.StructField("version", T.IntegerType()), T.StructField("data", T.BinaryType())])
    ship(placed.sparkSession)

    def rows(key: dict, chunk: Chunk, version: int, sent: list[tuple[int, bytes]]) -> pa.Table:
        """The chunk's state (side -1) and, for its neighbours, what they see of it."""
        found = [key | {"side": -1, "version": version, "data": chunk.data()}]
        for k, data in sent:
            _, _, dy, dx = SIDES[k]
            found.append(key | {"cy": key["cy"] + dy, "cx": key["cx"] + dx, "side": k ^ 1, "version": version, "data": data})
        return pa.Table.from_pylist(found, schema=to_arrow_schema(schema))

    def sides(chunk: Chunk, name: str, before: np.ndarray | None) -> list[tuple[int, bytes]]:
        values = getattr(chunk, name)
        none = np.inf if name == "level" else NO_LABEL
        found = [(k, chunk.side(k, values), None if before is None else chunk.side(k, before)) for k in range(4)]
        return [(k, np.ascontiguousarray(now).tobytes()) for k, now, old in found if (now < none).any() and (old is None or not np.array_equal(now, old))]

    def first(table: pa.Table) -> pa.Table:
        key, chunk = table.select(by).slice(0, 1).to_pylist()[0], Chunk(size)
        place = table["row"].to_numpy() % size, table["col"].to_numpy() % size
        chunk.cost[place] = np.maximum(table["cost"].fill_null(np.inf).to_numpy(), 0.0)
        seeds, known = table["seed"].fill_null(0).to_numpy(), table["seed"].is_valid().to_numpy()
        chunk.label[place[0][known], place[1][known]] = seeds[known]
        chunk.level[place[0][known], place[1][known]] = 0.0
        chunk.relax("level")
        return rows(key, chunk, 0, sides(chunk, "level", None))

    def again(name: str, version: int, states: pa.Table, seen: pa.Table | None) -> pa.Table:
        if not states.num_rows:  # a neighbour beyond the raster
            return to_arrow_schema(schema).empty_table()
        at = int(np.argmax(states["version"].to_numpy()))
        key, chunk = states.select(by).slice(at, 1).to_pylist()[0], Chunk(size, states["data"][at].as_py())
        before = None if seen is None else getattr(chunk, name).copy()
        for r in [] if seen is None else seen.to_pylist():
            (chunk.halo_level if name == "level" else chunk.halo_label)[r["side"]] = np.frombuffer(r["data"], float if name == "level" else np.int64)
        chunk.relax(name)
        return rows(key, chunk, version, sides(chunk, name, before))

    def newest(states: DataFrame, told: DataFrame | None = None) -> DataFrame:
        """The last state of each chunk, or of those that are told something; keys, one for each size ** 2 pixels, are broadcast, and no state is shuffled."""
        keyed = states.withColumn("_key", F.struct(*by))
        some = keyed if told is None else keyed.join(F.broadcast(told.select(F.struct(*by).alias("_key")).distinct()), "_key", "left_semi")
        return keyed.join(F.broadcast(some.groupBy("_key").agg(F.max("version").alias("version"))), ["_key", "version"], "left_semi").select(states.columns)

    state, version = written(placed.groupBy(*by).applyInArrow(first, schema)), 0
    states, last = state.where("side = -1"), state
    for name in ("level", "label"):
        if name == "label":
            version += 1
            last = written(states.groupBy(*by).applyInArrow(_alone(again, name, version), schema))
            states = states.unionByName(last.where("side = -1"))
        while not (sent := last.where("side >= 0")).isEmpty():
            version += 1
            sent = sent.select(*(F.col(c).alias(c) for c in sent.columns))  # columns of their own, apart from the states'
            known = newest(states, sent)
            last = written(known.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(_seeing(again, name, version), schema))
            states = states.unionByName(last.where("side = -1"))

    def pixels_of(table: pa.RecordBatch) -> pa.Table:
        key, chunk = table.select(by).to_pylist()[0], Chunk(size, table["data"][0].as_py())
        row, col = np.nonzero(np.isfinite(chunk.cost) | (chunk.label < NO_LABEL))
        label = chunk.label[row, col]
        same = {c: pa.array([key[c]] * len(row), table.schema.field(c).type) for c in held}
        return pa.table(same | {"row": pa.array(row + key["cy"] * size), "col": pa.array(col + key["cx"] * size), "label": pa.array(label, mask=label == NO_LABEL)})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield from pixels_of(b.slice(k, 1)).to_batches()

    return newest(states).select(*by, "data").mapInArrow(each, T.StructType([*(placed.schema[c] for c in held), *(T.StructField(c, T.LongType()) for c in ("row", "col", "label"))]))


def _alone(again: Callable, name: str, version: int) -> Callable:
    def run(states: pa.Table) -> pa.Table:
        return again(name, version, states, None)

    return run


def _seeing(again: Callable, name: str, version: int) -> Callable:
    def run(states: pa.Table, seen: pa.Table) -> pa.Table:
        return again(name, version, states, seen)

    return run


def boundary_edges(labels: DataFrame) -> DataFrame:
    """(label, x1, y1, x2, y2): unit edges between a region and what isn't the region, the region on the right hand in image axes."""
    sides = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("r", "c", "x1", "y1", "x2", "y2"), s, strict=True))) for s in ((-1, 0, 0, 0, 1, 0), (0, 1, 1, 0, 1, 1), (1, 0, 1, 1, 0, 1), (0, -1, 0, 1, 0, 0))))
    held = keys(labels)
    wide = labels.select(*held, "label", "row", "col", F.explode(sides).alias("s"))
    near = labels.select(*held, F.col("row").alias("nr"), F.col("col").alias("nc"), F.col("label").alias("nl"))
    joined = wide.withColumn("nr", F.col("row") + F.col("s.r")).withColumn("nc", F.col("col") + F.col("s.c")).join(near, [*held, "nr", "nc"], "left")
    kept = joined.where(F.col("nl").isNull() | (F.col("nl") != F.col("label")))
    return kept.select(*held, "label", *((F.col(axis) + F.col(f"s.{n}")).cast("bigint").alias(n) for n, axis in (("x1", "col"), ("y1", "row"), ("x2", "col"), ("y2", "row"))))


def polygonize(labels: DataFrame, cell: int = 512) -> DataFrame:
    """(label, ring_no, ring array<struct<x, y>>): outlines of regions in pixel corners, outer rings and holes. cell: the side of a chunk in pixels."""
    by = [*keys(labels), "label"]
    found = rings(boundary_edges(labels), by, cell)
    number = F.row_number().over(Window.partitionBy(*by).orderBy(F.get("ring", 0), F.get("ring", 1))) - 1
    return found.withColumn("ring_no", number).select(*by, "ring_no", "ring")


def arcs(labels: DataFrame, cell: int = 512) -> DataFrame:
    """(arc, a, b, closed, points): the borders between regions, each once, from one point where three borders or more meet to the next.

    a, b: the labels on the left and right hand, b null beside no region. A border that meets no other is closed and begins at its least point.
    """
    held = keys(labels)
    directed = boundary_edges(labels)
    forth = F.struct("x1", "y1") < F.struct("x2", "y2")
    ends = [F.when(forth, F.col(p)).otherwise(F.col(q)).alias(p) for p, q in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))]
    sides = directed.select(*held, *ends, F.when(forth, F.col("label")).alias("l"), F.when(~forth, F.col("label")).alias("r"))
    once = sides.groupBy(*held, "x1", "y1", "x2", "y2").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    # Directed with the lesser label on the left, the same along a border.
    turned = F.coalesce(F.col("l") > F.col("r"), F.col("l").isNull())
    at = [F.when(turned, F.col(q)).otherwise(F.col(p)).alias(p) for p, q in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))]
    once = written(once.select(*held, F.when(turned, F.col("r")).otherwise(F.col("l")).alias("a"), F.when(turned, F.col("l")).otherwise(F.col("r")).alias("b"), *at))
    nodes = once.select(*held, F.col("x1").alias("x2"), F.col("y1").alias("y2")).unionByName(once.select(*held, "x2", "y2")).groupBy(*held, "x2", "y2").count().where("count <> 2")
    found = chains(once.select(*held, "x1", "y1", "x2", "y2"), held, cell, nodes.drop("count"))
    first = F.when(F.col("closed"), F.array_position("points", F.array_min("points")).cast("int") - 1).otherwise(0)
    found = found.withColumn("_n", first)
    path = F.when(F.col("closed"), F.concat(F.slice("points", F.col("_n") + 1, F.size("points")), F.slice("points", 1, F.col("_n")), F.array(F.array_min("points")))).otherwise(F.col("points"))
    found = found.select(*held, "closed", path.alias("points"))
    p, q = F.get("points", 0), F.get("points", 1)
    found = found.select(*held, "closed", "points", p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))
    return found.join(once, [*held, "x1", "y1", "x2", "y2"]).select(*held, F.struct("x1", "y1", "x2", "y2").alias("arc"), "a", "b", "closed", "points")


def simplify_shared(labels: DataFrame, tolerance: float, size: tuple[float, float] = (1.0, 1.0), cell: int = 512) -> DataFrame:
    """(label, ring_no, ring) in pixel corners: outlines whose shared borders are simplified once, so that neighbours still share them.

    tolerance: in the unit of size, a pixel's width and height. Ends of borders stay. A border that would collapse, lie on another or cross one stays
    as it is; this is repeated until no two meet.
    """
    held = keys(labels)
    known = written(arcs(labels, cell))
    kind = known.schema["points"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for points in batch.column(batch.num_columns - 1).to_pylist():
                short = simplified_path(np.array([(p["x"], p["y"]) for p in points], float) * size, tolerance)
                new.append([points[k] for k in short] if len(short) >= 4 or points[0] != points[-1] else points)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, batch.schema.field("points").type)], [*batch.schema.names, "short"])

    ship(known.sparkSession)
    short = written(known.select(*held, "arc", "a", "b", "points").mapInArrow(run, T.StructType([*(known.schema[c] for c in (*held, "arc", "a", "b", "points")), T.StructField("short", kind)])))
    pair = lambda c: F.explode(F.slice(F.zip_with(c, F.slice(c, 2, F.size(c)), lambda p, q: F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"))), 1, F.size(c) - 1))
    while True:
        edges = written(short.select(*held, "arc", pair("short").alias("e")).select(*held, "arc", *(F.col(f"e.{n}.{axis}").alias(f"{axis}{k}") for k, n in ((1, "p"), (2, "q")) for axis in "xy")))
        at = [*held, "x1", "y1", "x2", "y2"]
        met = crossings(edges.select(*at).distinct().withColumn("new", F.lit(True)), held, min(cell, NEAR)).select(*held, *(F.col(f"edge.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")))
        twice = edges.groupBy(*at).count().where("count > 1").select(*at)
        bad = edges.join(met.unionByName(twice).distinct(), at).select(*held, "arc").distinct().withColumn("bad", F.lit(True))
        new = written(short.join(bad, [*held, "arc"], "left").withColumn("short", F.when(F.col("bad"), F.col("points")).otherwise(F.col("short"))).withColumn("bad", F.col("bad") & (F.size("short") > 2)))
        if new.where("bad").isEmpty():
            break
        changed = short.join(new.where("bad").select(*held, "arc"), [*held, "arc"], "left_semi").where(F.size("short") < F.size("points"))
        done, short = changed.isEmpty(), new.drop("bad")
        if done:
            break
    way = lambda label, ends: short.where(F.col(label).isNotNull()).select(*held, F.col(label).alias("label"), F.explode(F.slice(F.zip_with("short", F.slice("short", 2, F.size("short")), lambda p, q: F.struct(p.alias("p"), q.alias("q"))), 1, F.size("short") - 1)).alias("e")).select(*held, "label", *(F.col(f"e.{n}.{axis}").alias(f"{axis}{k}") for k, n in zip((1, 2), ends, strict=True) for axis in "xy"))
    by = [*held, "label"]
    found = rings(way("a", "pq").unionByName(way("b", "qp")), by, cell, straight=True)
    number = F.row_number().over(Window.partitionBy(*by).orderBy(F.get("ring", 0), F.get("ring", 1))) - 1
    return found.withColumn("ring_no", number).select(*by, "ring_no", "ring")


def simplified_path(points: np.ndarray, tolerance: float) -> list[int]:
    """Douglas-Peucker: places of the points that stay; both ends do."""
    keep, stack = [0, len(points) - 1], [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        way, inner = points[b] - points[a], points[a + 1 : b] - points[a]
        length = float(np.hypot(*way))
        away = np.abs(way[0] * inner[:, 1] - way[1] * inner[:, 0]) / length if length else np.hypot(inner[:, 0], inner[:, 1])
        at = int(away.argmax())
        if away[at] > tolerance:
            keep.append(a + 1 + at)
            stack += [(a, a + 1 + at), (a + 1 + at, b)]
    return sorted(keep)


def simplify(rings: DataFrame, tolerance: float, ring: str = "ring") -> DataFrame:
    """The same rows with rings simplified one by one; a ring that would fall below four points stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, new = batch.schema.get_field_index(ring), []
            for points in batch.column(k).to_pylist():
                short = simplified_path(np.array([(p["x"], p["y"]) for p in points]), tolerance) if points else []
                new.append([points[n] for n in short] if len(short) >= 4 else points)
            yield batch.set_column(k, ring, pa.array(new, batch.schema.field(ring).type))

    ship(rings.sparkSession)
    return rings.mapInArrow(run, rings.schema)
