"""Scene catalogues kept as pages of GeoJSON features, as a Python data source that reads only the pages that a search can need.

A catalogue is a folder of text files, the pages, each line a feature or a collection of them, with a table _index of each page's least and
greatest values. `register` names the source "scene_pages". Filters on its columns (=, <, <=, >, >=, in, not null) drop pages by the index
before any task begins and rows before Spark sees them. With the option limit, the n best rows are asked for (least cloud, then youngest, then
least id): a task reads its pages by least cloud and stops at the first that can't hold a better one; it hands on n rows at most. The
index is planning data, a row for each page of 10,000 scenes.

Defined results: a feature without a known name of cloud cover has 0, one whose cloud cover is null has null; other values that are missing are null and
match no filter; numbers that aren't finite are written as null; repeated scenes are kept; a catalogue without pages has no rows.
"""

from __future__ import annotations

import heapq
import itertools
import json
import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from agrolith.operators.scratch import ship
from agrolith.sources.geotiff import opened

BOX = ("west", "south", "east", "north")
SCHEMA = "scene_id string, collection string, acquired timestamp, cloud double, west double, south double, east double, north double, assets map<string,string>"
ARROW = pa.schema([("scene_id", pa.string()), ("collection", pa.string()), ("acquired", pa.timestamp("us", "UTC")), ("cloud", pa.float64()), *((c, pa.float64()) for c in BOX), ("assets", pa.map_(pa.string(), pa.string()))])
COLUMNS = tuple(ARROW.names[:-1])
# The names that cloud cover goes by.
CLOUD_NAMES = ("eo:cloud_cover", "cloudCoverage", "cloud_cover")
#: Scenes of a page, and of the pages that one task reads.
PAGE_ROWS, PART_ROWS = 10_000, 50_000
_START = datetime(1970, 1, 1, tzinfo=UTC)


def write_pages(scenes: DataFrame, path: str, page_rows: int = PAGE_ROWS) -> None:
    """Write scenes (the columns of `SCHEMA`, of which collection, box and assets may be absent) as pages and their index.

    Scenes are parted by ranges of collection and time, so that a page holds few collections and a short span of time.
    """
    held = lambda c: F.col(c) if c in scenes.columns else F.lit(None)
    finite = lambda c: F.when(F.abs(held(c).cast("double")) < F.lit(float("inf")), held(c).cast("double"))
    at = F.to_utc_timestamp(F.col("acquired").cast("timestamp"), F.current_timezone())
    properties = F.struct(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("datetime"), finite("cloud").alias(CLOUD_NAMES[0]))
    links = F.transform_values("assets", lambda _, v: F.struct(v.alias("href"))) if "assets" in scenes.columns else F.lit(None)
    feature = F.struct(F.lit("Feature").alias("type"), held("scene_id").cast("string").alias("id"), held("collection").cast("string").alias("collection"), F.array(*map(finite, BOX)).alias("bbox"), properties.alias("properties"), links.alias("assets"))
    keyed = scenes.select(held("collection").cast("string").alias("c"), F.col("acquired").alias("t"), F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))
    keyed.repartitionByRange("c", "t").sortWithinPartitions("c", "t").select("value").write.option("maxRecordsPerFile", page_rows).text(path)
    lines = scenes.sparkSession.read.option("pathGlobFilter", "part-*").text(path)
    f = F.from_json("value", "id string, collection string, bbox array<double>, properties struct<datetime: timestamp, `eo:cloud_cover`: double>")
    values: dict[str, Column] = {"scene_id": F.col("f.id"), "collection": F.col("f.collection"), "acquired": F.unix_micros("f.properties.datetime"), "cloud": F.col("f.properties.`eo:cloud_cover`")} | {c: F.col("f.bbox")[k] for k, c in enumerate(BOX)}
    rows = lines.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("page"), f.alias("f")).select("page", *(v.alias(c) for c, v in values.items()))
    rows.groupBy("page").agg(F.count(F.lit(1)).alias("n"), *(g(c).alias(f"{end}_{c}") for c in COLUMNS for end, g in (("least", F.min), ("most", F.max)))).write.parquet(f"{path}/_index")


def _micros(t: datetime) -> int:
    return ((t if t.tzinfo else t.replace(tzinfo=UTC)) - _START) // timedelta(microseconds=1)


def parsed(line: str) -> Iterator[dict]:
    """The scenes of a line, times as microseconds."""
    if not line.strip():
        return
    whole = json.loads(line)
    for f in whole["features"] if whole.get("type") == "FeatureCollection" else [whole]:
        properties = f.get("properties") or {}
        named = [properties[c] for c in CLOUD_NAMES if c in properties]
        cloud = next((float(c) for c in named if c is not None), None if named else 0.0)
        time = properties.get("datetime")
        box = (f.get("bbox") or [None] * 4)[:4]
        assets = {k: v.get("href") for k, v in (f.get("assets") or {}).items()}
        yield {"scene_id": f.get("id"), "collection": f.get("collection"), "acquired": time and _micros(datetime.fromisoformat(time)), "cloud": cloud, **dict(zip(BOX, box, strict=True)), "assets": list(assets.items())}


@dataclass
class Test:
    """A filter on one column: whether a value passes, and whether a page with values from least to most can hold one that does."""

    name: str
    passes: Callable[[object], bool]
    possible: Callable[[object, object], bool]

    def row(self, row: dict) -> bool:
        return row[self.name] is not None and self.passes(row[self.name])

    def page(self, page: dict) -> bool:
        return page[f"most_{self.name}"] is not None and self.possible(page[f"least_{self.name}"], page[f"most_{self.name}"])


def taken(f: Filter) -> Test | None:
    """A filter as a test; None if the source has no such test."""
    name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
    if name not in COLUMNS:
        return None
    if isinstance(f, IsNotNull):
        return Test(name, lambda _: True, lambda a, b: True)
    plain = lambda v: _micros(v) if isinstance(v, datetime) else v
    if isinstance(f, In):
        values = frozenset(plain(v) for v in f.value if v is not None)
        return Test(name, values.__contains__, lambda a, b: any(a <= v <= b for v in values))
    if type(f) not in (EqualTo, LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual) or f.value is None:
        return None
    v = plain(f.value)
    if isinstance(f, EqualTo):
        return Test(name, lambda x: x == v, lambda a, b: a <= v <= b)
    holds = {LessThan: operator.lt, LessThanOrEqual: operator.le, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge}[type(f)]
    down = isinstance(f, (LessThan, LessThanOrEqual))
    return Test(name, lambda x: holds(x, v), lambda a, b: holds(a if down else b, v))


class Pages(InputPartition):
    def __init__(self, pages: list[tuple[str, float]]) -> None:
        self.pages = pages


class PagesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.limit, self.filters = options["path"].rstrip("/"), int(options["limit"]) if options.get("limit") else None, []
        self.part_rows = int(options.get("part_rows", PART_ROWS))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the interface's name
        for f in filters:
            if taken(f) is not None:
                self.filters.append(f)
            elif self.limit is not None:
                raise ValueError(f"with a limit, scene_pages has to take every filter, and can't take {f}")
            else:
                yield f

    def partitions(self) -> list[Pages]:
        store, at = opened(self.path)
        files = sorted(f.path for f in store.get_file_info(pafs.FileSelector(f"{at}/_index")) if f.path.endswith(".parquet"))
        tests = [taken(f) for f in self.filters]
        index = sorted((r for f in files for r in pq.read_table(f, filesystem=store).to_pylist()), key=lambda r: r["page"])
        found, rows = [[]], 0
        for page in (r for r in index if all(t.page(r) for t in tests)):
            if found[-1] and rows + page["n"] > self.part_rows:
                found.append([])
                rows = 0
            found[-1].append((page["page"], page["least_cloud"]))
            rows += page["n"]
        return [Pages(p) for p in found]

    def scenes(self, page: str) -> Iterator[dict]:
        """A page's rows that pass all tests."""
        store, at = opened(self.path)
        tests = [taken(f) for f in self.filters]
        with store.open_input_stream(f"{at}/{page}") as f:
            for line in f.read().decode().splitlines():
                yield from (r for r in parsed(line) if all(t.row(r) for t in tests))

    def best(self, pages: list[tuple[str, float]]) -> Iterator[dict]:
        """The rows that come first by cloud, youth and id; rows without a cloud or a time are left out."""
        held: list[tuple] = []  # the last of the best n first
        number = itertools.count()
        for page, least in sorted((p for p in pages if p[1] is not None), key=lambda p: p[1]):
            if len(held) == self.limit and least > held[0][0].cloud:
                break
            for r in self.scenes(page):
                if r["cloud"] is not None and r["acquired"] is not None:
                    entry = (Rank(r["cloud"], r["acquired"], r["scene_id"] or ""), next(number), r)
                    if len(held) < self.limit:
                        heapq.heappush(held, entry)
                    elif held[0][0] < entry[0]:
                        heapq.heapreplace(held, entry)
        return (e[2] for e in held)

    def read(self, part: Pages) -> Iterator[pa.RecordBatch]:
        for rows in [self.best(part.pages)] if self.limit is not None else (self.scenes(p) for p, _ in part.pages):
            yield pa.RecordBatch.from_pylist(list(rows), schema=ARROW)


@dataclass
class Rank:
    """A scene's place: what comes first is the greatest."""

    cloud: float
    acquired: int
    scene_id: str

    def __lt__(self, other: Rank) -> bool:
        return (self.cloud, -self.acquired, self.scene_id) > (other.cloud, -other.acquired, other.scene_id)


class ScenePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scene_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> PagesReader:
        return PagesReader(self.options)


def register(spark: SparkSession) -> None:
    """Name the source, and let Spark hand filters to Python sources."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ScenePages)


def read_pages(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Scenes of a catalogue, the columns of `SCHEMA`; `catalog.search` on them reads the pages that it needs.

    With a limit, all filters have to be comparisons of a column with a value, for the source must see them all: follow it by
    `catalog.best` with the same number. A polygon's exact test isn't one; search without a limit then.
    """
    register(spark)
    reader = spark.read.format("scene_pages").option("path", path)
    return (reader.option("limit", limit) if limit is not None else reader).load()
