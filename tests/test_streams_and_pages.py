"""Newest rasters as a stream against the batch form, and catalogue pages against a search of the whole table."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from agrolith.operators import catalog
from agrolith.sources import pages
from agrolith.streaming import jobs, rasters


def file_stream(spark, at, batches):
    """Each list of (area, path, modified, seen) as a file of its own, read one a batch."""
    form = "area string, path string, modified timestamp, seen timestamp, expired int"
    for k, rows in enumerate(batches):
        spark.createDataFrame([(*r, k) for r in rows], form).coalesce(1).write.mode("append").parquet(str(at))
    return spark.readStream.schema(form).option("maxFilesPerTrigger", 1).parquet(str(at))


def day(n):
    return datetime(2024, 1, 1) + timedelta(days=n)


def test_newest_files_in_any_order(spark, tmp_path):
    batches = [
        [("a", "a1", day(5), day(5)), ("b", "b1", day(50), day(50)), (None, "x", day(1), day(1)), ("a", None, day(99), day(99))],
        [("a", "a0", day(1), day(60)), ("b", "b2", day(2), day(60)), ("c", "c1", day(3), day(60)), ("c", "c1", day(3), day(60))],
        [("a", "a2", day(5), day(61)), ("c", "c0", day(3), day(61)), ("d", "d", None, day(61))],
    ]
    found = jobs.run_available(rasters.newest(file_stream(spark, tmp_path / "in", batches), "area"), "update", "area", rasters.ROCKS)
    rows = spark.read.parquet(str(tmp_path / "in")).where("area IS NOT NULL AND path IS NOT NULL AND modified IS NOT NULL")
    want = {tuple(r) for r in catalog.newest(rows, "area").collect()}
    assert {(r.area, r.path, r.modified) for r in found.collect()} == want and not found.where("expired").count()
    assert spark.conf.get(jobs.PROVIDER, "") != rasters.ROCKS


def test_state_of_many_groups_goes_by_parts(spark, tmp_path):
    """Some calls a part and none in Python without expiry, so time doesn't go by the number of groups."""
    rows = spark.createDataFrame([(k, f"p{k}", datetime(2024, 1, 1 + k % 20), datetime(2024, 1, 1 + k % 20)) for k in range(3_000)], "area long, path string, modified timestamp, seen timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert "transformWithState" not in str(rasters.newest(stream(), "area")._jdf.queryExecution().logical())
    found = jobs.run_available(rasters.newest(stream(), "area", "1 day", timedelta(days=9), parts=4), "update", "area", rasters.ROCKS)
    assert {(r.area, r.path, r.expired) for r in found.collect()} == {(k, f"p{k}", k % 20 + 9 <= 18) for k in range(3_000)}


def test_idle_groups_expire(spark, tmp_path):
    batches = [[("a", "a1", day(1), day(1)), ("b", "b1", day(1), day(1))], [("b", "b2", day(40), day(40))]]
    found = jobs.run_available(rasters.newest(file_stream(spark, tmp_path / "in", batches), "area", "1 day", timedelta(days=20)), "update", "area", rasters.ROCKS)
    assert {(r.area, r.path, r.expired) for r in found.collect()} == {("a", "a1", True), ("b", "b2", False)}


AREA = [(0.0, 0.0), (4.0, 0.5), (2.0, 5.0), (0.0, 0.0)]


@pytest.fixture(scope="module")
def scenes(spark):
    k = F.col("id")
    box = {c: (k % n * 0.25 + d).cast("double") for c, n, d in (("west", 40, 0.0), ("south", 37, 0.0), ("east", 40, 0.2), ("north", 37, 0.1))}
    times = F.when(k % 53 != 0, F.timestamp_micros(F.lit(1_704_067_200_000_000) + k * 3_600_000_123))
    one = spark.range(2000).select(k.cast("string").alias("scene_id"), F.concat(F.lit("c"), k % 3).alias("collection"), times.alias("acquired"), F.when(k % 41 != 0, (k * 7919 % 1000) / 10).alias("cloud"))
    whole = spark.range(2000).select(k.cast("string").alias("scene_id"), *(v.alias(c) for c, v in box.items()), F.create_map(F.lit("visual"), F.concat(F.lit("v"), k)).alias("assets"))
    found = one.join(whole, "scene_id")
    return found.unionByName(found.where("scene_id < 20"))  # repeated scenes


@pytest.fixture(scope="module")
def catalogue(scenes, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('pages')}/all"
    pages.write_pages(scenes, at, 100)
    return at


def as_rows(df):
    return sorted(str((r.scene_id, r.collection, r.acquired, r.cloud, r.west, r.north, r.assets)) for r in df.collect())


def test_pages_hold_all_scenes(spark, scenes, catalogue):
    assert as_rows(pages.read_pages(spark, catalogue)) == as_rows(scenes)


def test_search_of_pages_equals_search_of_the_table(spark, scenes, catalogue):
    now = F.lit(datetime(2024, 3, 1))
    for days, cloud, collections, area in [(30, 20.0, None, None), (9, 100.0, ["c1"], None), (400, 60.0, ["c0", "c2"], AREA), (1, 0.0, ["none"], None)]:
        want = catalog.search(scenes, now, days, cloud, collections, area)
        found = catalog.search(pages.read_pages(spark, catalogue), now, days, cloud, collections, area)
        assert as_rows(found) == as_rows(want)
        best = catalog.best(want, 7)
        assert [r.scene_id for r in catalog.best(found, 7).collect()] == [r.scene_id for r in best.collect()]
        if area is None:
            limited = catalog.search(pages.read_pages(spark, catalogue, 7), now, days, cloud, collections)
            assert [r.scene_id for r in catalog.best(limited, 7).collect()] == [r.scene_id for r in best.collect()]


def test_pages_read_fall_with_the_filter(catalogue):
    def read(filters, **options):
        reader = pages.PagesReader({"path": catalogue, "part_rows": "1000000", **options})
        assert list(reader.pushFilters(filters)) == []
        asked, whole = [], reader.scenes
        reader.scenes = lambda page: asked.append(page) or whole(page)
        return len(asked), sum(b.num_rows for p in reader.partitions() for b in reader.read(p)), asked

    young, one = pages.GreaterThanOrEqual(("acquired",), datetime(2024, 3, 20)), pages.EqualTo(("collection",), "c1")
    every, in_one, both = read([])[2], read([one])[2], read([one, young])[2]
    assert len(every) > len(in_one) > len(both) > 0
    assert len(read([], limit="1")[2]) < len(every)
    assert read([pages.In(("collection",), ("x", "y"))])[1:] == (0, [])


def test_limit_needs_all_filters(catalogue):
    reader = pages.PagesReader({"path": catalogue, "limit": "3"})
    with pytest.raises(ValueError, match="every filter"):
        list(reader.pushFilters([pages.EqualTo(("assets",), "x")]))


def test_features_as_services_write_them():
    line = '{"type":"FeatureCollection","features":[{"id":"a","properties":{"datetime":"2024-01-01T00:00:00Z","cloudCoverage":3}},{"id":"b","bbox":[1,2,3,4],"properties":{"cloud_cover":null}},{"id":"c"}]}'
    found = list(pages.parsed(line))
    assert [(r["scene_id"], r["cloud"], r["west"]) for r in found] == [("a", 3.0, None), ("b", None, 1), ("c", 0.0, None)]
    assert found[0]["acquired"] == 1_704_067_200_000_000 and list(pages.parsed(" ")) == []


def test_empty_catalogue(spark, scenes, tmp_path):
    pages.write_pages(scenes.limit(0), f"file://{tmp_path}/none")
    assert pages.read_pages(spark, f"file://{tmp_path}/none").count() == 0


def test_wanted_assets(scenes):
    found = catalog.wanted_assets(scenes.where("scene_id = '1234'"), ["visual", "scl"]).collect()
    assert [tuple(r) for r in found] == [("1234", "visual", "v1234"), ("1234", "scl", None)]
