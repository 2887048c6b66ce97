"""Every registered query with SQL against DuckDB on the smallest tables; the others run."""

from __future__ import annotations

import os

import duckdb
import pytest

from agrolith.plans import enhance_queries, field_queries, more_queries, raster_queries, record_queries, service_queries  # noqa: F401  they register themselves
from agrolith.plans import queries as plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return db


def canonical(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = frame[c].astype(float).round(6) if frame[c].dtype.kind in "fiu" else frame[c].astype(str)
    return frame.sort_values(list(frame.columns), ignore_index=True)


#: What tells rows apart in queries without SQL.
KEYS = {
    "clahe": ["row", "col"], "farm_chain": ["row", "col"], "field_features": ["label"], "kmeans_zones": ["row", "col"], "polygonize": ["label", "ring_no"],
    "simplify": ["label", "ring_no"], "watershed_fields": ["row", "col"], "wow_chain": ["row", "col"],
}


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    found = plans.QUERIES[name](spark, SF).toPandas()
    if name not in plans.ORACLES:
        assert len(found.columns) == len(set(found.columns))
        keys = [k for k in KEYS.get(name, ()) if k in found.columns]
        assert not keys or not found.duplicated(keys).any()
        if {"row", "col"} <= set(keys):
            assert len(found) == (found.row.max() + 1) * (found.col.max() + 1)
        return
    a, b = canonical(found), canonical(duck.sql(plans.ORACLES[name]).df())
    assert list(a.columns) == list(b.columns)
    assert a.equals(b.astype(a.dtypes)), a.compare(b.astype(a.dtypes)).head() if len(a) == len(b) else (len(a), len(b))
