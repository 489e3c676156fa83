"""Every registered query of the library against its SQL in DuckDB, at the smallest scale."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from marlow.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    out.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        out.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return out


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)[:19] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert name in registry.ORACLES
    want = con.sql(registry.ORACLES[name])
    place = [want.columns.index(c) for c in columns]
    assert len(place) == len(want.columns)
    assert got == sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=str)
