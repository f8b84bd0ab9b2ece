"""Every registered query of the interval engine against its SQL on DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from trackforge.plans import catalog, files  # noqa: F401 - files registers its queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = {c: i for i, c in enumerate(want.columns)}
    a = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    b = sorted(repr([plain(r[at[c]]) for c in columns]) for r in want.fetchall()) if hasattr(want, "fetchall") else None
    assert a == b
