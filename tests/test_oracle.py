"""Every query with SQL against DuckDB at the smallest size."""

import math
from pathlib import Path

import duckdb
import pytest

import tessera.plans  # noqa: F401
from tessera.queries import QUERIES, SQL

SF = Path("/root/testdata/sf0.001")


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 4) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not SF.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    got = QUERIES[name](spark, str(SF))
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    a = sorted(([plain(v) for v in r] for r in got.collect()), key=str)
    b = sorted(([plain(r[i]) for i in order] for r in want.fetchall()), key=str)
    assert a == b
