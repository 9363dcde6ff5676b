"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tessella.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    return f"{float(value) + 0.0:.5g}" if isinstance(value, (int, float)) or hasattr(value, "as_integer_ratio") else str(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in registry.ORACLES:
        assert got
        return
    result = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in result.description]
    want = result.fetchall()
    assert sorted(df.columns) == sorted(columns)
    order = [columns.index(c) for c in df.columns]
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(plain(r[i]) for i in order) for r in want)
