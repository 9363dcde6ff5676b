"""The corpus queries that have SQL against DuckDB, on a small table."""

from pathlib import Path

import duckdb
import pytest

from tessella.llm import queries

SF = "/root/testdata/sf0.001"


def plain(value):
    return "" if value is None else f"{float(value) + 0.0:.9g}" if isinstance(value, (int, float)) else str(value)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in result.description]
    order = [columns.index(c) for c in df.columns]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())
