"""Operators that SQL expresses give in Spark what their SQL gives in DuckDB."""

import duckdb
import pytest

from yearbook.llm import queries as Q


@pytest.mark.parametrize("name", Q.oracle_sql())
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    expected = con.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    got = Q.queries()[name](spark, sf)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(expected.fetchall())
