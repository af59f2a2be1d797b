"""Every query with SQL gives in Spark what its SQL gives in DuckDB."""

import duckdb
import pytest

from yearbook.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SQL)
def test_same_rows(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    expected = duck.execute(SQL[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(got.columns)
    assert comparable(got.collect(), got.columns) == comparable(expected.fetchall(), columns)


def test_every_query_without_sql_has_a_test_of_its_own():
    assert set(QUERIES) - set(SQL) == {"resolve_entities", "weighted_sample"}


def test_registering_needs_no_session(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 50)"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True)
    assert out.stdout.strip().endswith("True"), out.stderr


@pytest.mark.parametrize("name", QUERIES)
def test_plans_have_no_products_of_tables(spark, sf, name):
    """Rows meet by keys. A nested loop is only for a side of one row, of the years, or of what has one given key, and is broadcast."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    # an outer product would keep all rows of both sides
    assert not any("BroadcastNestedLoopJoin" in line and "FullOuter" in line for line in plan.splitlines())


def test_scans_read_what_they_need(spark, sf):
    plan = QUERIES["event_windows"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "event_id" not in plan.split("ReadSchema:")[1].split("\n")[0]
    plan = spark.read.parquet(f"{sf}/orders.parquet")._jdf.queryExecution().executedPlan().toString()
    whole = plan.split("ReadSchema:")[1].count(":")
    plan = QUERIES["clamped_years"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("ReadSchema:")[1].count(":") < whole
