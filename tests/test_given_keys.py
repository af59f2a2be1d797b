"""Merges and splits whose given entities the tables lack."""

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_oracle import QUERIES, SQL, comparable

from yearbook.operators import mutate as M
from yearbook.plans.proxy import BASE

DIMENSION = "canonical_facility_id string, canonical_name string, all_names array<string>, years_declared array<int>"
FACTS = "canonical_facility_id string, year int, city string"


@pytest.fixture(scope="module")
def moved_away(sf, tmp_path_factory):
    """The tables, but XAP_000 is in another country, as in the larger ones."""
    home = tmp_path_factory.mktemp("tables")
    for name in BASE:
        table = pq.read_table(f"{sf}/{name}.parquet")
        if name == "supplier":
            i = table.schema.get_field_index("s_nationkey")
            nations = pc.if_else(pc.equal(table["s_suppkey"], 0), pa.scalar(2, table.schema.field(i).type), table["s_nationkey"])
            table = table.set_column(i, table.schema.field(i), nations)
        pq.write_table(table, home / f"{name}.parquet", coerce_timestamps="us")
    return str(home)


@pytest.mark.parametrize("name", ["merge_dimension", "merge_facts", "merge_plan", "split_dimension"])
def test_same_rows_without_the_given_entity(spark, moved_away, name):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{moved_away}/{t}.parquet'")
    got = QUERIES[name](spark, moved_away)
    expected = con.execute(SQL[name])
    columns = [c[0] for c in expected.description]
    assert comparable(got.collect(), got.columns) == comparable(expected.fetchall(), columns)


@pytest.fixture(scope="module")
def copies(sf, tmp_path_factory):
    """Three copies of the tables with shifted keys; ids of facilities keep three of the four digits of their numbers."""
    home = tmp_path_factory.mktemp("copies")
    con = duckdb.connect()
    for name in BASE:
        columns = [c[0] for c in con.execute(f"SELECT * FROM '{sf}/{name}.parquet' LIMIT 0").description]
        shifted = [f"{c} + i * 2017 AS {c}" for c in columns if c.endswith("key") and "nation" not in c and "region" not in c]
        shifted = f"REPLACE ({', '.join(shifted)})" if shifted else ""
        con.execute(f"COPY (SELECT t.* {shifted} FROM '{sf}/{name}.parquet' t, range(1, {2 if name == 'nation' else 4}) r(i)) TO '{home}/{name}.parquet' (FORMAT parquet)")
    return str(home)


def test_facts_merge_on_copies_with_shifted_keys(spark, copies):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{copies}/{t}.parquet'")
    got = QUERIES["merge_facts"](spark, copies).collect()
    assert sum(r["canonical_facility_id"] == "XAP_000" for r in got) > 100
    assert comparable(got, ["id", "canonical_facility_id"]) == comparable(con.execute(SQL["merge_facts"]).fetchall(), ["id", "canonical_facility_id"])


def test_merge_into_a_given_keeper(spark):
    dimension = spark.createDataFrame([("a", "A", ["A"], [2000]), ("b", "B", ["B"], [2001]), ("c", "C", ["C"], [2002])], DIMENSION)
    facts = spark.createDataFrame([("a", 2000, "x"), ("b", 2001, "y"), ("c", 2002, "z")], FACTS)
    groups = spark.createDataFrame([("a", "gone", "N", True), ("b", "lost", "N", False), ("c", "lost", "N", None)], "old string, keeper string, name string, given boolean")
    merged, moved = M.merge(dimension, facts, groups)
    assert sorted(r["canonical_facility_id"] for r in merged.collect()) == ["b", "c"]
    assert sorted(r["canonical_facility_id"] for r in moved.collect()) == ["b", "c", "gone"]


def test_plan_says_what_merge_does(spark):
    dimension = spark.createDataFrame([("a", "A", ["A"], [2000]), ("b", "B", ["B"], [2001])], DIMENSION)
    groups = spark.createDataFrame([("a", "gone", "N", True), ("b", "lost", "N", False), ("x", "gone", "N", True), ("a", "b", "N", None)], "old string, keeper string, name string, given boolean")
    got = sorted((r["old"], r["keeper"], r["action"]) for r in M.merge_plan(dimension, groups).collect())
    assert got == [("a", "b", "merge"), ("a", "gone", "merge"), ("b", "lost", "skip: no keeper"), ("x", "gone", "nothing to merge")]


@pytest.mark.parametrize("given", [False, True])
def test_split_of_a_missing_source(spark, given):
    dimension = spark.createDataFrame([("a", "A", ["A"], [2000])], DIMENSION)
    facts = spark.createDataFrame([("a", 2000, "x")], FACTS)
    out, moved = M.split(dimension, facts, "gone", "new", "New", F.col("city") == "x", given=given)
    assert sorted(tuple(r) for r in out.collect()) == [("a", "A", ["A"], [2000]), ("new", "New", ["New"], None)][: 1 + given]
    assert [r["canonical_facility_id"] for r in moved.collect()] == ["a"]


def test_given_split_without_facts_to_move(spark):
    dimension = spark.createDataFrame([("a", "A", ["A"], [2000])], DIMENSION)
    facts = spark.createDataFrame([("a", 2000, "x")], FACTS)
    out = M.split(dimension, facts, "a", "new", "New", F.col("city") == "y", given=True)[0]
    assert sorted(tuple(r) for r in out.collect()) == [("a", "A", ["A"], [2000]), ("new", "New", ["New"], None)]
