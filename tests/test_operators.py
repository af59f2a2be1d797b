"""Nulls, ties and boundaries that the supplied tables lack."""

import math
import random
from types import SimpleNamespace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from yearbook.functions import exprs as X
from yearbook.functions.similarity import common_subsequence, token_sort_ratio
from yearbook.operators import changes as C
from yearbook.operators import mutate as M
from yearbook.operators import summaries as S
from yearbook.operators.graph import components, lookup, shares
from yearbook.operators.latest import country_names, first_per_group
from yearbook.operators.resolve import resolve_entities
from yearbook.operators.search import search

YEARS = "id long, canonical_facility_id string, document_id string, country_iso3 string, year int, facility_name string, has_bsl4 boolean, bsl4_area_m2 decimal(10,2), has_bsl3 boolean, bsl3_area_m2 decimal(10,2), highest_containment string, mod_funded boolean, agents_summary string"
DOCUMENTS = "id string, country_iso3 string, country_name string, year int, is_amendment boolean"


def tables(spark, years=(), documents=(), facilities=(), status=(), vaccines=(), defence=()):
    from decimal import Decimal

    fixed = [tuple(Decimal(str(v)) if i in (7, 9) and v is not None else v for i, v in enumerate(r)) for r in years]
    return SimpleNamespace(
        facility_years=spark.createDataFrame(fixed, YEARS), documents=spark.createDataFrame(list(documents), DOCUMENTS),
        facilities=spark.createDataFrame(list(facilities), "canonical_facility_id string, country_iso3 string, canonical_name string, all_names array<string>, years_declared array<int>, latest_containment string"),
        form_compliance=spark.createDataFrame(list(status), "document_id string, form string, status string"),
        vaccine_facilities=spark.createDataFrame(list(vaccines), "id string, country_iso3 string, canonical_name string, first_year int, last_year int"),
        defence_facilities=spark.createDataFrame(list(defence), "country_iso3 string, facility_name string"),
    )


def year(n, fid, y, bsl4=None, area4=None, area3=None, level=None, text=None, name="Lab"):
    return (n, fid, f"d{n}", "DEU", y, name, bsl4, area4, None, area3, level, None, text)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_notable_changes(spark):
    rows = [year(1, "a", 2018, False, 0, level="BSL-3"), year(2, "a", 2019, False, 0, level="BSL-3"), year(3, "a", 2020, True, 200, level="BSL-4", name="Last")]
    rows += [year(4, "b", 2010, True, 100, 100), year(5, "b", 2013, None, 120, 129), year(6, "b", 2017, False, 500, 500), year(7, "b", 2017, False, 750, 650)]  # a gap of 4, a tie
    rows += [year(8, "few", 2020, False), year(9, "few", 2021, True)]
    t = tables(spark, rows, [("d1", "DEU", "Germany", 2018, False)], [(f, "DEU", None, [], [], None) for f in ("a", "b", "few")])
    got = [(r["canonical_facility_id"], r["to_year"], r["type"], r["severity"], r["delta_pct"]) for r in C.notable_changes(t).collect()]
    assert got == [("a", 2020, "bsl4_gained", "high", None), ("a", 2020, "containment_change", "high", None), ("b", 2017, "bsl4_area_change", "high", 50.0), ("b", 2017, "bsl3_area_change", "medium", 30.0), ("b", 2013, "bsl4_area_change", "medium", 20.0)]
    first = C.notable_changes(t).first()
    assert (first["facility_name"], first["country_name"], first["years_on_record"]) == ("Last", "Germany", 3)
    assert C.notable_changes(t, 5).collect() == [] and C.notable_changes(tables(spark)).collect() == []


def test_facility_diffs_and_events(spark):
    t = tables(spark, [year(1, "a", 2000, None, None, 10), year(2, "a", 2004, True, 5, 10), year(3, "a", 2009, False, None), year(4, "a", 2010, None, 0)])
    assert [(r["to_year"], r["key"], r["from_value"], r["to_value"]) for r in C.facility_diffs(t, "a").collect()] == [(2004, "BSL-4 area", "none", "5.00")]
    assert sorted((r["year"], r["event"]) for r in C.timeline_events(t).collect()) == [(2004, "bsl4_up")]


def test_names_and_first_rows(spark):
    df = spark.createDataFrame([("b", "X", "second"), ("a", "X", None), ("c", "X", "third"), ("d", "Y", None)], "id string, country_iso3 string, country_name string")
    assert [tuple(r) for r in country_names(df).collect()] == [("X", "second")]
    rows = spark.createDataFrame([(None, 1, 5), (None, 1, 4), ("k", 1, 3)], "key string, year int, id int")
    assert sorted(r["id"] for r in first_per_group(rows, ["key", "year"], [F.col("id")]).collect()) == [3, 4]


def test_rates_without_status_and_transparency(spark):
    documents = [("a", "AAA", "Aland", 2010, False), ("b", "AAA", None, 2012, False), ("z", "ONE", "One", 2003, False), ("am", "AMD", "Only", 2012, True)]
    t = tables(spark, documents=documents, status=[("a", "A1", "substantive"), ("b", "A2", "substantive")])
    assert {r["country_iso3"]: (r["submission_count"], r["a1_rate"]) for r in S.compliance(t).collect()} == {"AAA": (2, 0.5), "ONE": (1, 0.0)}
    assert S.compliance(t, "a2").columns[-1] == "rate"
    with pytest.raises(ValueError):
        S.compliance(t, "Z")
    got = {r["country_iso3"]: r["transparency_score"] for r in S.transparency(t, 2012).collect()}
    assert got == {"AAA": round((2 / 3 * 0.4 + 0.5 * 0.4 + 1.0 * 0.2) * 100, 1), "ONE": round((1.0 * 0.4 + 0.0 * 0.4 + 0.1 * 0.2) * 100, 1)}


def test_search(spark):
    t = tables(
        spark, [year(1, "a", 2001, text="old ring " + "x" * 300), year(2, "a", 2002, text="new RING"), year(3, "b", 2001, text="50% off")], [("d", "DEU", "Germany", 2001, False)],
        [("a", "DEU", "Alpha", ["Alpha", None], [2001], None), ("b", "DEU", None, ["Beta_ring"], [2001], None)], vaccines=[("v", "DEU", "Ringworks", 2014, 2012)], defence=[("DEU", "ring fort"), ("DEU", "ring fort"), ("FRA", None)],
    )
    got = {(r["layer"], r["id"]): (r["match_type"], r["activity_snippet"], r["years_declared"]) for r in search(t, "ring").collect()}
    assert got == {("A1", "a"): ("activity", "new RING", [2001]), ("A1", "b"): ("name", None, [2001]), ("G", "v"): ("name", None, []), ("A2", None): ("name", None, None)}
    assert [r["id"] for r in search(t, "%").collect() if r["layer"] == "A1"] and search(t, "a\\b").collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text("ab c", max_size=12), st.text("ab c", max_size=12))
def test_similarity(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert common_subsequence(a, b) == best[-1][-1]
    assert token_sort_ratio(a, b) == token_sort_ratio(b, a) and 0 <= token_sort_ratio(a, b) <= 100 and token_sort_ratio(a, a) == 100


def plain_entities(records, anchors=()):
    parent = {r[0]: r[0] for r in records}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def union(a, b):
        a, b = sorted((root(a), root(b)))
        parent[b] = a

    for i, (pa, ca, na, ya) in enumerate(records):
        for pb, cb, nb, yb in records[i + 1 :]:
            if (ca or "UNK") == (cb or "UNK") and (na or "").split() and (nb or "").split() and token_sort_ratio(na, nb) >= (95 if ya and yb and ya == yb else 85):
                union(pa, pb)
    for country, text in anchors:
        held = [p for p, c, n, _ in records if c == country and text.lower() in (n or "").lower()]
        for p in held[1:]:
            union(held[0], p)
    out = {}
    for country in {c or "UNK" for _, c, _, _ in records}:
        roots = sorted({root(p) for p, c, _, _ in records if (c or "UNK") == country})
        out |= {p: f"{country}_{roots.index(root(p)) + 1:03d}" for p, c, _, _ in records if (c or "UNK") == country}
    return out


def test_resolve_entities(spark):
    r = random.Random(5)
    words = ["national", "institute", "of", "health", "virology", "research", "centre", "animal", "north", "laboratory"]
    records = []
    for i in range(150):
        name = " ".join(r.sample(words, r.randrange(2, 6)))
        if r.random() < 0.4 and records and records[-1][2]:
            name = records[-1][2] + r.choice(["", "s", " x", " annex"])
        records.append((i, r.choice(["DEU", "FRA", None]), r.choice([name] * 9 + [None, " "]), r.choice([2001, 2001, 2002, 0, None])))
    for anchors in ((), (("DEU", "Virology"),)):
        got = resolve_entities(spark.createDataFrame(records, "place long, country_iso3 string, name string, year int"), "A1", anchors).collect()
        assert {x["place"]: x["canonical_id"] for x in got} == plain_entities(records, anchors)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_expressions(spark):
    lit = F.lit
    assert one(spark, X.year_span(lit(2014), lit(2012))) == [] and one(spark, X.year_span(lit(2012), lit(2014))) == [2012, 2013, 2014]
    assert one(spark, X.year_runs(F.array(*map(lit, (2012, 2013, 2014, 2016))))) == "2012–2014, 2016" and one(spark, X.year_runs(F.array(lit(2012), lit(2012)))) == "2012, 2012"
    assert [one(spark, X.to_bool(lit(v))) for v in ("yes", "False", "YES", None)] == [True, False, None, None]
    assert [one(spark, X.to_int(lit(v))) for v in ("7", "1.0", "", None)] == [7, None, None, None]
    assert one(spark, X.split_list(lit(" a ; ;b;"))) == ["a", "b"] and one(spark, X.split_list(lit(None).cast("string"))) == []
    assert one(spark, X.share(lit(1), lit(0))) is None and float(one(spark, X.share(lit(2), lit(3)))) == 0.667
    assert [one(spark, X.bsl_class(lit(v))) for v in ("Enhanced BSL-2", "abl4", None, "")] == ["BSL-2", "BSL-4", "unknown", "unknown"]
    assert [one(spark, X.iso3(lit(v))) for v in ("deu", "12X", "invalid")] == ["DEU", None, None]
    assert one(spark, X.any_contains(F.array(lit(None).cast("string"), lit("x")), "y")) is False
    got = [tuple(v) for v in one(spark, X.address_variants(lit("Agency, Porton Down, SP4 0JG"), lit("Salisbury")))]
    assert got == [("Agency, Porton Down, SP4 0JG", "Salisbury"), ("Porton Down, SP4 0JG", "Salisbury"), ("SP4 0JG", "Salisbury"), (None, "Salisbury")]
    assert one(spark, X.geocode_query(lit(""), lit("Bonn"), lit("de"))) == "Bonn, DE" and one(spark, X.geocode_query(lit(None).cast("string"), lit(""), lit("de"))) is None
    assert one(spark, X.slug(lit("--Ärzte & Co. "))) == "rzte-co" and math.isclose(float(one(spark, X.change_percent(lit(50).cast("decimal(10,2)"), lit(75).cast("decimal(10,2)")))), 50)


def test_merge_split_and_overlay(spark):
    dimension = spark.createDataFrame([("a", "A", ["A"], [2000]), ("b", "B", ["B", "A"], [2001]), ("c", "C", ["C"], [2002])], "canonical_facility_id string, canonical_name string, all_names array<string>, years_declared array<int>")
    facts = spark.createDataFrame([("a", 2000, "x"), ("b", 2001, "y"), ("b", 2003, None), ("c", 2002, "z")], "canonical_facility_id string, year int, city string")
    groups = spark.createDataFrame([("b", "a", None), ("c", "gone", "N")], "old string, keeper string, name string")
    merged, moved = M.merge(dimension, facts, groups)
    assert sorted((r["canonical_facility_id"], r["canonical_name"], r["all_names"], r["years_declared"]) for r in merged.collect()) == [("a", "A", ["A", "B"], [2000, 2001, 2003]), ("c", "C", ["C"], [2002])]
    assert sorted(r["canonical_facility_id"] for r in moved.collect()) == ["a", "a", "a", "c"]
    for _ in range(2):  # a second run changes nothing
        dimension, facts = M.split(dimension, facts, "b", "b2", "Second", F.col("city") == "y")
        assert sorted((r["canonical_facility_id"], r["years_declared"]) for r in dimension.collect()) == [("a", [2000]), ("b", [2003]), ("b2", [2001]), ("c", [2002])]
    marked = M.flag(facts.withColumns({"flagged_for_review": F.lit(False), "flag_note": F.lit("old")}), spark.createDataFrame([("a", 2000, True, "new")], "canonical_facility_id string, year int, flag boolean, note string"))
    assert sorted((r["canonical_facility_id"], r["flagged_for_review"], r["flag_note"]) for r in marked.collect()) == [("a", True, "new"), ("b", False, "old"), ("b2", False, "old"), ("c", False, "old")]


def test_capacity_other(spark):
    rows = spark.createDataFrame([(2023, f"C{i}", float(i)) for i in range(1, 4)] + [(2024, "C3", 1.5)], "year int, country_iso3 string, total_bsl4_area_m2 double")
    assert sorted(tuple(r) for r in S.capacity_top_n(rows, 2).collect()) == [(2023, "C2", 2.0), (2023, "C3", 3.0), (2023, "OTHER", 1.0), (2024, "C2", 0.0), (2024, "C3", 1.5), (2024, "OTHER", 0.0)]
    assert "OTHER" not in {r["series"] for r in S.capacity_top_n(rows, 3).collect()}


def test_hubs_stay_spread(spark):
    n = 100_000
    star = spark.range(1, n).selectExpr("id AS a", f"IF(id % 2 = 0, 0, {n}) AS b").unionByName(spark.createDataFrame([(n, 4)], "a long, b long"))
    got = components(star.repartition(8)).groupBy("root").count().collect()
    assert [tuple(r) for r in got] == [(0, n + 1)]
    rows = spark.range(n).selectExpr("IF(id % 3 = 0, -1, id) AS k", "id AS v").repartition(8)
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    met = lookup(rows, table, "k", "n", n)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with partitions that are worth a task
    try:
        sizes = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == n and max(sizes) <= n // 5 and shares(rows, n) == n // 16
    assert met.where("k = -1").agg(F.count("*"), F.min("top"), F.max("top")).first() == (n // 3 + 1, n - 1, n - 1)


def test_alike_names(spark, monkeypatch):
    from yearbook.operators import resolve as R

    r = random.Random(6)
    words = ["national", "institute", "of", "health", "virology", "Zürich", "日本", "a" * 30, "laboratoire", "centre", "x"]
    names = [(r.choice("AB"), i, " ".join(sorted(r.choices(words, k=r.randint(1, 7))))) for i in range(220)]
    names = [(b, i, w[: r.randint(len(w) - 2, len(w))] or "x") for b, i, w in names]
    expected = {}
    for block, i, a in names:
        for other, j, b in names:
            if block == other and i < j and (score := 200.0 * common_subsequence(a, b) / (len(a) + len(b))) >= 85:
                expected[i, j] = score
    assert any(len(names[i][2]) > 64 < len(names[j][2]) for i, j in expected) and len(expected) > 100
    df = spark.createDataFrame(names, "block string, name_id long, words string")
    for part in (R.PART, 7):
        monkeypatch.setattr(R, "PART", part)
        found = R.alike(df).collect()
        assert {(x["a"], x["b"]): x["score"] for x in found} == expected and len(found) == len(expected)
    assert R.alike(df.limit(0)).collect() == []
