"""Text of submissions, questions as data, files in and out, streams."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import functions as F

from yearbook.operators import text as T
from yearbook.plans import spec as Q
from yearbook.sources import catalogue as K
from yearbook.sources import exports as E
from yearbook.sources import tables as R
from yearbook.sources.portal import Portal
from yearbook.streaming.windows import upserted, windowed

ANCHORS = [("A1", r"Form A, part 1"), ("B", r"(?i)form\s+b\b")]
PAIRS = [("G", r"Form G .*vaccine")]


def test_segments(spark):
    text = "cover--- PAGE 1 ---\nintro\n--- PAGE 2 ---\nForm A, part 1\nlab\n--- PAGE 3 ---\nmore\nl2\nl3\nl4\nl5\nFORM  B here\ntail\n--- PAGE 4 ---\nForm G\nvaccine plants\n"
    pages = T.pages(spark.createDataFrame([("d", text), ("e", None), ("f", "--- PAGE 1 ---\nform b")], "id string, text string"))
    assert [(r["id"], r["page"]) for r in pages.orderBy("id", "place").collect()] == [("d", 1), ("d", 2), ("d", 3), ("d", 4), ("f", 1)]
    got = {(r["id"], r["form"]): (r["text"], r["confidence"]) for r in T.segments(pages, ANCHORS, PAIRS).collect()}
    assert set(got) == {("d", "A1"), ("d", "B"), ("d", "G"), ("f", "B")}
    assert got["d", "A1"] == ("--- PAGE 2 ---\nForm A, part 1\nlab\n--- PAGE 3 ---\nmore\nl2\nl3\nl4\nl5", "high") and got["d", "B"][0] == "--- PAGE 3 ---\nFORM  B here\ntail\n" and got["f", "B"][1] == "medium"
    assert {r["form"]: r["documents"] for r in T.form_coverage(T.segments(pages, ANCHORS, PAIRS)).collect()} == {"A1": 1, "B": 2, "G": 1}


def test_chunks_and_json(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(T.chunks(F.array(*map(F.lit, ("aaa", "bb", "cccc", "d", "e" * 9, "f"))), 5)) == ["aaa\n\nbb", "cccc\n\nd", "e" * 9, "f"]
    assert one(T.chunks(F.array().cast("array<string>"), 5)) == [] and one(T.fixed_chunks(F.lit("abcde"), 2)) == ["ab", "cd", "e"] and one(T.fixed_chunks(F.lit(""), 2)) == []
    assert one(T.sections(F.lit("head\n1. Name a\nx\n1. Name b\n"), r"^1\.\s+Name")) == ["1. Name a\nx", "1. Name b"] and one(T.sections(F.lit("  none "), r"^1\.")) == ["none"] and one(T.sections(F.lit(None).cast("string"), "^1")) == []
    assert one(T.shortened(F.lit("x" * 30 + "2. Funding"), r"2\. Funding", 10)) == "x" * 10 + "\n[...objectives truncated...]\n\n2. Funding"
    assert one(T.without_list(F.lit("abc LIST many FIELD rest"), "LIST", "FIELD", 7)) == "abc \n\nFIELD r"
    assert one(T.table_text(F.array(F.array(F.lit("a\nb"), F.lit(None).cast("string")), F.array(F.lit("c"), F.lit("d"))))) == "a b\t\nc\td"
    for text, expected in (('{"a": 1}', {"a": 1}), ('so: ```json\n{"a": 2}\n``` ok', {"a": 2}), ('x {"a": {"b": 3}} y', {"a": {"b": 3}}), ('{"a": "u""}', {"a": "u"}), ("none", None), (None, None)):
        got = one(T.json_object(F.lit(text).cast("string")))
        assert (json.loads(got) if got else None) == expected
    assert [one(T.nothing_to_declare(F.lit(x).cast("string"))) for x in ("Nothing NEW to declare", "nothing to report" + "x" * 2000, None)] == [True, False, False]


def test_questions():
    spec = Q.checked({"query_type": "comparative", "countries": ["DEU", "invalid", "12X", "GBR", "deu", 7], "forms": ["a1", "Z"], "year_min": "1900", "year_max": "x", "keywords": ["a" * 200, "Union Lab", "ok", 5], "legislation_category": "none"})
    assert (spec.countries, spec.forms, spec.year_min, spec.year_max, spec.keywords, spec.legislation_category) == (("DEU", "GBR"), ("A1",), 1988, None, ("a" * 100, "ok"), None)
    assert Q.checked({"query_type": "drop"}).query_type == "unknown" and Q.answer(None, Q.QuerySpec("unknown")) is None and Q.describe(Q.QuerySpec("unknown"), []) == Q.HELP
    assert Q.is_comparison(Q.QuerySpec("comparative", ("DEU", "GBR"))) and not Q.is_comparison(Q.QuerySpec("comparative", ("DEU", "GBR"), bsl=("4",)))
    assert Q.describe(Q.QuerySpec("comparative"), [{"country_iso3": "USA", "country_name": None, "count": 1200}]) == "1. USA: 1,200 records"


def test_catalogue(spark, tmp_path):
    rows = spark.createDataFrame([(1, "DEU", 2020), (2, "DEU", 2020), (3, "FRA", None), (4, "DEU", 2021)], "n int, country_iso3 string, year int")
    assert {r["n"]: r["id"] for r in K.with_ids(rows, "n").collect()} == {1: "DEU_2020", 2: "DEU_2020_2", 3: "FRA_UNKNOWN", 4: "DEU_2021"}
    (tmp_path / "DEU_2019_2.pdf").write_bytes(b"x")
    (tmp_path / "XXX_bad.pdf").write_bytes(b"y")
    assert sorted((r["id"], r["country_iso3"], r["year"]) for r in K.from_listing(spark, str(tmp_path)).collect()) == [("DEU_2019_2", "DEU", 2019), ("XXX_bad", "XXX", None)]
    good, bad = K.checked(spark.createDataFrame([("DEU", 2020), ("deu", 2020), (None, 2020), ("FRA", 1900), ("GBR", None)], "country_iso3 string, year int"))
    assert (good.count(), bad.count()) == (2, 3)
    (tmp_path / "c.json").write_text(json.dumps([{"id": "a", "year": 2020, "downloaded": True, "odd": 1}, {"id": "b"}]))
    read = K.read_catalogue(spark, str(tmp_path / "c.json"))
    assert sorted((r["id"], r["downloaded"]) for r in read.collect()) == [("a", True), ("b", None)]
    assert [r["id"] for r in K.pending(read, spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([], "id string")).collect()] == ["a"]
    (tmp_path / "m" / "D1").mkdir(parents=True)
    (tmp_path / "m" / "D1" / "manifest.json").write_text('{"forms_present": ["A1"],\n "confidence": "high"}')
    assert [(r["id"], r["forms_present"]) for r in R.read_manifests(spark, str(tmp_path / "m")).collect()] == [("D1", ["A1"])]


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("f1", 'A "b"', "DEU", "Germany", "A1", None, [2001, 2002]), (None, None, "FRA", None, "G", "BSL-2", None)], "id string, name string, country_iso3 string, country_name string, layer string, latest_containment string, years_declared array<int>")
    lines = [r["line"] for r in E.results_text(rows, 'say "x"', "2024-01-02").collect()]
    assert lines[1:4] == ['# Query: "say \\"x\\""', "# Date: 2024-01-02", "# Results: 2 facilities"] and lines[6] == '"f1","A ""b""","DEU","Germany","Research","","2001|2002"' and len(lines) == 8
    E.write_csv(rows.select("id", "name"), str(tmp_path / "csv"))
    assert sorted((r["id"] or "", r["name"] or "") for r in R.read_csv(spark, str(tmp_path / "csv"), ("id", "name")).collect()) == [("", ""), ("f1", 'A "b"')]
    E.write_json(rows.select("id", "name"), str(tmp_path / "json"))
    assert len(spark.read.json(str(tmp_path / "json")).collect()) == 2
    table = R.Reloaded(spark, str(tmp_path / "t"))
    table.replace(spark.range(3))
    table.replace(spark.range(5))
    assert table.read().count() == 5
    assert all(spark.createDataFrame([], schema).columns for schema in R.SCHEMAS.values())
    assert json.loads(E.feature_collection(spark.createDataFrame([('{"a":1}',), ('{"b":2}',)], "feature string")).first()[0])["features"] == [{"a": 1}, {"b": 2}]


def test_portal(spark):
    hits = [{"_source": {"id": i, "access": "public" if i % 3 else "closed", "country": {"iso": "DEU", "name": "Germany"}, "year": None if i == 1 else "2020", "language": "French" if i == 2 else None}} for i in range(7)]

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = json.dumps({"total": {"value": len(hits)}, "hits": hits[asked["from"] : asked["from"] + asked["size"]]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(Portal)
    got = spark.read.format("portal").option("url", f"http://127.0.0.1:{server.server_port}").option("size", 3).load().collect()
    server.shutdown()
    assert sorted((r["report_id"], r["year"], r["language"]) for r in got) == [("1", None, "en"), ("2", 2020, "fr"), ("4", 2020, "en"), ("5", 2020, "en")]
    assert {(r["type"], r["source_url"]) for r in got} == {("un", f"http://127.0.0.1:{server.server_port}/report/detail/{i}") for i in (1, 2, 4, 5)}


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    for i, part in enumerate(events.orderBy("ts").randomSplit([1.0, 1.0], 3)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windowed(stream, late="60 days").writeStream.outputMode("complete").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("hours").collect())) == sorted(map(str, windowed(events).collect()))
    merge = lambda old, new: old.unionByName(new).groupBy("event_id").agg(F.max("value").alias("value"))
    q = upserted(stream.select("event_id", "value"), str(tmp_path / "out"), str(tmp_path / "mark"), merge).trigger(availableNow=True).start()
    q.awaitTermination()
    last = max(tmp_path.joinpath("out").iterdir(), key=lambda p: int(p.name[1:]))
    assert len(list(tmp_path.joinpath("out").iterdir())) == 2
    assert spark.read.parquet(str(last)).count() == events.count()


def test_small_sources(spark, tmp_path):
    (tmp_path / "a_form.json").write_text(json.dumps({"id": "a", "facilities": [{"facility_name": "Lab", "containment": {"has_bsl4": True, "bsl4_area_m2": 1.5}, "agents": {"listed": ["x", "y"]}, "extraction_metadata": {"language": "fr", "year": 2001}}]}))
    (tmp_path / "b_form.json").write_text(json.dumps({"id": "b", "facilities": []}))
    inner = "facility_name string, responsible_organisation string, translated boolean, location struct<address:string,city:string,full_text:string>, funding struct<sources:array<string>,mod_funded:boolean>, containment struct<has_bsl4:boolean,bsl4_area_m2:double,has_bsl3:boolean,bsl3_area_m2:double,highest_containment:string>, agents struct<listed:array<string>,redacted:boolean,raw_text:string>, confidence double, extraction_metadata struct<country_iso3:string,year:int,language:string>"
    fields = ",".join(f"{name}:{kind}" for name, kind in (x.strip().split(" ", 1) for x in inner.split(", ")))
    records = R.read_records(spark, str(tmp_path / "*_form.json"), f"id string, facilities array<struct<{fields}>>", spark.createDataFrame([("b",)], "id string"))
    from yearbook.operators.compliance import flatten_facilities

    flat = flatten_facilities(records).collect()
    assert [(r["document_id"], r["place"], r["year"], r["agents_summary"], r["translated"], float(r["bsl4_area_m2"])) for r in flat] == [("a", 0, 2001, "x; y", True, 1.5)]
    pages = spark.createDataFrame([("d", 50), ("d", 100), ("e", 500)], "id string, char_count int")
    assert {r["id"]: r["needs_ocr"] for r in K.needs_ocr(pages).collect()} == {"d": True, "e": False}
    languages = spark.createDataFrame([("ar",), ("fr",), ("xx",)], "l string").select("l", K.ocr_engine(F.col("l")).alias("e"))
    assert {r["l"]: r["e"] for r in languages.collect()} == {"ar": "vision", "fr": "tesseract:fra", "xx": "tesseract:eng"}
    rows = spark.createDataFrame([(1, True, False, "a"), (2, True, False, "a"), (3, False, False, "b"), (4, False, True, "c")], "n int, downloaded boolean, is_amendment boolean, id string")
    assert sorted(r["n"] for r in K.loadable(rows, "n").collect()) == [1, 4]
    assert set(R.checks(spark.createDataFrame([], R.SCHEMAS["defence_facilities"]))) >= {"confidence from 0 to 1", "year from 1980 to 2099", "personnel_total not negative"}


def test_form_tables(spark):
    rows = [("Confidence Building Measure a, part 2", "A2"), ("MESURE DE CONFIANCE « B »", "B"), ("Medida de fomento de la confianza \u201cA\u201d: Parte 1", "A1"), ("Formulaire A - Partie 1", "A1"), ("Форма B, итоги", "B"), ("форма a часть 2", "A2"), ("2. CONFIDENCE-BUILDING MEASURE \"A\":", "A1"), ("Information on outbreaks of infectious diseases", "B"), ("Form BC", None), ("Performance B", None)]
    got = spark.createDataFrame(rows, "line string, form string").select("line", "form", T.page_form(F.col("line")).alias("own")).collect()
    assert [r["own"] for r in got] == [f for _, f in rows]
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    # the header of field one in its template form is no record
    assert one(T.sections(F.lit("x\n1. Nom de lieu\nA\n2. y\n3. Наименование(я) объекта\n4. Наименование объекта z"))) == ["1. Nom de lieu\nA\n2. y\n3. Наименование(я) объекта", "4. Наименование объекта z"]
    assert one(T.sections(F.lit(" none "))) == ["none"] and one(T.sections(F.lit("none"), whole=False)) == [] and one(T.sections(F.lit(None).cast("string"))) == []
    long = "Defence\n" + "1. State the objectives\n" + "o" * 3000 + "\n2. State the total funding: 5\n1. What is the name of the facility\nLab\n(viii) Provide a list of publicly available\n" + "p" * 5000 + "\n5. Briefly describe the biological defence work\n" + "w" * 2000
    made = one(T.programme_sections(F.lit(long)))
    assert made["preamble"] == "" and made["sections"][0].startswith("Defence\n1. State") and made["sections"][0].endswith("[...objectives truncated...]\n\n2. State the total funding: 5") and len(made["sections"]) == 2
    assert made["sections"][1] == "1. What is the name of the facility\nLab\n\n\n5. Briefly describe the biological defence work\n" + "w" * 1452
    assert one(T.programme_chunks(F.lit(" ab "), 1)) == ["a", "b"] and one(T.programme_chunks(F.lit(None).cast("string"))) == []
    assert one(T.nothing_to_declare(F.lit("--- PAGE 1 ---\n" * 200 + "Nothing to declare"))) is True


def test_records_count_through_files(spark, tmp_path):
    for name, n in (("b", 2), ("a", 3), ("c", 1)):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"id": f"{name}{i}", "facilities": [{"n": j} for j in range(2)]} for i in range(n)]))
    got = R.listed(R.read_records(spark, str(tmp_path / "*.json"), "id string, facilities array<struct<n:int>>"), "facilities").orderBy("place").collect()
    assert [(r["place"], r["id"], r["record"]["n"]) for r in got] == [(2 * k + j, d, j) for k, d in enumerate(["a0", "a1", "a2", "b0", "b1", "c0"]) for j in range(2)]


def test_default_anchors(spark):
    from yearbook.operators.resolve import resolve_entities

    names = [(0, "CAN", "The National Microbiology Laboratory", 2010), (1, "CAN", "National Microbiology Laboratory, Public Health Agency, Canadian Science Centre", 2011), (2, "USA", "National Microbiology Laboratory", 2011), (3, "CAN", "Other", 2011)]
    rows = spark.createDataFrame(names, "place long, country_iso3 string, name string, year int")
    ids = lambda **k: [r["canonical_id"] for r in resolve_entities(rows, **k).orderBy("place").collect()]
    assert ids() == ["CAN_001", "CAN_001", "USA_001", "CAN_002"] and ids(anchors=()) == ["CAN_001", "CAN_002", "USA_001", "CAN_003"] and ids(kind="G") == ["CAN_V001", "CAN_V002", "USA_V001", "CAN_V003"]


def test_rows_of_cells(spark):
    from yearbook.operators.metrics import clustered, request_metrics, run_progress

    cells = [(10.0, 5.0, "b"), (12.0, 1.0, "a"), (22.0, 0.0, "c"), (22.5, 0.0, "d"), (34.6, 9.0, "e")]
    df = spark.createDataFrame([(cells,), ([],)], "cells array<struct<top:double,x0:double,value:string>>")
    got = [[[c["value"] for c in row] for row in r["rows"]] for r in df.select(clustered(F.col("cells")).alias("rows")).collect()]
    assert got == [[["c", "a", "b"], ["d"], ["e"]], []]
    assert tuple(request_metrics(spark.createDataFrame([], "duration double, status int")).first()) == (0, 0, 0.0, 0.0)
    assert run_progress(spark.createDataFrame([], "status string, calls int, input_tokens int, output_tokens int"), 5, 1.0, 1.0, 1.0).first()["remaining"] is None


def test_described_answers():
    rows = [{"source": "past_programme", "country_iso3": "USA", "country_name": None, "year": 1999, "has_offensive_programme": True, "has_defensive_programme": True, "offensive_period": None, "defensive_period": "1950-"},
            {"source": "defence_programme", "country_iso3": "FRA", "country_name": "France", "year": 2001, "programme_name": None, "total_funding_amount": 1234567.6, "total_funding_currency": "EUR"}]
    assert Q.describe(Q.QuerySpec("defence_programmes"), rows, ("Chad",)) == "USA (1999): past programme, offensive, defensive (1950-); France (2001): unnamed programme, 1,234,568 EUR\nNo public data: Chad."
    assert Q.funding_phrase(None, "EUR") == "funding not disclosed" and Q.funding_phrase(5, None) == "5"
    assert Q.describe(Q.QuerySpec("aggregate_stats", bsl=("BSL-4",)), [{"country_iso3": "DEU", "country_name": "Germany", "facility_count": 1, "total_area_m2": 2500.0}, {"country_iso3": "USA", "country_name": None, "facility_count": 1200, "total_area_m2": None}]) == "Germany: 1 facility with 2,500 m²; USA: 1,200 facilities. 1,201 facilities of 2 countries."
    assert Q.describe(Q.QuerySpec("comparative"), [{"country_iso3": "DEU", "country_name": "Germany", "count": 1, "area_m2": 12.0}]) == "1. Germany: 1 record with 12 m²"


def test_a_step_leaves_its_result_alone(spark):
    import os

    from yearbook.sources.shared import settled, written

    inner = []

    def step():
        inner.append(written(spark.range(5)))
        return inner[0].selectExpr("id + 1 AS id")

    before = written(spark.range(2))
    out = settled(spark, step)
    folder = lambda df: os.path.dirname(df.inputFiles()[0].removeprefix("file:").replace("///", "/"))
    assert sorted(r["id"] for r in out.collect()) == [1, 2, 3, 4, 5] and before.count() == 2
    assert os.path.isdir(folder(out)) and not os.path.isdir(folder(inner[0]))
