"""Submissions' text, nested records, the catalogue and files, and their SQL.

The supplied documents play submissions: headings are put before their whole
texts, so that what a query should find is known from the number of a document.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import forms
from ..operators import compliance as K
from ..operators import metrics as R
from ..operators import text as T
from ..sources import catalogue, exports, tables
from ..sources.shared import shared_dir
from .registry import query

#: Headings and the forms that they begin.
HEADINGS = (
    ("Form B", "B"), ('CONFIDENCE-BUILDING MEASURE "A", Part 2', "A2"), ("MESURE DE CONFIANCE « A », Partie 1", "A1"), ("Formulaire A – Partie 2", "A2"), ("Medida de fomento de la confianza “G”", "G"),
    ("Форма C", "C"), ("FormuleE", "E"), ("Declaration of vaccine production facilities", "G"), ("measure a, part 1", "A1"), ("3. Confidence-Building Measure “F”", "F"),
    ("Nothing to declare or nothing new to declare", "0"), ("Page 3\n \nReference\nConfidence Building Measure «A»\nPart 2 of it", "A2"), ("Formula B", None), ("In Form B", None),
)


def _sql(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def _case(values, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {_sql(v)}" for i, v in enumerate(values)) + " END"


def _chosen(values, key):
    return F.get(F.array(*(F.lit(v) for v in values)), (key % len(values)).cast("int"))


def _documents(t):
    return t._base("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _digest(c):
    return F.md5(c.cast("binary"))


SUB = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"

query("page_marks", f"""SELECT doc_id, 0 AS place, 1 AS page, md5(concat(text, chr(10))) AS body FROM {SUB} UNION ALL SELECT doc_id, 1, 12, md5(text) FROM {SUB}""")(
    lambda t: T.pages(_documents(t).withColumn("text", F.concat(F.lit("cover--- PAGE 1 ---\n"), "text", F.lit("\n--- PAGE 12 ---\n"), "text"))).select("doc_id", "place", "page", _digest(F.col("page_text")).alias("body"))
)
query("page_forms", f"SELECT doc_id, {_case([f for _, f in HEADINGS], f'doc_id % {len(HEADINGS)}')} AS form FROM documents")(
    lambda t: _documents(t).select("doc_id", T.page_form(F.concat(F.lit("\n  "), _chosen([h for h, _ in HEADINGS], F.col("doc_id")), F.lit(" \n"), "text")).alias("form"))
)
_FILLER = "\n".join(f"line {i}" for i in range(6))


def _segments(t):
    head = _chosen(("Form B", "Form A, Part 1", "no form"), F.col("doc_id"))
    text = F.concat(F.lit("--- PAGE 1 ---\n"), head, F.lit("\n"), "text", F.lit(f"\n--- PAGE 2 ---\n{_FILLER}\n Form E\n"), "text")
    return T.segments(T.pages(_documents(t).select(F.col("doc_id").alias("id"), text.alias("text"))))


_SEGMENTS = f"""SELECT doc_id AS id, form, text, 'medium' AS confidence FROM (
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'A1' END AS form, concat('--- PAGE 1 ---', chr(10), CASE doc_id % 3 WHEN 0 THEN 'Form B' ELSE 'Form A, Part 1' END, chr(10), text, chr(10), '--- PAGE 2 ---', chr(10), {_sql(_FILLER)}) AS text FROM {SUB}
UNION ALL SELECT doc_id, 'E', concat('--- PAGE 2 ---', chr(10), ' Form E', chr(10), text) FROM {SUB}) WHERE form IS NOT NULL"""
query("form_segments", f"SELECT id, form, md5(text) AS body, confidence FROM ({_SEGMENTS})")(lambda t: _segments(t).select("id", "form", _digest(F.col("text")).alias("body"), "confidence"))
query("form_coverage", f"SELECT form, count(*) AS documents FROM ({_SEGMENTS}) GROUP BY 1")(lambda t: T.form_coverage(_segments(t)))
query("facility_sections", f"SELECT doc_id, 2 AS n, md5(concat('1. Name of it', chr(10), '[', text, ']|7. Наименование объекта', chr(10), '[', text, ']')) AS body FROM {SUB}")(
    lambda t: _documents(t).withColumn("s", T.sections(F.concat(F.lit("Preface\n1. Name of it\n["), "text", F.lit("] \n\n7. Наименование объекта\n["), "text", F.lit("]\n")), forms.FACILITY))
    .select("doc_id", F.size("s").alias("n"), _digest(F.array_join("s", "|")).alias("body"))
)
query("programme_chunks", f"""WITH s AS (SELECT doc_id, right(concat('[', text, ']'), 12000) AS before, concat(repeat('x', 399), chr(10), '1. State the objectives', chr(10), '[', text, ']') AS a, concat('1. What is the name of the facility', chr(10), '[', text, ']') AS b FROM {SUB})
SELECT doc_id, CASE WHEN len(a) + len(b) > 12000 THEN 3 ELSE 2 END AS n, md5(concat(before, '|', a, CASE WHEN len(a) + len(b) > 12000 THEN '|' ELSE chr(10) || chr(10) END, b)) AS body FROM s""")(
    lambda t: _documents(t).withColumn("s", T.programme_chunks(F.concat(F.lit("["), "text", F.lit("]\n" + "x" * 399 + "\n1. State the objectives\n["), "text", F.lit("]\n1. What is the name of the facility\n["), "text", F.lit("]"))))
    .select("doc_id", F.size("s").alias("n"), _digest(F.array_join("s", "|")).alias("body"))
)
query("shortened_objectives", f"""WITH s AS (SELECT doc_id, len(text) AS n, concat(text, chr(10), '2. State the total funding', text) AS s FROM {SUB})
SELECT doc_id, md5(CASE WHEN n + 1 > 2000 THEN concat(substring(s, 1, 2000), chr(10), '[...objectives truncated...]', chr(10), chr(10), substring(s, n + 2)) ELSE s END) AS body FROM s""")(
    lambda t: _documents(t).select("doc_id", _digest(T.shortened(F.concat("text", F.lit("\n2. State the total funding"), "text"), forms.FUNDING, forms.OBJECTIVES_MOST)).alias("body"))
)
query("json_answers", """SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN concat('{"id": ', CAST(doc_id AS STRING), ', "name": "x"}') END AS answer FROM documents""")(
    lambda t: _documents(t).withColumn("j", F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "name": "x"}')))
    .select("doc_id", T.json_object(F.when(F.col("doc_id") % 4 == 0, F.col("j")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), "j", F.lit("\n```\n{}"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("It is "), "j", F.lit("."))).otherwise(F.lit("none of them"))).alias("answer"))
)
query("table_rows", "SELECT p_partkey, concat(p_name, chr(9), 'two lines', chr(10), chr(9), p_brand) AS lines FROM part")(
    lambda t: t._base("part").select("p_partkey", T.table_text(F.array(F.array("p_name", F.lit("two \n lines")), F.array(F.lit(None).cast("string"), F.col("p_brand")))).alias("lines"))
)

# --- nested records -----------------------------------------------------------


def _nested(t, rows, **fields):
    """Two records a row, the second of another language, as an array of structs."""
    def one(second: bool):
        meta = F.struct(F.col("country_iso3"), F.col("year"), F.lit("fr" if second else "en").alias("language"))
        return F.struct(meta.alias("extraction_metadata"), *(f.alias(name) for name, f in fields.items()))

    return rows.select(F.col("id").cast("string").alias("id"), F.array(one(False), one(True)).alias("facilities"))


def _twice(sql: str) -> str:
    return f"WITH x AS ({sql}) SELECT *, 0 AS place FROM x UNION ALL SELECT *, 1 FROM x"


query("flatten_vaccines", """WITH x AS (SELECT CAST(id AS STRING) AS document_id, country_iso3, year, facility_name, city, address, diseases_covered, concat(facility_name, '; ', vaccines_summary) AS vaccines_summary, confidence FROM r_vaccine_facility_years)
SELECT *, 0 AS place, false AS translated FROM x UNION ALL SELECT *, 1, true FROM x""")(
    lambda t: K.flatten_vaccines(_nested(t, t.vaccine_facility_years, facility_name=F.col("facility_name"), location=F.struct("city", "address"), diseases_covered=F.col("diseases_covered"), vaccines=F.array("facility_name", "vaccines_summary"), confidence=F.col("confidence").cast("double"), translated=F.lit(None).cast("boolean")))
)
query("flatten_defence_programmes", _twice("SELECT CAST(id AS STRING) AS document_id, country_iso3, year, programme_name, responsible_org, objectives_summary, array_to_string(research_areas, '; ') AS research_areas, total_funding_amount, total_funding_currency, uses_contractors, contractor_proportion_pct, confidence, true AS translated FROM r_defence_programmes"))(
    lambda t: K.flatten_defence_programmes(_nested(t, t.defence_programmes, **{c: F.col(c) for c in ("programme_name", "responsible_org", "objectives_summary", "research_areas", "total_funding_amount", "total_funding_currency", "uses_contractors", "contractor_proportion_pct", "confidence")}, translated=F.lit(True)), "facilities")
)
_COUNTS = ("personnel_military", "personnel_civilian", "personnel_scientists", "personnel_engineers", "personnel_technicians", "personnel_admin")
query("flatten_defence_facilities", _twice(f"""SELECT CAST(id AS STRING) AS document_id, country_iso3, year, facility_name, city, CAST(NULL AS STRING) AS address, CAST(NULL AS DECIMAL(10,2)) AS bsl2_area_m2, bsl3_area_m2, bsl4_area_m2, CAST(NULL AS DECIMAL(10,2)) AS total_lab_area_m2, personnel_total,
  {', '.join(f'personnel_total + {i} AS {c}' for i, c in enumerate(_COUNTS))}, mod_funded, 'own' AS funding_source, funding_research, CAST(0 AS DECIMAL(15,2)) AS funding_development, CAST(NULL AS DECIMAL(15,2)) AS funding_te, 'EUR' AS funding_currency, work_description, confidence, CAST(NULL AS BOOLEAN) AS translated FROM r_defence_facilities"""))(
    lambda t: K.flatten_defence_facilities(_nested(t, t.defence_facilities, **{c: F.col(c) for c in ("facility_name", "bsl3_area_m2", "bsl4_area_m2", "personnel_total", "mod_funded", "funding_research", "work_description", "confidence")},
        **{c: F.lit(None).cast("double") for c in ("bsl2_area_m2", "total_lab_area_m2", "funding_te")}, **{c: F.col("personnel_total") + i for i, c in enumerate(_COUNTS)}, location=F.struct("city", F.lit(None).cast("string").alias("address")),
        funding_source=F.lit("own"), funding_development=F.lit(0), funding_currency=F.lit("EUR"), translated=F.lit(None).cast("boolean")))
)
query("flatten_past_programmes", """SELECT document_id, country_iso3, CASE WHEN year > 1996 THEN year + 1 ELSE year END AS year, convention_entry_date, has_offensive_programme, offensive_period, offensive_summary, has_defensive_programme, defensive_period, defensive_summary, false AS translated, confidence, notes
FROM r_past_programmes WHERE has_offensive_programme IS NOT NULL OR has_defensive_programme IS NOT NULL""")(
    lambda t: K.flatten_past_programmes(t.past_programmes.withColumns({"id": F.col("document_id"), "extraction_metadata": F.struct(F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("string").alias("country_iso3"), F.when(F.col("year") > 1996, F.col("year") + 1).alias("year")), "translated": F.lit(False)}))
)

# --- catalogue and rules -------------------------------------------------------


def _entries(t):
    return t.documents.select("id", "year", "language", "is_amendment", F.when(F.col("year") == 1995, F.lower("country_iso3")).otherwise(F.col("country_iso3")).alias("country_iso3"), (F.col("language") != "fr").alias("downloaded"), F.when(F.col("year") == 1996, True).alias("needs_ocr"))


_ENTRIES = "(SELECT id, year, language, is_amendment, CASE WHEN year = 1995 THEN lower(country_iso3) ELSE country_iso3 END AS country_iso3, language <> 'fr' AS downloaded, CASE WHEN year = 1996 THEN true END AS needs_ocr FROM r_documents)"
query("catalogue_checked", f"SELECT id, regexp_full_match(country_iso3, '[A-Z]{{3}}') AND year BETWEEN 1980 AND 2099 AS good FROM {_ENTRIES}")(
    lambda t: (lambda both: both[0].select("id", F.lit(True).alias("good")).unionByName(both[1].select("id", F.lit(False).alias("good"))))(catalogue.checked(_entries(t)))
)
query("catalogue_loadable", f"SELECT id, year FROM {_ENTRIES} WHERE downloaded OR is_amendment")(lambda t: catalogue.loadable(_entries(t).unionByName(_entries(t).withColumn("year", F.col("year") + 100)), "year").select("id", "year"))
query("catalogue_pending", f"SELECT id FROM {_ENTRIES} WHERE downloaded AND NOT coalesce(needs_ocr, false) AND NOT coalesce(is_amendment, false) AND id IN (SELECT document_id FROM r_legislation) AND id NOT IN (SELECT document_id FROM r_past_programmes)")(
    lambda t: catalogue.pending(_entries(t), t.legislation.select(F.col("document_id").alias("id")), t.past_programmes.select(F.col("document_id").alias("id"))).select("id")
)
_LANGUAGES = (*catalogue.TESSERACT, "xx")
query("ocr_engines", "SELECT p_partkey, " + _case([("vision" if x in catalogue.VISION else f"tesseract:{catalogue.TESSERACT.get(x, 'eng')}") for x in _LANGUAGES], f"p_partkey % {len(_LANGUAGES)}") + " AS engine FROM part")(
    lambda t: t._base("part").select("p_partkey", catalogue.ocr_engine(_chosen(_LANGUAGES, F.col("p_partkey"))).alias("engine"))
)
query("ocr_needed", "SELECT p_brand AS id, avg(p_size * 5) AS avg_chars_per_page, avg(p_size * 5) < 130 AS needs_ocr FROM part GROUP BY 1")(
    lambda t: catalogue.needs_ocr(t._base("part").select(F.col("p_brand").alias("id"), (F.col("p_size") * 5).alias("char_count")), 130)
)
query("rate_buckets", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 5 WHEN l_quantity > 30 THEN 4 WHEN l_quantity > 20 THEN 3 WHEN l_quantity > 10 THEN 2 WHEN l_quantity > 2 THEN 1 ELSE 0 END AS bucket FROM lineitem")(
    lambda t: t._base("lineitem").select("l_orderkey", "l_linenumber", X.rate_bucket(F.when(F.col("l_quantity") > 2, F.col("l_quantity").cast("double") / 50).when(F.col("l_quantity") == 2, 0.0)).alias("bucket"))
)
query("iso_codes", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'ABC' WHEN 1 THEN upper(substring(c_mktsegment, 1, 3)) END AS code FROM customer")(
    lambda t: t._base("customer").select("c_custkey", X.iso3(F.when(F.col("c_custkey") % 3 == 0, " abc").when(F.col("c_custkey") % 3 == 1, F.substring("c_mktsegment", 1, 3)).otherwise("A1C")).alias("code"))
)
query("clamped_years", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN least(greatest(1960 + o_orderkey % 100, 1988), 2030) END AS year FROM orders")(
    lambda t: t._base("orders").select("o_orderkey", X.clamp(F.when(F.col("o_orderstatus") != "P", 1960 + F.col("o_orderkey") % 100)).alias("year"))
)

# --- files, written to the shared folder and read back ---------------------------


def _through_csv(t):
    path = shared_dir(t.spark)
    exports.write_csv(t._base("supplier").select("s_suppkey", F.concat(F.lit('a "b", '), "s_name", F.lit("\nc")).alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("balance")), path)
    read = tables.read_csv(t.spark, path, ("s_suppkey", "name", "balance"))
    return read.select(X.to_int(F.col("s_suppkey")).alias("s_suppkey"), "name", X.to_double(F.col("balance")).alias("balance"))


query("csv_files", """SELECT CAST(s_suppkey AS INT) AS s_suppkey, concat('a "b", ', s_name, chr(10), 'c') AS name, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_acctbal AS DOUBLE) END AS balance FROM supplier""")(_through_csv)


def _through_json(t):
    path = shared_dir(t.spark)
    exports.write_json(t._base("part").select("p_partkey", "p_name", F.when(F.col("p_size") > 10, F.col("p_size")).alias("size")), path)
    return t.spark.read.schema("p_partkey long, p_name string, size int").json(path)


query("json_files", "SELECT p_partkey, p_name, CASE WHEN p_size > 10 THEN p_size END AS size FROM part")(_through_json)


def _record_files(t):
    """A file a brand with an array of documents, each with nested records."""
    path = shared_dir(t.spark)
    record = F.struct(F.col("p_partkey").alias("n"), F.col("p_name").alias("name"))
    documents = t._base("part").groupBy("p_brand", "p_size").agg(F.sort_array(F.collect_list(record)).alias("records"))
    files = documents.groupBy("p_brand").agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("id"), "records")))).alias("value"))
    files.repartition("p_brand").write.partitionBy("p_brand").text(path)
    read = tables.read_records(t.spark, f"{path}/*/*.txt", "brand string, id string, records array<struct<n:long,name:string>>", t.spark.createDataFrame([("7",)], "id string"))
    # places count through all files: the least of a document is its first record's
    rows = tables.listed(read, "records").select("brand", "id", "place", "record.n", "record.name")
    return rows.withColumn("at", (F.col("place") - F.min("place").over(W.partitionBy("brand", "id"))).cast("int")).drop("place")


query("record_files", "SELECT p_brand AS brand, CAST(p_size AS STRING) AS id, CAST(row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) - 1 AS INT) AS at, p_partkey AS n, p_name AS name FROM part WHERE p_size <> 7")(_record_files)


def _reloaded(t):
    loads = tables.Reloaded(t.spark, shared_dir(t.spark))
    loads.replace_all({"legislation": t.legislation.select("document_id", "year"), "documents": t.documents.select("id", "year")})
    loads.replace_all({"legislation": t.legislation.select("document_id", (F.col("year") + 1).alias("year")), "documents": t.documents.select("id", (F.col("year") + 1).alias("year"))})
    return loads.read("documents").withColumn("kind", F.lit("documents")).unionByName(loads.read("legislation").select(F.col("document_id").alias("id"), "year", F.lit("legislation").alias("kind")))


query("reloaded_tables", "SELECT id, year + 1 AS year, 'documents' AS kind FROM r_documents UNION ALL SELECT document_id, year + 1, 'legislation' FROM r_legislation")(_reloaded)

# --- figures of runs, cells of tables ---------------------------------------------

query("request_metrics", """SELECT count(*) AS requests_total, count(*) FILTER (WHERE c_custkey % 10 = 4) AS errors_total, round(avg(CAST(c_custkey % 1000 AS DOUBLE) / 100) * 1000, 1) AS latency_avg_ms, round(max(CAST(c_custkey % 1000 AS DOUBLE) / 100) * 1000, 1) AS latency_max_ms FROM customer""")(
    lambda t: R.request_metrics(t._base("customer").select(((F.col("c_custkey") % 1000).cast("double") / 100).alias("duration"), F.when(F.col("c_custkey") % 10 == 4, 404).otherwise(200).alias("status")))
)
query("run_progress", """WITH r AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'skipped' ELSE 'no_form' END AS status, o_orderkey % 3 AS calls, o_orderkey % 1000 AS a, o_orderkey % 100 AS b FROM orders), s AS (
SELECT count(*) AS done, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'no_form') AS failed, CAST(coalesce(sum(calls) FILTER (WHERE status = 'ok'), 0) AS BIGINT) AS calls,
  CAST(coalesce(sum(a) FILTER (WHERE status = 'ok'), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(b) FILTER (WHERE status = 'ok'), 0) AS BIGINT) AS output_tokens FROM r)
SELECT *, CAST(input_tokens AS DOUBLE) * 0.25 + CAST(output_tokens AS DOUBLE) * 1.5 AS cost, CAST(60 AS DOUBLE) / done * (1000000 - done) AS remaining FROM s""")(
    lambda t: R.run_progress(t._base("orders").select(F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "skipped").otherwise("no_form").alias("status"), (F.col("o_orderkey") % 3).alias("calls"), (F.col("o_orderkey") % 1000).alias("input_tokens"), (F.col("o_orderkey") % 100).alias("output_tokens")), 1_000_000, 60.0, 0.25, 1.5)
)
query("cell_rows", """WITH c AS (SELECT l_orderkey, list(CAST(l_quantity AS DOUBLE) ORDER BY l_quantity) AS tops FROM lineitem GROUP BY 1),
h AS (SELECT l_orderkey, len(tops) AS n, list_reduce(list_transform(tops, lambda t: [t]), lambda acc, t: CASE WHEN t[1] - acc[-1] > 12 THEN list_concat(acc, t) ELSE acc END) AS heads FROM c)
SELECT l_orderkey, CAST(n AS BIGINT) AS cells, array_to_string(list_transform(heads, lambda x: CAST(CAST(x AS INT) AS STRING)), '|') AS heads FROM h""")(
    lambda t: t._base("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("top"), F.col("l_linenumber").alias("x0"), F.lit("Yes").alias("value"))).alias("cells")).withColumn("rows", R.clustered(F.col("cells")))
    .select("l_orderkey", F.size(F.flatten("rows")).cast("long").alias("cells"), F.array_join(F.transform("rows", lambda row: F.array_min(F.transform(row, lambda c: c["top"])).cast("int").cast("string")), "|").alias("heads"))
)
