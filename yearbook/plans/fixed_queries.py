"""Fixed analytic queries and lookups, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import lookups as L
from ..operators import summaries as S
from ..operators.search import search
from .registry import query

NAMES = "names AS (SELECT country_iso3, arg_min(country_name, id) AS country_name FROM r_documents WHERE country_name IS NOT NULL GROUP BY 1)"
#: Half-up to three places, exact on whole numbers.
RATE = "CAST(nullif((2000 * {a} + {b}) // (2 * nullif({b}, 0)), -1) AS DOUBLE) / 1000"
ISO, YEAR, TERM = "XAC", 2005, "ring"
ENTITY, DEFENCE, VACCINE = "XAP_000", "XAC_D002", "XAC_V003"


def rate(a: str, b: str) -> str:
    return RATE.format(a=a, b=b)


def joined(column: str) -> str:
    """An array as text; null if there is none."""
    return f"array_to_string({column}, '|')"


def text(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), "|").alias(column)


query("stats", """
SELECT (SELECT count(*) FROM r_documents WHERE NOT is_amendment) AS total_submissions, (SELECT count(DISTINCT country_iso3) FROM r_documents WHERE NOT is_amendment) AS total_countries,
  (SELECT count(*) FROM r_facility_years) AS total_facility_years, (SELECT count(*) FROM r_facilities) AS total_unique_facilities, (SELECT count(*) FROM r_facility_years WHERE lon IS NOT NULL) AS geocoded_facility_years,
  (SELECT count(*) FROM r_vaccine_facility_years) AS vaccine_facility_years, (SELECT count(*) FROM r_defence_facilities) AS defence_facility_years, (SELECT count(*) FROM r_vaccine_facilities) AS total_unique_vaccine,
  (SELECT count(DISTINCT canonical_defence_facility_id) FROM r_defence_facilities) AS total_unique_defence,
  (SELECT min(year) FROM r_documents WHERE NOT is_amendment) AS year_min, (SELECT max(year) FROM r_documents WHERE NOT is_amendment) AS year_max""")(S.stats)

query("countries", f"""
SELECT d.country_iso3, max(d.country_name) AS country_name, count(DISTINCT d.year) AS submission_count, max(d.year) AS latest_year, count(DISTINCT fy.canonical_facility_id) AS facility_count,
  count(DISTINCT CASE WHEN fy.has_bsl4 THEN fy.canonical_facility_id END) AS bsl4_count, {rate("count(DISTINCT CASE WHEN fc.status = 'substantive' THEN d.year END)", "count(DISTINCT d.year)")} AS a1_rate
FROM r_documents d LEFT JOIN r_facility_years fy ON fy.document_id = d.id LEFT JOIN r_form_compliance fc ON fc.document_id = d.id AND fc.form = 'A1'
WHERE NOT d.is_amendment GROUP BY d.country_iso3""")(S.countries)

for _form, _name in (("A1", "a1_rate"), ("E", "rate")):
    query(f"compliance_{_form.lower()}", f"""
SELECT d.country_iso3, max(d.country_name) AS country_name, count(DISTINCT d.year) AS submission_count, {rate("count(DISTINCT CASE WHEN fc.status = 'substantive' THEN d.year END)", "count(DISTINCT d.year)")} AS {_name}
FROM r_documents d LEFT JOIN r_form_compliance fc ON fc.document_id = d.id AND fc.form = '{_form}' WHERE NOT d.is_amendment GROUP BY 1""")(lambda t, f=_form: S.compliance(t, f))

TIMELINE = f"""SELECT fy.year, count(*) AS a1_facility_years, count(*) FILTER (WHERE has_bsl4) AS bsl4_facility_years, count(DISTINCT d.country_iso3) AS submitting_countries
FROM r_facility_years fy JOIN r_documents d ON d.id = fy.document_id WHERE fy.year < {YEAR} GROUP BY fy.year"""
query("timeline", TIMELINE)(lambda t: S.timeline(t, YEAR))
query("timeline_columns", f"""SELECT {', '.join(f"{joined(f'list({c} ORDER BY year)')} AS {'years' if c == 'year' else c}" for c in ('year', 'a1_facility_years', 'bsl4_facility_years', 'submitting_countries'))} FROM ({TIMELINE})""")(
    lambda t: S.timeline_columns(S.timeline(t, YEAR)).select(text("years"), text("a1_facility_years"), text("bsl4_facility_years"), text("submitting_countries"))
)

CAPACITY = f"""SELECT year, fy.country_iso3, any_value(country_name) AS country_name, CAST(sum(bsl4_area_m2) AS DOUBLE) AS total_bsl4_area_m2, count(*) FILTER (WHERE has_bsl4) AS bsl4_facility_count
FROM r_facility_years fy LEFT JOIN names USING (country_iso3) WHERE bsl4_area_m2 > 0 AND year < {YEAR} GROUP BY year, fy.country_iso3"""
query("bsl4_capacity", f"WITH {NAMES} {CAPACITY}")(lambda t: S.bsl4_capacity(t, YEAR))
query("capacity_top_n", f"""
WITH {NAMES}, capacity AS ({CAPACITY}),
top AS (SELECT country_iso3 FROM capacity GROUP BY 1 ORDER BY sum(total_bsl4_area_m2) DESC, country_iso3 LIMIT 8),
cells AS (SELECT year, CASE WHEN country_iso3 IN (FROM top) THEN country_iso3 ELSE 'OTHER' END AS series, CAST(sum(CAST(total_bsl4_area_m2 AS DECIMAL(20,2))) AS DOUBLE) AS area FROM capacity GROUP BY ALL)
SELECT y.year, s.series, coalesce(c.area, 0.0) AS area FROM (SELECT DISTINCT year FROM capacity) y CROSS JOIN (SELECT DISTINCT series FROM cells) s LEFT JOIN cells c ON c.year = y.year AND c.series = s.series""")(
    lambda t: S.capacity_top_n(S.bsl4_capacity(t, YEAR))
)

TERMS = tuple((w.title(), w) for w in ("ring", "widget", "blue", "small", "promo", "economy", "anthrax", "e_o", "nut", "bolt"))
query("pathogen_frequency", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{label}' AS label, '{w}' AS term, count(DISTINCT CASE WHEN agents_summary ILIKE '%{w}%' THEN canonical_facility_id END) AS count FROM r_facility_years" for label, w in TERMS) + ") WHERE count > 0")(
    lambda t: S.pathogen_frequency(t, TERMS)
)

query("transparency", f"""
WITH base AS (SELECT d.country_iso3, max(d.country_name) AS country_name, count(DISTINCT d.id) AS submission_count, min(d.year) AS first_year, max(d.year) AS latest_year,
  {rate("count(DISTINCT CASE WHEN fc.status = 'substantive' THEN d.id END)", "count(DISTINCT d.id)")} AS a1_rate
  FROM r_documents d LEFT JOIN r_form_compliance fc ON fc.document_id = d.id AND fc.form = 'A1' WHERE NOT d.is_amendment GROUP BY 1),
scores AS (SELECT *, least(1.0::DOUBLE, submission_count::DOUBLE / (latest_year - first_year + 1)::DOUBLE) AS regularity_score, CASE WHEN latest_year >= {YEAR} - 2 THEN 1.0 WHEN latest_year >= {YEAR} - 5 THEN 0.5 ELSE 0.1 END::DOUBLE AS recency_score FROM base)
SELECT *, CAST(printf('%.1f', (regularity_score * 0.4::DOUBLE + a1_rate * 0.4::DOUBLE + recency_score * 0.2::DOUBLE) * 100::DOUBLE) AS DOUBLE) AS transparency_score FROM scores""")(lambda t: S.transparency(t, YEAR))

query("lapsed", """
WITH f AS (SELECT canonical_facility_id, min(country_iso3) AS country_iso3, max(year) AS y FROM r_facility_years GROUP BY 1), c AS (SELECT country_iso3, max(year) AS y FROM r_facility_years WHERE year < 2002 GROUP BY 1)
SELECT canonical_facility_id FROM f JOIN (SELECT country_iso3, max(y) AS y FROM f GROUP BY 1) c USING (country_iso3) WHERE c.y - f.y >= 0""")(lambda t: S.lapsed(t, 0))
query("compare", """
WITH n AS (SELECT 'facilities' AS metric, country_iso3 FROM r_facilities UNION ALL SELECT 'bsl4', country_iso3 FROM r_facilities WHERE latest_containment LIKE '%4%' UNION ALL SELECT 'bsl3', country_iso3 FROM r_facilities WHERE latest_containment LIKE '%3%'
  UNION ALL SELECT DISTINCT concat('years_submitted', CAST(year AS STRING)), country_iso3 FROM r_documents WHERE NOT is_amendment UNION ALL SELECT 'vaccine_facilities', country_iso3 FROM r_vaccine_facilities UNION ALL SELECT 'defence_facilities', country_iso3 FROM r_defence_entities),
m AS (SELECT unnest(['facilities', 'bsl4', 'bsl3', 'years_submitted', 'vaccine_facilities', 'defence_facilities']) AS metric)
SELECT m.metric, count(*) FILTER (WHERE country_iso3 = 'XAC') AS a, count(*) FILTER (WHERE country_iso3 = 'XAP') AS b FROM m LEFT JOIN n ON n.metric = m.metric OR (m.metric = 'years_submitted' AND n.metric LIKE 'years_submitted%') GROUP BY 1""")(
    lambda t: S.compare(t, "XAC", "XAP")
)
query("summary_stats", """
SELECT (SELECT count(*) FROM r_facility_years) AS facility_years, (SELECT CAST(round(CAST(sum(confidence) AS DOUBLE) / count(confidence), 3) AS DOUBLE) FROM r_facility_years) AS mean_confidence,
  (SELECT string_agg(DISTINCT country_iso3, ',' ORDER BY country_iso3) FROM r_facility_years) AS countries, (SELECT string_agg(DISTINCT CAST(year AS STRING), ',' ORDER BY CAST(year AS STRING)) FROM r_facility_years) AS years,
  (SELECT count(*) FROM r_facilities) AS facilities, (SELECT count(*) FROM r_facilities WHERE latest_containment = 'BSL-4') AS bsl4_facilities, (SELECT count(*) FROM r_facilities WHERE latest_containment IN ('BSL-4', 'BSL-3')) AS bsl3_facilities,
  (SELECT count(*) FROM r_past_programmes) AS past_programmes, (SELECT count(*) FROM r_past_programmes WHERE has_offensive_programme) AS with_offensive, (SELECT count(*) FROM r_past_programmes WHERE has_defensive_programme) AS with_defensive,
  (SELECT count(*) FROM r_vaccine_facility_years) AS vaccine_facility_years, (SELECT count(*) FROM r_defence_programmes) AS defence_programmes, (SELECT count(*) FROM r_legislation) AS legislation_records""")(S.summary_stats)
query("substantive_rates", f"SELECT form, {rate('count(*) FILTER (WHERE status = $$substantive$$)', '(SELECT count(DISTINCT document_id) FROM r_form_compliance)')} AS rate FROM r_form_compliance GROUP BY form")(S.substantive_rates)
query("bsl_by_country", "SELECT coalesce(country_iso3, 'UNK') AS country_iso3, count(*) FILTER (WHERE latest_containment = 'BSL-4') AS bsl4, count(*) FILTER (WHERE latest_containment IN ('BSL-4', 'BSL-3')) AS bsl3 FROM r_facilities GROUP BY 1")(S.bsl_by_country)
query("declared_years", "SELECT year FROM r_facility_years UNION SELECT year FROM r_vaccine_facility_years UNION SELECT year FROM r_defence_facilities")(S.declared_years)
query("bar_shares", "WITH c AS (SELECT country_iso3, count(*) AS count FROM r_documents GROUP BY 1) SELECT country_iso3, count, count / (SELECT max(count) FROM c) AS share FROM c")(
    lambda t: S.bar_shares(t.documents.groupBy("country_iso3").count())
)
query("weighted_sample")(lambda t: S.weighted_sample(t.facility_years.select("id", F.col("bsl3_area_m2").cast("double").alias("weight")), "weight", 20))

# --- one country ---------------------------------------------------------------

COMPLIANCE = f"SELECT document_id, year, form, status FROM r_form_compliance JOIN r_documents d ON d.id = document_id WHERE country_iso3 = '{ISO}' AND NOT is_amendment"
query("country_compliance", COMPLIANCE)(lambda t: L.country_compliance(t, ISO))
query("compliance_grid", f"SELECT year, {', '.join(f"coalesce(arg_max(status, document_id) FILTER (WHERE form = '{f}'), 'absent') AS {f.lower()}" for f in S.FORMS)} FROM ({COMPLIANCE}) GROUP BY year")(
    lambda t: L.compliance_grid(L.country_compliance(t, ISO))
)
query("country_facilities", f"""
SELECT f.canonical_facility_id, canonical_name, latest_containment, {joined('years_declared')} AS years_declared, latest_area_m2, latest_source_url
FROM r_facilities f LEFT JOIN (SELECT DISTINCT ON (canonical_facility_id) canonical_facility_id, source_url AS latest_source_url FROM r_facility_years fy JOIN r_documents d ON d.id = fy.document_id ORDER BY canonical_facility_id, fy.year DESC, document_id DESC, fy.id DESC) USING (canonical_facility_id)
WHERE f.country_iso3 = '{ISO}'""")(lambda t: L.country_facilities(t, ISO).withColumn("years_declared", text("years_declared")))
query("country_defence_programmes", f"SELECT year, id, programme_name, responsible_org, objectives_summary, {joined('research_areas')} AS research_areas, total_funding_amount, total_funding_currency, uses_contractors, contractor_proportion_pct, confidence FROM r_defence_programmes WHERE country_iso3 = '{ISO}'")(
    lambda t: L.country_defence_programmes(t, ISO).withColumn("research_areas", text("research_areas"))
)
query("country_defence_entities", f"""SELECT canonical_defence_facility_id AS canonical_id, any_value(canonical_name) AS canonical_name, any_value(first_year) AS first_year, any_value(last_year) AS last_year, bool_or(bsl4_area_m2 > 0) AS has_bsl4, bool_or(bsl3_area_m2 > 0) AS has_bsl3
FROM r_defence_entities e LEFT JOIN r_defence_facilities USING (canonical_defence_facility_id) WHERE e.country_iso3 = '{ISO}' GROUP BY 1""")(lambda t: L.country_defence_entities(t, ISO))
query("country_vaccine_entities", f"SELECT id AS canonical_id, canonical_name, first_year, last_year FROM r_vaccine_facilities WHERE country_iso3 = '{ISO}'")(lambda t: L.country_vaccine_entities(t, ISO))
query("country_vaccine_records", f"SELECT year, id, facility_name, city, address, diseases_covered, vaccines_summary, confidence FROM r_vaccine_facility_years WHERE country_iso3 = '{ISO}'")(lambda t: L.country_vaccine_records(t, ISO))
LAWS = f"SELECT l.year, {', '.join(L.LEGISLATION)}, {joined('key_laws')} AS key_laws, notes, confidence, document_id, source_url FROM r_legislation l JOIN r_documents d ON d.id = document_id WHERE l.country_iso3 = '{ISO}'"
query("country_legislation", LAWS)(lambda t: L.country_legislation(t, ISO).withColumn("key_laws", text("key_laws")))
query("legislation_rollup", f"""SELECT document_id, year, {', '.join(f"coalesce({c}_legislation, false) OR coalesce({c}_regulations, false) OR coalesce({c}_other_measures, false) AS {c}" for c in L.CATEGORIES)}, {joined('key_laws[1:3]')} AS key_laws
FROM r_legislation WHERE country_iso3 = '{ISO}' ORDER BY year DESC, document_id LIMIT 50""")(lambda t: L.legislation_rollup(L.country_legislation(t, ISO)).withColumn("key_laws", text("key_laws")))
query("country_past_programmes", f"""SELECT p.year, convention_entry_date, has_offensive_programme, offensive_period, offensive_summary, has_defensive_programme, defensive_period, defensive_summary, confidence, notes, document_id, source_url
FROM r_past_programmes p JOIN r_documents d ON d.id = document_id WHERE p.country_iso3 = '{ISO}'""")(lambda t: L.country_past_programmes(t, ISO))
_statuses = " ".join(f"WHEN '{c}' THEN '{s}'" for s, codes in L.MEMBERSHIP.items() for c in codes)
query("country_status", f"""WITH c AS (SELECT country_iso3 FROM r_documents UNION SELECT unnest(['CHN', 'SYR', 'ISR', 'DEU'])), m AS (SELECT country_iso3, CASE country_iso3 {_statuses} END AS member FROM c)
SELECT country_iso3, CASE WHEN member = 'restricted' THEN member WHEN country_iso3 IN (SELECT country_iso3 FROM r_documents) THEN 'data' ELSE coalesce(member, 'none') END AS status FROM m""")(
    lambda t: L.country_status(t, t.documents.select("country_iso3").union(t.spark.createDataFrame([("CHN",), ("SYR",), ("ISR",), ("DEU",)], "country_iso3 string")))
)

# --- one entity ------------------------------------------------------------------

query("entity", f"WITH {NAMES} SELECT canonical_facility_id, canonical_name, country_iso3, country_name, {joined('all_names')} AS all_names, {joined('years_declared')} AS years_declared, latest_containment, latest_area_m2 FROM r_facilities LEFT JOIN names USING (country_iso3) WHERE canonical_facility_id = '{ENTITY}'")(
    lambda t: L.entity(t, ENTITY).withColumns({"all_names": text("all_names"), "years_declared": text("years_declared")})
)
query("entity_records", f"""SELECT fy.year, fy.id, document_id, facility_name, responsible_org, city, address, funding_sources, has_bsl4, bsl4_area_m2, has_bsl3, bsl3_area_m2, highest_containment, agents_summary, agents_redacted, confidence, flagged_for_review, flag_note, source_url
FROM r_facility_years fy JOIN r_documents d ON d.id = document_id WHERE canonical_facility_id = '{ENTITY}'""")(lambda t: L.entity_records(t, ENTITY))
query("entity_defence", f"""WITH {NAMES} SELECT canonical_defence_facility_id AS id, (SELECT facility_name FROM r_defence_facilities x WHERE x.canonical_defence_facility_id = '{DEFENCE}' ORDER BY year DESC, document_id DESC, x.id DESC LIMIT 1) AS canonical_name, country_iso3, country_name,
  array_to_string(list_sort(list(DISTINCT facility_name) FILTER (WHERE facility_name IS NOT NULL)), '|') AS all_names, min(year) AS first_year, max(year) AS last_year
FROM r_defence_facilities LEFT JOIN names USING (country_iso3) WHERE canonical_defence_facility_id = '{DEFENCE}' GROUP BY 1, 3, 4""")(lambda t: L.entity_defence(t, DEFENCE).withColumn("all_names", text("all_names")))
query("entity_defence_records", f"SELECT r.* EXCLUDE (canonical_defence_facility_id), source_url FROM r_defence_facilities r JOIN r_documents d ON d.id = document_id WHERE canonical_defence_facility_id = '{DEFENCE}'")(lambda t: L.entity_defence_records(t, DEFENCE))
query("entity_vaccine", f"WITH {NAMES} SELECT id, canonical_name, country_iso3, country_name, first_year, last_year FROM r_vaccine_facilities LEFT JOIN names USING (country_iso3) WHERE id = '{VACCINE}'")(lambda t: L.entity_vaccine(t, VACCINE))
query("entity_vaccine_records", f"SELECT r.year, r.id, document_id, facility_name, city, address, diseases_covered, vaccines_summary, confidence, source_url FROM r_vaccine_facility_years r JOIN r_documents d ON d.id = document_id WHERE canonical_vaccine_facility_id = '{VACCINE}'")(lambda t: L.entity_vaccine_records(t, VACCINE))
query("flagged", "SELECT canonical_facility_id, canonical_name, fy.country_iso3, fy.year, flag_note, source_url FROM r_facility_years fy JOIN r_facilities USING (canonical_facility_id) JOIN r_documents d ON d.id = document_id WHERE flagged_for_review")(L.flagged)

# --- maps --------------------------------------------------------------------------

MAP = f"""SELECT DISTINCT ON (canonical_facility_id, year) canonical_facility_id, coalesce(canonical_name, facility_name) AS name, fy.country_iso3, highest_containment AS containment, year, city, geocode_confidence, lon, lat, country_name, agents_summary, agents_redacted
FROM r_facility_years fy LEFT JOIN (SELECT canonical_facility_id, canonical_name FROM r_facilities) USING (canonical_facility_id) LEFT JOIN names ON names.country_iso3 = fy.country_iso3 WHERE lon IS NOT NULL ORDER BY canonical_facility_id, year, document_id, fy.id"""
query("map_facilities", f"WITH {NAMES} {MAP}")(L.map_facilities)
query("map_defence", f"WITH {NAMES} SELECT id, facility_name AS name, country_iso3, year, city, geocode_confidence, lon, lat, country_name FROM r_defence_facilities LEFT JOIN names USING (country_iso3) WHERE lon IS NOT NULL")(L.map_defence)
query("map_vaccines", f"""WITH {NAMES} SELECT DISTINCT ON (canonical_vaccine_facility_id, year) r.id, coalesce(canonical_name, facility_name) AS name, r.country_iso3, year, city, geocode_confidence, lon, lat, country_name
FROM r_vaccine_facility_years r LEFT JOIN r_vaccine_facilities v ON v.id = canonical_vaccine_facility_id LEFT JOIN names ON names.country_iso3 = r.country_iso3 WHERE lon IS NOT NULL ORDER BY canonical_vaccine_facility_id, year, document_id, r.id""")(L.map_vaccines)
query("map_filter", f"""WITH {NAMES}, m AS ({MAP}), latest AS (SELECT country_iso3, max(year) AS year FROM m GROUP BY 1)
SELECT m.* FROM m JOIN latest USING (country_iso3, year) WHERE coalesce(geocode_confidence, '') <> 'low' AND (containment LIKE '%4%' OR (containment LIKE '%3%' AND containment NOT LIKE '%4%'))""")(lambda t: L.map_filter(L.map_facilities(t), hide_low=True, bsl=("BSL-4", "BSL-3")))
query("map_filter_lapsed", f"WITH {NAMES}, m AS ({MAP}), latest AS (SELECT canonical_facility_id, max(year) AS year FROM m GROUP BY 1) SELECT m.* FROM m JOIN latest USING (canonical_facility_id, year)")(lambda t: L.map_filter(L.map_facilities(t), lapsed=True))
query("map_geojson", """SELECT to_json({type: 'Feature', geometry: {type: 'Point', coordinates: [lon, lat]}, properties: {id: id, year: year, city: city}}) AS feature FROM r_defence_facilities WHERE lon IS NOT NULL""")(
    lambda t: L.geojson(L.map_defence(t).select("id", "year", "city", "lon", "lat"))
)
query("vaccine_spans", "SELECT id, array_to_string(CASE WHEN first_year <= last_year THEN generate_series(first_year, last_year) ELSE [] END, '|') AS years FROM r_vaccine_facilities")(lambda t: L.spans(t).withColumn("years", text("years")))

# --- search and changes --------------------------------------------------------------

query("search", f"""
WITH {NAMES}, active AS (
SELECT canonical_facility_id, first(left(agents_summary, 200) ORDER BY year DESC, document_id DESC, id DESC) AS activity_snippet FROM r_facility_years WHERE agents_summary ILIKE '%{TERM}%' GROUP BY 1), named AS (
SELECT *, coalesce(canonical_name ILIKE '%{TERM}%', false) OR len(list_filter(all_names, lambda x: x ILIKE '%{TERM}%')) > 0 AS by_name FROM r_facilities), every AS (
SELECT n.canonical_facility_id AS id, canonical_name AS name, country_iso3, latest_containment, array_to_string(years_declared, '|') AS years_declared, 'A1' AS layer, CASE WHEN by_name THEN 'name' ELSE 'activity' END AS match_type, activity_snippet
FROM named n LEFT JOIN active a ON a.canonical_facility_id = n.canonical_facility_id WHERE by_name OR activity_snippet IS NOT NULL
UNION ALL SELECT id, canonical_name, country_iso3, NULL, array_to_string(CASE WHEN first_year <= last_year THEN generate_series(first_year, last_year) ELSE [] END, '|'), 'G', 'name', NULL FROM r_vaccine_facilities WHERE canonical_name ILIKE '%{TERM}%'
UNION ALL SELECT DISTINCT NULL, facility_name, country_iso3, NULL, NULL, 'A2', 'name', NULL FROM r_defence_facilities WHERE facility_name ILIKE '%{TERM}%'), top AS (
SELECT * FROM every ORDER BY name NULLS LAST, layer, id NULLS LAST, country_iso3 LIMIT 20)
SELECT t.id, t.name, t.country_iso3, t.latest_containment, t.years_declared, t.layer, n.country_name, t.match_type, t.activity_snippet FROM top t LEFT JOIN names n ON n.country_iso3 = t.country_iso3""")(
    lambda t: search(t, TERM).withColumn("years_declared", text("years_declared"))
)

_pct = "(100 * (bsl{n}_area_m2 - p{n})::DOUBLE / p{n}::DOUBLE)"
_area = lambda n: f"'BSL-{n} area ' || CASE WHEN {_pct.format(n=n)} > 0 THEN 'increased' ELSE 'decreased' END || ' ' || CAST(CAST(round_even(abs({_pct.format(n=n)}), 0) AS BIGINT) AS STRING) || '% (' || CAST(CAST(round_even(p{n}::DOUBLE, 0) AS BIGINT) AS STRING) || '→' || CAST(CAST(round_even(bsl{n}_area_m2::DOUBLE, 0) AS BIGINT) AS STRING) || ' m²)'"
_none = "NULL::DOUBLE AS delta_pct, NULL::DOUBLE AS from_m2, NULL::DOUBLE AS to_m2, NULL::STRING AS from_level, NULL::STRING AS to_level"
_of_area = lambda n: f"round_even({_pct.format(n=n)}, 1), p{n}::DOUBLE, bsl{n}_area_m2::DOUBLE, NULL, NULL"
query("changes_notable", f"""
WITH {NAMES}, r AS (SELECT *, lag(year) OVER w AS py, lag(has_bsl4) OVER w AS ph, lag(bsl4_area_m2) OVER w AS p4, lag(bsl3_area_m2) OVER w AS p3, lag(highest_containment) OVER w AS pl, count(*) OVER a AS n,
    last_value(facility_name) OVER a AS last_name, last_value(country_iso3) OVER a AS last_country
  FROM r_facility_years WINDOW w AS (PARTITION BY canonical_facility_id ORDER BY year, document_id, id), a AS (PARTITION BY canonical_facility_id ORDER BY year, document_id, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
p AS (SELECT * FROM r WHERE n >= 3 AND py IS NOT NULL AND year - py <= 3),
c AS (SELECT p.*, 'bsl4_gained' AS type, 'BSL-4 status gained' AS label, 'high' AS severity, {_none}, 0 AS place FROM p WHERE ph = false AND has_bsl4 = true
  UNION ALL SELECT p.*, 'bsl4_lost', 'BSL-4 status lost', 'medium', NULL, NULL, NULL, NULL, NULL, 1 FROM p WHERE ph = true AND has_bsl4 = false
  UNION ALL SELECT p.*, 'bsl4_area_change', {_area(4)}, CASE WHEN abs({_pct.format(n=4)}) >= 50 THEN 'high' ELSE 'medium' END, {_of_area(4)}, 2 FROM p WHERE p4 > 0 AND bsl4_area_m2 <> 0 AND abs({_pct.format(n=4)}) >= 20
  UNION ALL SELECT p.*, 'bsl3_area_change', {_area(3)}, 'medium', {_of_area(3)}, 3 FROM p WHERE p3 > 0 AND bsl3_area_m2 <> 0 AND abs({_pct.format(n=3)}) >= 30
  UNION ALL SELECT p.*, 'containment_change', 'Containment level changed: ' || pl || ' → ' || highest_containment, 'high', NULL, NULL, NULL, pl, highest_containment, 4 FROM p WHERE pl <> '' AND highest_containment <> '' AND pl <> highest_containment)
SELECT c.canonical_facility_id, coalesce(canonical_name, last_name) AS facility_name, last_country AS country_iso3, country_name, py AS from_year, year AS to_year, n AS years_on_record, type, label, severity, delta_pct, from_m2, to_m2, from_level, to_level
FROM c JOIN (SELECT canonical_facility_id, canonical_name FROM r_facilities) f USING (canonical_facility_id) LEFT JOIN names ON names.country_iso3 = last_country
ORDER BY CASE severity WHEN 'high' THEN 0 ELSE 1 END, year DESC, c.canonical_facility_id, py, document_id, id, place LIMIT 200""")(C.notable_changes)

_num = lambda c: f"CAST(CAST({c} AS DECIMAL(20,2)) AS STRING)"
_round = lambda n: f"CAST(CAST(round({_pct.format(n=n)}, 0) AS BIGINT) AS STRING)"
query("facility_diffs", f"""
WITH p AS (SELECT *, lag(year) OVER w AS py, lag(highest_containment) OVER w AS pl, lag(bsl4_area_m2) OVER w AS p4, lag(bsl3_area_m2) OVER w AS p3, lag(mod_funded) OVER w AS pm
  FROM r_facility_years WHERE canonical_facility_id = '{ENTITY}' WINDOW w AS (PARTITION BY canonical_facility_id ORDER BY year, document_id, id)), q AS (SELECT * FROM p WHERE year - py <= 4)
SELECT document_id, py AS from_year, year AS to_year, 'Containment' AS key, pl AS from_value, highest_containment AS to_value, '' AS dir, NULL AS pct FROM q WHERE pl <> highest_containment AND pl <> '' AND highest_containment <> ''
UNION ALL SELECT document_id, py, year, 'BSL-4 area', {_num('p4')}, {_num('bsl4_area_m2')}, CASE WHEN bsl4_area_m2 > p4 THEN 'up' ELSE 'down' END, CASE WHEN p4 > 0 THEN {_round(4)} END FROM q WHERE p4 <> bsl4_area_m2
UNION ALL SELECT document_id, py, year, 'BSL-4 area', 'none', {_num('bsl4_area_m2')}, 'up', NULL FROM q WHERE p4 IS NULL AND bsl4_area_m2 <> 0
UNION ALL SELECT document_id, py, year, 'BSL-4 area', {_num('p4')}, 'none declared', 'down', NULL FROM q WHERE bsl4_area_m2 IS NULL AND p4 <> 0
UNION ALL SELECT document_id, py, year, 'BSL-3 area', {_num('p3')}, {_num('bsl3_area_m2')}, CASE WHEN bsl3_area_m2 > p3 THEN 'up' ELSE 'down' END, CASE WHEN p3 > 0 THEN {_round(3)} END FROM q WHERE p3 <> bsl3_area_m2
UNION ALL SELECT document_id, py, year, 'MoD funded', CASE WHEN pm THEN 'Yes' ELSE 'No' END, CASE WHEN mod_funded THEN 'Yes' ELSE 'No' END, '', NULL FROM q WHERE pm <> mod_funded""")(lambda t: C.facility_diffs(t, ENTITY))
query("timeline_events", f"""
WITH p AS (SELECT *, lag(year) OVER w AS py, coalesce(lag(has_bsl4) OVER w, false) AS ph, coalesce(has_bsl4, false) AS h, lag(bsl4_area_m2) OVER w AS p4 FROM r_facility_years WINDOW w AS (PARTITION BY canonical_facility_id ORDER BY year, document_id, id)), q AS (SELECT * FROM p WHERE year - py <= 4)
SELECT canonical_facility_id, year, 'bsl4_up' AS event FROM q WHERE h AND NOT ph UNION ALL SELECT canonical_facility_id, year, 'bsl4_down' FROM q WHERE ph AND NOT h
UNION ALL SELECT canonical_facility_id, year, CASE WHEN bsl4_area_m2 > p4 THEN 'area_up' ELSE 'area_down' END FROM q WHERE p4 > 0 AND bsl4_area_m2 > 0 AND abs({_pct.format(n=4)}) >= 25""")(C.timeline_events)
query("year_ranges", """
WITH y AS (SELECT canonical_facility_id, unnest(years_declared) AS y FROM r_facilities), g AS (SELECT *, y - row_number() OVER (PARTITION BY canonical_facility_id ORDER BY y) AS g FROM y),
r AS (SELECT canonical_facility_id, min(y) AS a, max(y) AS b FROM g GROUP BY canonical_facility_id, g)
SELECT canonical_facility_id, string_agg(CASE WHEN b > a THEN concat(a, '–', b) ELSE CAST(a AS STRING) END, ', ' ORDER BY a) AS years FROM r GROUP BY 1""")(C.year_ranges)
query("gap_segments", """
WITH y AS (SELECT DISTINCT canonical_vaccine_facility_id, year FROM r_vaccine_facility_years), m AS (SELECT *, CASE WHEN year - lag(year) OVER w > 1 THEN 1 ELSE 0 END AS new FROM y WINDOW w AS (PARTITION BY canonical_vaccine_facility_id ORDER BY year)),
s AS (SELECT *, sum(new) OVER (PARTITION BY canonical_vaccine_facility_id ORDER BY year) AS segment FROM m)
SELECT canonical_vaccine_facility_id, CAST(segment AS BIGINT) AS segment, min(year) AS first_year, max(year) AS last_year FROM s GROUP BY 1, 2""")(lambda t: C.gap_segments(t.vaccine_facility_years, "canonical_vaccine_facility_id"))
