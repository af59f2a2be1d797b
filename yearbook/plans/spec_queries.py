"""The handlers of classified questions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import spec as Q
from .fixed_queries import NAMES, joined, text
from .registry import query

C3 = ("XAC", "XAP", "XAU")
IN = "('XAC', 'XAP', 'XAU')"
_span = "CASE WHEN first_year <= last_year THEN generate_series(first_year, last_year) ELSE [] END"


def _ask(kind: str, **fields):
    spec = Q.QuerySpec(kind, **fields)
    return lambda t: Q.answer(t, spec)


def _with_text(f, column: str):
    return lambda t: f(t).withColumn(column, text(column))


query("nq_facility_search", f"""
WITH {NAMES}, every AS (
(SELECT canonical_facility_id AS id, canonical_name AS name, country_iso3, latest_containment, {joined('years_declared')} AS years_declared, 'A1' AS layer FROM r_facilities f WHERE country_iso3 IN {IN}
  AND (canonical_name ILIKE '%ring%' OR EXISTS (FROM r_facility_years y WHERE y.canonical_facility_id = f.canonical_facility_id AND agents_summary ILIKE '%ring%'))
  AND EXISTS (FROM r_facility_years y WHERE y.canonical_facility_id = f.canonical_facility_id AND highest_containment ILIKE '%BSL-3%') ORDER BY name NULLS LAST, id LIMIT 50)
UNION ALL (SELECT id, canonical_name, country_iso3, NULL, {joined(_span)}, 'G' FROM r_vaccine_facilities WHERE country_iso3 IN {IN} AND canonical_name ILIKE '%ring%' ORDER BY canonical_name NULLS LAST, id LIMIT 20)
UNION ALL (SELECT canonical_defence_facility_id, canonical_name, country_iso3, NULL, {joined(_span)}, 'A2' FROM r_defence_entities WHERE country_iso3 IN {IN} AND canonical_name ILIKE '%ring%' ORDER BY canonical_name NULLS LAST, canonical_defence_facility_id LIMIT 20))
SELECT id, name, country_iso3, latest_containment, years_declared, layer, country_name FROM every LEFT JOIN names USING (country_iso3)""")(_with_text(_ask("facility_search", countries=C3, organisms=("ring",), bsl=("BSL-3",)), "years_declared"))
query("nq_submission_history", f"SELECT country_iso3, year, form, status FROM r_form_compliance JOIN r_documents d ON d.id = document_id WHERE country_iso3 IN {IN} AND form IN ('A1', 'E') AND year BETWEEN 1996 AND 1999 ORDER BY country_iso3, year, form, document_id LIMIT 200")(
    _ask("submission_history", countries=C3, forms=("A1", "E"), year_min=1996, year_max=1999)
)
query("nq_country_overview", "SELECT form, count(*) AS total, count(*) FILTER (WHERE status = 'substantive') AS substantive FROM r_form_compliance JOIN r_documents d ON d.id = document_id WHERE country_iso3 = 'XAC' GROUP BY form")(_ask("country_overview", countries=("XAC",)))
query("nq_country_counts", """SELECT (SELECT count(*) FROM r_facilities WHERE country_iso3 = 'XAP') AS a1_facilities, (SELECT count(*) FROM r_vaccine_facilities WHERE country_iso3 = 'XAP') AS vaccine_facilities,
  (SELECT count(*) FROM r_defence_entities WHERE country_iso3 = 'XAP') AS defence_facilities, (SELECT max(year) FROM r_legislation WHERE country_iso3 = 'XAP') AS latest_legislation""")(lambda t: Q.country_counts(t, Q.QuerySpec("country_overview", ("XAP",))))
query("nq_comparative_bsl", f"""WITH {NAMES} SELECT f.country_iso3, any_value(country_name) AS country_name, count(DISTINCT f.canonical_facility_id) AS count, CAST(sum(bsl4_area_m2) AS DOUBLE) AS area_m2
FROM r_facilities f LEFT JOIN names USING (country_iso3) LEFT JOIN r_facility_years y ON y.canonical_facility_id = f.canonical_facility_id WHERE highest_containment ILIKE '%BSL-4%' OR highest_containment ILIKE '%BSL-3%' GROUP BY 1 ORDER BY area_m2 DESC NULLS LAST, 1 LIMIT 10""")(
    _ask("comparative", bsl=("BSL-4", "BSL-3"))
)
query("nq_comparative_forms", f"WITH {NAMES} SELECT d.country_iso3, any_value(names.country_name) AS country_name, count(*) AS count FROM r_form_compliance JOIN r_documents d ON d.id = document_id LEFT JOIN names ON names.country_iso3 = d.country_iso3 WHERE form IN ('A1', 'G') AND status = 'substantive' GROUP BY 1 ORDER BY count DESC, 1 LIMIT 10")(
    _ask("comparative", forms=("A1", "G"))
)
query("nq_comparative", f"WITH {NAMES} SELECT country_iso3, any_value(country_name) AS country_name, count(*) AS count FROM r_facilities LEFT JOIN names USING (country_iso3) GROUP BY 1 ORDER BY count DESC, 1 LIMIT 10")(_ask("comparative"))
_three = lambda c: [f"{c}_{m}" for m in Q.MEASURES]
query("nq_legislation", f"""SELECT DISTINCT ON (l.country_iso3) l.country_iso3, country_name, l.year, {', '.join(_three('exports'))}, {joined('key_laws')} AS key_laws FROM r_legislation l JOIN r_documents d ON d.id = document_id
WHERE {' OR '.join(_three('exports'))} ORDER BY l.country_iso3, l.year DESC, document_id""")(_with_text(_ask("legislation", legislation_category="exports"), "key_laws"))
query("nq_legislation_years", f"""SELECT l.country_iso3, country_name, l.year, {', '.join(x for c in Q.CATEGORIES for x in _three(c))}, {joined('key_laws')} AS key_laws FROM r_legislation l JOIN r_documents d ON d.id = document_id
WHERE l.country_iso3 IN {IN} AND l.year BETWEEN 1997 AND 1998 ORDER BY l.country_iso3, l.year DESC, document_id LIMIT 200""")(_with_text(_ask("legislation", countries=C3, year_min=1997, year_max=1998), "key_laws"))
PAST = "p.country_iso3, country_name, p.year, has_offensive_programme, offensive_period, offensive_summary, has_defensive_programme, defensive_period, defensive_summary"
query("nq_defence_programmes", f"""
(SELECT {PAST}, 'past_programme' AS source, NULL AS programme_name, NULL AS responsible_org, NULL AS objectives_summary, NULL::DECIMAL(15,2) AS total_funding_amount, NULL AS total_funding_currency, NULL::BOOLEAN AS uses_contractors
  FROM r_past_programmes p JOIN r_documents d ON d.id = document_id WHERE p.country_iso3 IN {IN} ORDER BY p.country_iso3, p.year DESC, document_id LIMIT 100)
UNION ALL (SELECT p.country_iso3, country_name, p.year, NULL, NULL, NULL, NULL, NULL, NULL, 'defence_programme', programme_name, responsible_org, objectives_summary, total_funding_amount, total_funding_currency, uses_contractors
  FROM r_defence_programmes p JOIN r_documents d ON d.id = document_id WHERE p.country_iso3 IN {IN} ORDER BY p.country_iso3, p.year DESC, document_id, p.id LIMIT 100)""")(_ask("defence_programmes", countries=C3))
query("nq_defence_offensive", f"SELECT {PAST}, 'past_programme' AS source FROM r_past_programmes p JOIN r_documents d ON d.id = document_id WHERE has_offensive_programme AND p.year >= 1999 ORDER BY p.country_iso3, p.year DESC, document_id LIMIT 100")(
    _ask("defence_programmes", keywords=("Offensive",), year_min=1999)
)
query("nq_aggregate_bsl", f"""WITH {NAMES} SELECT f.country_iso3, any_value(country_name) AS country_name, count(DISTINCT f.canonical_facility_id) AS facility_count, CAST(sum(bsl3_area_m2) AS DOUBLE) AS total_area_m2 FROM r_facilities f LEFT JOIN names USING (country_iso3)
LEFT JOIN r_facility_years y ON y.canonical_facility_id = f.canonical_facility_id WHERE latest_containment ILIKE '%BSL-3%' GROUP BY 1 ORDER BY total_area_m2 DESC NULLS LAST, 1 LIMIT 15""")(_ask("aggregate_stats", bsl=("BSL-3",)))
query("nq_aggregate_forms", "SELECT 'countries submitting A1, B' AS metric, count(DISTINCT country_iso3) AS value FROM r_form_compliance JOIN r_documents d ON d.id = document_id WHERE form IN ('A1', 'B') AND status = 'substantive' AND year >= 2000")(_ask("aggregate_stats", forms=("A1", "B"), year_min=2000))
query("nq_aggregate_countries", f"""SELECT 'research facilities (A1)' AS metric, count(*) AS value FROM r_facilities WHERE country_iso3 IN {IN} UNION ALL SELECT 'vaccine facilities (G)', count(*) FROM r_vaccine_facilities WHERE country_iso3 IN {IN}
UNION ALL SELECT 'defence facilities (A2)', count(*) FROM r_defence_entities WHERE country_iso3 IN {IN} UNION ALL SELECT 'total submissions', count(*) FROM r_documents WHERE country_iso3 IN {IN} AND NOT is_amendment""")(_ask("aggregate_stats", countries=C3))
query("nq_aggregate_all", "SELECT 'countries' AS metric, count(DISTINCT country_iso3) AS value FROM r_documents UNION ALL SELECT 'submissions', count(*) FROM r_documents WHERE NOT is_amendment UNION ALL SELECT 'facilities', count(*) FROM r_facilities")(_ask("aggregate_stats"))
query("nq_missing_countries", f"WITH {NAMES} SELECT c AS country_iso3, coalesce(country_name, c) AS name FROM (SELECT unnest(['XAC', 'XZZ']) AS c) LEFT JOIN names ON names.country_iso3 = c WHERE c NOT IN (SELECT country_iso3 FROM r_documents WHERE country_iso3 <> 'XAC')")(
    lambda t: Q.missing_countries(t, Q.QuerySpec("comparative", ("XAC", "XZZ")), t.documents.where(F.col("country_iso3") != "XAC"))
)
