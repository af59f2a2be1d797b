"""Entity resolution, corrections and compliance, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import compliance as K
from ..operators import mutate as M
from ..operators.latest import first_per_group, primary_documents
from ..operators.resolve import resolve_entities
from .fixed_queries import joined, text
from .registry import query

ALL = "list_sort(list(DISTINCT {c}) FILTER (WHERE {c} IS NOT NULL))"


def _records(t):
    """Parts as records: brands are countries, years make some names the same year's."""
    p = t._table("part") if hasattr(t, "_table") else t.part
    name = F.when(F.col("p_partkey") % 29 != 0, F.concat_ws(" ", F.when(F.col("p_partkey") % 3 == 0, F.lit("National")), F.col("p_name"), F.col("p_type"), F.when(F.col("p_partkey") % 5 == 0, F.lit("Centre"))))
    return p.select(F.col("p_partkey").alias("place"), F.col("p_brand").alias("country_iso3"), name.alias("name"), F.when(F.col("p_size") > 5, F.col("p_size") + 1990).alias("year"))


query("resolve_entities")(lambda t: resolve_entities(_records(t), "A1", (("Brand#2", "widget"),)))

LAST = "SELECT DISTINCT ON (canonical_facility_id) canonical_facility_id, country_iso3, highest_containment, CASE WHEN bsl4_area_m2 <> 0 THEN bsl4_area_m2 ELSE bsl3_area_m2 END AS area FROM r_facility_years ORDER BY canonical_facility_id, year DESC, document_id DESC, id DESC"
query("entity_registry", f"""
WITH seen AS (SELECT DISTINCT ON (canonical_facility_id, facility_name) canonical_facility_id, facility_name, year, document_id, id FROM r_facility_years WHERE facility_name <> '' ORDER BY canonical_facility_id, facility_name, year, document_id, id),
names AS (SELECT canonical_facility_id, list(facility_name ORDER BY year, document_id, id) AS all_names FROM seen GROUP BY 1), last AS ({LAST})
SELECT f.canonical_facility_id, any_value(l.country_iso3) AS country_iso3, any_value(n.all_names[-1]) AS canonical_name, any_value({joined('n.all_names')}) AS all_names, {joined(f"list_transform({ALL.format(c='year')}, lambda y: CAST(y AS STRING))")} AS years_declared,
  any_value(highest_containment_last) AS latest_containment, any_value(l.area) AS latest_area_m2, bool_or(coalesce(bsl4_area_m2 > 0, false)) AS has_area
FROM r_facility_years f JOIN (SELECT *, highest_containment AS highest_containment_last FROM last) l USING (canonical_facility_id) JOIN names n USING (canonical_facility_id) GROUP BY 1""")(
    lambda t: M.registry(t.facility_years).withColumns({"all_names": text("all_names"), "years_declared": text("years_declared")})
)
query("defence_entities", f"""SELECT canonical_defence_facility_id, max(country_iso3) AS country_iso3, first(facility_name ORDER BY year DESC, document_id DESC, id DESC) AS canonical_name, min(year) AS first_year, max(year) AS last_year,
  coalesce({joined(ALL.format(c='facility_name'))}, '') AS all_names FROM r_defence_facilities WHERE canonical_defence_facility_id IS NOT NULL GROUP BY 1""")(lambda t: M.defence_entities(t.defence_facilities).withColumn("all_names", text("all_names")))
query("primary_documents", """SELECT id, row_number() OVER (PARTITION BY country_iso3, year ORDER BY CASE WHEN language = 'en' THEN 0 ELSE 1 END, id) = 1 AS is_primary FROM r_documents WHERE NOT is_amendment""")(
    lambda t: primary_documents(t.documents.withColumn("downloaded", F.lit(True))).select("id", "is_primary")
)

_new = lambda t: t.documents.where("year >= 2000").withColumns({"country_name": F.concat(F.coalesce("country_name", F.lit("?")), F.lit(" new")), "language": F.lit("xx")})
query("upsert_documents", """SELECT id, CASE WHEN year >= 2000 THEN concat(coalesce(country_name, '?'), ' new') ELSE country_name END AS country_name, CASE WHEN year >= 2001 THEN 'xx' ELSE language END AS language FROM r_documents""")(
    lambda t: M.upsert(t.documents.where("year < 2001"), _new(t), "id", ("country_name",)).select("id", "country_name", "language")
)


def _groups(t):
    """Facilities whose number ends in 1 go into a given one, there or not; one group has a keeper to look for, and none is."""
    ids = t.facilities.select("canonical_facility_id")
    return ids.where("canonical_facility_id like '%1'").select(F.col("canonical_facility_id").alias("old"), F.lit("XAP_000").alias("keeper"), F.lit("Merged").alias("name"), F.lit(True).alias("given")).union(t.spark.createDataFrame([("XAU_002", "none", "x", False)], "old string, keeper string, name string, given boolean"))


query("merge_dimension", f"""
WITH m AS (SELECT canonical_facility_id AS old FROM r_facilities WHERE canonical_facility_id LIKE '%1'), f AS (SELECT CASE WHEN canonical_facility_id IN (FROM m) THEN 'XAP_000' ELSE canonical_facility_id END AS k, year FROM r_facility_years),
n AS (SELECT CASE WHEN canonical_facility_id IN (FROM m) THEN 'XAP_000' ELSE canonical_facility_id END AS k, unnest(all_names) AS n FROM r_facilities)
SELECT canonical_facility_id, CASE WHEN canonical_facility_id = 'XAP_000' THEN 'Merged' ELSE canonical_name END AS canonical_name, {joined("(SELECT list_sort(list(DISTINCT n)) FROM n WHERE k = canonical_facility_id)")} AS all_names,
  {joined("(SELECT list_transform(list_sort(list(DISTINCT year)), lambda y: CAST(y AS STRING)) FROM f WHERE k = canonical_facility_id)")} AS years_declared, latest_containment, latest_area_m2
FROM r_facilities WHERE canonical_facility_id NOT IN (FROM m)""")(
    lambda t: M.merge(t.facilities, t.facility_years, _groups(t))[0].select("canonical_facility_id", "canonical_name", text("all_names"), text("years_declared"), "latest_containment", "latest_area_m2")
)
query("merge_facts", "SELECT id, CASE WHEN canonical_facility_id LIKE '%1' THEN 'XAP_000' ELSE canonical_facility_id END AS canonical_facility_id FROM r_facility_years")(lambda t: M.merge(t.facilities, t.facility_years, _groups(t))[1].select("id", "canonical_facility_id"))
query("merge_plan", "SELECT canonical_facility_id AS old, 'XAP_000' AS keeper, 'merge' AS action FROM r_facilities WHERE canonical_facility_id LIKE '%1' UNION ALL SELECT 'XAU_002', 'none', 'skip: no keeper'")(lambda t: M.merge_plan(t.facilities, _groups(t)))
_split = lambda t: M.split(t.facilities, t.facility_years, "XAP_000", "XAP_900", "Annex", F.col("facility_name").contains("Annex"), given=True)
query("split_dimension", f"""
WITH f AS (SELECT CASE WHEN canonical_facility_id = 'XAP_000' AND facility_name LIKE '%Annex%' THEN 'XAP_900' ELSE canonical_facility_id END AS k, year FROM r_facility_years),
d AS (SELECT canonical_facility_id, canonical_name, all_names FROM r_facilities UNION ALL SELECT 'XAP_900', 'Annex', ['Annex'])
SELECT canonical_facility_id, canonical_name, {joined('all_names')} AS all_names, {joined("(SELECT list_transform(list_sort(list(DISTINCT year)), lambda y: CAST(y AS STRING)) FROM f WHERE k = canonical_facility_id)")} AS years_declared FROM d""")(
    lambda t: _split(t)[0].select("canonical_facility_id", "canonical_name", text("all_names"), text("years_declared"))
)
query("split_facts", "SELECT id, CASE WHEN canonical_facility_id = 'XAP_000' AND facility_name LIKE '%Annex%' THEN 'XAP_900' ELSE canonical_facility_id END AS canonical_facility_id FROM r_facility_years")(lambda t: _split(t)[1].select("id", "canonical_facility_id"))


def _fixes():
    return [
        M.Fix("014 city", F.col("city").isNull() & F.col("address").like("%1 Main%"), {"city": F.lit("Main")}),
        M.Fix("015 area", F.col("bsl4_area_m2").between(20000, 30000) & ~F.col("has_bsl4"), {"bsl4_area_m2": F.lit(None)}),
        M.Fix("016 level", (F.col("highest_containment") == "BSL-4") & F.col("bsl4_area_m2").isNull(), {"highest_containment": F.lit("BSL-3"), "has_bsl4": F.lit(False)}),
        M.Fix("013 done", F.lit(True), {"city": F.lit("never")}),
    ]


query("apply_fixes", """
WITH a AS (SELECT id, CASE WHEN city IS NULL AND address LIKE '%1 Main%' THEN 'Main' ELSE city END AS city, CASE WHEN bsl4_area_m2 BETWEEN 20000 AND 30000 AND NOT has_bsl4 THEN NULL ELSE bsl4_area_m2 END AS bsl4_area_m2, highest_containment, has_bsl4 FROM r_facility_years)
SELECT id, city, bsl4_area_m2, CASE WHEN highest_containment = 'BSL-4' AND bsl4_area_m2 IS NULL THEN 'BSL-3' ELSE highest_containment END AS highest_containment, CASE WHEN highest_containment = 'BSL-4' AND bsl4_area_m2 IS NULL THEN false ELSE has_bsl4 END AS has_bsl4 FROM a""")(
    lambda t: M.apply_fixes(t.facility_years, _fixes(), done=("013 done",)).select("id", "city", "bsl4_area_m2", "highest_containment", "has_bsl4")
)
query("delete_orphans", "SELECT canonical_facility_id FROM r_facilities f WHERE EXISTS (FROM r_facility_years y WHERE y.canonical_facility_id = f.canonical_facility_id AND year > 2000)")(
    lambda t: M.delete_orphans(t.facilities, t.facility_years.where("year > 2000")).select("canonical_facility_id")
)
query("flag_overlay", """SELECT id, CASE WHEN canonical_facility_id = 'XAP_000' AND year = 1998 THEN true WHEN canonical_facility_id = 'XAP_000' AND year = 1999 THEN false ELSE flagged_for_review END AS flagged_for_review,
  CASE WHEN canonical_facility_id = 'XAP_000' AND year = 1998 THEN 'check' WHEN canonical_facility_id = 'XAP_000' AND year = 1999 THEN NULL ELSE flag_note END AS flag_note FROM r_facility_years""")(
    lambda t: M.flag(t.facility_years, t.spark.createDataFrame([("XAP_000", 1998, True, "check"), ("XAP_000", 1999, False, "gone")], "canonical_facility_id string, year int, flag boolean, note string")).select("id", "flagged_for_review", "flag_note")
)
_bare = lambda t: t.defence_facilities.withColumns({"lon": F.when(F.col("year") > 1998, F.col("lon")), "lat": F.when(F.col("year") > 1998, F.col("lat")), "geocode_confidence": F.when(F.col("year") > 1998, F.col("geocode_confidence"))})
KEYS = ("document_id", "facility_name")
query("restore_positions", """
WITH k AS (SELECT document_id, facility_name, min({lon: lon, lat: lat, c: geocode_confidence}) AS pos FROM r_defence_facilities WHERE lon IS NOT NULL GROUP BY 1, 2)
SELECT id, coalesce(CASE WHEN year > 1998 THEN lon END, pos.lon) AS lon, coalesce(CASE WHEN year > 1998 THEN lat END, pos.lat) AS lat FROM r_defence_facilities LEFT JOIN k USING (document_id, facility_name)""")(lambda t: M.restore_positions(_bare(t), t.defence_facilities, KEYS).select("id", "lon", "lat"))
query("unmatched_positions", "SELECT DISTINCT document_id, facility_name FROM r_defence_facilities d WHERE lon IS NOT NULL AND NOT EXISTS (FROM r_defence_facilities x WHERE x.year > 1998 AND x.document_id = d.document_id AND x.facility_name = d.facility_name)")(
    lambda t: M.unmatched_positions(t.defence_facilities.where("year > 1998"), t.defence_facilities, KEYS)
)
query("violations", """
SELECT 'confidence' AS rule, CAST(id AS STRING) AS key FROM r_facility_years WHERE NOT confidence BETWEEN 0 AND 0.8 UNION ALL SELECT 'area', CAST(id AS STRING) FROM r_facility_years WHERE NOT bsl4_area_m2 < 90000
UNION ALL SELECT 'document_id has a parent', CAST(id AS STRING) FROM r_facility_years WHERE document_id NOT IN (SELECT id FROM r_documents WHERE NOT is_amendment)""")(
    lambda t: M.violations(t.facility_years, {"confidence": F.col("confidence").between(0, 0.8), "area": F.col("bsl4_area_m2") < 90000}, {"document_id": (t.documents.where("not is_amendment"), "id")})
)
query("geocode", """
WITH g AS (SELECT DISTINCT city AS query, 1.5 AS lon, 2.5 AS lat, CASE WHEN city LIKE '%1%' THEN 0.7 WHEN city LIKE '%2%' THEN 0.4 ELSE 0.1 END AS importance FROM r_facility_years WHERE city IS NOT NULL)
SELECT id, coalesce(f.lon, CAST(g.lon AS DOUBLE)) AS lon, CASE WHEN f.lon IS NULL AND g.query IS NOT NULL THEN CASE WHEN importance >= 0.6 THEN 'high' WHEN importance >= 0.3 THEN 'medium' ELSE 'low' END ELSE geocode_confidence END AS geocode_confidence
FROM r_facility_years f LEFT JOIN g ON g.query = f.city""")(
    lambda t: M.geocode(t.facility_years, t.facility_years.where("city is not null").select(F.col("city").alias("query"), F.lit(1.5).alias("lon"), F.lit(2.5).alias("lat"), F.when(F.col("city").contains("1"), 0.7).when(F.col("city").contains("2"), 0.4).otherwise(0.1).alias("importance")).distinct(), F.array(F.concat(F.lit("?"), "address"), "city")).select("id", "lon", "geocode_confidence")
)


def _manifests(t):
    c = t.form_compliance
    return c.groupBy(F.col("document_id").alias("id")).agg(F.collect_set(F.when(F.col("status") != "absent", F.col("form"))).alias("forms_present"), F.collect_set(F.when(F.col("status") == "nothing_to_declare", F.col("form"))).alias("forms_nothing_to_declare"))


def _matrix(t):
    counts = t.facility_years.groupBy(F.col("document_id").alias("id")).agg(F.count_if(F.col("year") > 1996).alias("facility_count"))
    return K.compliance_matrix(t.documents.withColumn("downloaded", F.col("language") != "fr"), _manifests(t), counts)


_cell = lambda f: f"CASE coalesce(max(c.status) FILTER (WHERE c.form = '{f}'), 'absent') WHEN 'absent' THEN 'absent' WHEN 'nothing_to_declare' THEN 'nothing_to_declare' ELSE {'CASE WHEN any_value(n.n) = 0 THEN $$limited$$ ELSE $$substantive$$ END' if f == 'A1' else '$$substantive$$'} END AS form_{f.lower()}"
MATRIX = f"""SELECT any_value(country_iso3) AS country_iso3, any_value(d.year) AS year, d.id AS source_document, {', '.join(_cell(f) for f in K.FORMS)}
FROM r_documents d JOIN r_form_compliance c ON c.document_id = d.id LEFT JOIN (SELECT document_id, count(*) FILTER (WHERE year > 1996) AS n FROM r_facility_years GROUP BY 1) n ON n.document_id = d.id WHERE NOT is_amendment AND language <> 'fr' GROUP BY d.id"""
_count = lambda *kinds: " + ".join(f"CAST(form_{f.lower()} IN ({', '.join(repr(k) for k in kinds)}) AS INT)" for f in K.FORMS)
query("compliance_matrix", f"WITH m AS ({MATRIX}) SELECT *, {_count('substantive')} AS forms_substantive_count, {_count('nothing_to_declare', 'limited')} AS forms_ntd_count, {_count('absent')} AS forms_absent_count FROM m")(_matrix)
query("form_compliance", f"WITH m AS ({MATRIX}) " + " UNION ALL ".join(f"SELECT country_iso3, year, source_document, '{f}' AS form, form_{f.lower()} AS status FROM m" for f in K.FORMS))(lambda t: K.form_compliance(_matrix(t)))


def _nested_laws(t):
    return t.legislation.select(F.col("document_id").alias("id"), "country_iso3", "year", F.struct(*(F.struct(*(F.col(f"{c}_{m}").alias(m) for m in K.MEASURES)).alias(c) for c in K.CATEGORIES)).alias("categories"), F.when(F.col("year") > 1997, F.col("key_laws")).alias("key_laws"), "confidence", "notes")


query("flatten_legislation", f"SELECT document_id, country_iso3, year, {', '.join(f'{c}_{m}' for c in K.CATEGORIES for m in K.MEASURES)}, CASE WHEN year > 1997 THEN {joined('key_laws')} ELSE '' END AS key_laws, confidence, notes FROM r_legislation")(
    lambda t: K.flatten_legislation(_nested_laws(t)).withColumn("key_laws", text("key_laws"))
)
query("differing_fields", """SELECT document_id AS id, 'notes' AS field, notes AS "full", NULL AS other FROM r_legislation WHERE notes IS NOT NULL UNION ALL SELECT document_id, 'year', CAST(year AS STRING), CAST(year + 1 AS STRING) FROM r_legislation WHERE year = 1999""")(
    lambda t: K.differing_fields(t.legislation.select(F.col("document_id").alias("id"), "year", "notes"), t.legislation.select(F.col("document_id").alias("id"), F.when(F.col("year") == 1999, F.col("year") + 1).otherwise(F.col("year")).alias("year"), F.lit(None).cast("string").alias("notes")))
)
query("sequential_ids", """WITH d AS (SELECT id, country_iso3, year, row_number() OVER (PARTITION BY country_iso3, year ORDER BY id) AS n FROM r_documents) SELECT id, concat(country_iso3, '_', CAST(year AS STRING), CASE WHEN n > 1 THEN concat('_', CAST(n AS STRING)) ELSE '' END) AS new_id FROM d""")(
    lambda t: _ids(t)
)


def _ids(t):
    from ..sources.catalogue import with_ids

    return with_ids(t.documents.select(F.col("id").alias("old"), "country_iso3", "year"), "old").select(F.col("old").alias("id"), F.col("id").alias("new_id"))


query("first_record", "SELECT DISTINCT ON (canonical_vaccine_facility_id, year) id FROM r_vaccine_facility_years ORDER BY canonical_vaccine_facility_id, year, document_id, id")(
    lambda t: first_per_group(t.vaccine_facility_years, ["canonical_vaccine_facility_id", "year"], [F.col("document_id"), F.col("id")]).select("id")
)
query("bsl_classes", "SELECT id, CASE WHEN highest_containment LIKE '%4%' THEN 'BSL-4' WHEN highest_containment LIKE '%3%' THEN 'BSL-3' WHEN highest_containment LIKE '%2%' THEN 'BSL-2' WHEN highest_containment LIKE '%1%' THEN 'BSL-1' ELSE 'unknown' END AS level FROM r_facility_years")(
    lambda t: t.facility_years.select("id", X.bsl_class(F.col("highest_containment")).alias("level"))
)
