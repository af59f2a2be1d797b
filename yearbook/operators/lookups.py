"""Everything about one country or one entity, in fixed shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import year_span
from .latest import first_per_group, latest_value, with_country_name

CATEGORIES = ("prohibitions", "exports", "imports", "biosafety")
MEASURES = ("legislation", "regulations", "other_measures", "amended")
LEGISLATION = tuple(f"{c}_{m}" for c in CATEGORIES for m in MEASURES)


def _of(df: DataFrame, iso3: str) -> DataFrame:
    return df.where(F.col("country_iso3") == iso3)


def _sources(t) -> DataFrame:
    return t.documents.select(F.col("id").alias("document_id"), "source_url")


def country_compliance(t, iso3: str) -> DataFrame:
    """Status of each form by year, of unamended documents."""
    documents = _of(t.documents, iso3).where(~F.col("is_amendment")).select(F.col("id").alias("document_id"), "year")
    return t.form_compliance.join(documents, "document_id").select("document_id", "year", "form", "status").orderBy(F.desc("year"), "form", "document_id")


def compliance_grid(compliance: DataFrame, forms: tuple[str, ...] = ("A1", "A2", "B", "C", "E", "F", "G")) -> DataFrame:
    """A row a year, a column a form; absent where there is no status. Of several documents the last by id counts."""
    last = compliance.groupBy("year").pivot("form", list(forms)).agg(F.max_by("status", "document_id"))
    return last.select("year", *(F.coalesce(f, F.lit("absent")).alias(f.lower()) for f in forms)).orderBy("year")


def country_facilities(t, iso3: str) -> DataFrame:
    """Facilities with the source of their latest year's document."""
    sources = _of(t.facility_years, iso3).join(_sources(t), "document_id").groupBy("canonical_facility_id").agg(latest_value("source_url", "year", "document_id", "id").alias("latest_source_url"))
    cols = ("canonical_facility_id", "canonical_name", "latest_containment", "years_declared", "latest_area_m2", "latest_source_url")
    return _of(t.facilities, iso3).join(sources, "canonical_facility_id", "left").select(*cols).orderBy(F.col("canonical_name").asc_nulls_last(), "canonical_facility_id")


def country_defence_programmes(t, iso3: str) -> DataFrame:
    cols = ("year", "id", "programme_name", "responsible_org", "objectives_summary", "research_areas", "total_funding_amount", "total_funding_currency", "uses_contractors", "contractor_proportion_pct", "confidence")
    return _of(t.defence_programmes, iso3).select(*cols).orderBy(F.desc("year"), "id")


def country_defence_entities(t, iso3: str) -> DataFrame:
    """Defence entities, and whether any year declared an area of level 4 or 3; unknown if none says."""
    areas = t.defence_facilities.groupBy("canonical_defence_facility_id").agg(F.bool_or(F.col("bsl4_area_m2") > 0).alias("has_bsl4"), F.bool_or(F.col("bsl3_area_m2") > 0).alias("has_bsl3"))
    out = _of(t.defence_entities, iso3).join(areas, "canonical_defence_facility_id", "left")
    return out.select(F.col("canonical_defence_facility_id").alias("canonical_id"), "canonical_name", "first_year", "last_year", "has_bsl4", "has_bsl3").orderBy(F.col("canonical_name").asc_nulls_last(), "canonical_id")


def country_vaccine_entities(t, iso3: str) -> DataFrame:
    return _of(t.vaccine_facilities, iso3).select(F.col("id").alias("canonical_id"), "canonical_name", "first_year", "last_year").orderBy(F.col("canonical_name").asc_nulls_last(), "canonical_id")


def country_vaccine_records(t, iso3: str) -> DataFrame:
    cols = ("year", "id", "facility_name", "city", "address", "diseases_covered", "vaccines_summary", "confidence")
    return _of(t.vaccine_facility_years, iso3).select(*cols).orderBy(F.desc("year"), F.col("facility_name").asc_nulls_last(), "id")


def country_legislation(t, iso3: str) -> DataFrame:
    return _of(t.legislation, iso3).join(_sources(t), "document_id").select("year", *LEGISLATION, "key_laws", "notes", "confidence", "document_id", "source_url").orderBy(F.desc("year"), "document_id")


def legislation_rollup(legislation: DataFrame, most: int = 50, laws: int = 3) -> DataFrame:
    """Per document whether a category has any of its first three measures, and its first laws."""
    any_of = lambda c: F.coalesce(F.greatest(*(F.coalesce(F.col(f"{c}_{m}"), F.lit(False)) for m in MEASURES[:3])), F.lit(False)).alias(c)
    return legislation.orderBy(F.desc("year"), "document_id").limit(most).select("document_id", "year", *(any_of(c) for c in CATEGORIES), F.slice("key_laws", 1, laws).alias("key_laws"))


def country_past_programmes(t, iso3: str) -> DataFrame:
    cols = ("year", "convention_entry_date", "has_offensive_programme", "offensive_period", "offensive_summary", "has_defensive_programme", "defensive_period", "defensive_summary", "confidence", "notes", "document_id", "source_url")
    return _of(t.past_programmes, iso3).join(_sources(t), "document_id").select(*cols).orderBy(F.desc("year"), "document_id")


def entity(t, facility_id: str) -> DataFrame:
    header = t.facilities.where(F.col("canonical_facility_id") == facility_id)
    return with_country_name(header, t.documents).select("canonical_facility_id", "canonical_name", "country_iso3", "country_name", "all_names", "years_declared", "latest_containment", "latest_area_m2")


def entity_records(t, facility_id: str) -> DataFrame:
    cols = ("year", "id", "document_id", "facility_name", "responsible_org", "city", "address", "funding_sources", "has_bsl4", "bsl4_area_m2", "has_bsl3", "bsl3_area_m2", "highest_containment", "agents_summary", "agents_redacted", "confidence", "flagged_for_review", "flag_note", "source_url")
    return t.facility_years.where(F.col("canonical_facility_id") == facility_id).join(_sources(t), "document_id").select(*cols).orderBy(F.desc("year"), "document_id", "id")


def _distinct_names(column: str) -> Column:
    """Sorted distinct names; null, not empty, if there is none."""
    names = F.array_sort(F.collect_set(column))
    return F.when(F.size(names) > 0, names)


def entity_defence(t, entity_id: str) -> DataFrame:
    records = t.defence_facilities.where(F.col("canonical_defence_facility_id") == entity_id)
    header = records.groupBy(F.col("canonical_defence_facility_id").alias("id")).agg(
        latest_value("facility_name", "year", "document_id", "id").alias("latest_name"), F.min("country_iso3").alias("country_iso3"), _distinct_names("facility_name").alias("all_names"), F.min("year").alias("first_year"), F.max("year").alias("last_year")
    )
    return with_country_name(header, t.documents).select("id", F.col("latest_name").alias("canonical_name"), "country_iso3", "country_name", "all_names", "first_year", "last_year")


def entity_defence_records(t, entity_id: str) -> DataFrame:
    cols = [c for c in t.defence_facilities.columns if c != "canonical_defence_facility_id"]
    return t.defence_facilities.where(F.col("canonical_defence_facility_id") == entity_id).join(_sources(t), "document_id").select(*cols, "source_url").orderBy(F.desc("year"), "document_id", "id")


def entity_vaccine(t, entity_id: str) -> DataFrame:
    return with_country_name(t.vaccine_facilities.where(F.col("id") == entity_id), t.documents).select("id", "canonical_name", "country_iso3", "country_name", "first_year", "last_year")


def entity_vaccine_records(t, entity_id: str) -> DataFrame:
    cols = ("year", "id", "document_id", "facility_name", "city", "address", "diseases_covered", "vaccines_summary", "confidence", "source_url")
    return t.vaccine_facility_years.where(F.col("canonical_vaccine_facility_id") == entity_id).join(_sources(t), "document_id").select(*cols).orderBy(F.desc("year"), "document_id", "id")


def flagged(t) -> DataFrame:
    """Records marked for review."""
    records = t.facility_years.where("flagged_for_review").select("canonical_facility_id", "country_iso3", "year", "flag_note", "document_id", "id")
    names = t.facilities.select("canonical_facility_id", "canonical_name")
    return records.join(names, "canonical_facility_id").join(_sources(t), "document_id").select("canonical_facility_id", "canonical_name", "country_iso3", "year", "flag_note", "source_url").orderBy("country_iso3", F.desc("year"), "canonical_facility_id")


#: States that are not parties with public data.
MEMBERSHIP = {
    "restricted": ("CHN", "FRA", "RUS", "IND"),
    "signatory": ("EGY", "HTI", "SOM", "SYR"),
    "non_party": ("TCD", "COM", "DJI", "ERI", "ISR", "FSM", "NAM", "SSD", "TUV"),
}


def membership(spark) -> DataFrame:
    return spark.createDataFrame([(c, s) for s, codes in MEMBERSHIP.items() for c in codes], "country_iso3 string, status string")


def country_status(t, countries: DataFrame) -> DataFrame:
    """The status of each of countries: restricted, data, another membership, or none."""
    have = t.documents.groupBy("country_iso3").agg(F.count("*").alias("n"))
    known = membership(t.documents.sparkSession).withColumnRenamed("status", "member")
    status = F.when(F.col("member") == "restricted", "restricted").when(F.col("n") > 0, "data").otherwise(F.coalesce("member", F.lit("none")))
    return countries.select("country_iso3").distinct().join(have, "country_iso3", "left").join(known, "country_iso3", "left").select("country_iso3", status.alias("status"))


# --- maps --------------------------------------------------------------------


def map_facilities(t) -> DataFrame:
    """One located record a facility and year: of the document with the smallest id."""
    some = t.facility_years.where("lon is not null")
    one = first_per_group(some, ["canonical_facility_id", "year"], [F.col("document_id"), F.col("id")])
    named = one.join(t.facilities.select("canonical_facility_id", "canonical_name"), "canonical_facility_id", "left")
    cols = ("canonical_facility_id", F.coalesce("canonical_name", "facility_name").alias("name"), "country_iso3", F.col("highest_containment").alias("containment"), "year", "city", "geocode_confidence", "lon", "lat", "country_name", "agents_summary", "agents_redacted")
    return with_country_name(named, t.documents).select(*cols)


def map_defence(t) -> DataFrame:
    cols = ("id", F.col("facility_name").alias("name"), "country_iso3", "year", "city", "geocode_confidence", "lon", "lat", "country_name")
    return with_country_name(t.defence_facilities.where("lon is not null"), t.documents).select(*cols)


def map_vaccines(t) -> DataFrame:
    """One located record an entity and year; records without an entity are one group a year."""
    some = t.vaccine_facility_years.where("lon is not null")
    one = first_per_group(some, ["canonical_vaccine_facility_id", "year"], [F.col("document_id"), F.col("id")])
    names = t.vaccine_facilities.select(F.col("id").alias("canonical_vaccine_facility_id"), "canonical_name")
    named = one.join(names, "canonical_vaccine_facility_id", "left")
    cols = ("id", F.coalesce("canonical_name", "facility_name").alias("name"), "country_iso3", "year", "city", "geocode_confidence", "lon", "lat", "country_name")
    return with_country_name(named, t.documents).select(*cols)


def map_filter(features: DataFrame, year: int | None = None, lapsed: bool = False, hide_low: bool = False, bsl: tuple[str, ...] | None = None, ids: tuple[str, ...] | None = None) -> DataFrame:
    """Map records as the filters leave them.

    Without a year: each facility's latest record if lapsed ones are shown,
    else the records of its country's latest year."""
    from ..functions.exprs import bsl_class

    if year is not None:
        out = features.where(F.col("year") == year)
    else:
        key = "canonical_facility_id" if lapsed else "country_iso3"
        latest = features.groupBy(key).agg(F.max("year").alias("year"))
        out = features.join(latest, [key, "year"], "left_semi")
    if hide_low:
        out = out.where(F.coalesce(F.col("geocode_confidence") != "low", F.lit(True)))
    if bsl is not None:
        out = out.where(bsl_class(F.col("containment")).isin(*bsl))
    if ids is not None:
        out = out.where(F.col("canonical_facility_id").isin(*ids))
    return out


def geojson(features: DataFrame) -> DataFrame:
    """A feature's JSON a row: a point, and all other columns as properties."""
    properties = F.struct(*(c for c in features.columns if c not in ("lon", "lat")))
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return features.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))


def spans(t) -> DataFrame:
    """Vaccine entities with all years of their span."""
    return t.vaccine_facilities.select("id", year_span(F.col("first_year"), F.col("last_year")).alias("years"))
