"""Status of forms, from what was found in documents; nested records made flat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import join_list
from .summaries import FORMS

CATEGORIES = ("prohibitions", "exports", "imports", "biosafety")
MEASURES = ("legislation", "regulations", "other_measures", "amended")


def compliance_matrix(catalogue: DataFrame, manifests: DataFrame, facility_counts: DataFrame) -> DataFrame:
    """A row a document with the status of each form, and how many are what.

    Only downloaded, unamended documents of the catalogue. A form not present
    is absent; one marked so has nothing to declare; a first form with a count
    of 0 facilities is limited, which counts with nothing to declare; all else
    is substantive."""
    documents = catalogue.where("downloaded and not coalesce(is_amendment, false)").select("id", "country_iso3", "year")
    joined = manifests.join(documents, "id").join(facility_counts.select("id", "facility_count"), "id", "left")
    inside = lambda column, form: F.coalesce(F.array_contains(column, form), F.lit(False))

    def status(form: str) -> Column:
        out = F.when(~inside("forms_present", form), "absent").when(inside("forms_nothing_to_declare", form), "nothing_to_declare")
        if form == "A1":
            out = out.when(F.col("facility_count") == 0, "limited")
        return out.otherwise("substantive")

    wide = joined.select("country_iso3", "year", F.col("id").alias("source_document"), *(status(f).alias(f"form_{f.lower()}") for f in FORMS))

    def count(*kinds: str) -> Column:
        return sum((F.col(f"form_{f.lower()}").isin(*kinds).cast("int") for f in FORMS), F.lit(0))

    return wide.withColumns({"forms_substantive_count": count("substantive"), "forms_ntd_count": count("nothing_to_declare", "limited"), "forms_absent_count": count("absent")}).orderBy("country_iso3", "year", "source_document")


def form_compliance(matrix: DataFrame) -> DataFrame:
    """The matrix as a row a document and form."""
    cells = F.array(*(F.struct(F.lit(f).alias("form"), F.col(f"form_{f.lower()}").alias("status")) for f in FORMS))
    return matrix.select("country_iso3", "year", "source_document", F.inline(cells))


def flatten_legislation(records: DataFrame) -> DataFrame:
    """categories<category: <measure: boolean>> as a column for each category and measure."""
    cells = [F.col(f"categories.{c}.{m}").alias(f"{c}_{m}") for c in CATEGORIES for m in MEASURES]
    return records.select(F.col("id").alias("document_id"), "country_iso3", "year", *cells, F.coalesce("key_laws", F.array().cast("array<string>")).alias("key_laws"), "confidence", "notes")


def flatten_facilities(records: DataFrame) -> DataFrame:
    """Nested records of the first form, a row a facility, in their order; places count from 0."""
    one = records.select(F.col("id").alias("document_id"), F.posexplode("facilities").alias("place", "f"))
    language = F.col("f.extraction_metadata.language")
    return one.select(
        "document_id", "place", F.col("f.extraction_metadata.country_iso3").alias("country_iso3"), F.col("f.extraction_metadata.year").alias("year"), F.col("f.facility_name").alias("facility_name"), F.col("f.responsible_organisation").alias("responsible_org"),
        F.col("f.location.city").alias("city"), F.coalesce("f.location.address", "f.location.full_text").alias("address"), F.array_join("f.funding.sources", "; ").alias("funding_sources"), F.col("f.funding.mod_funded").alias("mod_funded"),
        F.col("f.containment.has_bsl4").alias("has_bsl4"), F.col("f.containment.bsl4_area_m2").cast("decimal(10,2)").alias("bsl4_area_m2"), F.col("f.containment.has_bsl3").alias("has_bsl3"), F.col("f.containment.bsl3_area_m2").cast("decimal(10,2)").alias("bsl3_area_m2"),
        F.col("f.containment.highest_containment").alias("highest_containment"), F.coalesce(F.nullif(F.array_join("f.agents.listed", "; "), F.lit("")), F.col("f.agents.raw_text")).alias("agents_summary"), F.col("f.agents.redacted").alias("agents_redacted"),
        F.col("f.confidence").cast("decimal(4,3)").alias("confidence"), F.coalesce(F.col("f.translated"), F.when(language.isNotNull(), language != "en")).alias("translated"),
    )


def _each(records: DataFrame, column: str) -> DataFrame:
    """A row for each of the nested records f, with its place from 0, and what its metadata say."""
    meta = "f.extraction_metadata"
    rows = records.select(F.col("id").alias("document_id"), F.posexplode(column).alias("place", "f"))
    return rows.select("document_id", "place", F.col(f"{meta}.country_iso3").alias("country_iso3"), F.col(f"{meta}.year").alias("year"), F.col(f"{meta}.language").alias("language"), "f")


def _fields(*names: str, kind: str = "") -> list[Column]:
    return [(F.col(f"f.{n}").cast(kind) if kind else F.col(f"f.{n}")).alias(n) for n in names]


def _confidence() -> Column:
    return F.col("f.confidence").cast("decimal(4,3)").alias("confidence")


_KEYS = ("document_id", "place", "country_iso3", "year")


def flatten_vaccines(records: DataFrame, column: str = "facilities") -> DataFrame:
    """Nested vaccine facilities, a row each; a record that does not say whether it is translated is so unless in English."""
    place = [F.col("f.location.city").alias("city"), F.col("f.location.address").alias("address")]
    translated = F.coalesce(F.col("f.translated"), F.coalesce("language", F.lit("en")) != "en").alias("translated")
    return _each(records, column).select(*_KEYS, *_fields("facility_name"), *place, *_fields("diseases_covered"), join_list(F.col("f.vaccines")).alias("vaccines_summary"), _confidence(), translated)


def flatten_defence_programmes(records: DataFrame, column: str = "programmes") -> DataFrame:
    """Nested defence programmes, a row each; research areas become one text."""
    return _each(records, column).select(
        *_KEYS, *_fields("programme_name", "responsible_org", "objectives_summary"), join_list(F.col("f.research_areas")).alias("research_areas"), *_fields("total_funding_amount", kind="decimal(15,2)"),
        *_fields("total_funding_currency", "uses_contractors"), *_fields("contractor_proportion_pct", kind="decimal(5,2)"), _confidence(), *_fields("translated"),
    )


def flatten_defence_facilities(records: DataFrame, column: str = "facilities") -> DataFrame:
    """Nested defence facilities, a row each."""
    return _each(records, column).select(
        *_KEYS, *_fields("facility_name"), F.col("f.location.city").alias("city"), F.col("f.location.address").alias("address"),
        *_fields("bsl2_area_m2", "bsl3_area_m2", "bsl4_area_m2", "total_lab_area_m2", kind="decimal(10,2)"),
        *_fields("personnel_total", "personnel_military", "personnel_civilian", "personnel_scientists", "personnel_engineers", "personnel_technicians", "personnel_admin", kind="int"),
        *_fields("mod_funded", "funding_source"), *_fields("funding_research", "funding_development", "funding_te", kind="decimal(15,2)"), *_fields("funding_currency", "work_description"), _confidence(), *_fields("translated"),
    )


def flatten_past_programmes(records: DataFrame) -> DataFrame:
    """A record a document; those that answer neither question are stubs and left out. What the metadata lack, the record says."""
    meta = "extraction_metadata"
    return records.where("has_offensive_programme IS NOT NULL OR has_defensive_programme IS NOT NULL").select(
        F.coalesce(f"{meta}.source_id", "id").alias("document_id"), *(F.coalesce(f"{meta}.{c}", c).alias(c) for c in ("country_iso3", "year")), "convention_entry_date", "has_offensive_programme", "offensive_period", "offensive_summary",
        "has_defensive_programme", "defensive_period", "defensive_summary", "translated", F.col("confidence").cast("decimal(4,3)").alias("confidence"), "notes",
    )


def differing_fields(full: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    """(key, field, full, other) wherever two versions of a record differ; null equals null."""
    fields = [c for c in full.columns if c != key]
    text = lambda side, c: F.col(f"{side}.{c}").cast("string")
    joined = full.select(key, F.struct(*fields).alias("a")).join(other.select(key, F.struct(*fields).alias("b")), key)
    items = F.array_compact(F.array(*(F.when(~text("a", c).eqNullSafe(text("b", c)), F.struct(F.lit(c).alias("field"), text("a", c).alias("full"), text("b", c).alias("other"))) for c in fields)))
    return joined.select(key, F.inline(items))
