"""Questions as data: a checked specification, and the plan that answers it."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import contains, year_span
from ..operators.latest import country_names, first_per_group, with_country_name
from ..operators.lookups import CATEGORIES
from ..operators.summaries import FORMS

#: Words that a question's terms may not hold.
BLOCKED = ("union", "select", "insert", "update", "delete", "drop", "--", "/*", "*/")
TYPES = ("facility_search", "submission_history", "country_overview", "comparative", "legislation", "defence_programmes", "aggregate_stats")
MEASURES = ("legislation", "regulations", "other_measures")
HELP = "Ask about facilities, submissions, a country, a comparison, legislation, defence programmes or totals."


@dataclass(frozen=True)
class QuerySpec:
    """A question after classification. All fields but the type may be empty."""

    query_type: str
    countries: tuple[str, ...] = ()
    forms: tuple[str, ...] = ()
    year_min: int | None = None
    year_max: int | None = None
    organisms: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    bsl: tuple[str, ...] = ()
    legislation_category: str | None = None
    extra: dict = field(default_factory=dict, compare=False)


def terms(values: Iterable | None, most: int = 10) -> tuple[str, ...]:
    """The texts of the first ten values, cut to 100 characters, without those that hold a blocked word."""
    some = [v[:100] for v in list(values or ())[:most] if isinstance(v, str)]
    return tuple(v for v in some if not any(w in v.lower() for w in BLOCKED))


def codes(values: Iterable | None) -> tuple[str, ...]:
    """Country codes: three letters, upper-cased, at most 60, in order and without repeats."""
    some = [v.strip().upper() for v in values or () if isinstance(v, str)]
    return tuple(dict.fromkeys(v for v in some if re.fullmatch(r"[A-Z]{3}", v)))[:60]


def _year(value) -> int | None:
    try:
        return None if value is None else min(2030, max(1988, int(value)))
    except (TypeError, ValueError):
        return None


def checked(raw: dict) -> QuerySpec:
    """A specification from untrusted fields; an unknown type is 'unknown'."""
    kind = raw.get("query_type")
    category = raw.get("legislation_category")
    return QuerySpec(
        kind if kind in TYPES else "unknown", codes(raw.get("countries")), tuple(f.upper() for f in raw.get("forms") or () if isinstance(f, str) and f.upper() in FORMS), _year(raw.get("year_min")), _year(raw.get("year_max")),
        terms(raw.get("organisms")), terms(raw.get("keywords")), terms(raw.get("bsl")), category if category in CATEGORIES else None,
    )


def _among(df: DataFrame, spec: QuerySpec, years: bool = False) -> DataFrame:
    """Rows of the countries asked for, if any, and of the years."""
    if spec.countries:
        df = df.where(F.col("country_iso3").isin(*spec.countries))
    if years and spec.year_min is not None:
        df = df.where(F.col("year") >= spec.year_min)
    if years and spec.year_max is not None:
        df = df.where(F.col("year") <= spec.year_max)
    return df


def facility_search(t, spec: QuerySpec) -> DataFrame:
    """Facilities that meet all terms: 50 research ones, and of given countries 20 vaccine and 20 defence ones.

    Each condition on declared records is a semi-join on its own. No condition, no rows."""
    words = spec.organisms + spec.keywords
    a1 = _among(t.facilities, spec)
    if not (words or spec.countries or spec.bsl):
        a1 = a1.where(F.lit(False))
    for i, word in enumerate(words):
        declared = t.facility_years.where(contains(F.col("agents_summary"), word)).select("canonical_facility_id").distinct().withColumn(f"_w{i}", F.lit(True))
        a1 = a1.join(declared, "canonical_facility_id", "left").where(F.coalesce(contains(F.col("canonical_name"), word), F.lit(False)) | F.col(f"_w{i}").isNotNull()).drop(f"_w{i}")
    for level in spec.bsl:
        a1 = a1.join(t.facility_years.where(contains(F.col("highest_containment"), level)).select("canonical_facility_id"), "canonical_facility_id", "left_semi")
    none = F.lit(None).cast("string")
    parts = [a1.select(F.col("canonical_facility_id").alias("id"), F.col("canonical_name").alias("name"), "country_iso3", "latest_containment", "years_declared", F.lit("A1").alias("layer")).orderBy(F.col("name").asc_nulls_last(), "id").limit(50)]
    if spec.countries:
        for df, key, layer in ((t.vaccine_facilities, "id", "G"), (t.defence_entities, "canonical_defence_facility_id", "A2")):
            some = _among(df, spec)
            for word in words:
                some = some.where(contains(F.col("canonical_name"), word))
            some = some.select(F.col(key).alias("id"), F.col("canonical_name").alias("name"), "country_iso3", none.alias("latest_containment"), year_span(F.col("first_year"), F.col("last_year")).alias("years_declared"), F.lit(layer).alias("layer"))
            parts.append(some.orderBy(F.col("name").asc_nulls_last(), "id").limit(20))
    return with_country_name(reduce(lambda a, b: a.unionByName(b), parts), t.documents).orderBy("layer", F.col("name").asc_nulls_last(), "id").select("id", "name", "country_iso3", "latest_containment", "years_declared", "layer", "country_name")


def submission_history(t, spec: QuerySpec) -> DataFrame:
    """Form statuses by country and year, amendments included; 200 rows."""
    documents = _among(t.documents, spec, years=True).select(F.col("id").alias("document_id"), "country_iso3", "year")
    forms = t.form_compliance.where(F.col("form").isin(*spec.forms)) if spec.forms else t.form_compliance
    return forms.join(documents, "document_id").orderBy("country_iso3", "year", "form", "document_id").limit(200).select("country_iso3", "year", "form", "status")


def country_overview(t, spec: QuerySpec) -> DataFrame:
    """Per form of the first country: statuses, and the substantive ones."""
    documents = t.documents.where(F.col("country_iso3") == spec.countries[0]).select(F.col("id").alias("document_id"))
    return t.form_compliance.join(documents, "document_id").groupBy("form").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "substantive").alias("substantive")).orderBy("form")


def country_counts(t, spec: QuerySpec) -> DataFrame:
    """Facilities, vaccine facilities and defence entities of the first country, and the year of its latest legislation."""
    of = lambda df: df.where(F.col("country_iso3") == spec.countries[0])
    frames = [of(df).agg(F.count("*").alias(name)) for df, name in ((t.facilities, "a1_facilities"), (t.vaccine_facilities, "vaccine_facilities"), (t.defence_entities, "defence_facilities"))]
    return reduce(lambda a, b: a.crossJoin(b), [*frames, of(t.legislation).agg(F.max("year").alias("latest_legislation"))])


def _area_level(bsl: tuple[str, ...]) -> str | None:
    """The area column of the first level asked for; facilities have one for 3 and 4 only."""
    digits = "".join(c for c in bsl[0] if c.isdigit())
    return f"bsl{digits}_area_m2" if digits in ("3", "4") else None


def is_comparison(spec: QuerySpec) -> bool:
    """Two countries and nothing else: shown side by side."""
    return len(spec.countries) == 2 and not (spec.bsl or spec.keywords or spec.forms)


def comparative(t, spec: QuerySpec) -> DataFrame:
    """The ten countries with the most: facilities of a level and their declared area, substantive forms, or facilities.

    Areas are sums over facility-years. A facility's records are aggregated
    with its country in hand; the two sides of the join share their key."""
    if spec.bsl:
        level = reduce(lambda a, b: a | b, (contains(F.col("highest_containment"), x) for x in spec.bsl))
        area = _area_level(spec.bsl)
        records = t.facility_years.where(level).select("canonical_facility_id", "bsl3_area_m2", "bsl4_area_m2")
        joined = records.join(_among(t.facilities, spec).select("canonical_facility_id", "country_iso3"), "canonical_facility_id").groupBy("country_iso3")
        counts = joined.agg(F.count_distinct("canonical_facility_id").alias("count"), *([F.sum(area).cast("double").alias("area_m2")] if area else []))
        order = [F.desc_nulls_last("area_m2")] if area else [F.desc("count")]
    elif spec.forms:
        documents = _among(t.documents, spec).select(F.col("id").alias("document_id"), "country_iso3")
        some = t.form_compliance.where(F.col("form").isin(*spec.forms) & (F.col("status") == "substantive"))
        counts, order = some.join(documents, "document_id").groupBy("country_iso3").agg(F.count("*").alias("count")), [F.desc("count")]
    else:
        counts, order = _among(t.facilities, spec).groupBy("country_iso3").agg(F.count_distinct("canonical_facility_id").alias("count")), [F.desc("count")]
    return with_country_name(counts.orderBy(*order, "country_iso3").limit(10), t.documents).orderBy(*order, "country_iso3")


def legislation(t, spec: QuerySpec) -> DataFrame:
    """Legislation that has any measure of the category: of the years asked for, or else each
    country's latest year that has it (not its current state); 200 rows."""
    some = _among(t.legislation, spec, years=True)
    shown = [f"{c}_{m}" for c in ([spec.legislation_category] if spec.legislation_category else CATEGORIES) for m in MEASURES]
    if spec.legislation_category:
        some = some.where(reduce(lambda a, b: a | b, (F.coalesce(F.col(c), F.lit(False)) for c in shown)))
    if not (spec.year_min or spec.year_max):
        some = first_per_group(some, ["country_iso3"], [F.desc("year"), F.col("document_id")])
    names = t.documents.select(F.col("id").alias("document_id"), "country_name")
    return some.join(names, "document_id").orderBy("country_iso3", F.desc("year"), "document_id").limit(200).select("country_iso3", "country_name", "year", *shown, "key_laws")


def defence_programmes(t, spec: QuerySpec) -> DataFrame:
    """Past and current programmes, 100 of each, told apart by source; which ones, by form and keyword, else both."""
    words = {w.lower() for w in spec.keywords}
    past = "F" in spec.forms or bool(words & {"offensive", "defensive", "past"})
    current = "A2" in spec.forms or bool(words & {"budget", "funding", "contractor", "current", "defence", "defense"})
    names = t.documents.select(F.col("id").alias("document_id"), "country_name")
    parts = []
    if past or not current:
        some = _among(t.past_programmes, spec, years=True)
        for word in ("offensive", "defensive"):
            if word in words:
                some = some.where(F.col(f"has_{word}_programme"))
        cols = ("has_offensive_programme", "offensive_period", "offensive_summary", "has_defensive_programme", "defensive_period", "defensive_summary")
        parts.append(some.join(names, "document_id").orderBy("country_iso3", F.desc("year"), "document_id").limit(100).select("country_iso3", "country_name", "year", *cols, F.lit("past_programme").alias("source")))
    if current or not past:
        cols = ("programme_name", "responsible_org", "objectives_summary", "total_funding_amount", "total_funding_currency", "uses_contractors")
        some = _among(t.defence_programmes, spec, years=True).join(names, "document_id").orderBy("country_iso3", F.desc("year"), "document_id", "id").limit(100)
        parts.append(some.select("country_iso3", "country_name", "year", *cols, F.lit("defence_programme").alias("source")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def aggregate_stats(t, spec: QuerySpec) -> DataFrame:
    """Totals: by containment a row a country (15); else metrics of forms, of countries, or of all."""
    if spec.bsl:
        area = _area_level(spec.bsl)
        some = _among(t.facilities, spec).where(contains(F.col("latest_containment"), spec.bsl[0])).select("canonical_facility_id", "country_iso3")
        if area:
            sums = t.facility_years.groupBy("canonical_facility_id").agg(F.sum(area).alias("area"))
            counts = some.join(sums, "canonical_facility_id", "left").groupBy("country_iso3").agg(F.count("*").alias("facility_count"), F.sum("area").cast("double").alias("total_area_m2"))
            order = F.desc_nulls_last("total_area_m2")
        else:
            counts, order = some.groupBy("country_iso3").agg(F.count("*").alias("facility_count")), F.desc("facility_count")
        return with_country_name(counts.orderBy(order, "country_iso3").limit(15), t.documents).orderBy(order, "country_iso3")
    if spec.forms:
        documents = _among(t.documents, replace(spec, countries=()), years=True).select(F.col("id").alias("document_id"), "country_iso3")
        some = t.form_compliance.where(F.col("form").isin(*spec.forms) & (F.col("status") == "substantive")).join(documents, "document_id")
        return some.agg(F.count_distinct("country_iso3").alias("value")).select(F.lit(f"countries submitting {', '.join(spec.forms)}").alias("metric"), "value")
    if spec.countries:
        frames = {"research facilities (A1)": _among(t.facilities, spec), "vaccine facilities (G)": _among(t.vaccine_facilities, spec), "defence facilities (A2)": _among(t.defence_entities, spec), "total submissions": _among(t.documents, spec).where(~F.col("is_amendment"))}
        return reduce(lambda a, b: a.unionByName(b), (df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value") for name, df in frames.items()))
    documents = t.documents.agg(F.count_distinct("country_iso3").alias("countries"), F.count_if(~F.col("is_amendment")).alias("submissions")).crossJoin(t.facilities.agg(F.count("*").alias("facilities")))
    return documents.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in documents.columns))))


HANDLERS = {f.__name__: f for f in (facility_search, submission_history, country_overview, comparative, legislation, defence_programmes, aggregate_stats)}


def answer(t, spec: QuerySpec) -> DataFrame | None:
    """The rows that answer a specification; none for an unknown type, for which HELP is the answer."""
    return HANDLERS[spec.query_type](t, spec) if spec.query_type in HANDLERS else None


def missing_countries(t, spec: QuerySpec, rows: DataFrame) -> DataFrame:
    """Countries asked for that the rows lack, with their names or else their codes."""
    asked = t.documents.sparkSession.createDataFrame([(c,) for c in spec.countries], "country_iso3 string")
    lost = asked.join(rows.select("country_iso3"), "country_iso3", "left_anti")
    return lost.join(country_names(t.documents), "country_iso3", "left").select("country_iso3", F.coalesce("country_name", "country_iso3").alias("name"))


def _plural(n: int, one: str, many: str) -> str:
    return f"{n:,} {one if n == 1 else many}"


def funding_phrase(amount, currency: str | None) -> str:
    """An amount in whole units and its currency."""
    return f"{amount:,.0f} {currency or ''}".strip() if amount else "funding not disclosed"


def _programme(r: dict) -> str:
    """A past or current programme in a line."""
    name = f"{r['country_name'] or r['country_iso3']} ({r['year']})"
    if r["source"] == "past_programme":
        kinds = ", ".join(k for k in ("offensive", "defensive") if r.get(f"has_{k}_programme")) or "none declared"
        return f"{name}: past programme, {kinds} ({r.get('offensive_period') or r.get('defensive_period') or 'unknown period'})"
    return f"{name}: {r.get('programme_name') or 'unnamed programme'}, {funding_phrase(r.get('total_funding_amount'), r.get('total_funding_currency'))}"


def _area(area) -> str:
    return f" with {area:,.0f} m²" if area else ""


def describe(spec: QuerySpec, rows: list[dict], missing: tuple[str, ...] = ()) -> str:
    """A text on at most 200 rows of an answer, and on countries asked for that have no data."""
    text = _described(spec, rows)
    return f"{text}\nNo public data: {', '.join(missing)}." if missing and spec.query_type in HANDLERS else text


def _described(spec: QuerySpec, rows: list[dict]) -> str:
    if spec.query_type not in HANDLERS:
        return HELP
    if not rows:
        return "No matching records found."
    if spec.query_type == "comparative":
        if is_comparison(spec):
            return f"Compare {spec.countries[0]} with {spec.countries[1]} side by side."
        return "; ".join(f"{i + 1}. {r['country_name'] or r['country_iso3']}: {_plural(r['count'], 'record', 'records')}{_area(r.get('area_m2'))}" for i, r in enumerate(rows))
    if spec.query_type == "defence_programmes":
        return "; ".join(map(_programme, rows))[:2000]
    if spec.query_type == "aggregate_stats" and "facility_count" in rows[0]:
        own = "; ".join(f"{r['country_name'] or r['country_iso3']}: {_plural(r['facility_count'], 'facility', 'facilities')}{_area(r.get('total_area_m2'))}" for r in rows)
        return f"{own}. {_plural(sum(r['facility_count'] for r in rows), 'facility', 'facilities')} of {_plural(len(rows), 'country', 'countries')}."
    if spec.query_type == "aggregate_stats" and "metric" in rows[0]:
        return "; ".join(f"{r['metric']}: {r['value']:,}" for r in rows)
    if spec.query_type == "submission_history":
        return f"{_plural(len(rows), 'form', 'forms')} of {_plural(len({r['country_iso3'] for r in rows}), 'country', 'countries')}."
    return f"{_plural(len(rows), 'record', 'records')}."[:2000]
