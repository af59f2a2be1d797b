"""Totals, rates and rankings over all countries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import contains, share, year_span
from ..functions.similarity import python_round1
from .latest import with_country_name

#: The terms whose mentions are counted, and their patterns.
PATHOGENS = (
    ("Anthrax", "anthrax"), ("Botulinum toxin", "botulinum"), ("Brucella", "brucell"), ("Plague", "plague"), ("Tularaemia", "tularaem"), ("Ebola", "ebola"), ("Marburg", "marburg"),
    ("Smallpox / Variola", "smallpox"), ("Influenza", "influenza"), ("Tuberculosis", "tuberculosis"), ("Rabies", "rabies"), ("Salmonella", "salmonella"), ("West Nile virus", "west nile"),
    ("Dengue", "dengue"), ("Q fever / Coxiella", "coxiella"), ("Rickettsia", "rickettsia"), ("Venezuelan EE", "venezuelan equine"), ("Foot-and-mouth", "foot-and-mouth"), ("Hantavirus", "hantavirus"),
    ("Coronavirus / SARS", "coronavirus"),
)
#: The forms of a submission.
FORMS = ("A1", "A2", "B", "C", "E", "F", "G")


def this_year() -> Column:
    return F.year(F.current_date())


def _one_row(frames: list[DataFrame]) -> DataFrame:
    """One-row frames side by side."""
    return reduce(lambda a, b: a.crossJoin(b), frames)


def stats(t) -> DataFrame:
    """Eleven totals in one row; each table is read once."""
    documents = t.documents.agg(
        F.count_if(~F.col("is_amendment")).alias("total_submissions"), F.count_distinct(F.when(~F.col("is_amendment"), F.col("country_iso3"))).alias("total_countries"),
        F.min(F.when(~F.col("is_amendment"), F.col("year"))).alias("year_min"), F.max(F.when(~F.col("is_amendment"), F.col("year"))).alias("year_max"),
    )
    years = t.facility_years.agg(F.count("*").alias("total_facility_years"), F.count_if(F.col("lon").isNotNull()).alias("geocoded_facility_years"))
    return _one_row([
        documents, years, t.facilities.agg(F.count("*").alias("total_unique_facilities")), t.vaccine_facility_years.agg(F.count("*").alias("vaccine_facility_years")), t.vaccine_facilities.agg(F.count("*").alias("total_unique_vaccine")),
        t.defence_facilities.agg(F.count("*").alias("defence_facility_years"), F.count_distinct("canonical_defence_facility_id").alias("total_unique_defence")),
    ]).select("total_submissions", "total_countries", "total_facility_years", "total_unique_facilities", "geocoded_facility_years", "vaccine_facility_years", "defence_facility_years", "total_unique_vaccine", "total_unique_defence", "year_min", "year_max")


def _by_form(t, form: str) -> DataFrame:
    """Unamended documents with the status of one form; documents without any status stay."""
    status = t.form_compliance.where(F.col("form") == form).select("document_id", "status")
    return t.documents.where(~F.col("is_amendment")).join(status, F.col("id") == F.col("document_id"), "left")


def countries(t) -> DataFrame:
    """A row a country: years submitted, the latest, facilities that its documents
    declare, those ever of level 4, and the rate of substantive first forms.

    The two sides are aggregated before they meet, so they do not multiply."""
    rates = _by_form(t, "A1").groupBy("country_iso3").agg(
        F.max("country_name").alias("country_name"), F.count_distinct("year").alias("submission_count"), F.max("year").alias("latest_year"),
        share(F.count_distinct(F.when(F.col("status") == "substantive", F.col("year"))), F.count_distinct("year")).cast("double").alias("a1_rate"),
    )
    documents = t.documents.where(~F.col("is_amendment")).select(F.col("id").alias("document_id"), "country_iso3")
    declared = t.facility_years.select("document_id", "canonical_facility_id", "has_bsl4").join(documents, "document_id")
    found = declared.groupBy("country_iso3").agg(F.count_distinct("canonical_facility_id").alias("facility_count"), F.count_distinct(F.when(F.col("has_bsl4"), F.col("canonical_facility_id"))).alias("bsl4_count"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rates.join(found, "country_iso3", "left").select("country_iso3", "country_name", "submission_count", "latest_year", zero("facility_count"), zero("bsl4_count"), "a1_rate")


def compliance(t, form: str = "A1") -> DataFrame:
    """Per country the years with a substantive form by the years submitted. Forms go in any case."""
    form = form.upper()
    if form not in FORMS:
        raise ValueError(f"unknown form {form}")
    rate = share(F.count_distinct(F.when(F.col("status") == "substantive", F.col("year"))), F.count_distinct("year")).cast("double")
    return _by_form(t, form).groupBy("country_iso3").agg(F.max("country_name").alias("country_name"), F.count_distinct("year").alias("submission_count"), rate.alias("a1_rate" if form == "A1" else "rate"))


def timeline(t, as_of_year: int | None = None) -> DataFrame:
    """Declared facility-years by year before as_of_year, amendments included."""
    now = this_year() if as_of_year is None else F.lit(as_of_year)
    years = t.facility_years.where(F.col("year") < now).select("year", "has_bsl4", "document_id")
    documents = t.documents.select(F.col("id").alias("document_id"), "country_iso3")
    return years.join(documents, "document_id").groupBy("year").agg(F.count("*").alias("a1_facility_years"), F.count_if("has_bsl4").alias("bsl4_facility_years"), F.count_distinct("country_iso3").alias("submitting_countries"))


def timeline_columns(rows: DataFrame) -> DataFrame:
    """The timeline as one row of arrays in order of years."""
    names = rows.columns
    ordered = F.array_sort(F.collect_list(F.struct(*names)))
    return rows.agg(ordered.alias("r")).select(*(F.col(f"r.{c}").alias("years" if c == "year" else c) for c in names))


def bsl4_capacity(t, as_of_year: int | None = None) -> DataFrame:
    """Declared area and facilities of level 4 by year and country; only areas over 0."""
    now = this_year() if as_of_year is None else F.lit(as_of_year)
    some = t.facility_years.where((F.col("bsl4_area_m2") > 0) & (F.col("year") < now))
    sums = some.groupBy("year", "country_iso3").agg(F.sum("bsl4_area_m2").cast("double").alias("total_bsl4_area_m2"), F.count_if("has_bsl4").alias("bsl4_facility_count"))
    return with_country_name(sums, t.documents).select("year", "country_iso3", "country_name", "total_bsl4_area_m2", "bsl4_facility_count").orderBy("year", F.desc("total_bsl4_area_m2"), "country_iso3")


def capacity_top_n(capacity: DataFrame, n: int = 8) -> DataFrame:
    """A grid of years and the n largest countries, the rest as OTHER unless it is all 0; missing areas are 0."""
    totals = capacity.groupBy("country_iso3").agg(F.sum("total_bsl4_area_m2").alias("total")).orderBy(F.desc("total"), "country_iso3").limit(n)
    named = capacity.join(totals.select("country_iso3", F.lit(True).alias("top")), "country_iso3", "left")
    cells = named.select("year", F.when(F.col("top"), F.col("country_iso3")).otherwise("OTHER").alias("series"), "total_bsl4_area_m2").groupBy("year", "series").agg(F.sum(F.col("total_bsl4_area_m2").cast("decimal(20,2)")).cast("double").alias("area"))
    # years times series: at most n + 1 rows a year
    live = cells.groupBy("series").agg(F.sum("area").alias("all")).where("all > 0 or series <> 'OTHER'").select("series")
    grid = live.crossJoin(F.broadcast(capacity.select("year").distinct()))
    return grid.join(cells, ["year", "series"], "left").select("year", "series", F.coalesce("area", F.lit(0.0)).alias("area"))


def pathogen_frequency(t, terms=PATHOGENS) -> DataFrame:
    """Facilities that mention each term, the most first; terms without any are left out.

    One scan: a facility's matches are a bit set, and sets merge before the
    shuffle, so there is no expansion by terms."""
    hits = [F.max(F.coalesce(contains(F.col("agents_summary"), pattern), F.lit(False))).alias(f"h{i}") for i, (_, pattern) in enumerate(terms)]
    found = t.facility_years.where("agents_summary is not null").groupBy("canonical_facility_id").agg(*hits)
    counts = found.agg(*(F.count_if(f"h{i}").alias(f"n{i}") for i in range(len(terms))))
    rows = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(pattern).alias("term"), F.col(f"n{i}").alias("count"), F.lit(i).alias("place")) for i, (label, pattern) in enumerate(terms)))
    return counts.select(F.inline(rows)).where("count > 0").orderBy(F.desc("count"), "place").select("label", "term", "count")


def transparency(t, as_of_year: int | None = None) -> DataFrame:
    """Regularity, rate of first forms and recency, and their weighted score of 0 to 100."""
    now = this_year() if as_of_year is None else F.lit(as_of_year)
    base = _by_form(t, "A1").groupBy("country_iso3").agg(
        F.max("country_name").alias("country_name"), F.count_distinct("id").alias("submission_count"), F.min("year").alias("first_year"), F.max("year").alias("latest_year"),
        share(F.count_distinct(F.when(F.col("status") == "substantive", F.col("id"))), F.count_distinct("id")).cast("double").alias("a1_rate"),
    )
    regular = F.least(F.lit(1.0), F.col("submission_count").cast("double") / (F.col("latest_year") - F.col("first_year") + 1).cast("double"))
    recent = F.when(F.col("latest_year") >= now - 2, 1.0).when(F.col("latest_year") >= now - 5, 0.5).otherwise(0.1)
    scored = base.withColumns({"regularity_score": regular, "recency_score": recent})
    exact = (F.coalesce("regularity_score", F.lit(0.0)) * 0.4 + F.coalesce("a1_rate", F.lit(0.0)) * 0.4 + F.col("recency_score") * 0.2) * 100
    return scored.withColumn("transparency_score", python_round1(exact)).orderBy(F.col("country_name").asc_nulls_last(), "country_iso3")


def lapsed(t, threshold: int = 3) -> DataFrame:
    """Facilities whose last year lies `threshold` years or more before their country's."""
    last = t.facility_years.groupBy("canonical_facility_id").agg(F.max("year").alias("facility_year"), F.min("country_iso3").alias("country_iso3"))
    of_country = t.facility_years.groupBy("country_iso3").agg(F.max("year").alias("country_year"))
    return last.join(of_country, "country_iso3").where(F.col("country_year") - F.col("facility_year") >= threshold).select("canonical_facility_id")


def compare(t, a: str, b: str) -> DataFrame:
    """Two countries side by side: a row a metric."""
    some = lambda df: df.where(F.col("country_iso3").isin(a, b)).groupBy("country_iso3")
    facilities = some(t.facilities).agg(F.count("*").alias("facilities"), F.count_if(F.col("latest_containment").contains("4")).alias("bsl4"), F.count_if(F.col("latest_containment").contains("3")).alias("bsl3"))
    documents = some(t.documents.where(~F.col("is_amendment"))).agg(F.count_distinct("year").alias("years_submitted"))
    vaccines = some(t.vaccine_facilities).agg(F.count("*").alias("vaccine_facilities"))
    defence = some(t.defence_entities).agg(F.count("*").alias("defence_facilities"))
    joined = reduce(lambda x, y: x.join(y, "country_iso3", "full"), (facilities, documents, vaccines, defence))
    metrics = ("facilities", "bsl4", "bsl3", "years_submitted", "vaccine_facilities", "defence_facilities")
    long = joined.select("country_iso3", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.coalesce(m, F.lit(0).cast("long")).alias("n")) for m in metrics))))
    of = lambda iso: F.coalesce(F.sum(F.when(F.col("country_iso3") == iso, F.col("n"))), F.lit(0).cast("long"))
    return long.groupBy("metric").agg(of(a).alias("a"), of(b).alias("b"))


def summary_stats(t) -> DataFrame:
    """The data set in one row; lists are sorted and joined by commas."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    years = t.facility_years.agg(F.count("*").alias("facility_years"), F.round(F.avg("confidence"), 3).cast("double").alias("mean_confidence"), names("country_iso3").alias("countries"), names(F.col("year").cast("string")).alias("years"))
    entities = t.facilities.agg(F.count("*").alias("facilities"), F.count_if(F.col("latest_containment") == "BSL-4").alias("bsl4_facilities"), F.count_if(F.col("latest_containment").isin("BSL-4", "BSL-3")).alias("bsl3_facilities"))
    past = t.past_programmes.agg(F.count("*").alias("past_programmes"), F.count_if("has_offensive_programme").alias("with_offensive"), F.count_if("has_defensive_programme").alias("with_defensive"))
    return _one_row([years, entities, past, t.vaccine_facility_years.agg(F.count("*").alias("vaccine_facility_years")), t.defence_programmes.agg(F.count("*").alias("defence_programmes")), t.legislation.agg(F.count("*").alias("legislation_records"))])


def substantive_rates(t) -> DataFrame:
    """Per form, the share of documents with a status that is substantive."""
    total = t.form_compliance.agg(F.count_distinct("document_id").alias("documents"))
    by_form = t.form_compliance.where(F.col("form").isin(*FORMS)).groupBy("form").agg(F.count_if(F.col("status") == "substantive").alias("n"))
    return by_form.crossJoin(total).select("form", share(F.col("n"), F.col("documents")).cast("double").alias("rate"))


def bsl_by_country(t) -> DataFrame:
    """Facilities by their latest containment, per country."""
    return t.facilities.groupBy(F.coalesce("country_iso3", F.lit("UNK")).alias("country_iso3")).agg(F.count_if(F.col("latest_containment") == "BSL-4").alias("bsl4"), F.count_if(F.col("latest_containment").isin("BSL-4", "BSL-3")).alias("bsl3"))


def declared_years(t) -> DataFrame:
    """All years in any of the three layers, in order."""
    layers = [t.facility_years, t.vaccine_facility_years, t.defence_facilities]
    return reduce(lambda a, b: a.union(b), (x.select("year") for x in layers)).distinct().orderBy("year")


def bar_shares(counts: DataFrame) -> DataFrame:
    """Each count by the largest one."""
    return counts.crossJoin(counts.agg(F.max("count").alias("_most"))).withColumn("share", F.col("count") / F.col("_most")).drop("_most")


def weighted_sample(df: DataFrame, weight: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the chance in proportion to weight."""
    key = -F.log(1.0 - F.rand(seed)) / F.col(weight)
    return df.where(F.col(weight) > 0).withColumn("_key", key).orderBy("_key").limit(n).drop("_key")


def vaccine_span(first: str = "first_year", last: str = "last_year") -> Column:
    return year_span(F.col(first), F.col(last))
