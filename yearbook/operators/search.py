"""Search by name and by declared activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import any_contains, contains, year_span
from .latest import country_names


def search(t, q: str, most: int = 20) -> DataFrame:
    """Up to `most` facilities of all layers whose name, or declared activity, matches.

    A facility whose name matches by any spelling is a name match, else an
    activity match with the latest matching text's first 200 characters."""
    matching = t.facility_years.where(contains(F.col("agents_summary"), q)).groupBy("canonical_facility_id").agg(F.max_by(F.left("agents_summary", F.lit(200)), F.struct("year", "document_id", "id")).alias("activity_snippet"))
    by_name = F.coalesce(contains(F.col("canonical_name"), q), F.lit(False)) | any_contains(F.col("all_names"), q)
    none = lambda kind: F.lit(None).cast(kind)
    a1 = t.facilities.join(matching, "canonical_facility_id", "left").where(by_name | F.col("activity_snippet").isNotNull()).select(
        F.col("canonical_facility_id").alias("id"), F.col("canonical_name").alias("name"), "country_iso3", "latest_containment", "years_declared", F.lit("A1").alias("layer"), F.when(by_name, "name").otherwise("activity").alias("match_type"), "activity_snippet"
    )
    g = t.vaccine_facilities.where(contains(F.col("canonical_name"), q)).select(
        "id", F.col("canonical_name").alias("name"), "country_iso3", none("string").alias("latest_containment"), year_span(F.col("first_year"), F.col("last_year")).alias("years_declared"), F.lit("G").alias("layer"), F.lit("name").alias("match_type"), none("string").alias("activity_snippet")
    )
    a2 = t.defence_facilities.where(contains(F.col("facility_name"), q)).select("country_iso3", "facility_name").distinct().select(
        none("string").alias("id"), F.col("facility_name").alias("name"), "country_iso3", none("string").alias("latest_containment"), none("array<int>").alias("years_declared"), F.lit("A2").alias("layer"), F.lit("name").alias("match_type"), none("string").alias("activity_snippet")
    )
    every = a1.unionByName(g).unionByName(a2)
    cols = ("id", "name", "country_iso3", "latest_containment", "years_declared", "layer", "country_name", "match_type", "activity_snippet")
    # names join after the limit: at most `most` rows need one
    ranking = (F.col("name").asc_nulls_last(), "layer", F.col("id").asc_nulls_last(), "country_iso3")
    top = every.orderBy(*ranking).limit(most)
    return top.join(country_names(t.documents), "country_iso3", "left").orderBy(*ranking).select(*cols)


