"""First and latest rows of groups, always by a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group; rows whose key is null form a group too."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest_per_group(df: DataFrame, keys: list[str], by: str, ties: list[str]) -> DataFrame:
    """The row with the largest `by` (unknown last); ties by the smallest of `ties`."""
    return first_per_group(df, keys, [F.col(by).desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in ties)])


def latest_value(value: str, year: str, *ties: str) -> Column:
    """An aggregate: the value in the row of the largest year; null values win too."""
    return F.max_by(F.struct(F.col(value).alias("v")), F.struct(year, *ties)).getField("v")


def country_names(documents: DataFrame) -> DataFrame:
    """A country's name in its document with the smallest id that has one.

    One aggregate with partial results, no window: a row a country."""
    return documents.where("country_name is not null").groupBy("country_iso3").agg(F.min_by("country_name", "id").alias("country_name"))


def with_country_name(df: DataFrame, documents: DataFrame) -> DataFrame:
    """df and country_name, null for countries without one.

    The names are a row a country (some 250 at most); their side is broadcast
    by the size that the planner sees, not by a hint."""
    return df.join(country_names(documents), "country_iso3", "left")


def primary_documents(catalogue: DataFrame) -> DataFrame:
    """Each downloaded, unamended document with is_primary: the English one of its
    country and year, or else the one with the smallest id."""
    some = catalogue.where("downloaded and not coalesce(is_amendment, false) and year is not null")
    order = W.partitionBy("country_iso3", "year").orderBy((F.coalesce("language", F.lit("")) != "en").cast("int"), "id")
    return some.withColumn("is_primary", F.row_number().over(order) == 1)
