"""Files for people and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import slug

MAP_COLUMNS = ("layer", "id", "name", "country_iso3", "country_name", "year", "containment", "city", "geocode_conf", "lat", "lon", "agents_summary")
KINDS = {"A1": "Research", "G": "Vaccine", "A2": "Defence"}


def quoted(*columns) -> F.col:
    """A CSV line: every value in quotes, quotes doubled, null empty."""
    return F.concat_ws(",", *(F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, all values quoted, null as empty."""
    text = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns))
    text.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', emptyValue="")


def map_export(features: DataFrame, layer: str) -> DataFrame:
    """Map records with the columns of the export; places to five decimals."""
    have = {"layer": F.lit(layer), "id": F.col("canonical_facility_id" if "canonical_facility_id" in features.columns else "id"), "geocode_conf": F.col("geocode_confidence"), "lat": F.format_string("%.5f", "lat"), "lon": F.format_string("%.5f", "lon")}
    none = F.lit("")
    return features.select(*((have[c] if c in have else F.col(c) if c in features.columns else none).cast("string").alias(c) for c in MAP_COLUMNS))


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object a line; nulls are kept, letters outside ASCII are not escaped."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def results_text(rows: DataFrame, question: str, date: str) -> DataFrame:
    """Lines of a results file, in order: a preamble of comments, a header, and a line a facility."""
    spark = rows.sparkSession
    header = ("id", "name", "country_iso3", "country_name", "facility_type", "latest_containment", "years_declared")
    kind = F.lit(KINDS["A1"])
    for layer, name in KINDS.items():
        kind = F.when(F.col("layer") == layer, name).otherwise(kind)
    lines = rows.withColumn("facility_type", kind).withColumn("years_declared", F.array_join(F.transform("years_declared", lambda y: y.cast("string")), "|"))
    body = lines.select(F.concat(F.lit("1"), F.coalesce("name", F.lit("￿")), F.coalesce("id", F.lit(""))).alias("place"), quoted(*(F.col(c) for c in header)).alias("line"))
    n = rows.agg(F.count("*").alias("n"))
    counted = n.select(F.lit("03").alias("place"), F.concat(F.lit("# Results: "), F.col("n").cast("string"), F.when(F.col("n") == 1, " facility").otherwise(" facilities")).alias("line"))
    text = ["# Search export", '# Query: "' + question.replace('"', '\\"') + '"', f"# Date: {date}", None, "#", ",".join(f'"{h}"' for h in header)]
    fixed = spark.createDataFrame([(f"0{i}", x) for i, x in enumerate(text) if x is not None], "place string, line string")
    return fixed.union(counted).union(body).orderBy("place").select("line")


def results_name(question: str, date: str):
    """The name of a results file."""
    return F.concat(F.lit("search-"), slug(F.lit(question or "results")), F.lit(f"-{date}.csv"))


def feature_collection(features: DataFrame) -> DataFrame:
    """All features (JSON texts) as one collection; for layers that fit one row."""
    body = F.array_join(F.array_sort(F.collect_list("feature")), ",")
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("geojson"))
