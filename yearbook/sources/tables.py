"""Declared schemas, rules, and reloading of whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BOOLS = ", ".join(f"{c}_{m} boolean" for c in ("prohibitions", "exports", "imports", "biosafety") for m in ("legislation", "regulations", "other_measures", "amended"))
_POINT = "lon double, lat double, geocode_source string, geocode_confidence string"
#: Columns of the tables.
SCHEMAS = {
    "documents": "id string not null, country_iso3 string not null, country_name string, year int not null, language string, source_url string, is_amendment boolean not null",
    "form_compliance": "document_id string not null, form string not null, status string not null",
    "facilities": "canonical_facility_id string not null, country_iso3 string not null, canonical_name string, all_names array<string> not null, years_declared array<int> not null, latest_containment string, latest_area_m2 decimal(10,2)",
    "facility_years": f"id long not null, canonical_facility_id string not null, document_id string not null, country_iso3 string not null, year int not null, facility_name string, responsible_org string, city string, address string, funding_sources string, mod_funded boolean, has_bsl4 boolean, bsl4_area_m2 decimal(10,2), has_bsl3 boolean, bsl3_area_m2 decimal(10,2), highest_containment string, agents_summary string, agents_redacted boolean, confidence decimal(4,3), translated boolean, {_POINT}, flagged_for_review boolean not null, flag_note string",
    "vaccine_facilities": "id string not null, country_iso3 string not null, canonical_name string, first_year int, last_year int",
    "vaccine_facility_years": f"id long not null, document_id string not null, canonical_vaccine_facility_id string, country_iso3 string not null, year int not null, facility_name string, city string, address string, diseases_covered string, vaccines_summary string, confidence decimal(4,3), translated boolean, {_POINT}",
    "defence_entities": "canonical_defence_facility_id string not null, country_iso3 string not null, canonical_name string, first_year int, last_year int, all_names array<string>",
    "defence_facilities": f"id long not null, document_id string not null, canonical_defence_facility_id string, country_iso3 string not null, year int not null, facility_name string, city string, address string, bsl2_area_m2 decimal(10,2), bsl3_area_m2 decimal(10,2), bsl4_area_m2 decimal(10,2), total_lab_area_m2 decimal(10,2), personnel_total int, personnel_military int, personnel_civilian int, personnel_scientists int, personnel_engineers int, personnel_technicians int, personnel_admin int, mod_funded boolean, funding_source string, funding_research decimal(15,2), funding_development decimal(15,2), funding_te decimal(15,2), funding_currency string, work_description string, confidence decimal(4,3), translated boolean, {_POINT}",
    "defence_programmes": "id long not null, document_id string not null, country_iso3 string not null, year int not null, programme_name string, responsible_org string, objectives_summary string, research_areas array<string> not null, total_funding_amount decimal(15,2), total_funding_currency string, uses_contractors boolean, contractor_proportion_pct decimal(5,2), confidence decimal(4,3), translated boolean",
    "past_programmes": "document_id string not null, country_iso3 string not null, year int not null, convention_entry_date string, has_offensive_programme boolean, offensive_period string, offensive_summary string, has_defensive_programme boolean, defensive_period string, defensive_summary string, confidence decimal(4,3), translated boolean, notes string",
    "legislation": f"document_id string not null, country_iso3 string not null, year int not null, {_BOOLS}, key_laws array<string> not null, confidence decimal(4,3), translated boolean, notes string",
    "outbreaks": "id long not null, document_id string not null, country_iso3 string, year int, pathogen string, location string, date_range string, cases_estimate string, deaths_estimate string, suspected_source string, notes string, confidence float, created_at timestamp",
}
#: Column -> parent table and its key.
PARENTS = {"document_id": ("documents", "id"), "canonical_facility_id": ("facilities", "canonical_facility_id"), "canonical_vaccine_facility_id": ("vaccine_facilities", "id"), "canonical_defence_facility_id": ("defence_entities", "canonical_defence_facility_id")}
STATUSES = ("substantive", "nothing_to_declare", "absent", "limited")


def checks(df: DataFrame) -> dict[str, Column]:
    """The rules that hold for the columns that df has; unknown values pass."""
    out: dict[str, Column] = {}
    for c in df.columns:
        if c == "confidence":
            out["confidence from 0 to 1"] = F.col(c).between(0, 1)
        elif c == "year":
            out["year from 1980 to 2099"] = F.col(c).between(1980, 2099)
        elif c.startswith("personnel_"):
            out[f"{c} not negative"] = F.col(c) >= 0
        elif c == "status":
            out["a known status"] = F.col(c).isin(*STATUSES)
    return out


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A CSV with a header as text columns: values are coerced by whoever knows their kind."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("enforceSchema", "false").csv(path, header=True, escape='"', multiLine=True)


def read_records(spark: SparkSession, pattern: str, schema: str, skipped: DataFrame | None = None) -> DataFrame:
    """JSON records of files that match a pattern, with their file, less those of documents in skipped (id)."""
    records = spark.read.schema(schema).json(pattern, multiLine=True).withColumn("file", F.input_file_name())
    return records if skipped is None else records.join(skipped.select("id"), "id", "left_anti")


def listed(records: DataFrame, column: str) -> DataFrame:
    """The nested records of files, a row each, with `place`: a number that orders them by file and by their order in it.

    Ids that depend on the order of arrival count by it."""
    # a file is read by one task, in order: within it, the number of a row grows
    rows = records.withColumn("row", F.monotonically_increasing_id()).select("file", "row", *(c for c in records.columns if c not in ("file", column)), F.posexplode(column).alias("at", "record"))
    own = rows.withColumn("own", F.row_number().over(W.partitionBy("file").orderBy("row", "at")))
    # a row a file: the running total orders files, not records
    count = own.groupBy("file").agg(F.max("own").alias("n"))
    base = count.select("file", (F.sum("n").over(W.orderBy("file")) - F.col("n")).alias("base"))
    return own.join(base, "file").withColumn("place", F.col("base") + F.col("own") - 1).drop("base", "own", "at", "row")


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Manifests by the folder that each lies in, which is the document's id."""
    schema = "forms_present array<string>, forms_nothing_to_declare array<string>, segmentation_method string, confidence string"
    return spark.read.schema(schema).json(f"{folder}/*/manifest.json", multiLine=True).withColumn("id", F.regexp_extract(F.input_file_name(), r"([^/]+)/manifest\.json$", 1))


class Reloaded:
    """A table that is replaced as a whole: readers see the old one or the new one.

    Each load is a folder of its own; which one counts is written last."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def replace(self, df: DataFrame) -> str:
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/{version}")
        return self._count(version)

    def replace_all(self, tables: dict[str, DataFrame]) -> str:
        """Several tables in one load: all are replaced, parents before children, or none is."""
        version = uuid.uuid4().hex
        for name in sorted(tables, key=lambda n: list(SCHEMAS).index(n) if n in SCHEMAS else len(SCHEMAS)):
            tables[name].write.parquet(f"{self.root}/{version}/{name}")
        return self._count(version)

    def _count(self, version: str) -> str:
        order = self._versions().agg(F.max("load")).first()[0] if self._exists() else 0
        self.spark.createDataFrame([((order or 0) + 1, version)], "load long, version string").coalesce(1).write.mode("append").parquet(f"{self.root}/_loads")
        return version

    def read(self, name: str = "") -> DataFrame:
        """The table of the last load; or of that name, of a load of several."""
        return self.spark.read.parquet(f"{self.root}/{self._versions().orderBy(F.desc('load')).first()['version']}/{name}".rstrip("/"))

    def _versions(self) -> DataFrame:
        return self.spark.read.schema("load long, version string").parquet(f"{self.root}/_loads")

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_loads")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
