"""The catalogue of documents: reading, numbering, checking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CATALOGUE = "id string, country string, country_iso3 string, year int, source_url string, local_path string, file_size_bytes long, page_count int, language string, downloaded boolean, is_amendment boolean, needs_ocr boolean"
#: Names of languages and their codes.
LANGUAGES = {"English": "en", "French": "fr", "Spanish": "es", "Russian": "ru", "Arabic": "ar", "Chinese": "zh"}


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of documents; fields that are missing are null."""
    return spark.read.schema(CATALOGUE).json(path, multiLine=True)


def with_ids(entries: DataFrame, *arrival: str) -> DataFrame:
    """entries with id: country and year, and _n for the n-th of a pair from the second on; an unknown year is UNKNOWN."""
    base = F.concat_ws("_", "country_iso3", F.coalesce(F.col("year").cast("string"), F.lit("UNKNOWN")))
    rank = F.row_number().over(W.partitionBy("country_iso3", "year").orderBy(*arrival))
    return entries.withColumn("_n", rank).withColumn("id", F.when(F.col("_n") > 1, F.concat_ws("_", base, F.col("_n").cast("string"))).otherwise(base)).drop("_n")


def from_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by the names of the PDF files in a folder: ISO3_YEAR[_N].pdf. Files are listed, not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", F.col("length").alias("file_size_bytes"))
    name = F.regexp_extract("path", r"([^/]+)\.pdf$", 1)
    parts = F.split(name, "_")
    return files.select(name.alias("id"), F.get(parts, F.lit(0)).alias("country_iso3"), F.get(parts, F.lit(1)).try_cast("int").alias("year"), "file_size_bytes")


def checked(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with a code of three capitals and a year of 1980 to 2099, or none; and the others."""
    good = F.coalesce(F.col("country_iso3").rlike("^[A-Z]{3}$"), F.lit(False)) & F.coalesce(F.col("year").between(1980, 2099), F.lit(True))
    return entries.where(good), entries.where(~good)


def loadable(entries: DataFrame, *arrival: str) -> DataFrame:
    """Downloaded or amending documents; of equal ids the first to arrive."""
    some = entries.where("downloaded or is_amendment")
    return some.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(*arrival))).where("_n = 1").drop("_n")


def pending(entries: DataFrame, texts: DataFrame, outputs: DataFrame) -> DataFrame:
    """Documents to extract: downloaded, no image only, no amendment, with a text, and without an output so far."""
    some = entries.where("downloaded and not coalesce(needs_ocr, false) and not coalesce(is_amendment, false)")
    return some.join(texts.select("id"), "id", "left_semi").join(outputs.select("id"), "id", "left_anti")


#: Languages and what the local engine calls them; and those that the hosted one reads better.
TESSERACT = {
    "en": "eng", "fr": "fra", "es": "spa", "pt": "por",
    "de": "deu", "nl": "nld", "ru": "rus", "uk": "ukr",
    "ar": "ara", "zh": "chi_sim", "ja": "jpn", "ko": "kor",
    "da": "dan", "sv": "swe", "fi": "fin", "no": "nor",
    "pl": "pol", "cs": "ces", "ro": "ron", "hu": "hun",
}
VISION = ("ar", "zh")


def ocr_engine(language, vision: bool = True):
    """Which engine reads a language, and under what name; vision: whether the hosted engine can be had."""
    names = F.create_map(*(F.lit(x) for pair in TESSERACT.items() for x in pair))
    local = F.concat(F.lit("tesseract:"), F.coalesce(names[language], F.lit("eng")))
    return F.when(language.isin(*VISION), F.lit("vision")).otherwise(local) if vision else local


def needs_ocr(pages: DataFrame, least: int = 100) -> DataFrame:
    """Documents whose pages have fewer characters than `least` on average."""
    return pages.groupBy("id").agg(F.avg("char_count").alias("avg_chars_per_page")).select("id", "avg_chars_per_page", (F.col("avg_chars_per_page") < least).alias("needs_ocr"))
