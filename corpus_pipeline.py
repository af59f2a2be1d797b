"""A corpus pipeline: what is kept of `documents`, packed for training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yearbook.llm.lines import drop_shared_lines
from yearbook.llm.packing import pack
from yearbook.llm.patterns import contamination
from yearbook.llm.queries import table, tokenizer_path
from yearbook.llm.rulefit import learned, scored
from yearbook.llm.simhash import one_of_each
from yearbook.sources.shared import settled


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality 1."""
    model = learned(docs, table(spark, sf_dir, "labels"), "quality")
    return scored(docs, model, carry=tuple(docs.columns)).where("predicted = 1").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document with a smaller id has; n_chars is that of the new text."""
    out = drop_shared_lines(docs, carry=tuple(docs.columns))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(new.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, five-word shingles of similarity 0.8 or over: that with the smallest id."""
    return one_of_each(docs, k=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    out = contamination(docs, table(spark, sf_dir, "benchmark"), carry=tuple(docs.columns))
    return out.where("n_hit = 0").select(*(F.col(f"carried.`{c}`").alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: its sequence, its place there, and the crc32 of its ids."""
    return pack(docs, tokenizer_path(), 4096, 1)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]
#: SQL cannot express the classifier, the fingerprints and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written and read again for the next; what a stage wrote on its way is deleted."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
