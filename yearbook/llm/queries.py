"""The registered queries of this subpackage: thin digests of its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .ans import coded_tokens
from .lines import drop_shared_lines
from .packing import pack
from .pages import main_text
from .patterns import contamination
from .rulefit import held_out, learned, scored
from .rules import quality_rules
from .simhash import near_duplicates
from .substring import remove_repeats
from .suffix import remove_repeated_bytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), 4096, 1)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coded_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), 2)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, learned(docs, table(spark, sf_dir, "labels"), "quality"), carry=("doc_id",))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_shared_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_substring_dedup, op2_simhash_near_dedup, op3_quality_rules, op4_suffix_array_dedup, op5_best_fit_packing, op6_token_files,
        op7_quality_classifier, op8_html_extraction, op9_benchmark_decontamination, op10_line_dedup,
    )}


def oracle_sql() -> dict[str, str]:
    """The others need a hash, a tokenizer, a fitted model, 400-byte strings at every byte, or a page's tags."""
    return {"op1_substring_dedup": oracle.OP1, "op3_quality_rules": oracle.OP3, "op9_benchmark_decontamination": oracle.OP9, "op10_line_dedup": oracle.OP10}
