"""Text operators over the supplied documents, and their SQL; an extension over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import text as T
from .registry import query


def _documents(t):
    return t.spark.read.parquet(f"{t._dir}/documents.parquet")


query("text_chunks", """SELECT doc_id, CAST(len(text) AS INT) AS n, CAST(ceil(len(text) / 1000.0) AS INT) AS chunks, substring(text, 1, 1000) AS first FROM documents""")(
    lambda t: _documents(t).withColumn("c", T.fixed_chunks(F.col("text"), 1000)).select("doc_id", F.length("text").alias("n"), F.size("c").alias("chunks"), F.coalesce(F.get("c", F.lit(0)), F.lit("")).alias("first"))
)
query("text_chunk_rows", """SELECT doc_id, CAST(place AS INT) AS place, substring(text, place * 1000 + 1, 1000) AS chunk
FROM (SELECT doc_id, text, unnest(range(CAST(ceil(len(text) / 1000.0) AS BIGINT))) AS place FROM documents)""")(
    lambda t: _documents(t).select("doc_id", F.posexplode(T.fixed_chunks(F.col("text"), 1000)).alias("place", "chunk"))
)
_NTD = "concat('--- PAGE 1 ---', chr(10), text, chr(10), CASE WHEN doc_id % 3 = 0 THEN 'Nothing new  to declare.' ELSE '.' END)"
_CONTENT = rf"regexp_replace(regexp_replace({_NTD}, '(?m)^--- PAGE \d+ ---$', '', 'g'), '^\s+|\s+$', '', 'g')"
query("nothing_to_declare", rf"""SELECT doc_id, regexp_matches({_CONTENT}, '(?i)nothing\s+(new\s+)?to\s+declare|nothing\s+to\s+report|no\s+declaration\s+(is\s+)?required|no\s+activities\s+to\s+report')
  AND len({_CONTENT}) < 2000 AS nothing FROM documents""")(
    lambda t: _documents(t).select("doc_id", T.nothing_to_declare(F.concat(F.lit("--- PAGE 1 ---\n"), "text", F.lit("\n"), F.when(F.col("doc_id") % 3 == 0, "Nothing new  to declare.").otherwise("."))).alias("nothing"))
)
query("organism_tokens", "SELECT p_partkey, array_to_string(CASE WHEN len(p_type) > 3 AND p_name <> p_type THEN [p_name, p_type] ELSE [p_name] END, '|') AS tokens FROM part")(
    lambda t: t._table("part").select("p_partkey", F.array_join(X.organism_tokens(F.concat_ws("; ", "p_name", "p_type", F.lit("abc"), "p_name")), "|").alias("tokens"))
)
query("slugs", "SELECT s_suppkey, concat('the-', replace(lower(s_name), '#', '-'), '-x') AS slug FROM supplier")(lambda t: t._table("supplier").select("s_suppkey", X.slug(F.concat(F.lit("--The "), "s_name", F.lit(" / x!"))).alias("slug")))
query("coercions", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus = 'O' THEN false END AS flag, CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderkey AS INT) END AS number, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders""")(
    lambda t: t._table("orders").select("o_orderkey", X.to_bool(F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "0").otherwise("Yes")).alias("flag"),
        X.to_int(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey").cast("string")).otherwise("1.0")).alias("number"), X.to_double(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("string")).otherwise(" ")).alias("price"))
)
query("address_variants", "SELECT s_suppkey, concat('Institute, 5 Road, City|5 Road, City|', s_name) AS variants FROM supplier")(
    lambda t: t._table("supplier").select("s_suppkey", F.array_join(F.transform(X.address_variants(F.lit("Institute,  5 Road, City"), F.col("s_name")), lambda v: F.coalesce(v.getField("address"), v.getField("city"))), "|").alias("variants"))
)
query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL")(lambda t: _windows(t))


def _windows(t):
    from ..streaming.windows import windowed

    return windowed(t.spark.read.parquet(f"{t._dir}/events.parquet"))
