"""Resolving differently spelled names into stable entities.

Records of one block (a country) whose names are alike are one entity, and so
are records linked through others. Equal names, the order of their words aside,
always link; so only distinct names are compared, and only those of a length
that can reach the threshold at all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import Names, alike_pairs, alphabet_of, sorted_words
from ..sources.shared import written
from .graph import components, forest, lookup

#: The least similarity of names, and of names declared in one year.
THRESHOLD, SAME_YEAR = 85.0, 95.0
#: Laboratories whose formal names have grown and shrunk beyond likeness (form A1).
ANCHORS = (("CAN", "National Microbiology Laboratory"), ("CAN", "National Centre for Foreign Animal Disease"))
FORMATS = {"A1": "%s_%03d", "G": "%s_V%03d", "A2": "%s_D%03d"}


#: Names of one part; every two parts of like lengths are compared in a task of their own.
PART = 2048


def cells(names: DataFrame, threshold: float) -> DataFrame:
    """names (block, name_id, words, ...) dealt for comparison: a row for each cell that a name is in, with its side there.

    Two names can reach the threshold only if the longer is at most (200 -
    threshold) / threshold times as long, so they are in one band of lengths or
    in neighbouring ones. A band of a block is dealt into parts of about PART
    names; a cell is two parts of such bands, or one part with itself."""
    most = (200 - threshold) / threshold
    banded = names.withColumn("band", F.floor(F.log(F.length("words").cast("double")) / math.log(most)).cast("int"))
    # a row a block and band
    counts = written(banded.groupBy("block", "band").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int")))
    above = counts.select("block", (F.col("band") - 1).alias("band"), F.col("parts").alias("above"))
    below = counts.select("block", (F.col("band") + 1).alias("band"), F.col("parts").alias("below"))
    key = F.xxhash64("block", "band").alias("key")
    sizes = counts.join(above, ["block", "band"], "left").join(below, ["block", "band"], "left").select(key, "n", "parts", F.coalesce("above", F.lit(0)).alias("above"), F.coalesce("below", F.lit(0)).alias("below"))
    # two bands with one key would only be dealt alike
    sizes = sizes.groupBy("key").agg(F.sum("n").alias("n"), *(F.max(c).alias(c) for c in ("parts", "above", "below")))
    dealt = lookup(banded.withColumn("key", key), sizes, "key", "n", names.count()).withColumn("part", F.pmod(F.xxhash64("name_id"), F.greatest("parts", F.lit(1))).cast("int"))
    count = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda band, low, high, side: F.struct(band.alias("band"), low.alias("low"), high.alias("high"), side.alias("side"))
    none = F.lit(-1)
    own = F.transform(count("parts"), lambda p: F.when(p == F.col("part"), cell(F.col("band") * 2, p, none, F.lit(0))).otherwise(cell(F.col("band") * 2, F.least(p, "part"), F.greatest(p, "part"), (F.col("part") > p).cast("int"))))
    up = F.transform(count("above"), lambda p: cell(F.col("band") * 2 + 1, F.col("part"), p, F.lit(0)))
    down = F.transform(count("below"), lambda p: cell(F.col("band") * 2 - 1, p, F.col("part"), F.lit(1)))
    return dealt.select(*names.columns, F.explode(F.concat(own, up, down)).alias("cell")).select(*names.columns, F.struct("cell.band", "cell.low", "cell.high").alias("cell"), "cell.side")


def _compared(table: pa.Table, threshold: float):
    """The names of a cell, and blocks of (row, row, score) of its pairs that reach the threshold."""
    words, side = table["words"].to_pylist(), table["side"].to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alphabet = alphabet_of(words)
    a = Names([words[i] for i in left], alphabet)
    if table["cell"][0].as_py()["high"] < 0:
        for x, y, score in alike_pairs(a, a, threshold, same=True):
            yield left[x], left[y], score
    elif len(right):
        for x, y, score in alike_pairs(a, Names([words[i] for i in right], alphabet), threshold):
            yield left[x], right[y], score


def alike(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs a < b of distinct names of one block that reach the threshold, with their score.

    names: block, name_id, words (sorted)."""

    def compare(table: pa.Table) -> pa.Table:
        ids = table["name_id"].to_numpy()
        found = [(ids[x], ids[y], score) for x, y, score in _compared(table, threshold)]
        a, b, score = (np.concatenate([np.empty(0, k), *(f[i] for f in found)]) for i, k in enumerate((np.int64, np.int64, float)))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": score})

    return cells(names.select("block", "name_id", "words"), threshold).groupBy("block", "cell").applyInArrow(compare, "a long, b long, score double")


def linked(names: DataFrame, threshold: float = THRESHOLD, same_year: float = SAME_YEAR) -> DataFrame:
    """Edges (a, b) that connect all names of one block whose records link, as a forest of each cell.

    names: block, name_id, words, first, last (years), undated."""

    def compare(table: pa.Table) -> pa.Table:
        ids = table["name_id"].to_numpy()
        dated = ~table["undated"].to_numpy(zero_copy_only=False).astype(bool)
        first, last = (pc.fill_null(table[c], 0).to_numpy() for c in ("first", "last"))
        single = dated & (first == last)
        a = b = np.empty(0, np.int64)
        for x, y, score in _compared(table, threshold):
            good = (score >= same_year) | ~(single[x] & single[y] & (first[x] == first[y]))
            a, b = forest(np.concatenate([a, ids[x[good]]]), np.concatenate([b, ids[y[good]]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells(names.select("block", "name_id", "words", "first", "last", "undated"), threshold).groupBy("block", "cell").applyInArrow(compare, "a long, b long")


def resolve_entities(records: DataFrame, kind: str = "A1", anchors: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """(place, canonical_id) of each record.

    records: place (a distinct number that orders them), country_iso3, name,
    year. Names link at 85 or more, at 95 or more if both are declared in one
    year only, the same; an empty or unknown name links to none; names that
    hold an anchor (country, text in any case; for A1 there are some by default) are one. Entities of a country
    are numbered by their first record. A missing country is UNK.
    """
    rows = records.select("place", F.coalesce("country_iso3", F.lit("UNK")).alias("block"), F.coalesce("name", F.lit("")).alias("name"), F.nullif("year", F.lit(0)).alias("year")).withColumn("words", sorted_words(F.col("name")))
    named = rows.where("words <> ''")
    # a row a name: years tell whether two names were declared in one year only, the same
    names = written(named.groupBy("block", "words").agg(F.min("place").alias("name_id"), F.min("year").alias("first"), F.max("year").alias("last"), F.bool_or(F.col("year").isNull()).alias("undated"), F.collect_set(F.lower("name")).alias("spellings")))
    edges = linked(names)
    for country, text in ANCHORS if anchors is None and kind == "A1" else anchors or ():
        held = names.where((F.col("block") == country) & F.exists("spellings", lambda s: s.contains(text.lower()))).select("name_id")
        first = held.agg(F.min("name_id").alias("a"))
        edges = edges.union(held.crossJoin(first).select("a", F.col("name_id").alias("b")))
    roots = names.select("block", "words", "name_id").join(components(edges).withColumnRenamed("node", "name_id"), "name_id", "left").select("block", "words", F.coalesce("root", "name_id").alias("root"))
    # a root is its component's least name_id, which is its first record's place; a nameless record is its own
    placed = rows.join(roots, ["block", "words"], "left").select("place", "block", F.coalesce("root", "place").alias("root"))
    numbered = placed.select("block", "root").distinct().withColumn("n", F.dense_rank().over(W.partitionBy("block").orderBy("root")))
    return placed.join(numbered, ["block", "root"]).select("place", F.format_string(FORMATS[kind], "block", "n").alias("canonical_id"))
