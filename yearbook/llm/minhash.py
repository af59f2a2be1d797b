"""Sets of shingles: bands that find candidates beyond fingerprints' reach, and exact similarity.

A text is the set of its shingles, as 64-bit hashes. Candidates share a band of
ROWS minhashes, any of BANDS: two sets of similarity s miss each other with
probability (1 - s**ROWS)**BANDS, 7e-10 at 0.8. Bands meet in shards of their
hashed range, which send on a spanning forest only. The candidates that edges
join are then verified: the exact similarity of every pair of one such group
decides, so that what candidates are joined by costs work and never a result.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import forest, lookup
from .exchange import U64, by_shard, from_low_bytes, low_bytes, ranges, runs, shards_of, shuffle_partitions, written
from .memory import freed, freeing
from .shingles import _spread, shingled
from .textbytes import mix, parts

BANDS, ROWS = 40, 4
#: Keys of a shard, at least and at most (see exchange.shards_of).
SHARD_KEYS, MOST_KEYS = 1 << 18, 1 << 25
#: Odd multipliers, each the order of one minhash.
ORDERS = np.random.default_rng(5).integers(0, 2**64, (BANDS, ROWS), U64) | U64(1)
#: Shingles of a group that are compared in one task; of more, every two parts are compared in tasks of their own.
GROUP = 1 << 21


def sets_of(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, one text after the other; and where each begins, and the end. h is sorted in place."""
    ends = np.cumsum(count)
    for i, j in zip((ends - count).tolist(), ends.tolist()):
        h[i:j].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[(ends - count)[count > 0]] = True
    total = np.concatenate([[0], np.cumsum(new)])
    return h[new], np.concatenate([[0], total[ends]])


def band_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The keys of the bands of each set, a row a set; sets are not empty."""
    out = np.empty((len(at) - 1, BANDS), U64)
    for band, orders in enumerate(ORDERS):
        key = np.full(len(out), band, U64)
        for order in orders:
            key = mix(key ^ np.minimum.reduceat(h * order, at[:-1]))
        out[:, band] = key
    return out


def alike(h: np.ndarray, at: np.ndarray, similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of pairs at or over the similarity that connect all such pairs.

    A breadth-first search that compares a set with the unvisited only. Of those, it
    counts the common shingles where one of the rarest n - ceil(similarity * n) + 1 shingles of
    either is in both: two sets of that similarity have such a shingle."""
    size = np.diff(at)
    n = len(size)
    owner = np.repeat(np.arange(n), size)
    _, shingle, df = np.unique(h, return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    token = rank[shingle]
    token = token[np.lexsort((token, owner))]  # the rarest of each set first
    head = size + (-size * similarity.numerator) // similarity.denominator + 1
    entry, place = token[_spread(at[:-1], head)], np.repeat(np.arange(n), head)
    order = np.argsort(entry, kind="stable")
    entry, place = entry[order], place[order]
    todo, mark = np.ones(n, bool), np.zeros(len(df), bool)
    left = built = n
    found_a, found_b = [], []
    for start in range(n):
        if not todo[start]:
            continue
        todo[start] = False
        left -= 1
        open_ = [start]
        while open_ and left:
            if 2 * left < built:  # visited sets leave the index
                entry, place, built = entry[todo[place]], place[todo[place]], left
            i = open_.pop()
            own = token[at[i] : at[i + 1]]
            first = np.searchsorted(entry, own[: head[i]], "left")
            near = np.unique(place[_spread(first, np.searchsorted(entry, own[: head[i]], "right") - first)])
            near = near[todo[near]]
            if not len(near):
                continue
            mark[own] = True
            common = np.add.reduceat(mark[token[_spread(at[near], size[near])]].astype(np.int64), np.cumsum(size[near]) - size[near])
            mark[own] = False
            near = near[common * similarity.denominator >= similarity.numerator * (size[i] + size[near] - common)]
            todo[near] = False
            left -= len(near)
            open_ += near.tolist()
            found_a.append(np.full(len(near), i))
            found_b.append(near)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def candidates(nodes: DataFrame, count: int | None = None) -> DataFrame:
    """Edges (a, b) that connect all nodes that share a key; nodes: (node, keys), about so many."""
    n, tasks = shards_of(nodes.sparkSession, (nodes.count() if count is None else count) * BANDS, SHARD_KEYS, MOST_KEYS)

    def cells(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 8192):
                some = batch.slice(i, 8192)
                ids, lists = some.column(0).to_numpy(), some.column(1)
                keys = lists.flatten().to_numpy().view(U64)
                places = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
                order = np.argsort(keys)
                keys, places = keys[order], ids[places[order]]
                shards, data = [], []
                for shard, cut in ranges(keys, n):
                    shards.append(shard)
                    data.append(places[cut].tobytes() + low_bytes(keys[cut]))
                yield pa.record_batch({"shard": pa.array(shards, pa.int32()), "payload": pa.array(data, pa.binary())})

    def join(table: pa.Table) -> pa.Table:
        keys, ids = [], []
        for data in table["payload"].to_pylist():
            count = len(data) // 14
            ids.append(np.frombuffer(data, np.int64, count))
            keys.append(from_low_bytes(data[8 * count :]))
        keys, ids = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order].view(U64)
        heads = runs(keys)
        first = np.repeat(ids[heads], np.diff(np.append(heads, len(keys))))
        some = first != ids
        a, b = forest(first[some], ids[some])
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return by_shard(nodes.select("node", "keys").mapInArrow(freeing(cells), "shard int, payload binary"), tasks).applyInArrow(lambda t: freed(join(t)), "a long, b long")


def verified(texts: DataFrame, k: int, similarity: float, most: int = GROUP) -> DataFrame:
    """Edges (a, b) that connect all nodes of one group at or over the similarity; texts: (node, root, text), root the group's."""
    n, share = max(8, shuffle_partitions(texts.sparkSession)), Fraction(similarity).limit_denominator(10**6)

    def shingles(batches):
        for batch in batches:
            for rows, some in parts(batch, 2):
                h, at = sets_of(*shingled(some, k, 42))
                yield pa.record_batch({"node": rows.column(0), "root": rows.column(1), "n": pa.array(np.diff(at), pa.int64()), "shingles": pa.array([h[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())})

    sets = written(texts.select("node", "root", "text").mapInArrow(freeing(shingles), "node long, root long, n long, shingles binary"))
    total = sets.groupBy("root").agg(F.ceil(F.sum("n") / most).cast("int").alias("parts"), F.count("*").alias("sets"))
    dealt = lookup(sets, total, "root", "sets", sets.count()).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # each part meets each other one; groups of one part share cells
    other = F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("part")))).alias("other")
    cell = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("root"), F.lit(n))).otherwise(F.xxhash64("root", F.least("part", "other"), F.greatest("part", "other"))).alias("cell")

    def compare(table: pa.Table) -> pa.Table:
        roots = table["root"].to_numpy()
        order = np.argsort(roots, kind="stable")
        nodes, data = table["node"].to_numpy()[order], table["shingles"].to_pylist()
        heads = runs(roots[order])
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, j in zip(heads.tolist(), np.append(heads[1:], len(order)).tolist()):
            own = [np.frombuffer(data[x], U64) for x in order[i:j].tolist()]
            x, y = alike(np.concatenate(own), np.concatenate([[0], np.cumsum([len(z) for z in own])]), share)
            a.append(nodes[i:j][x])
            b.append(nodes[i:j][y])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return dealt.select("node", "root", "shingles", "part", "parts", other).select(cell, "node", "root", "shingles").groupBy("cell").applyInArrow(lambda t: freed(compare(t)), "a long, b long")
