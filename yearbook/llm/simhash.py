"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. The perfect
Golay code (23, 12) decodes a segment to the codewords within 4 bits of it: one,
or six for segments 3 bits off the nearest. Two segments at most 2 bits apart
have such a codeword in common, and the nearest codeword of one at most 1 bit
apart is among those of the other. Four or fewer differing bits over three
segments leave
- a segment without any, and another with 2 or fewer: keys of one segment as
  it is and a codeword of another (34 bits and the choice of the two); or
- two segments with 1 each and the third with 2 or fewer: keys of three
  codewords (36 bits), where the index side takes the nearest codewords of two
  segments and the probing side all codewords of all three.
Keys meet in shards of their hashed range; every pair that shares one is
verified by its exact distance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components, forest, lookup
from .exchange import U64, by_shard, from_low_bytes, low_bytes, ranges, runs, shards_of, shuffle_partitions, written
from .memory import freed, freeing
from .minhash import BANDS, GROUP, MOST_KEYS, SHARD_KEYS, band_keys, candidates, sets_of, verified
from .shingles import _spread, majority, shingled
from .textbytes import mix, parts

SEGMENTS = (22, 21, 21)
#: The generator polynomial of the (23, 12) Golay code: a fixed value.
GENERATOR = 0b101011100011
#: Keys of a fingerprint, about.
KEYS = 200
#: Pairs verified at a time.
PAIRS = 1 << 21
#: Fingerprints of one key that a shard compares by itself; of more, parts are compared in tasks of their own.
HOT = 1 << 13


def _tables():
    """Syndromes of the upper 12 bits, and for each syndrome the error patterns of up to 4 bits."""

    def rest(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - 11)
        return x

    upper = np.array([rest(i << 11) for i in range(4096)], np.uint32)
    of = [rest(1 << k) for k in range(23)]
    errors = np.full((2048, 6), -1, np.int64)
    count = np.zeros(2048, int)
    for w in range(5):
        for c in combinations(range(23), w):
            s = 0
            for k in c:
                s ^= of[k]
            errors[s, count[s]] = sum(1 << k for k in c)
            count[s] += 1
    return upper, errors


UPPER, ERRORS = _tables()


def codewords(segment: np.ndarray) -> np.ndarray:
    """Six columns: indices of the codewords within 4 bits, the nearest first; -1 where there are fewer."""
    e = ERRORS[UPPER[segment >> 11] ^ (segment & 0x7FF)]
    return np.where(e >= 0, (segment[:, None] ^ e) >> 11, -1)


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed keys and the fingerprints' places; bit 0 is set in keys that only probe."""
    values, shift = [], 0
    for bits in SEGMENTS:
        values.append(((prints >> U64(shift)) & U64((1 << bits) - 1)).astype(np.int64))
        shift += bits
    near = [codewords(v) for v in values]
    place = np.arange(len(prints))
    keys, places, probes = [], [], []

    def add(key: np.ndarray, good: np.ndarray, probe: int):
        keys.append(key[good].astype(U64))
        places.append(np.broadcast_to(place.reshape(-1, *[1] * (key.ndim - 1)), key.shape)[good])
        probes.append(np.full(len(keys[-1]), probe, U64))

    for i in range(3):
        for j in range(3):
            if i != j:
                add(((i * 3 + j) << 40) | (values[i][:, None] << 12) | near[j], near[j] >= 0, 0)
    a, b, c = near
    triple = lambda x, y, z: (9 << 40) | (x[:, :, None, None] << 24) | (y[:, None, :, None] << 12) | z[:, None, None, :]
    good = lambda x, y, z: (x >= 0)[:, :, None, None] & (y >= 0)[:, None, :, None] & (z >= 0)[:, None, None, :]
    for x, y, z, probe in ((a, b[:, :1], c[:, :1], 0), (a[:, :1], b[:, 1:], c[:, :1], 0), (a[:, :1], b[:, :1], c[:, 1:], 0), (a, b, c, 1)):
        add(triple(x, y, z), good(x, y, z), probe)
    key = mix(np.concatenate(keys)) & ~U64(1) | np.concatenate(probes)
    return key, np.concatenate(places)


def linked(keys: np.ndarray, prints: np.ndarray, most: int, hot: int = 2**62) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Links between fingerprints that share a key and differ in `most` bits or fewer, as a forest.

    Keys of more than `hot` entries are left out, and returned with their distinct fingerprints."""
    order = np.argsort(keys)
    keys, prints = keys[order], prints[order]
    heads = runs(keys >> U64(1))
    size = np.diff(np.append(heads, len(keys)))
    index = np.add.reduceat((keys & U64(1) == 0).astype(np.int64), heads) if len(heads) else size
    # in a run, index entries come first: each is compared with all that follow it
    live = (size > 1) & (index > 0)
    large = [(int(keys[h]), np.unique(prints[h : h + n])) for h, n in zip(heads[live & (size > hot)], size[live & (size > hot)])]
    live &= size <= hot
    first = _spread(heads[live], index[live])
    after = np.repeat((heads + size)[live], index[live]) - first - 1
    found_a, found_b = [], []
    total = np.cumsum(after)
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, "right")))
        n = after[i:j]
        left = np.repeat(first[i:j], n)
        right = _spread(first[i:j] + 1, n)
        for k in range(0, len(left), PAIRS):
            x, y = prints[left[k : k + PAIRS]], prints[right[k : k + PAIRS]]
            close = (np.bitwise_count(x ^ y) <= most) & (x != y)
            found_a.append(np.minimum(x[close], y[close]))
            found_b.append(np.maximum(x[close], y[close]))
        if sum(map(len, found_a)) > PAIRS:
            a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b = [a], [b]
        i = j
    if not found_a:
        return np.empty(0, U64), np.empty(0, U64), large
    return *forest(np.concatenate(found_a), np.concatenate(found_b)), large


def between(x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two sets of fingerprints, as a forest."""
    a, b = np.empty(0, U64), np.empty(0, U64)
    step = max(1, PAIRS // max(1, len(y)))
    for i in range(0, len(x), step):
        some = x[i : i + step, None]
        p, q = np.nonzero((np.bitwise_count(some ^ y) <= most) & (some != y))
        left, right = some[p, 0], y[q]
        a, b = forest(np.concatenate([a, np.minimum(left, right)]), np.concatenate([b, np.maximum(left, right)]))
    return a, b


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fingerprint (long) and the struct `carried`, of the columns named
    in carry, of every whole text.

    Words are lower-cased (A-Z) runs of bytes other than space and 0x09-0x0D;
    shingles are k words joined by a space, repeats included; a text of fewer
    words is one shingle; one without words, or null, has fingerprint zero. A
    bit is set if it is set in over half of the shingles' XXH64."""

    def prints(batches):
        for batch in batches:
            for rows, texts in parts(batch, 1):
                yield pa.record_batch({"doc_id": rows.column(0), "fingerprint": pa.array(majority(*shingled(texts, k, seed)).view(np.int64)), "carried": rows.column(2)})

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(F.lit(0).alias("_none"), *(F.col(c) for c in carry)).alias("carried"))
    return source.mapInArrow(freeing(prints), f"doc_id long, fingerprint long, carried {source.schema['carried'].dataType.simpleString()}")


def links(classes: DataFrame, most: int = 4, hot: int = HOT) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within `most` (4 or fewer) bits of each other.

    A shard compares the entries of each of its keys, in blocks. The entries of
    a key with more than `hot` are dealt into parts instead, and every two
    parts are compared in a task of their own."""
    if most > 4:
        raise ValueError("the keys find pairs of 4 or fewer differing bits")
    n = max(8, shuffle_partitions(classes.sparkSession))
    shards, tasks = shards_of(classes.sparkSession, classes.count() * KEYS, SHARD_KEYS, MOST_KEYS)

    def cells(batches):
        for batch in batches:
            prints = batch.column(0).to_numpy().view(U64)
            for i in range(0, len(prints), 8192):
                some = prints[i : i + 8192]
                keys, places = keys_of(some)
                order = np.argsort(keys)
                keys, places = keys[order], places[order].astype("<u2")
                own, data = [], []
                for shard, cut in ranges(keys, shards):
                    # the fingerprints that have keys here, and each key's place among them
                    used, place = np.unique(places[cut], return_inverse=True)
                    own.append(shard)
                    data.append(len(used).to_bytes(4, "little") + some[used].tobytes() + place.astype("<u2").tobytes() + low_bytes(keys[cut]))
                yield pa.record_batch({"shard": pa.array(own, pa.int32()), "payload": pa.array(data, pa.binary())})

    def link(table: pa.Table) -> pa.Table:
        keys, prints = [], []
        for data in table["payload"].to_pylist():
            m = 4 + 8 * int.from_bytes(data[:4], "little")
            count = (len(data) - m) // 8
            prints.append(np.frombuffer(data[4:m], U64)[np.frombuffer(data, "<u2", count, m)])
            keys.append(from_low_bytes(data[m + 2 * count :]))
        a, b, large = linked(np.concatenate(keys), np.concatenate(prints), most, hot)
        # within a shard a key is its 48 low bits (see low_bytes); if two keys got one name, more would be compared
        name = lambda key: (table["shard"][0].as_py() * 0x9E3779B97F4A7C15 ^ key) & (2**63 - 1)
        parts = [(name(key), k, -(-len(p) // hot), p[k * hot : (k + 1) * hot].tobytes()) for key, p in large for k in range(-(-len(p) // hot))]
        none = [None] * len(parts)
        key, part, count, own = (list(c) for c in zip(*parts)) if parts else ([], [], [], [])
        pad = [None] * len(a)
        return pa.table({"a": pa.array([*a.view(np.int64).tolist(), *none], pa.int64()), "b": pa.array([*b.view(np.int64).tolist(), *none], pa.int64()), "key": pa.array([*pad, *key], pa.int64()), "part": pa.array([*pad, *part], pa.int32()), "parts": pa.array([*pad, *count], pa.int32()), "prints": pa.array([*pad, *own], pa.binary())})

    def compare(batches):
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = between(np.frombuffer(x, U64), np.frombuffer(y, U64), most)
                yield pa.record_batch({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    found = written(by_shard(classes.select("fingerprint").repartition(n).mapInArrow(freeing(cells), "shard int, payload binary"), tasks).applyInArrow(lambda t: freed(link(t)), "a long, b long, key long, part int, parts int, prints binary"))
    edges, large = found.where("key is null").select("a", "b"), found.where("key is not null")
    if large.isEmpty():
        return edges
    left = large.select("key", "part", F.col("prints").alias("x"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("other"))
    right = large.select("key", F.col("part").alias("other"), F.col("prints").alias("y"))
    pairs = left.join(right, ["key", "other"]).repartition(n, "key", "part", "other").select("x", "y")
    return edges.unionByName(pairs.mapInArrow(freeing(compare), "a long, b long"))


def grouped(prints: DataFrame, most: int) -> DataFrame:
    """(fingerprint, root): for each distinct fingerprint the least one that links lead to."""
    classes = written(prints.select("fingerprint").distinct())
    root = components(links(classes, most))
    return classes.join(root, classes["fingerprint"] == root["node"], "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4) -> DataFrame:
    """doc_id, fingerprint (long) and component_id of every document.

    Documents link if their fingerprints differ in `most` bits or fewer;
    component_id is the smallest doc_id that links lead to, its own included.
    Equal fingerprints, those of empty and null texts too, are one node of the
    graph, however many documents have them. Rows with equal ids count one by
    one; null ids are never a component's, unless it has no other. Other
    columns are ignored; an empty table gives an empty result.
    """
    prints = written(fingerprints(docs, id_col, text_col).drop("carried"))
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    placed = written(grouped(prints, most).join(least, "fingerprint"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    # a component may have any share of the fingerprints, and a fingerprint any share of the rows
    ids = written(lookup(placed, named, "root", "m", placed.count()).select("fingerprint", "component_id", "n"))
    return lookup(prints, ids, "fingerprint", "n", prints.count()).select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, bits: int = 4, most: int = GROUP) -> DataFrame:
    """The rows of docs, all columns, but of each group of near duplicates only the one with the smallest id.

    Whole texts link if the Jaccard similarity of their sets of k-word shingles
    is at or over `similarity`, and a group is all that links lead to. Candidates
    are fingerprints of k-word shingles within `bits` (linked by Golay keys) and,
    as similar texts may differ in more bits than any such keys reach, texts that
    share a band of minhashes; the exact similarity decides on both. Words and
    shingles are those of simhash.fingerprints: a text of fewer words is one
    shingle, and those without words, or null, are equal. A row with an id goes
    before one without; of rows with equal ids any one stays. An empty table
    gives an empty result."""

    def keyed(batches):
        for batch in batches:
            for rows, texts in parts(batch, 1):
                h, count = shingled(texts, k, 42)
                prints = majority(h, count)
                h, at = sets_of(h, count)
                has = np.flatnonzero(np.diff(at))
                start = at[:-1][has]
                digest, keys = np.zeros((len(texts), 2), U64), np.empty((0, BANDS), U64)
                if len(has):
                    for i, salt in enumerate((0, 0x9E3779B97F4A7C15)):
                        digest[has, i] = np.add.reduceat(mix(h ^ U64(salt)), start)
                    keys = band_keys(h, np.append(start, len(h)))
                at = np.concatenate([[0], np.cumsum(BANDS * (np.diff(at) > 0))])
                yield pa.record_batch({"doc_id": rows.column(0), "fingerprint": pa.array(prints.view(np.int64)), "digest": pa.array([x.tobytes() for x in digest], pa.binary()), "keys": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys.ravel().view(np.int64))), "carried": rows.column(2)})

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(F.lit(0).alias("_none"), *(F.col(c) for c in docs.columns)).alias("carried"))
    made = source.mapInArrow(freeing(keyed), f"doc_id long, fingerprint long, digest binary, keys array<long>, carried {source.schema['carried'].dataType.simpleString()}")
    rows = written(made.withColumn("row", F.monotonically_increasing_id()))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    least = rows.select("digest", first.alias("first")).groupBy("digest").agg(F.min("first").alias("first"))
    nodes = written(least.select(F.col("first.row").alias("node"), "first"))
    keyed_nodes = written(rows.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "fingerprint", "keys"))
    # of equal fingerprints, one node stands for all
    alike = written(keyed_nodes.groupBy("fingerprint").agg(F.min("node").alias("one"), F.count("*").alias("n")))
    same = lookup(keyed_nodes.select("node", "fingerprint"), alike, "fingerprint", "n", nodes.count()).select(F.col("node").alias("a"), F.col("one").alias("b"))
    golay = written(links(alike.select("fingerprint"), bits))
    for side, name in (("a", "x"), ("b", "y")):
        # a forest's root may be the end of any share of its edges
        ends = alike.select(F.col("fingerprint").alias(side), F.col("one").alias(name)).join(golay.groupBy(side).agg(F.count("*").alias("n")), side)
        golay = written(lookup(golay, ends, side, "n", golay.count()))
    golay = golay.select(F.col("x").alias("a"), F.col("y").alias("b"))
    bands = candidates(keyed_nodes.select("node", "keys"), nodes.count())
    joined = components(same.unionByName(golay).unionByName(bands))
    texts = rows.select(F.col("row").alias("node"), F.col(f"carried.`{text_col}`").cast("string").alias("text")).join(joined, "node")
    linked = components(verified(texts, k, similarity, most))
    chosen = nodes.join(linked, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select("first.row")
    return rows.join(chosen, "row", "left_semi").select(*(F.col(f"carried.`{c}`") for c in docs.columns))
