"""Benchmark decontamination by Wu-Manber multi-pattern search.

Test items become patterns: every `window` words in a row, between spaces.
Patterns of like length share a table. Its shift table says, for the last block
of bytes in view, how far the view may move without missing a pattern; where it
may not move, the block's bucket names the patterns that may end there, and a
direct comparison of all their bytes confirms them. A text is normalised, laid
out between spaces, and cut into lanes that move on in step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import U64
from .memory import freeing
from .shingles import _spread
from .textbytes import LOWER, Buffer, byte_set, cover, spans
from .textbytes import parts as batch_parts

#: Bytes between words, once A-Z is lower-cased.
GAP = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Bytes of items searched for in one pass over the documents; more are searched in several.
#: A word of an item is a pattern of ten words, so what is broadcast is some 25 times as much: 100 MB.
ITEM_BYTES = 4 << 20
#: Bytes of a lane, and the bits of a shift table's index.
LANE, TABLE_BITS = 512, 20
#: Least pattern length and block length of the classes.
CLASSES = ((32, 8), (16, 8), (8, 4), (3, 2))


class Laid:
    """Lower-cased words with a space before and after each; two spaces between texts."""

    def __init__(self, texts: list[bytes]):
        buffer = Buffer(texts)
        lowered = LOWER[buffer.data]
        starts, ends = spans(lowered, GAP)
        self.first, self.last = buffer.counts(starts)
        n = self.last - self.first
        lens = ends - starts
        self.starts = np.cumsum(lens + 1) - lens - 1 + np.repeat(np.arange(len(texts)), n) + 1
        self.ends = self.starts + lens
        size = int(lens.sum()) + len(lens) + len(texts)
        inside = np.zeros(size + 1, np.int8)
        inside[self.starts] += 1
        inside[self.ends] -= 1
        source = np.zeros(len(lowered) + 1, np.int8)
        source[starts] += 1
        source[ends] -= 1
        self.data = np.full(size, 0x20, np.uint8)
        self.data[np.cumsum(inside[:-1], dtype=np.int8) > 0] = lowered[np.cumsum(source[:-1], dtype=np.int8) > 0]


def windows(items: list[tuple[str, bytes]], window: int):
    """Patterns, the words in a row of each window between spaces, each once; their numbers of words; and for each window its pattern and its item's place."""
    found: dict[bytes, int] = {}
    words, pattern, owner = [], [], []
    for item, (_, text) in enumerate(items):
        laid = Laid([text])
        data, n = laid.data.tobytes(), len(laid.starts)
        for i in range(max(1, n - window + 1) if n else 0):
            j = min(i + window, n)
            k = found.setdefault(data[laid.starts[i] - 1 : laid.ends[j - 1] + 1], len(words))
            if k == len(words):
                words.append(j - i)
            pattern.append(k)
            owner.append(item)
    return list(found), np.array(words, np.int64), np.array(pattern, np.int64), np.array(owner, np.int64)


class WuManber:
    """Shift table and buckets of patterns of at least `least` bytes."""

    def __init__(self, patterns: list[bytes], block: int):
        self.least, self.block = min(map(len, patterns)), block
        self.lens = np.array([len(p) for p in patterns], np.int64)
        self.first = np.cumsum(self.lens) - self.lens
        self.data = np.frombuffer(b"".join(patterns) + bytes(8), np.uint8)
        self.shift = np.full(1 << TABLE_BITS, self.least - block + 1, np.uint16)
        for j in range(block, self.least + 1):
            np.minimum.at(self.shift, self.hashes(self.data, self.first + j), np.uint16(self.least - j))
        key = self.hashes(self.data, self.first + self.least)
        self.order = np.argsort(key, kind="stable")
        key = key[self.order]
        self.keys, self.heads, self.sizes = np.unique(key, return_index=True, return_counts=True)

    def hashes(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table's index of the block of bytes before each end."""
        words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        h = (words[ends - self.block] & U64((1 << 8 * self.block) - 1)) * U64(0x9E3779B97F4A7C15)
        return (h >> U64(64 - TABLE_BITS)).astype(np.int64)

    def candidates(self, data: np.ndarray, n: int) -> np.ndarray:
        """Ends of views where no shift is allowed. data has 8 bytes more than the n of text."""
        at = np.arange(self.least, n + 1, LANE)
        stop = np.minimum(at + LANE, n + 1)
        found = []
        while len(at):
            step = self.shift[self.hashes(data, at)].astype(np.int64)
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        return np.sort(np.concatenate(found)) if found else at

    def search(self, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of occurrences, and the patterns."""
        ends = self.candidates(data, n)
        out_at, out_pattern = [], []
        if len(ends):
            key = self.hashes(data, ends)
            row = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[row] == key
            ends, row = ends[known], row[known]
        for i in range(0, len(ends), 1 << 18):
            r = row[i : i + (1 << 18)]
            pattern = self.order[_spread(self.heads[r], self.sizes[r])]
            at = np.repeat(ends[i : i + (1 << 18)], self.sizes[r]) - self.least
            fits = at + self.lens[pattern] <= n
            at, pattern = self.confirmed(data, at[fits], pattern[fits])
            out_at.append(at)
            out_pattern.append(pattern)
        none = np.empty(0, np.int64)
        return np.concatenate([none, *out_at]), np.concatenate([none, *out_pattern])

    def confirmed(self, data: np.ndarray, at: np.ndarray, pattern: np.ndarray):
        """Those whose bytes are all equal, compared eight at a time."""
        text = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        mine = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        live, k = np.arange(len(at)), 0
        good = np.zeros(len(at), bool)
        while len(live):
            left = self.lens[pattern[live]] - k
            mask = np.where(left >= 8, U64(2**64 - 1), (U64(1) << (8 * np.minimum(left, 7)).astype(U64)) - U64(1))
            same = ((text[at[live] + k] ^ mine[self.first[pattern[live]] + k]) & mask) == 0
            live, left, k = live[same], left[same], k + 8
            good[live[left <= 8]] = True
            live = live[left > 8]
        return at[good], pattern[good]


class Searcher:
    """All patterns of a set of items: arrays, but for the items' names."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        patterns, self.words, pattern, owner = windows(items, window)
        self.names = [name for name, _ in items]
        order = np.lexsort((owner, pattern))
        pattern, owner = pattern[order], owner[order]
        new = np.ones(len(owner), bool)
        new[1:] = (pattern[1:] != pattern[:-1]) | (owner[1:] != owner[:-1])
        #: The items of all patterns, pattern after pattern, and where each one's begin and end.
        self.items = owner[new].astype(np.int32)
        self.ends = np.searchsorted(pattern[new], np.arange(len(patterns)), "right")
        self.tables, lens = [], np.array([len(p) for p in patterns], np.int64)
        rest = np.ones(len(patterns), bool)
        for least, block in CLASSES:
            own = np.flatnonzero(rest & (lens >= least))
            rest[own] = False
            if len(own):
                self.tables.append((WuManber([patterns[k] for k in own.tolist()], block), own))

    def names_of(self, patterns: np.ndarray) -> set[str]:
        """The names of the items that have any of the patterns."""
        some = np.unique(patterns)
        first = np.append(0, self.ends)[some]
        return {self.names[k] for k in np.unique(self.items[_spread(first, self.ends[some] - first)]).tolist()}

    def search(self, texts: list[bytes]):
        """The words; (first word, number) of every occurrence, its document and its pattern."""
        laid = Laid(texts)
        data = np.concatenate([laid.data, np.zeros(8, np.uint8)])
        none = np.empty(0, np.int64)
        firsts, found = [none], [none]
        for table, own in self.tables:
            at, pattern = table.search(data, len(laid.data))
            firsts.append(np.searchsorted(laid.starts, at + 1))
            found.append(own[pattern])
        first, pattern = np.concatenate(firsts), np.concatenate(found)
        return laid, first, self.words[pattern], np.searchsorted(laid.last, first, "right"), pattern


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, item_bytes: int = ITEM_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Where test items occur in documents.

    Words are runs of ASCII letters and digits and of bytes from 0x80, A-Z
    lower-cased. A window is `window` words of an item in a row; an item of
    fewer words is one window, one of none has no window. Returns doc_id,
    n_words, n_hit (words inside any occurrence of a window) and items (ids of
    items with occurring windows, as strings, sorted), then the columns named
    in carry, in a struct `carried`. A null text has no words; a null item id counts as an empty one;
    items with equal ids count as one; repeated rows are all searched. The
    items are read in parts of about item_bytes, one pass over the documents
    each, so their number is not bounded by memory; any number of documents,
    empty tables and other columns are fine.
    """
    spark = docs.sparkSession
    tests = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    total = tests.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = -(-total // item_bytes) or 1
    now = docs.select(F.col(id_col).cast("long").alias("_doc_id"), F.col(text_col).cast("string").alias("_text"), F.lit(None).cast("binary").alias("_runs"), F.array().cast("array<string>").alias("_items"), F.struct(F.lit(0).alias("_none"), *carry).alias("_carry"))
    for part in range(parts):
        some = tests if parts == 1 else tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        searcher = spark.sparkContext.broadcast(Searcher([(r["item"], r["text"].encode()) for r in some.collect()], window))

        def scan(batches, searcher=searcher):
            for batch in batches:
                for rows, texts in batch_parts(batch, 1):
                    laid, first, count, doc, pattern = searcher.value.search(texts)
                    runs, found = rows.column(2).to_pylist(), rows.column(3).to_pylist()
                    order = np.argsort(doc, kind="stable")
                    heads = np.flatnonzero(np.diff(doc[order], prepend=-1))
                    for i, j in zip(heads.tolist(), np.append(heads[1:], len(order)).tolist()):
                        d, own = int(doc[order[i]]), order[i:j]
                        pairs = np.stack([first[own] - laid.first[d], count[own]], axis=1).astype("<i8")
                        runs[d] = (runs[d] or b"") + np.unique(pairs, axis=0).tobytes()
                        found[d] = sorted(searcher.value.names_of(pattern[own]).union(found[d]))
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(runs, pa.binary()), pa.array(found, pa.list_(pa.string())), rows.column(4)], names=["_doc_id", "_text", "_runs", "_items", "_carry"])

        now = now.mapInArrow(freeing(scan), now.schema)

    def count_hits(batches):
        for batch in batches:
            for rows, texts in batch_parts(batch, 1):
                laid = Laid(texts)
                n = laid.last - laid.first
                hit = []
                for own, words in zip(rows.column(2).to_pylist(), n.tolist()):
                    pairs = np.frombuffer(own or b"", "<i8").reshape(-1, 2)
                    hit.append(int(cover(words, pairs[:, 0], pairs.sum(axis=1)).sum()) if own else 0)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), rows.column(3), rows.column(4)], names=["doc_id", "n_words", "n_hit", "items", "_carry"])

    carried = next(f.dataType for f in now.schema if f.name == "_carry")
    return now.mapInArrow(freeing(count_hits), f"doc_id long, n_words long, n_hit long, items array<string>, _carry {carried.simpleString()}").withColumnRenamed("_carry", "carried")
