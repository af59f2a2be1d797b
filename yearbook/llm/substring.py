"""Substring dedup by fixed-block anchors.

Any `window` words in a row hold a whole block of (window + 1) // 2 words that
starts at a multiple of the block's length. So the index takes each text's
non-overlapping blocks, every rolling window of that length probes it, and only
windows round a hit are extended to `window` words, by comparing 96-bit hashes
of the whole window. Neighbouring extended windows join into maximal repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import U64, Chunks, bits, from_bits, from_low_bytes, low_bytes, ranges, runs
from .textbytes import Buffer, Poly, cover, in_one_text, kept_pieces, texts_of, words_of

WORD, BLOCKS, WINDOW, CHECK = Poly(11), Poly(12), Poly(13), Poly(14)
LAST = np.iinfo(np.int64).max


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    """doc_ids; null counts as the largest."""
    return column.cast(pa.int64()).fill_null(LAST).to_numpy()


class _Blocks:
    """A chunk's words, its rolling block hashes and their distinct values."""

    def __init__(self, table: pa.Table, window: int):
        self.window, self.block = window, (window + 1) // 2
        self.buffer = Buffer(texts_of(table["text"]))
        self.starts, self.ends = words_of(self.buffer)
        self.words = WORD.of_spans(self.buffer.data, self.starts, self.ends)
        self.first, self.last = self.buffer.counts(self.starts)
        n = self.last - self.first
        place = np.arange(len(self.starts)) - np.repeat(self.first, n)
        self.at = np.flatnonzero(in_one_text(self.buffer, self.starts, self.block))
        h = BLOCKS.rolling(self.words, self.block)[self.at] & ~U64(3)
        h |= (place[self.at] % self.block == 0).astype(U64)
        self.order = np.argsort(h)
        h = h[self.order]
        self.heads = runs(h >> U64(2))
        self.sizes = np.diff(np.append(self.heads, len(h)))
        # the last of a run has the aligned flag if any of it has
        self.distinct = h[self.heads + self.sizes - 1] if len(h) else h
        self.distinct |= (self.sizes > 1).astype(U64) << U64(1)

    def windows(self, hot: dict[int, bytes], shards: int):
        """Starts and hashes of the windows that hold a hit."""
        found = np.zeros(len(self.distinct), bool)
        for shard, cut in ranges(self.distinct, shards):
            if shard in hot:
                found[cut] = from_bits(hot[shard], cut.stop - cut.start)
        hit = np.zeros(len(self.starts) + 1, np.int64)
        hit[1 + self.at[self.order]] = np.repeat(found, self.sizes)
        hits = np.cumsum(hit)
        whole = in_one_text(self.buffer, self.starts, self.window)
        reach = self.window - self.block + 1
        at = np.flatnonzero(whole & (hits[reach : reach + len(whole)] > hits[: len(whole)]))
        return at, WINDOW.rolling(self.words, self.window)[at], CHECK.rolling(self.words, self.window)[at] >> U64(32)

    def grouped(self, ids: np.ndarray, hot: dict[int, bytes], shards: int):
        """The distinct windows by hash, with their smallest doc_id, and each window's place among them."""
        at, ha, hb = self.windows(hot, shards)
        doc = ids[np.searchsorted(self.last, at, "right")]
        order = np.lexsort((doc, hb, ha))
        at, ha, hb, doc = at[order], ha[order], hb[order], doc[order]
        new = np.ones(len(ha), bool)
        new[1:] = (ha[1:] != ha[:-1]) | (hb[1:] != hb[:-1])
        heads = np.flatnonzero(new)
        return at, doc, np.cumsum(new) - 1, ha[heads], hb[heads], doc[heads]


def _hot_blocks(cells):
    """Which probes hit an indexed block that occurs elsewhere too."""
    values = [from_low_bytes(x) for _, _, x in cells]
    every = np.sort(np.concatenate(values))
    heads = runs(every >> U64(2))
    flags = np.bitwise_or.reduceat((every & U64(3)).astype(np.uint8), heads)
    size = np.diff(np.append(heads, len(every)))
    hot = (every[heads] >> U64(2))[(flags & 1 > 0) & ((flags & 2 > 0) | (size > 1))]
    if not len(hot):
        return
    for (chunk, _, _), v in zip(cells, values):
        v = v >> U64(2)
        mask = hot[np.minimum(np.searchsorted(hot, v), len(hot) - 1)] == v
        if mask.any():
            yield chunk, 1, bits(mask)


_ENTRY = np.dtype([("ha", "<u8"), ("hb", "<u4"), ("doc", "<i8")])


def _first_docs(cells):
    """The smallest doc_id of each window, for the cells that hold a larger one."""
    parts = [np.frombuffer(x, _ENTRY) for _, _, x in cells]
    every = np.concatenate(parts)
    order = np.lexsort((every["doc"], every["hb"], every["ha"]))
    ha, hb = every["ha"][order], every["hb"][order]
    new = np.ones(len(ha), bool)
    new[1:] = (ha[1:] != ha[:-1]) | (hb[1:] != hb[:-1])
    least = np.empty(len(ha), np.int64)
    least[order] = every["doc"][order][np.flatnonzero(new)][np.cumsum(new) - 1]
    i = 0
    for (chunk, _, _), part in zip(cells, parts):
        mine = least[i : i + len(part)]
        i += len(part)
        less = mine < part["doc"]
        if less.any():
            yield chunk, 2, bits(less) + mine[less].tobytes()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Remove every word that a window of `window` words covers whose word
    sequence also starts in a document with a smaller id.

    Words are runs of bytes other than space and 0x09-0x0D. Returns doc_id,
    n_words, n_removed and text, the kept words joined by one space. A null
    text has no words; a text of fewer words than the window is never changed;
    a null id counts as the largest; rows with equal ids do not remove each
    other's words; a repeated row is returned as often as it comes. Other
    columns are ignored. An empty table gives an empty result.
    """
    chunks = Chunks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))

    def probes(table, replies, shards):
        for shard, cut in ranges(b := _Blocks(table, window).distinct, shards):
            yield shard, 1, low_bytes(b[cut])

    def extended(table, replies, shards):
        *_, ha, hb, doc = _Blocks(table, window).grouped(ids_of(table["doc_id"]), replies.get(1, {}), shards)
        entries = np.empty(len(ha), _ENTRY)
        entries["ha"], entries["hb"], entries["doc"] = ha, hb, doc
        for shard, cut in ranges(ha, shards):
            yield shard, 2, entries[cut].tobytes()

    hot = chunks.ask(probes, _hot_blocks)
    least = chunks.ask(extended, _first_docs, hot)
    shards = chunks.shards

    def removed(chunk, table, replies):
        blocks = _Blocks(table, window)
        at, doc, group, ha, _, first = blocks.grouped(ids_of(table["doc_id"]), replies.get(1, {}), shards)
        first = first.copy()
        for shard, cut in ranges(ha, shards):
            if data := replies.get(2, {}).get(shard):
                n = cut.stop - cut.start
                less = from_bits(data[: (n + 7) // 8], n)
                first[cut][less] = np.frombuffer(data[(n + 7) // 8 :], np.int64)
        late = at[doc > first[group]]
        gone = cover(len(blocks.starts), late, late + window)
        total = np.concatenate([[0], np.cumsum(gone)])
        texts = kept_pieces(blocks.buffer, blocks.starts, blocks.ends, ~gone, 0x20)
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(blocks.last - blocks.first, pa.int64()), "n_removed": pa.array(total[blocks.last] - total[blocks.first], pa.int64()), "text": pa.array(texts, pa.binary()).cast(pa.string())})

    return chunks.apply(removed, "doc_id long, n_words long, n_removed long, text string", hot.unionByName(least))
