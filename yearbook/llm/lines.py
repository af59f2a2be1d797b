"""Line dedup over a sharded minimal perfect hash.

Each shard of the hash range builds a minimal perfect hash over its distinct
lines. It leads into three arrays without keys: a 32-bit fingerprint, the number
of documents, and the smallest doc_id. The arrays are written to the shared
folder, a row a shard; documents then probe them with their packed line hashes.
No table of lines is joined. A line is 96 bits, a 64-bit key and a 32-bit print:
both lead to its place, so lines of equal keys have places of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import CELLS, U64, Chunks, bits, from_bits, ranges, replied, written
from .memory import freed
from .substring import ids_of
from .textbytes import LOWER, Buffer, Poly, byte_set, kept_pieces, mix, spans, texts_of, words_of

LINE, PRINT = Poly(21), Poly(22)
NEWLINE = byte_set((0x0A, 0x0A))


class PerfectHash:
    """A minimal perfect hash of distinct lines (key, print), by levels of bit arrays.

    A line lives in the first level in which no other remaining line hashes to
    its bit; its index is the number of bits set before that one. About three
    bits a line. A line that was not built in gives -1 or any index."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = [np.cumsum(level, dtype=np.int64) - level for level in levels]
        sizes = np.cumsum([0, *(int(level.sum()) for level in levels)]).tolist()
        self.bases, self.size = sizes[:-1], sizes[-1]

    @classmethod
    def of(cls, keys: np.ndarray, prints: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        levels = []
        while len(keys):
            size = max(64, int(len(keys) * gamma))
            at = cls.spot(keys, prints, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys, prints = keys[~alone[at]], prints[~alone[at]]
        return cls(levels)

    @staticmethod
    def spot(keys: np.ndarray, prints: np.ndarray, level: int, size: int) -> np.ndarray:
        h = mix(keys + U64(0x9E3779B97F4A7C15 * (level + 1) % 2**64))
        return (mix(h + prints.astype(U64)) % U64(size)).astype(np.int64)

    def index(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for k, (level, before, base) in enumerate(zip(self.levels, self.before, self.bases)):
            if not len(todo):
                break
            at = self.spot(keys[todo], prints[todo], k, len(level))
            hit = level[at]
            out[todo[hit]] = base + before[at[hit]]
            todo = todo[~hit]
        return out


class LineIndex:
    """Fingerprint, document count and smallest doc_id of each line, without its key."""

    def __init__(self, hash_: PerfectHash, prints: np.ndarray, docs: np.ndarray, counts: np.ndarray):
        self.hash, self.prints, self.docs, self.counts = hash_, prints, docs, counts

    @classmethod
    def of(cls, keys: np.ndarray, prints: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> LineIndex:
        order = np.lexsort((docs, prints, keys))
        keys, prints, docs, counts = keys[order], prints[order], docs[order], counts[order]
        heads = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (prints[1:] != prints[:-1])])[: len(keys)])
        hash_ = PerfectHash.of(keys[heads], prints[heads])
        at = hash_.index(keys[heads], prints[heads])
        out = cls(hash_, np.empty(len(heads), "<u4"), np.empty(len(heads), "<i8"), np.empty(len(heads), "<u4"))
        out.prints[at], out.docs[at] = prints[heads], docs[heads]
        out.counts[at] = np.minimum(np.add.reduceat(counts, heads), 2**32 - 1) if len(heads) else 0
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.hash.levels), self.hash.size, *map(len, self.hash.levels)], "<i8")
        return sizes.tobytes() + self.prints.tobytes() + self.docs.tobytes() + self.counts.tobytes() + b"".join(bits(x) for x in self.hash.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> LineIndex:
        levels, n = np.frombuffer(data, "<i8", 2).tolist()
        sizes, at = np.frombuffer(data, "<i8", levels, 16).tolist(), 16 + 8 * levels
        prints, docs, counts = np.frombuffer(data, "<u4", n, at), np.frombuffer(data, "<i8", n, at + 4 * n), np.frombuffer(data, "<u4", n, at + 12 * n)
        at, found = at + 16 * n, []
        for size in sizes:
            found.append(from_bits(data[at : at + (size + 7) // 8], size))
            at += (size + 7) // 8
        return cls(PerfectHash(found), prints, docs, counts)

    def probe(self, keys: np.ndarray, prints: np.ndarray):
        """Counts and smallest doc_ids; 0 and the largest integer where the fingerprint differs."""
        at = self.hash.index(keys, prints)
        known = at >= 0
        known[known] = self.prints[at[known]] == prints[known]
        counts, docs = np.zeros(len(keys), np.int64), np.full(len(keys), np.iinfo(np.int64).max)
        counts[known], docs[known] = self.counts[at[known]], self.docs[at[known]]
        return counts, docs


class _Lines:
    """A chunk's lines, their keys' hashes, and the distinct ones."""

    def __init__(self, table: pa.Table, least: int):
        self.buffer = b = Buffer(texts_of(table["text"]))
        breaks = np.flatnonzero(NEWLINE[b.data])
        self.ends, self.starts = breaks, np.concatenate([[0], breaks[:-1] + 1]).astype(np.int64)
        words, word_ends = words_of(b)
        first, last = np.searchsorted(words, self.starts, "left"), np.searchsorted(words, self.ends, "left")
        full = np.flatnonzero(last > first)
        s, e = words[first[full]], word_ends[last[full] - 1]
        points = np.concatenate([[0], np.cumsum((b.data & 0xC0) != 0x80, dtype=np.int64)])
        long = points[e] - points[s] >= least
        self.at, s, e = full[long], s[long], e[long]  # lines whose key is long enough
        lowered = LOWER[b.data]
        keys, prints = LINE.of_spans(lowered, s, e), PRINT.of_spans(lowered, s, e) >> U64(32)
        ids = ids_of(table["doc_id"])
        doc = ids[b.text_at(s)]
        order = np.lexsort((doc, prints, keys))
        self.at, keys, prints, self.doc = self.at[order], keys[order], prints[order], doc[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (prints[1:] != prints[:-1])
        heads, self.group = np.flatnonzero(new), np.cumsum(new) - 1
        other = new.copy()
        other[1:] |= self.doc[1:] != self.doc[:-1]
        self.entries = np.empty(len(heads), _ENTRY)
        self.entries["key"], self.entries["print"], self.entries["doc"] = keys[heads], prints[heads], self.doc[heads]
        self.entries["docs"] = np.add.reduceat(other.astype(np.int64), heads) if len(heads) else 0


_ENTRY = np.dtype([("key", "<u8"), ("print", "<u4"), ("doc", "<i8"), ("docs", "<u4")])


def _built(table: pa.Table) -> pa.Table:
    """A shard's arrays."""
    every = np.concatenate([np.frombuffer(x, _ENTRY) for x in table["payload"].to_pylist()])
    index = LineIndex.of(every["key"], every["print"], every["doc"], every["docs"].astype(np.int64))
    return pa.table({"shard": table["shard"].slice(0, 1), "lines": pa.array([index.to_bytes()], pa.binary())})


def _probed(cells: pa.Table, index: pa.Table) -> pa.Table:
    """For each cell, which of its lines a smaller doc_id has, and the smallest."""
    parts = [np.frombuffer(x, _ENTRY) for x in cells["payload"].to_pylist()]
    if not parts or not index.num_rows:
        return replied(0, [])
    every = np.concatenate(parts)
    counts, docs = LineIndex.from_bytes(index["lines"][0].as_py()).probe(every["key"], every["print"])
    less, at, out = (counts > 1) & (docs < every["doc"]), 0, []
    for chunk, part in zip(cells["chunk"].to_pylist(), parts):
        mine = slice(at, at + len(part))
        at += len(part)
        if less[mine].any():
            out.append((chunk, 1, bits(less[mine]) + docs[mine][less[mine]].tobytes()))
    return replied(index["shard"][0].as_py(), out)


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drop each line whose key occurs in a document with a smaller id.

    Lines are split at newlines; a key is the line without white space
    (0x09-0x0D, space) at its ends and with A-Z lower-cased. Keys of fewer than
    `least` code points are never dropped. Returns doc_id, n_lines (before
    dropping), n_dropped and text (the other lines, unchanged, joined by
    newlines). A null or empty text is one empty line and becomes an empty
    text; all lines of the document with the smallest id stay, repeated ones
    too; rows with equal ids keep each other's lines; a null id counts as the
    largest. The columns named in carry follow in a struct `carried`, unchanged;
    others are ignored; an empty table gives an empty result.
    """
    carried = F.struct(F.lit(0).alias("_none"), *(F.col(c) for c in carry)).alias("carried")
    chunks = Chunks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), carried))

    def probes(table, replies, shards):
        entries = _Lines(table, least).entries
        for shard, cut in ranges(entries["key"], shards):
            yield shard, 1, entries[cut].tobytes()

    shards = chunks.shards
    cells = written(chunks.send(probes, columns=("doc_id", "text")))
    index = written(chunks.by_shard(cells).applyInArrow(lambda t: freed(_built(t)), "shard int, lines binary"))
    found = written(chunks.by_shard(cells).cogroup(chunks.by_shard(index)).applyInArrow(lambda c, i: freed(_probed(c, i)), CELLS))

    def dropped(chunk, table, replies):
        lines = _Lines(table, least)
        first = lines.entries["doc"].copy()
        for shard, cut in ranges(lines.entries["key"], shards):
            if data := replies.get(1, {}).get(shard):
                n = cut.stop - cut.start
                less = from_bits(data[: (n + 7) // 8], n)
                first[cut][less] = np.frombuffer(data[(n + 7) // 8 :], np.int64)
        keep = np.ones(len(lines.starts), bool)
        keep[lines.at[lines.doc > first[lines.group]]] = False
        lo, hi = np.searchsorted(lines.ends, lines.buffer.starts, "left"), np.searchsorted(lines.ends, lines.buffer.ends, "right")
        total = np.concatenate([[0], np.cumsum(~keep)])
        return pa.table({"doc_id": table["doc_id"], "n_lines": pa.array(hi - lo, pa.int64()), "n_dropped": pa.array(total[hi] - total[lo], pa.int64()), "text": pa.array(_joined(lines, keep), pa.binary()).cast(pa.string()), "carried": table["carried"]})

    kind = chunks.table.schema["carried"].dataType.simpleString()
    return chunks.apply(dropped, f"doc_id long, n_lines long, n_dropped long, text string, carried {kind}", found)


def _joined(lines: _Lines, keep: np.ndarray) -> list[bytes]:
    """Each text's kept lines, joined by newlines; lines may be empty."""
    b = lines.buffer
    step = np.zeros(len(b.data) + 1, np.int32)
    np.add.at(step, lines.starts[keep], 1)
    np.add.at(step, lines.ends[keep] + 1, -1)
    mask = np.cumsum(step[:-1]) > 0
    out = b.data[mask].tobytes()
    total = np.concatenate([[0], np.cumsum(mask)])
    return [out[i : j - 1] if j > i else b"" for i, j in zip(total[b.starts].tolist(), total[b.ends + 1].tolist())]
