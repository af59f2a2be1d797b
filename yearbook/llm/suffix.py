"""Suffix-array dedup of byte strings by two-stage sorting.

Only strings that can repeat reach the sort. Every run of `length` bytes holds
a minimizer (the least hash of its words of eight bytes, the first of equal
ones), which depends on its bytes alone. The starts in a row that share one
minimizer, and lie in the same eighth of the length before it, all reach over
the same stretch of seven eighths of the length: its hash is their key. Starts whose key occurs once in
the corpus are done, and a passage that many texts share is no key unless it is
nearly as long as the strings sought. The rest travel as segments: such starts
with the bytes they reach over. Segments of one key meet in one shard. Equal
segments settle each other; for those that only overlap, the shard builds a
suffix array in two stages - suffixes smaller than their successors are sorted
directly, all others are induced by scanning the buckets - and compares
neighbours: the bytes that adjacent suffixes have in common, up to `length`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import U64, Chunks, bits, from_bits, from_low_bytes, low_bytes, ranges, runs
from .textbytes import Buffer, Poly, cover, texts_of

SEGMENT, CHECK, KEY = Poly(42), Poly(43), Poly(44)
#: An odd multiplier: the order of words among which the least is sought.
ORDER = U64(0x9E3779B97F4A7C15)
#: Bytes whose minimizers are found at a time; a longer text is a slice by itself.
SLICE = 1 << 20
#: Bytes sorted at a time; more only where the segments of one key are more.
SORTED = 1 << 20


def minima(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` values in a row."""
    n = len(values)
    if n < width:
        return values[:0]
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, U64)
    padded[:n] = values
    block = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The suffixes of a byte string in order of their first `depth` bytes at least.

    Suffixes that agree so far may come in any order. An end of the text sorts
    before every byte. If places are marked as wanted, only their suffixes come,
    and only those from which they are induced are sorted with them."""
    n = len(text)
    if n < 2:
        return np.arange(n) if wanted is None else np.flatnonzero(wanted)
    # stage one: which suffixes are smaller than the next one, decided at the first unequal pair
    step = np.diff(text.astype(np.int16))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    rising = np.zeros(n, bool)
    rising[:-1] = (at < n - 1) & (np.append(step, 0)[at] > 0)
    needed = np.ones(n, bool)
    if wanted is not None:
        # a suffix that is induced follows from the one after it, up to one that is sorted directly
        some, stops = np.flatnonzero(wanted), np.append(np.flatnonzero(rising), n - 1)
        needed = cover(n, some, stops[np.searchsorted(stops, some)] + 1)
    direct = _sorted_directly(text, np.flatnonzero(rising & needed), depth)
    bucket = text[direct]
    lo, hi = np.searchsorted(bucket, np.arange(256), "left"), np.searchsorted(bucket, np.arange(256), "right")
    # stage two: scan the buckets; a suffix that is not smaller than the scanned one it precedes comes after it
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.flatnonzero(needed[n - 1 :]) + n - 1)
    induced_ones, out = ~rising & needed, []

    def pass_on(scanned: np.ndarray, own: int) -> np.ndarray:
        before = scanned[scanned > 0] - 1
        before = before[induced_ones[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        first = first[order]
        for i, j in zip(h := runs(first), np.append(h[1:], len(first))):
            if first[i] != own:
                waiting[first[i]].append(before[order[i:j]])
        return before[text[before] == own]

    for c in range(256):
        induced = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        while len(induced):  # those of the same byte follow in the order of the scan
            out.append(induced)
            induced = pass_on(induced, c)
        if hi[c] > lo[c]:
            out.append(direct[lo[c] : hi[c]])
            pass_on(out[-1], c)
    order = np.concatenate([np.empty(0, np.int64), *out])
    return order if wanted is None else order[wanted[order]]


def _sorted_directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Sort the suffixes at `at`, and no others, seven bytes a round; only ties go on.

    Of the ties, only groups that differ in the bytes of the round are sorted."""
    n = len(text)
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((n + 1,), ">u8", wide, strides=(1,))

    def key(p: np.ndarray) -> np.ndarray:
        # seven bytes, then how many of them the text has: an end goes before a zero byte
        p = np.minimum(p, n)
        return words[p].astype(U64) & ~U64(0xFF) | np.minimum(n - p, 7).astype(U64)

    out = at.copy()
    place, heads = np.arange(len(at)), np.zeros(min(1, len(at)), np.int64)
    for done in range(0, depth, 7):
        if not len(place):
            break
        size = np.diff(np.append(heads, len(place)))
        k = key(out[place] + done)
        group = np.repeat(np.arange(len(heads)), size)
        uneven = np.bincount(group[k != k[heads][group]], minlength=len(heads)) > 0
        mixed = np.flatnonzero(uneven[group])
        order = mixed[np.lexsort((k[mixed], group[mixed]))]
        out[place[mixed]], k[mixed] = out[place[order]], k[order]
        new = np.ones(len(place) + 1, bool)
        new[1:-1] = k[1:] != k[:-1]
        new[heads] = True
        tied = ~(new[:-1] & new[1:])
        place, heads = place[tied], np.flatnonzero(new[:-1][tied])
    return out


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many bytes the strings at a and b have in common, up to `most`, eight at a time."""
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((len(text) + 1,), "<u8", wide, strides=(1,))
    limit = np.minimum(most, len(text) - np.maximum(a, b))
    out = limit.copy()
    live = np.flatnonzero(limit > 0)
    for k in range(0, most, 8):
        x = words[a[live] + k] ^ words[b[live] + k]
        differ = np.flatnonzero(x)
        # the lowest set bit lies in the first byte that differs
        low = np.bitwise_count((x[differ] & -x[differ]) - U64(1)).astype(np.int64) // 8
        out[live[differ]] = np.minimum(limit[live[differ]], k + low)
        live = live[x == 0]
        live = live[limit[live] > k + 8]
        if not len(live):
            break
    return out


def repeated_starts(text: np.ndarray, is_start: np.ndarray, length: int) -> np.ndarray:
    """Which marked starts share their next `length` bytes with another marked start."""
    order = suffix_array(text, length, is_start)
    shared = common_prefixes(text, order[:-1], order[1:], length)
    group = np.concatenate([[0], np.cumsum(shared < length)])[: len(order)]
    out = np.zeros(len(text), bool)
    out[order] = (np.bincount(group) > 1)[group]
    return out


class _Segments:
    """A chunk's runs of starts that share a key."""

    def __init__(self, table: pa.Table, length: int):
        self.buffer = b = Buffer(texts_of(table["text"]))
        eighth, width = length // 8, length - 7
        found, i = [], 0
        while i < len(b.lens):
            j = max(i + 1, int(np.searchsorted(b.ends, b.starts[i] + SLICE, "right")))
            first, last = int(b.starts[i]), int(b.ends[j - 1])
            value = np.ndarray((max(0, last - first - 7),), "<u8", b.data, offset=first, strides=(1,)) * ORDER
            # the upper half of the product decides, then the place
            value &= U64(0xFFFFFFFF00000000)
            value |= np.arange(len(value), dtype=U64)
            # the lower half of each least value is its place
            anchor = np.ascontiguousarray(minima(value, width).view("<u4")[::2])
            m = len(anchor)
            before = (anchor - np.arange(m, dtype=np.uint32)) // np.uint32(eighth)
            step = np.zeros(m + 1, np.int8)
            n = b.lens[i:j] - length + 1
            at = b.starts[i:j][n > 0] - first
            np.add.at(step, at, 1)
            np.add.at(step, at + n[n > 0], -1)
            whole = np.cumsum(step[:m], dtype=np.int8) > 0  # starts with `length` bytes of their text ahead
            same = np.zeros(m + 1, bool)
            same[1:m] = (anchor[1:] == anchor[:-1]) & (before[1:] == before[:-1]) & whole[1:] & whole[:-1]
            heads, lasts = np.flatnonzero(whole & ~same[:m]), np.flatnonzero(whole & ~same[1:])
            # all windows of the run hold these bytes
            begin = anchor[heads].astype(np.int64) - eighth * before[heads].astype(np.int64) + first
            order = np.argsort(begin, kind="stable")
            key = np.empty(len(begin), U64)
            key[order] = KEY.of_spans(b.data, begin[order], begin[order] + length - eighth + 1)
            found.append((heads + first, lasts - heads + 1, key))
            i = j
        cat = lambda k, kind: np.concatenate([f[k] for f in found] or [np.empty(0, kind)])
        self.at, self.n, self.key = cat(0, np.int64), cat(1, np.int64), cat(2, U64)

    def keys(self):
        """The distinct keys with bit 0 set if it has several segments; each segment's place among them."""
        order = np.argsort(self.key)
        k = self.key[order] & ~U64(1)
        heads = runs(k)
        size = np.diff(np.append(heads, len(k)))
        place = np.empty(len(k), np.int64)
        place[order] = np.repeat(np.arange(len(heads)), size)
        return k[heads] | (size > 1).astype(U64), place

    def hot(self, replies: dict[int, bytes], shards: int, length: int):
        """The distinct segments whose key occurs elsewhere, and each one's occurrences."""
        keys, place = self.keys()
        found = np.zeros(len(keys), bool)
        for shard, cut in ranges(keys, shards):
            if shard in replies:
                found[cut] = from_bits(replies[shard], cut.stop - cut.start)
        live = np.flatnonzero(found[place] if len(place) else place)
        ends = self.at[live] + self.n[live] + length - 1
        h1, h2 = (p.of_spans(self.buffer.data, self.at[live], ends) for p in (SEGMENT, CHECK))
        key = self.key[live] & ~U64(1)
        order = np.lexsort((h2, h1, key))
        live, key, h1, h2, ends = live[order], key[order], h1[order], h2[order], ends[order]
        new = np.ones(len(live), bool)
        new[1:] = (key[1:] != key[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, len(live)))
        entries = np.empty(len(heads), _ENTRY)
        entries["key"], entries["h1"], entries["h2"], entries["many"] = key[heads], h1[heads], h2[heads], size > 1
        entries["n"] = self.n[live[heads]]
        return live, np.cumsum(new) - 1, entries, self.at[live[heads]], ends[heads]


_ENTRY = np.dtype([("key", "<u8"), ("h1", "<u8"), ("h2", "<u8"), ("n", "<u2"), ("many", "u1")])


def _hot_keys(cells):
    values = [from_low_bytes(x) for _, _, x in cells]
    every = np.sort(np.concatenate(values))
    heads = runs(every >> U64(1))
    size = np.diff(np.append(heads, len(every)))
    many = np.bitwise_or.reduceat(every & U64(1), heads) > 0
    hot = (every[heads] >> U64(1))[many | (size > 1)]
    if not len(hot):
        return
    for (chunk, _, _), v in zip(cells, values):
        v = v >> U64(1)
        mask = hot[np.minimum(np.searchsorted(hot, v), len(hot) - 1)] == v
        if mask.any():
            yield chunk, 1, bits(mask)


def _marked(length: int):
    def marked(cells):
        """For each segment of each cell: 1 byte, all (1) or none (0) or some (2) of its starts; then the bits of the some."""
        parts, texts = [], []
        for _, _, data in cells:
            n = int.from_bytes(data[:4], "little")
            part = np.frombuffer(data, _ENTRY, n, 4)
            parts.append(part)
            ends = 4 + n * _ENTRY.itemsize + np.cumsum(part["n"].astype(np.int64) + length - 1)
            texts += [(data, a, b) for a, b in zip(np.append(4 + n * _ENTRY.itemsize, ends[:-1]).tolist(), ends.tolist())]
        every = np.concatenate(parts)
        order = np.lexsort((every["h2"], every["h1"], every["key"]))
        e = every[order]
        new = np.ones(len(e), bool)
        other = np.ones(len(e), bool)
        other[1:] = e["key"][1:] != e["key"][:-1]
        new[1:] = other[1:] | (e["h1"][1:] != e["h1"][:-1]) | (e["h2"][1:] != e["h2"][:-1])
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, len(e)))
        settled = (size > 1) | (np.maximum.reduceat(e["many"], heads) > 0)
        family = np.cumsum(other[heads]) - 1
        unsettled = np.bincount(family, weights=~settled)
        torn = (unsettled > 0) & (np.bincount(family) > 1)
        state = settled.astype(np.uint8)
        some: dict[int, bytes] = {}
        torn_ones = np.flatnonzero(torn[family])
        size_of = e["n"][heads[torn_ones]].astype(np.int64) + length - 1
        # a family stays whole: equal strings have equal keys
        edges = np.flatnonzero(np.diff(family[torn_ones], prepend=-1))
        part = (np.cumsum(size_of) - size_of)[edges] // SORTED if len(edges) else edges
        cut = np.append(edges[np.flatnonzero(np.diff(part, prepend=-1))], len(torn_ones))
        for i, j in zip(cut, cut[1:]):
            pick = torn_ones[i:j]
            n = e["n"][heads[pick]].astype(np.int64)
            raw = b"".join([d[a:b] for d, a, b in (texts[k] for k in order[heads[pick]])])
            at = np.concatenate([[0], np.cumsum(n + length - 1)])
            starts = cover(len(raw), at[:-1], at[:-1] + n)
            found = repeated_starts(np.frombuffer(raw, np.uint8), starts, length)
            for k, a, m in zip(pick.tolist(), at.tolist(), n.tolist()):
                if not settled[k] and (got := found[a : a + m]).any():
                    state[k] = 1 if got.all() else 2
                    if state[k] == 2:
                        some[k] = np.packbits(got).tobytes()
        distinct = np.empty(len(e), np.int64)
        distinct[order] = np.cumsum(new) - 1
        i = 0
        for (chunk, _, _), part in zip(cells, parts):
            mine = distinct[i : i + len(part)]
            i += len(part)
            if state[mine].any():
                yield chunk, 2, state[mine].tobytes() + b"".join([some[k] for k in mine[state[mine] == 2].tolist()])

    return marked


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that also starts
    anywhere else in the corpus, in the same document included.

    Texts are their UTF-8 bytes; matches never cross documents; overlapping
    matches count; strings are judged on the input. Returns doc_id, n_bytes,
    n_removed, n_spans (maximal removed runs) and kept (binary: what is left
    may cut a character in two). A null text is empty; shorter texts never
    change; of repeated rows, all lose their common strings; ids are only
    handed on and may be null or equal. Other columns are ignored; an empty
    table gives an empty result. length must be 64 or more.
    """
    if length < 64:
        raise ValueError("length must be 64 or more")
    chunks = Chunks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))

    def anchors(table, replies, shards):
        keys, _ = _Segments(table, length).keys()
        for shard, cut in ranges(keys, shards):
            yield shard, 1, low_bytes(keys[cut])

    def segments(table, replies, shards):
        s = _Segments(table, length)
        _, _, entries, at, ends = s.hot(replies.get(1, {}), shards, length)
        raw = s.buffer.data.tobytes()
        for shard, cut in ranges(entries["key"], shards):
            yield shard, 2, (cut.stop - cut.start).to_bytes(4, "little") + entries[cut].tobytes() + b"".join([raw[a:b] for a, b in zip(at[cut].tolist(), ends[cut].tolist())])

    hot = chunks.ask(anchors, _hot_keys)
    found = chunks.ask(segments, _marked(length), hot)
    shards = chunks.shards

    def removed(chunk, table, replies):
        s = _Segments(table, length)
        b = s.buffer
        live, group, entries, _, _ = s.hot(replies.get(1, {}), shards, length)
        state = np.zeros(len(entries), np.uint8)
        part: dict[int, np.ndarray] = {}
        for shard, cut in ranges(entries["key"], shards):
            if data := replies.get(2, {}).get(shard):
                m = cut.stop - cut.start
                state[cut] = np.frombuffer(data, np.uint8, m)
                at = m
                for k in np.flatnonzero(state[cut] == 2).tolist():
                    n = int(entries["n"][cut.start + k])
                    part[cut.start + k] = np.flatnonzero(from_bits(data[at : at + (n + 7) // 8], n))
                    at += (n + 7) // 8
        whole = live[state[group] == 1]
        starts, ends = [s.at[whole]], [s.at[whole] + s.n[whole] + length - 1]
        for k, g in zip(*(x[state[group] == 2].tolist() for x in (live, group))):
            starts.append(s.at[k] + part[g])
            ends.append(starts[-1] + length)
        gone = cover(len(b.data), np.concatenate(starts), np.concatenate(ends))
        total = np.concatenate([[0], np.cumsum(gone)])
        edge = np.concatenate([[0], np.cumsum(gone & ~np.concatenate([[False], gone[:-1]]))])
        data = b.data[~gone].tobytes()
        lo, hi = b.starts - total[b.starts], b.ends - total[b.ends]
        kept = [data[i:j] for i, j in zip(lo.tolist(), hi.tolist())]
        return pa.table({"doc_id": table["doc_id"], "n_bytes": pa.array(b.lens, pa.int64()), "n_removed": pa.array(total[b.ends] - total[b.starts], pa.int64()), "n_spans": pa.array(edge[b.ends] - edge[b.starts], pa.int64()), "kept": pa.array(kept, pa.binary())})

    return chunks.apply(removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", hot.unionByName(found))
