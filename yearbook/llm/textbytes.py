"""Vectorised work on the UTF-8 bytes of many texts at once.

A group of texts is one byte buffer: each text followed by a newline that is
not part of it. Spans are pairs of arrays (starts, ends) into the buffer. All
hashes are polynomials modulo 2**64 over random odd byte values, finished by a
mixing step; they need a few operations a byte and no Python object a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes hashed at a time: bounds the 8-byte temporaries, and the tables of powers that each worker keeps.
BLOCK = 1 << 16
#: Spans of up to so many bytes are hashed by whole words, longer ones by prefix sums.
SHORT = 32
#: Masks for the first 0 to 8 bytes of a little-endian word.
HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true for the bytes in the ranges (ends included)."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: The white space of the word rule: space and 0x09 to 0x0D.
SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return pc.fill_null(column, "").cast(pa.large_binary()).to_pylist()


def parts(batch: pa.RecordBatch, column: int, most: int = 2 << 20):
    """(rows, texts) of a batch, about `most` bytes of text at a time; a longer text is one part."""
    lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lens)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        rows = batch.slice(i, j - i)
        yield rows, texts_of(rows.column(column))
        i = j


class Buffer:
    """Texts laid end to end, a newline after each."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join([*texts, b""]) if texts else b"", np.uint8)
        self.lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.lens + 1) - 1
        self.starts = self.ends - self.lens

    def text_at(self, positions: np.ndarray) -> np.ndarray:
        """The index of the text that holds each position."""
        return np.searchsorted(self.ends, positions, "left")

    def counts(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one index, for each text, of its spans in ascending starts."""
        return np.searchsorted(starts, self.starts, "left"), np.searchsorted(starts, self.ends, "left")


def spans(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that are not in breaks; the buffer ends with a break."""
    inside = np.empty(len(data) + 1, np.int8)
    inside[0] = 0
    inside[1:] = ~breaks[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word (in place)."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class Poly:
    """One hash function: random odd byte values, an odd base, its powers and their inverses."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**64, 256, dtype=U64) | U64(1)
        self.base = int(rng.integers(0, 2**62, dtype=U64)) * 4 + 3
        self.inverse = pow(self.base, -1, 2**64)
        self.powers, self.inverses = np.ones(1, U64), np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """n powers and inverses at least; only as many as a block needs are kept."""
        powers, inverses = self.powers, self.inverses
        while len(powers) < n:
            k = len(powers)
            powers = np.concatenate([powers, powers * U64(pow(self.base, k, 2**64))])
            inverses = np.concatenate([inverses, inverses * U64(pow(self.inverse, k, 2**64))])
        if n <= 2 * BLOCK:
            self.powers, self.inverses = powers, inverses
        return powers, inverses

    def sums(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums of values times powers, one longer than values; and the inverses."""
        powers, inverses = self.upto(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * powers[: len(values)], out=out[1:])
        return out, inverses

    def of_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each span's bytes; starts and ends ascend."""
        short = ends - starts <= SHORT
        if short.all():
            return self.of_short(data, starts, ends - starts)
        out = np.empty(len(starts), U64)
        out[short] = self.of_short(data, starts[short], (ends - starts)[short])
        out[~short] = self.of_long(data, starts[~short], ends[~short])
        return out

    def of_short(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Eight bytes at a time, for many spans at once."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        h = self.table[lens]
        live, at, left = np.arange(len(starts)), starts, lens
        while len(live):
            lane = lanes[at] & HEAD[np.minimum(left, 8)]
            if len(live) == len(h):
                h = (h ^ lane) * U64(self.base)
                h ^= h >> U64(32)
            else:
                g = (h[live] ^ lane) * U64(self.base)
                h[live] = g ^ (g >> U64(32))
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        return mix(h)

    def of_long(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """By prefix sums over each block of bytes."""
        out = np.empty(len(starts), U64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
            first, last = int(starts[i]), int(ends[j - 1])
            total, inverses = self.sums(self.table[data[first:last]])
            s, e = starts[i:j] - first, ends[i:j] - first
            out[i:j] = (total[e] - total[s]) * inverses[s]
            i = j
        return mix(out)

    def rolling(self, values: np.ndarray, k: int) -> np.ndarray:
        """A hash of every k values in a row (uint64 values); as many as fit."""
        n = len(values) - k + 1
        if n <= 0:
            return np.empty(0, U64)
        out = np.empty(n, U64)
        for i in range(0, n, BLOCK):
            j = min(n, i + BLOCK)
            total, inverses = self.sums(values[i : j + k - 1])
            out[i:j] = (total[k:] - total[:-k]) * inverses[: j - i]
        return mix(out)


def words_of(buffer: Buffer) -> tuple[np.ndarray, np.ndarray]:
    return spans(buffer.data, SPACE)


def in_one_text(buffer: Buffer, starts: np.ndarray, k: int) -> np.ndarray:
    """Whether the k spans from each on lie in one text, for as many as fit."""
    n = len(starts) - k + 1
    if n <= 0:
        return np.empty(0, bool)
    first, last = buffer.counts(starts)
    out = np.zeros(len(starts) + 1, np.int32)
    has = last - first >= k
    np.add.at(out, first[has], 1)
    np.add.at(out, last[has] - k + 1, -1)
    return np.cumsum(out)[:n] > 0


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def kept_pieces(buffer: Buffer, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray, joint: int) -> list[bytes]:
    """For each text its kept spans joined by the byte joint.

    Spans ascend, do not overlap, and are each followed by a byte that is not
    in a span: that byte becomes the joint."""
    s, e = starts[keep], ends[keep]
    step = np.zeros(len(buffer.data) + 1, np.int8)
    step[s] += 1
    step[e + 1] -= 1
    mask = np.cumsum(step[:-1], dtype=np.int8) > 0
    data = buffer.data.copy()
    data[ends] = joint
    out = data[mask].tobytes()
    total = np.concatenate([[0], np.cumsum(mask)])
    lo, hi = total[buffer.starts].tolist(), total[buffer.ends + 1].tolist()
    return [out[a : b - 1] if b > a else b"" for a, b in zip(lo, hi)]
