"""Word shingles of whole texts, and their fingerprints."""

from __future__ import annotations

import numpy as np

from .exchange import U64
from .textbytes import LOWER, Buffer, words_of
from .xxh import xxh64


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... as many as counted, one after the other."""
    total = np.cumsum(counts)
    return np.repeat(starts - (total - counts), counts) + np.arange(int(total[-1]) if len(total) else 0)


def shingled(texts: list[bytes], k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles, in the order of the texts, and how many each text has."""
    buffer = Buffer(texts)
    starts, ends = words_of(buffer)
    first, last = buffer.counts(starts)
    lens = ends - starts
    step = np.zeros(len(buffer.data) + 1, np.int8)
    step[starts] += 1
    step[ends + 1] -= 1
    data = LOWER[buffer.data]
    data[ends] = 0x20
    data = data[np.cumsum(step[:-1], dtype=np.int8) > 0]  # all words, a space after each
    at = np.cumsum(lens + 1) - lens - 1
    words = last - first
    shingles = np.where(words > 0, np.maximum(words - k + 1, 1), 0)
    begin = _spread(first, shingles)
    end = np.minimum(begin + k, np.repeat(last, shingles)) - 1
    return xxh64(data, at[begin], at[end] + lens[end], seed), shingles


def majority(h: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """A fingerprint for each text: the bits that are set in over half of its shingles' hashes."""
    out = np.zeros(len(shingles), U64)
    has = np.flatnonzero(shingles)
    total = np.cumsum(shingles)
    weight = U64(1) << np.arange(64, dtype=U64)
    i = 0
    while i < len(has):  # some 200,000 shingles at a time
        j = max(i + 1, int(np.searchsorted(total[has], (total[has[i - 1]] if i else 0) + 200_000, "right")))
        some = has[i:j]
        lo = total[some] - shingles[some]
        bits = np.unpackbits(h[lo[0] : total[some[-1]]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count = np.add.reduceat(bits, lo - lo[0], axis=0, dtype=np.int32)
        out[some] = ((2 * count > shingles[some, None]) * weight).sum(axis=1, dtype=U64)
        i = j
    return out
