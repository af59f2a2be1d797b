"""XXH64 of many byte strings of one buffer at once."""

from __future__ import annotations

import numpy as np
import xxhash

from .exchange import U64, runs

# Fixed values of the published algorithm.
P1, P2, P3, P4, P5 = (U64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Longer strings are few: they are hashed one by one.
LONG = 512


def _rotl(x: np.ndarray, k: int) -> np.ndarray:
    return (x << U64(k)) | (x >> U64(64 - k))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """The hash of data[start:end] for each pair."""
    out = np.empty(len(starts), U64)
    lens = ends - starts
    order = np.argsort(np.minimum(lens, LONG).astype(np.uint16), kind="stable")
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    four = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    ordered = lens[order]
    heads = runs(np.minimum(ordered, LONG))
    for i, j in zip(heads.tolist(), np.append(heads[1:], len(order)).tolist()):
        at, n = order[i:j], int(ordered[i])
        if n >= LONG:
            raw = data.tobytes()
            out[at] = [xxhash.xxh64_intdigest(raw[a:b], seed) for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        else:
            out[at] = _equal(padded, eight, four, starts[at], n, seed)
    return out


def _equal(data, eight, four, s, n: int, seed: int) -> np.ndarray:
    """Strings of one length."""
    seed64 = np.array([seed], U64)
    k = 0
    if n >= 32:
        v = [np.broadcast_to(x, s.shape) for x in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
        while k + 32 <= n:
            v = [_round(x, eight[s + (k + 8 * i)]) for i, x in enumerate(v)]
            k += 32
        h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        zero = np.zeros(1, U64)
        for x in v:
            h = (h ^ _round(zero, x)) * P1 + P4
    else:
        h = np.broadcast_to(seed64 + P5, s.shape)
    h = h + U64(n)
    while k + 8 <= n:
        h = _rotl(h ^ _round(np.zeros(1, U64), eight[s + k]), 27) * P1 + P4
        k += 8
    if k + 4 <= n:
        h = _rotl(h ^ (four[s + k].astype(U64) * P1), 23) * P2 + P3
        k += 4
    while k < n:
        h = _rotl(h ^ (data[s + k].astype(U64) * P5), 11) * P1
        k += 1
    h = (h ^ (h >> U64(33))) * P2
    h = (h ^ (h >> U64(29))) * P3
    return h ^ (h >> U64(32))
