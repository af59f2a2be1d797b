"""Similarity of names, and rounding as Python does it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_subsequence(a: str, b: str) -> int:
    """The length of a longest common subsequence, by bits of one integer a row."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for c in b:
        hit = rows & where.get(c, 0)
        rows = (rows + hit | rows - hit) & full
    return len(a) - rows.bit_count()


def token_sort(text: str | None) -> str:
    return " ".join(sorted((text or "").split()))


def ratio(a: str, b: str) -> float:
    """200 times the common subsequence by the sum of lengths; 100 for two empty texts."""
    total = len(a) + len(b)
    return 200.0 * common_subsequence(a, b) / total if total else 100.0


def token_sort_ratio(a: str | None, b: str | None) -> float:
    """Similarity (0 to 100) of two names, the order of their words aside."""
    return ratio(token_sort(a), token_sort(b))


#: Classes of characters whose counts bound what two names can have in common, and pairs compared at a time.
CLASSES, PAIRS = 32, 1 << 16


class Names:
    """Names prepared for comparison with many others."""

    def __init__(self, names: list[str], alphabet: dict[str, int]):
        self.names = names
        self.lens = np.array([len(x) for x in names], np.int64)
        #: Characters by their number in the alphabet; its length stands for none.
        self.codes = np.full((len(names), int(self.lens.max(initial=0))), len(alphabet), np.int32)
        self.counts = np.zeros((len(names), CLASSES), np.uint16)
        #: For each character, where a name of up to 64 has it, as bits.
        self.bits = np.zeros((len(names), len(alphabet) + 1), np.uint64)
        for i, name in enumerate(names):
            own = np.array([alphabet[c] for c in name], np.int64)
            self.codes[i, : len(own)] = own
            np.add.at(self.counts[i], own % CLASSES, 1)
            if len(own) <= 64:
                np.bitwise_or.at(self.bits[i], own, np.uint64(1) << np.arange(len(own), dtype=np.uint64))


def alphabet_of(*lists: list[str]) -> dict[str, int]:
    return {c: i for i, c in enumerate(sorted({c for names in lists for name in names for c in name}))}


def _subsequences(a: Names, i: np.ndarray, b: Names, j: np.ndarray) -> np.ndarray:
    """common_subsequence() of many pairs at once; the names of a have up to 64 characters."""
    full = np.where(a.lens[i] < 64, (np.uint64(1) << np.minimum(a.lens[i], 63).astype(np.uint64)) - np.uint64(1), np.uint64(2**64 - 1))
    rows = full.copy()
    for k in range(int(b.lens[j].max(initial=0))):
        hit = rows & a.bits[i, b.codes[j, k]]
        rows = (rows + hit | rows - hit) & full
    return a.lens[i] - np.bitwise_count(rows).astype(np.int64)


def alike_pairs(a: Names, b: Names, threshold: float, same: bool = False):
    """Blocks of (place in a, place in b, score) of the pairs at or over the threshold; of one list with itself, each pair once.

    Lengths, then counts of characters bound what a pair can reach; names are
    compared only where those allow it."""
    step = max(1, PAIRS * 8 // max(1, len(b.names)))
    for at in range(0, len(a.names), step):
        some = np.arange(at, min(at + step, len(a.names)))
        total = a.lens[some, None] + b.lens[None, :]
        can = 200.0 * np.minimum(a.lens[some, None], b.lens[None, :]) >= threshold * total
        if same:
            can &= np.arange(len(b.names))[None, :] > some[:, None]
        i, j = np.nonzero(can)
        for k in range(0, len(i), PAIRS):
            x, y = some[i[k : k + PAIRS]], j[k : k + PAIRS]
            most = np.minimum(a.counts[x], b.counts[y]).sum(axis=1, dtype=np.int64)
            near = 200.0 * most >= threshold * (a.lens[x] + b.lens[y])
            x, y = x[near], y[near]
            common = np.empty(len(x), np.int64)
            left = a.lens[x] <= 64
            right = ~left & (b.lens[y] <= 64)
            common[left] = _subsequences(a, x[left], b, y[left])
            common[right] = _subsequences(b, y[right], a, x[right])
            long = np.flatnonzero(~left & ~right)
            common[long] = [common_subsequence(a.names[p], b.names[q]) for p, q in zip(x[long].tolist(), y[long].tolist())]
            score = 200.0 * common / (a.lens[x] + b.lens[y])
            good = score >= threshold
            yield x[good], y[good], score[good]


@F.pandas_udf(DoubleType())
def python_round1(x: pd.Series) -> pd.Series:
    """To one place, by the exact value of the double; ties to even."""
    return x.map(lambda v: None if pd.isna(v) else round(v, 1))


def sorted_words(column):
    """The words of a name, sorted and joined by one space."""
    return F.array_join(F.array_sort(F.filter(F.split(column, r"\s+"), lambda w: w != "")), " ")
