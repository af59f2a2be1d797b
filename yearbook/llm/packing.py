"""Packing documents into as few sequences as possible.

Swap-based local search packs them. Its bins start as a plain deal, next fit in
shuffled order. Then the emptiest bin gives documents to fuller ones - one moves,
one is exchanged for one, two for one or one for two - whenever this increases
the sum of squared fills, until bins are empty or no exchange helps.

The search sees lengths, not documents, and does not grow with the corpus. In
the order of their lengths, pieces form UNIT groups of equal number at most. A
group's first piece, the longest, stands for it in the search, and each bin
found stands for as many sequences: the j-th one takes the j-th piece of each of
its groups. So what grouping costs is half a bin to each of them, one part in
thousands; a corpus of UNIT pieces or fewer is packed piece by piece. Lengths
by rank come from the counts of lengths, so each row works out its own place.
"""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .exchange import written
from .memory import freeing
from .shingles import _spread
from .textbytes import parts
from .tokens import encoder

#: Groups of pieces that the search packs, at most.
UNIT = 1 << 14
#: Exchanges for each of them, at most. Where that ends the search, all pieces have their
#: places, and only more bins may be left than need be.
EXCHANGES = 16


def dealt(pieces: list[int], size: int) -> list[list[int]]:
    """A plain deal: in shuffled order, each piece into the last bin or a new one."""
    bins: list[list[int]] = []
    room = 0
    for x in random.Random(len(pieces)).sample(pieces, len(pieces)):
        if room < x:
            bins.append([])
            room = size
        bins[-1].append(x)
        room -= x
    return bins


class Search:
    """Bins of some thousands of pieces, and the exchanges between them.

    Underfull bins are found by their room, and by the room that they have once
    a certain piece of theirs is taken: the least that suffices is the next byte
    set in a table."""

    def __init__(self, bins: list[list[int]], size: int):
        self.bins = [list(b) for b in bins]
        self.room = [size - sum(b) for b in bins]
        self.left = len(bins)
        self.least = -(-sum(map(sum, bins)) // size)
        self.most = EXCHANGES * sum(map(len, bins))
        self.by_room: dict[int, dict[int, None]] = defaultdict(dict)  # room: bins
        self.by_swap: dict[int, dict[tuple[int, int], None]] = defaultdict(dict)  # room without a piece: (piece, bin)
        self.has_room, self.has_swap = bytearray(size + 1), bytearray(size + 1)
        self.donors: dict[int, dict[int, None]] = defaultdict(dict)  # those not known to be stuck, by room
        self.has_donor = bytearray(size + 1)
        for b in range(len(self.bins)):
            self.enter(b)

    def enter(self, b: int) -> None:
        r = self.room[b]
        if not r or not self.bins[b]:
            return
        self.by_room[r][b] = None
        self.has_room[r] = 1
        for t in set(self.bins[b]):
            self.by_swap[r + t][t, b] = None
            self.has_swap[r + t] = 1
        self.donors[r][b] = None
        self.has_donor[r] = 1

    def leave(self, b: int) -> None:
        r = self.room[b]
        if not r:
            return
        for t in set(self.bins[b]):
            _drop(self.by_swap, self.has_swap, r + t, (t, b))
        _drop(self.by_room, self.has_room, r, b)
        _drop(self.donors, self.has_donor, r, b)

    def run(self) -> None:
        done = tried = 0
        while self.left > self.least and done < self.most:
            r = self.has_donor.rfind(1)
            if r < 0:  # all are stuck: again, if anything has changed since
                if tried == done:
                    break
                tried = done
                for room, some in self.by_room.items():
                    if some:
                        self.donors[room] = dict(some)
                        self.has_donor[room] = 1
                continue
            donor = next(iter(self.donors[r]))
            self.leave(donor)
            found = self.move(donor) or self.swap(donor, 1) or self.swap(donor, 2) or self.one_for_two(donor)
            if not found:
                self.enter(donor)
                _drop(self.donors, self.has_donor, r, donor)
                continue
            other, give, take = found
            self.leave(other)
            for b, gone, new in ((donor, give, take), (other, take, give)):
                for x in gone:
                    self.bins[b].remove(x)
                self.bins[b] += new
                self.room[b] += sum(gone) - sum(new)
                self.enter(b)
            self.left -= not self.bins[donor]
            done += 1

    def gains(self, donor: int, other_room: int, gain: int) -> bool:
        """Whether the squared fills grow if so much goes from the donor to a bin with that room."""
        return gain > other_room - self.room[donor]

    def move(self, donor: int):
        for x in sorted(set(self.bins[donor]), reverse=True):
            r = self.has_room.find(1, x)
            if r >= 0 and self.gains(donor, r, x):
                return next(iter(self.by_room[r])), (x,), ()
        return None

    def swap(self, donor: int, n: int):
        """One or two of the donor's for a shorter one: that which moves most to the fullest use of a room."""
        own = sorted(self.bins[donor], reverse=True)
        gives = {(x,) for x in own} if n == 1 else {(x, y) for i, x in enumerate(own) for y in own[i + 1 :]}
        best, most = None, 0
        for give in sorted(gives, reverse=True):
            total = sum(give)
            c = self.has_swap.find(1, total)
            while c >= 0:
                t, b = min(self.by_swap[c])
                if total - t > most and self.gains(donor, self.room[b], total - t):
                    best, most = (b, give, (t,)), total - t
                if t < total:
                    break
                c = self.has_swap.find(1, c + 1)
        return best

    def one_for_two(self, donor: int):
        """One of the donor's for two shorter ones that leave it the most to give."""
        best, most = None, 0
        for r, some in self.by_room.items():
            for b in some:
                own = sorted(self.bins[b])
                for x in set(self.bins[donor]):
                    i, j = 0, len(own) - 1
                    while i < j:  # the least pair that makes room enough
                        pair = own[i] + own[j]
                        if r + pair < x:
                            i += 1
                            continue
                        if x - pair > most and self.gains(donor, r, x - pair):
                            best, most = (b, (x,), (own[i], own[j])), x - pair
                        j -= 1
        return best


def _drop(by: dict, has: bytearray, key: int, value) -> None:
    by[key].pop(value, None)
    if not by[key]:
        has[key] = 0


class Packing:
    """Where each of so many pieces of each length goes."""

    def __init__(self, counts: dict[int, int], size: int, unit: int = UNIT):
        self.lengths = np.array(sorted((k for k, n in counts.items() if n), reverse=True), np.int64)
        #: How many pieces are longer, or as long, as each length.
        self.ends = np.cumsum([counts[k] for k in self.lengths.tolist()], dtype=np.int64)
        n = int(self.ends[-1]) if len(self.ends) else 0
        self.copies = max(1, -(-n // unit))
        groups = self.length_at(np.arange(0, n, self.copies))
        first = dealt(groups.tolist(), size)
        search = Search(first, size)
        search.run()
        #: Bins dealt, left by the search, and the least that could hold the groups.
        self.dealt, self.left, self.least = len(first), search.left, search.least
        of: dict[int, list[int]] = defaultdict(list)
        for g, length in enumerate(groups.tolist()):
            of[length].append(g)
        bins = [sorted(of[x].pop() for x in some) for some in search.bins if some]
        sizes = np.array([len(b) for b in bins], np.int64)
        #: The groups of all bins, bin after bin; each group's bin, and how many of the bin's come before it.
        self.slots = np.array([g for b in bins for g in b], np.int64)
        self.bin, self.before = np.empty(len(groups), np.int64), np.empty(len(groups), np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.bin[self.slots] = np.repeat(np.arange(len(bins)), sizes)
        self.before[self.slots] = np.arange(len(self.slots)) - np.repeat(self.first, sizes)

    def length_at(self, ranks: np.ndarray) -> np.ndarray:
        """The length of the piece of each rank, long ones first; 0 beyond the last."""
        return np.append(self.lengths, 0)[np.searchsorted(self.ends, ranks, "right")]

    def at(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of these lengths, by their ranks among those of their length."""
        row = np.searchsorted(-self.lengths, -lengths)
        group, copy = np.divmod(np.append(0, self.ends)[row] + ranks, self.copies)
        b, before = self.bin[group], self.before[group]
        earlier = self.slots[_spread(self.first[b], before)]
        sizes = np.append(0, np.cumsum(self.length_at(earlier * self.copies + np.repeat(copy, before))))
        ends = np.cumsum(before)
        return b * self.copies + copy, sizes[ends] - sizes[ends - before]


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each piece, with its rank among its partition's pieces of that length."""
    tail = np.array([end_id], np.uint32)

    def cut(batches):
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            for some, texts in parts(batch, 1):
                ids, n = encoder(tokenizer).encode(texts)
                at = np.concatenate([[0], np.cumsum(n)]).tolist()
                rows = []
                for doc, a, b in zip(some.column(0).to_pylist(), at, at[1:]):
                    own = np.concatenate([ids[a:b], tail]).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), size)):
                        data = own[start : start + size]
                        rows.append((doc, piece, start, len(data), zlib.crc32(data.tobytes()), part, seen[len(data)]))
                        seen[len(data)] += 1
                cols = list(zip(*rows)) or [()] * 7
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "own_rank"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        freeing(cut), "doc_id long, piece int, start long, length long, ids_crc32 long, part long, own_rank long"
    )


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most `size` ids.

    A document is its ids and the end id. Only longer ones are cut, into pieces
    of `size` ids and a last one that may be shorter. Returns for each piece
    doc_id, piece (from 0), start (ids of its document before it), length,
    ids_crc32 (of its little-endian unsigned 32-bit ids), sequence_id (any
    numbers) and offset (its place there, without gaps from 0). A null text is
    empty: the end id alone. Repeated rows and equal or null ids are packed row
    by row; other columns are ignored; an empty table gives an empty result.
    """
    cut = written(pieces(docs, tokenizer, size, end_id, id_col, text_col))
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    # rows: at most `size` lengths
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    packing = Packing(counts, size)
    before = by_part.select("part", "length", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))

    def place(batches):
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("own_rank").to_numpy() + b.column("before").to_numpy()
            sequence, offset = packing.at(length, rank)
            yield pa.record_batch([*(b.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    joined = cut.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "own_rank", "before")
    return joined.mapInArrow(freeing(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
