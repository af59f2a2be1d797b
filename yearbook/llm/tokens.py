"""Token ids of whole texts, by a public tokenizer's own file.

A word occurs many times, so each worker encodes a piece of text once and keeps
its ids. Text is cut where the tokenizer surely cuts too: at ASCII white space,
and between plain letters and ASCII characters that are not letters. A chunk
with anything else (an apostrophe, which starts contractions; '<', which may
start a special token; characters outside ASCII and Latin-1 letters, which
normalisation may join) is handed to the tokenizer as it is. Pieces of plain
letters go straight to the tokenizer's model, lower-cased.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np

from .exchange import U64
from .textbytes import LOWER, SPACE, Buffer, Poly, byte_set, spans

PIECE = Poly(61)
#: Pieces a worker keeps at most; it then starts anew.
KEPT = 500_000
LETTER = byte_set((0x61, 0x7A))
ODD = byte_set((0x27, 0x27), (0x3C, 0x3C), (0x80, 0xFF))


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_names() -> list[str]:
    """The character by which byte-level BPE writes each byte: itself if printable, else the next from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


class Encoder:
    """The ids of texts, by one tokenizer file."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.names = _byte_names()
        self.clear()

    def clear(self) -> None:
        self.known = np.empty(0, U64)
        self.first = np.empty(0, np.int64)
        self.n = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def pieces(self, data: np.ndarray):
        """Lower-cased bytes, and the starts, ends and kinds (plain letters, or not) of the pieces."""
        lowered = LOWER[data]
        lead = lowered[:-1] == 0xC3
        nxt = lowered[1:]
        latin = np.zeros(len(data), bool)
        latin[:-1] = lead & (nxt >= 0x80) & (nxt <= 0xBF) & (nxt != 0x97) & (nxt != 0xB7)
        latin[1:] |= latin[:-1]
        capital = np.zeros(len(data), bool)
        capital[1:] = lead & (nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)
        odd = np.flatnonzero(ODD[data] & ~latin)
        lowered[capital] += 0x20
        kind = LETTER[lowered].view(np.uint8) + 2
        kind[latin] = 3
        kind[SPACE[data]] = 0
        if len(odd):  # whole chunks, in their own case
            starts, ends = spans(data, SPACE)
            hit = np.unique(np.searchsorted(starts, odd, "right") - 1)
            step = np.zeros(len(data) + 1, np.int8)
            step[starts[hit]] = 1
            step[ends[hit]] -= 1
            whole = np.cumsum(step[:-1], dtype=np.int8) > 0
            kind[whole] = 1
            lowered[whole] = data[whole]
        at = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)) != 0)
        ends = np.append(at[1:], len(kind))
        kinds = kind[at]
        return lowered, at[kinds > 0], ends[kinds > 0], kinds[kinds > 0]

    def learn(self, hashes: np.ndarray, pieces: list[bytes], kinds: list[int]) -> None:
        model, names = self.tokenizer.model, self.names
        got = [[t.id for t in model.tokenize("".join([names[c] for c in p]))] if k == 3 else None for p, k in zip(pieces, kinds)]
        rest = [i for i, g in enumerate(got) if g is None]
        for i, e in zip(rest, self.tokenizer.encode_batch([pieces[i].decode() for i in rest], add_special_tokens=False)):
            got[i] = e.ids
        n = np.fromiter(map(len, got), np.int64, len(got))
        if len(self.known) + len(n) > KEPT:
            self.clear()
        first = np.cumsum(n) - n + len(self.ids)
        self.ids = np.concatenate([self.ids, np.fromiter((i for g in got for i in g), np.uint32, int(n.sum()))])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known)
        self.known, self.first, self.n = known[order], np.concatenate([self.first, first])[order], np.concatenate([self.n, n])[order]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.known):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return at, self.known[at] == hashes

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and the number of each text's ids."""
        buffer = Buffer(texts)
        if not len(buffer.data):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        lowered, starts, ends, kinds = self.pieces(buffer.data)
        hashes = PIECE.of_spans(lowered, starts, ends) ^ kinds.astype(U64)
        order = np.argsort(hashes)
        ordered = hashes[order]
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        heads = np.flatnonzero(new)
        distinct, sample = ordered[heads], order[heads]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        _, have = self.find(distinct)
        if not have.all():
            if len(self.known) + int((~have).sum()) > KEPT:
                self.clear()
                have[:] = False
            miss = sample[~have]
            raw = lowered.tobytes()
            self.learn(distinct[~have], [raw[a:b] for a, b in zip(starts[miss].tolist(), ends[miss].tolist())], kinds[miss].tolist())
        at, _ = self.find(distinct)
        first, n = self.first[at], self.n[at].astype(np.int64)
        counts = n[group]
        total = np.cumsum(counts)
        out = np.repeat(first[group] - (total - counts), counts)
        out += np.arange(len(out))
        before = np.concatenate([[0], total])
        lo, hi = np.searchsorted(starts, buffer.starts, "left"), np.searchsorted(starts, buffer.ends, "left")
        return self.ids[out], before[hi] - before[lo]


@cache
def encoder(path: str) -> Encoder:
    """The worker's encoder: what it has learned serves all its tasks."""
    return Encoder(path)
