"""Statistics of whole texts, for quality rules and classifiers.

Each family below is one function over a Buffer; what several need (words,
their hashes, lines) is computed once, when first asked for.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

from .exchange import U64
from .textbytes import LOWER, Buffer, Poly, byte_set, in_one_text, mix, spans, words_of

WORD, LINE, GRAM = Poly(71), Poly(72), Poly(73)
#: Fixed: the symbols `#*$%&|<>` of the base rule.
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
NEWLINE = byte_set((0x0A, 0x0A))
DIGIT, UPPER, ASCII_LETTER = byte_set((0x30, 0x39)), byte_set((0x41, 0x5A)), byte_set((0x41, 0x5A), (0x61, 0x7A))
#: Words of a repeated window.
REPEAT = 5


class Texts:
    """Statistics of a group of texts: arrays with a value for each."""

    def __init__(self, texts: list[bytes]):
        self.buffer = Buffer(texts)
        self.data = self.buffer.data

    def per_text(self, marked: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        total = np.concatenate([[0], np.cumsum(marked, dtype=np.int64)])
        return total[self.buffer.ends] - total[self.buffer.starts]

    def per_word(self, marked: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marked, dtype=np.int64)])
        return total[self.last] - total[self.first]

    @cached_property
    def words(self):
        return words_of(self.buffer)

    @cached_property
    def bounds(self):
        return self.buffer.counts(self.words[0])

    first = property(lambda self: self.bounds[0])
    last = property(lambda self: self.bounds[1])

    @cached_property
    def word_hashes(self):
        return WORD.of_spans(self.data, *self.words)

    @cached_property
    def word_text(self):
        """The text of each word."""
        return np.repeat(np.arange(len(self.first)), self.last - self.first)

    @cached_property
    def lines(self):
        """Starts, ends, texts and whether there is a word, for each line."""
        ends = np.flatnonzero(NEWLINE[self.data])
        starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
        words = np.searchsorted(self.words[0], ends) > np.searchsorted(self.words[0], starts)
        return starts, ends, self.buffer.text_at(ends), words

    @cached_property
    def points(self):
        return (self.data & 0xC0) != 0x80

    def n_words(self):
        return self.last - self.first

    def word_chars(self):
        starts, ends = self.words
        total = np.concatenate([[0], np.cumsum(self.points, dtype=np.int64)])
        own = np.concatenate([[0], np.cumsum(total[ends] - total[starts])])
        return own[self.last] - own[self.first]

    def n_chars(self):
        return self.per_text(self.points)

    def n_symbols(self):
        return self.per_text(SYMBOL[self.data])

    def n_dup_lines(self):
        starts, ends, text, full = self.lines
        starts, ends, text = starts[full], ends[full], text[full]
        h = mix(LINE.of_spans(self.data, starts, ends) + text.astype(U64))
        order = np.lexsort((starts, h))
        again = np.zeros(len(h), bool)
        again[order[1:]] = h[order[1:]] == h[order[:-1]]
        return np.bincount(text[again], minlength=len(self.first))

    def n_lines(self):
        _, _, text, full = self.lines
        return np.bincount(text[full], minlength=len(self.first))

    def n_repeat_words(self):
        """Words in windows of REPEAT words that occur twice or more in the text."""
        starts = self.words[0]
        at = np.flatnonzero(in_one_text(self.buffer, starts, REPEAT))
        h = mix(GRAM.rolling(self.word_hashes, REPEAT)[at] + self.word_text[at].astype(U64))
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        again = np.zeros(len(starts) + REPEAT, np.int8)
        for side in (order[1:][same], order[:-1][same]):
            for k in range(REPEAT):
                again[at[side] + k] = 1
        return self.per_word(again[: len(starts)] > 0)

    @cached_property
    def _counts(self):
        """Distinct words of each text, and the count of the most frequent one."""
        lowered = WORD.of_spans(LOWER[self.data], *self.words)
        h = mix(lowered + self.word_text.astype(U64))
        order = np.argsort(h)
        new = np.ones(len(h), bool)
        new[1:] = h[order[1:]] != h[order[:-1]]
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, len(h)))
        text = self.word_text[order[heads]]
        top = np.zeros(len(self.first), np.int64)
        np.maximum.at(top, text, size)
        return np.bincount(text, minlength=len(self.first)), top

    def n_distinct_words(self):
        return self._counts[0]

    def n_top_word(self):
        return self._counts[1]

    def n_echo_words(self):
        """Words equal to the one before, their case aside."""
        h = WORD.of_spans(LOWER[self.data], *self.words)
        echo = np.zeros(len(h), bool)
        echo[1:] = (h[1:] == h[:-1]) & (self.word_text[1:] == self.word_text[:-1])
        return self.per_word(echo)

    def n_upper(self):
        capital = UPPER[self.data]
        latin = (self.data[:-1] == 0xC3) & (self.data[1:] >= 0x80) & (self.data[1:] <= 0x9E)
        capital[1:] |= latin
        return self.per_text(capital)

    def n_letters(self):
        """ASCII letters and characters outside ASCII."""
        return self.per_text(ASCII_LETTER[self.data] | (self.data >= 0xC0))

    def n_digits(self):
        return self.per_text(DIGIT[self.data])

    def n_bangs(self):
        return self.per_text(self.data == 0x21)

    def n_pipes(self):
        return self.per_text(self.data == 0x7C)

    def n_stops(self):
        """Full stops, question and exclamation marks."""
        return self.per_text(np.isin(self.data, list(b".?!")))

    def n_commas(self):
        return self.per_text(self.data == 0x2C)

    def n_short_words(self):
        starts, ends = self.words
        return self.per_word(ends - starts <= 3)

    def n_long_words(self):
        starts, ends = self.words
        return self.per_word(ends - starts > 20)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_chars", "n_lines", "n_distinct_words", "n_top_word", "n_echo_words", "n_upper", "n_letters", "n_digits", "n_bangs", "n_pipes", "n_stops", "n_commas", "n_short_words", "n_long_words")
