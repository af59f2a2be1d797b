"""Quality rules as a short-circuit cascade.

The base statistics are due for every document. The rules after them are not:
on a sample, each rule's cost and the share it rejects are measured, the rules
are put in the order of rejections per second, and each one sees only what all
before it have passed. The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import BASE, Texts
from .textbytes import parts

Rule = Callable[[Texts], np.ndarray]

#: Each rule marks the texts that it rejects.
RULES: dict[str, Rule] = {
    "symbols": lambda t: 10 * t.n_symbols() > t.n_words(),
    "capitals": lambda t: 100 * t.n_upper() > 40 * t.n_letters(),
    "exclamation": lambda t: 5 * t.n_bangs() > t.n_words(),
    "table": lambda t: 5 * t.n_pipes() > t.n_words(),
    "echo": lambda t: 5 * t.n_echo_words() > t.n_words(),
    "one word": lambda t: (100 * t.n_top_word() > 30 * t.n_words()) & (t.n_words() >= 50),
    "lines": lambda t: (2 * t.n_dup_lines() > t.n_lines()) & (t.n_lines() >= 4),
    "word length": lambda t: (t.word_chars() > 15 * t.n_words()) | (t.word_chars() < 2 * t.n_words()),
    "long words": lambda t: 10 * t.n_long_words() > t.n_words(),
}
#: Documents on which cost and selectivity are measured, about.
SAMPLE = 2000
#: Bytes of a text that is among them, at most.
SAMPLED_TEXT = 1 << 16


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])


def measured(docs: DataFrame, text_col: str, rules: dict[str, Rule], sample: int) -> list[str]:
    """The rules' names by rejections per second on a sample, the best first.

    The sample is the first rows that come, so that no table is scanned for it;
    texts over SAMPLED_TEXT bytes cost no time in it. A rule's cost has what its
    rejections cause: the texts that pass are laid out anew. Rules that reject
    nothing come last, cheap ones first."""
    text = F.col(text_col).cast("string")
    # rows: `sample` at most, of SAMPLED_TEXT bytes at most
    texts = [r[0].encode() for r in docs.select(F.when(F.octet_length(text) <= SAMPLED_TEXT, text)).limit(sample).collect() if r[0]]
    cost: dict[str, list[float]] = {name: [0.0, 0] for name in rules}
    for i in range(0, len(texts), 200):
        some = texts[i : i + 200]
        again = time.perf_counter()
        Texts(some).bounds
        again = time.perf_counter() - again
        for name, rule in rules.items():
            fresh = Texts(some)
            _ = fresh.bounds  # the base has found the words already
            began = time.perf_counter()
            rejected = int(np.asarray(rule(fresh)).sum())
            cost[name][0] += time.perf_counter() - began + (again if rejected else 0)
            cost[name][1] += rejected
    return sorted(rules, key=lambda name: (-cost[name][1] / max(cost[name][0], 1e-9), cost[name][0]))


def cascade(texts: list[bytes], order: list[str], rules: dict[str, Rule]) -> np.ndarray:
    """The place in order of the first rule that rejects each text; -1 if none does."""
    out = np.full(len(texts), -1)
    left, group = np.arange(len(texts)), Texts(texts)
    for k, name in enumerate(order):
        if not len(left):
            break
        gone = np.asarray(rules[name](group))
        if gone.any():
            out[left[gone]] = k
            left = left[~gone]
            group = Texts([texts[i] for i in left])
    return out


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, Rule] | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the base statistics, base_failed, rejected_by and kept.

    Base: n_words, word_chars (code points in words), n_symbols, n_dup_lines
    (lines with a word, equal to an earlier one) and n_repeat_words (words in
    5-word windows that the text has twice or more); base_failed if n_words <
    10 or more than a fifth of the words are repeated. rejected_by names the
    first rule of the cascade that rejects a document which passes the base;
    kept is true if none does. A null or empty text has no words and fails;
    ids are only handed on; other columns are ignored; an empty table gives an
    empty result. Which of several rejecting rules is named depends on the
    measured order, kept does not.
    """
    rules = RULES if rules is None else rules
    order = measured(docs, text_col, rules, sample)

    def judge(batches):
        for batch in batches:
            for some, own in parts(batch, 1):
                group = Texts(own)
                base = {name: getattr(group, name)() for name in BASE}
                failed = base_failed(base)
                passed = np.flatnonzero(~failed)
                by = cascade([own[i] for i in passed], order, rules)
                names: list[str | None] = [None] * len(own)
                for i in np.flatnonzero(by >= 0):
                    names[passed[i]] = order[by[i]]
                kept = ~failed
                kept[passed[by >= 0]] = False
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(v, pa.int64()) for v in base.values()), pa.array(failed), pa.array(names, pa.string()), pa.array(kept)], names=["doc_id", *BASE, "base_failed", "rejected_by", "kept"])

    schema = f"doc_id long, {', '.join(f'{n} long' for n in BASE)}, base_failed boolean, rejected_by string, kept boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(judge, schema)
