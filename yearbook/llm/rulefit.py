"""A quality classifier as a sparse ensemble of rules.

Boosted shallow trees are grown on statistics of a bounded sample of labelled
texts; every path from a root is a rule, a conjunction of conditions. A lasso
logistic regression keeps few of them, and those become one Spark column
expression over the statistics: scoring runs no model code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import freeing
from .stats import BASE, MORE, Texts
from .textbytes import parts

#: Labelled rows that a model is fitted on, at most about so many.
FIT_ROWS = 20_000
TREES, DEPTH, CUTS, RATE, LEAST_ROWS = 60, 3, 31, 0.2, 10
#: Strengths of the lasso, tried on a part of the sample that is not fitted.
PENALTIES = (0.03, 0.01, 0.003, 0.001, 0.0003)
#: Statistics in relation to the words, lines or letters of a text.
PER_WORD = tuple(n for n in (*BASE, *MORE) if n not in ("n_words", "n_lines", "n_dup_lines", "n_letters", "n_upper", "n_distinct_words"))
FEATURES = ("words", "lines_per_word", "dup_lines_per_line", "upper_per_letter", "letters_per_char", "distinct_per_root", *(f"{n.removeprefix('n_')}_per_word" for n in PER_WORD))


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text; all are 0 for one without words."""
    t = Texts(texts)
    s = {name: getattr(t, name)().astype(float) for name in (*BASE, *MORE)}
    by = lambda a, b: a / np.maximum(b, 1)
    n = s["n_words"]
    out = [n, by(s["n_lines"], n), by(s["n_dup_lines"], s["n_lines"]), by(s["n_upper"], s["n_letters"]), by(s["n_letters"], s["n_chars"]), by(s["n_distinct_words"], n**0.8), *(by(s[name], n) for name in PER_WORD)]
    return np.stack(out, axis=1) * (n > 0)[:, None]


def with_features(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns named in carry, as the struct `carried`, and a double column for each of FEATURES."""

    def measure(batches):
        for batch in batches:
            for rows, texts in parts(batch, 0):
                x = features(texts)
                yield pa.RecordBatch.from_arrays([rows.column(1), *(pa.array(x[:, k]) for k in range(x.shape[1]))], names=["carried", *FEATURES])

    source = docs.select(F.col(text_col).cast("string").alias("text"), F.struct(F.lit(0).alias("_none"), *(F.col(c) for c in carry)).alias("carried"))
    return source.mapInArrow(freeing(measure), f"carried {source.schema['carried'].dataType.simpleString()}, {', '.join(f'{n} double' for n in FEATURES)}")


@dataclass(frozen=True)
class Rule:
    """Conditions (feature, above?, threshold) that must all hold."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, t in self.conditions:
            out &= (x[:, k] > t) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, above, t in self.conditions:
            c = F.col(FEATURES[k])
            out = out & (c > F.lit(t) if above else c <= F.lit(t))
        return out


@dataclass
class Model:
    base: float = 0.0
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.base + sum((w * r.holds(x) for r, w in zip(self.rules, self.weights)), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        z = F.lit(float(self.base))
        for r, w in zip(self.rules, self.weights):
            z = z + F.when(r.column(), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(x: np.ndarray, cuts: list[np.ndarray], bins: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, path: tuple, depth: int, out: list[Rule], step: np.ndarray, allowed: np.ndarray) -> None:
    """Split rows where the logistic loss falls most; leaves add to step."""
    best = (1e-6, None, None)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    if depth and len(rows) >= 2 * LEAST_ROWS:
        for k in allowed:
            n = len(cuts[k]) + 1
            b = bins[rows, k]
            sg, sh, c = (np.cumsum(np.bincount(b, weights=w, minlength=n))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            good = (c >= LEAST_ROWS) & (len(rows) - c >= LEAST_ROWS)
            gain = np.where(good, sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1), 0)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), k, int(gain.argmax()))
    if best[1] is None:
        step[rows] = total_g / (total_h + 1)
        return
    _, k, at = best
    for above in (False, True):
        own = (*path, (int(k), above, float(cuts[k][at])))
        out.append(Rule(own))
        _grow(x, cuts, bins, g, h, rows[(bins[rows, k] > at) == above], own, depth - 1, out, step, allowed)


def grown(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The rules of boosted trees, each on a part of the rows and features."""
    rng = np.random.default_rng(17)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, CUTS + 2)[1:-1])) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1)
    z = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rules: list[Rule] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(y)) < 0.6)
        allowed = rng.permutation(x.shape[1])[: max(4, x.shape[1] // 2)]
        own: list[Rule] = []
        step = np.zeros(len(y))
        _grow(x, cuts, bins, y - p, p * (1 - p), np.arange(len(y)) if len(rows) < 4 * LEAST_ROWS else rows, (), DEPTH, own, step, allowed)
        rules += own
        z += RATE * step
    kept, seen = [], set()
    for r in rules:
        mark = (hold := r.holds(x)).tobytes()
        if 0 < hold.sum() < len(y) and mark not in seen:
            seen.add(mark)
            kept.append(r)
    return kept


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, start: tuple[np.ndarray, float], rounds: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for the mean logistic loss; the constant is free."""
    w, b = start
    v, c, t = w.copy(), b, 1.0
    rate = 4.0 / (np.linalg.norm(a, 2) ** 2 / len(y) + 1)
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(a @ v + c))) - y
        new = v - rate * (a.T @ r) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = c - rate * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return w, b


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of the chance of label 1; constant if the labels are all alike or none."""
    if not len(y) or y.min() == y.max():
        return Model(0.0 if not len(y) else 4.0 * (2 * float(y[0]) - 1))
    aside = np.arange(len(y)) % 5 == 4
    if aside.sum() < 20 or y[~aside].min() == y[~aside].max():
        aside[:] = False
    rules = grown(x[~aside], y[~aside])
    hold = np.stack([r.holds(x) for r in rules], axis=1) if rules else np.zeros((len(y), 0), bool)
    share = hold[~aside].mean(axis=0)
    scale = np.sqrt(np.maximum(share * (1 - share), 1e-4))
    a = (hold - share) / scale
    start, best = (np.zeros(len(rules)), 0.0), (np.inf, None)
    for penalty in PENALTIES:
        start = lasso(a[~aside], y[~aside], penalty, start)
        some = aside if aside.any() else np.ones(len(y), bool)
        z = a[some] @ start[0] + start[1]
        loss = float(np.logaddexp(0, np.where(y[some] > 0, -z, z)).mean())
        if loss < best[0] - 1e-6:
            best = (loss, start)
    w, b = best[1]
    live = np.flatnonzero(w)
    return Model(float(b - (w * share / scale).sum()), [rules[k] for k in live], [float(w[k] / scale[k]) for k in live])


def held_out(id_col: str) -> Column:
    """Rows that no model learns from: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """A model fitted on at most about fit_rows labelled texts, chosen by a hash of their ids.

    Only the ids, the label and the texts are read, whatever other columns there
    are; null ids and labels are left out; of repeated rows each counts."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col)).select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("int").alias("_label"))
    total = rows.count()
    if total > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * fit_rows / total))
    # the labelled rows are bounded: their side is small whatever the corpus is
    some = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(rows), "_id")
    got = with_features(some, "_text", ("_id", "_label")).select("carried._id", "carried._label", *FEATURES).toPandas().sort_values(["_id", *FEATURES])
    return fit(got[list(FEATURES)].to_numpy(float), got["_label"].to_numpy(float))


def scored(docs: DataFrame, model: Model, text_col: str = "text", carry: tuple[str, ...] = (), threshold: float = 0.3) -> DataFrame:
    """The columns named in carry, score (0 to 1, the chance of label 1) and predicted (1 from the threshold on).

    Every row is scored, whole text; a null or empty text by statistics that
    are all 0; repeated rows one by one; an empty table gives an empty result.
    Other columns are ignored, and those carried may be called like a statistic:
    they travel in a struct. score and predicted are the results' own names.
    """
    out = with_features(docs, text_col, carry).withColumn("_score", model.column())
    return out.select(*(F.col(f"carried.`{c}`") for c in carry), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))
