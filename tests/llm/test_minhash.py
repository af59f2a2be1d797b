import random

import numpy as np
import pytest
from brute_llm import WORD, lower, raw

from yearbook.llm.minhash import band_keys
from yearbook.llm.simhash import one_of_each


def shingles(text, k=5):
    words = WORD.findall(lower(raw(text)))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def plain(docs, similarity=(4, 5)):
    """The smallest id of each group; ids are distinct."""
    sets = [(d, shingles(t)) for d, t in docs]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x == y or similarity[1] * len(x & y) >= similarity[0] * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted({find(d) for d, _ in sets})


def edited(r, words, n):
    """A copy with n words replaced."""
    out = list(words)
    for i in r.sample(range(len(out)), n):
        out[i] = f"new{r.randrange(10**6)}"
    return out


@pytest.mark.parametrize("most", [1 << 21, 400])
def test_edited_copies(spark, most):
    r = random.Random(4)
    rows = [(10**6, None), (10**6 + 1, " \n"), (10**6 + 2, "One two"), (10**6 + 3, "one  TWO"), (10**6 + 4, "one two three")]
    for g in range(40):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randrange(60, 400))]
        rows += [(g * 10 + i, " ".join(edited(r, base, len(base) * i // 60))) for i in range(6)]
    # similarity exactly 0.8, and just under it: 36 of 45 shingles, 36 of 46
    line = [f"x{i}" for i in range(49)]
    rows += [(5000, " ".join(line)), (5001, " ".join(line[:40])), (5002, " ".join(f"y{i}" for i in range(50))), (5003, " ".join(f"y{i}" for i in range(40)))]
    df = spark.createDataFrame([(d, t, "more") for d, t in rows], "doc_id long, text string, keys string")
    got = one_of_each(df, most=most).collect()
    expected = plain(rows)
    assert sorted(x["doc_id"] for x in got) == expected and all(x["keys"] == "more" for x in got)
    assert 5000 in expected and 5001 not in expected and 5002 in expected and 5003 in expected


def test_candidates_at_the_similarity():
    r = np.random.default_rng(8)
    sets = [np.concatenate([c, x]) for c in r.integers(0, 2**64, (3000, 80), np.uint64) for x in (r.integers(0, 2**64, 10, np.uint64), r.integers(0, 2**64, 10, np.uint64))]
    keys = band_keys(np.concatenate(sets), np.arange(6001) * 90)
    same = (keys[::2] == keys[1::2]).sum(axis=1)
    assert (same > 0).all() and abs(same.mean() / 40 - 0.8**4) < 0.02


def test_pipeline_stage_drops_edited_copies(spark):
    import corpus_pipeline as P

    r = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(edited(r, base, 3))) for i in range(8)]
    df = spark.createDataFrame([*rows, (9, " ".join(edited(r, base, 120)))], "doc_id long, text string")
    expected = plain([(x["doc_id"], x["text"]) for x in df.collect()])
    assert sorted(x["doc_id"] for x in P.near_dedup(spark, df, "").collect()) == expected and len(expected) < 9
