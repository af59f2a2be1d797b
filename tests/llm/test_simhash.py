import random

import numpy as np
import pytest
import xxhash
from brute_llm import WORD, lower, raw
from hypothesis import given, settings
from hypothesis import strategies as st

from yearbook.llm import queries as Q
from yearbook.llm.simhash import codewords, keys_of, linked, links, near_duplicates
from yearbook.llm.xxh import xxh64


def plain_print(text):
    words = WORD.findall(lower(raw(text)))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain(docs, prints):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(parent)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for (d, _), p in zip(docs, prints):
        least[root(p)] = min(least.get(root(p), d), d)
    return sorted((d, f"{p:016x}", least[root(p)]) for (d, _), p in zip(docs, prints))


@given(st.lists(st.binary(max_size=100), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_xxh64(parts):
    parts.append(b"long" * 200)
    ends = np.cumsum([len(p) for p in parts])
    got = xxh64(np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]


def test_codewords_cover():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 23, 3000)
    for bits in (1, 2):
        y = x.copy()
        for row in range(len(x)):
            for b in r.choice(23, bits, replace=False):
                y[row] ^= 1 << int(b)
        for a, b in zip(codewords(x), codewords(y)):
            assert set(a[a >= 0]) & set(b[b >= 0])
            if bits == 1:
                assert a[0] in b


def test_no_link_is_lost():
    r = random.Random(2)
    x, y = [], []
    for bits in (1, 2, 3, 4) * 500:
        a = r.getrandbits(64)
        b = a
        for k in r.sample(range(64), bits):
            b ^= 1 << k
        x.append(a)
        y.append(b)
    every = np.array(x + y, np.uint64)
    keys, places = keys_of(every)
    a, b, _ = linked(keys, every[places], 4)
    assert {*zip(a.tolist(), b.tolist())} == {(max(p), min(p)) for p in zip(x, y)}


@pytest.mark.parametrize("hot", [8, 1 << 13])
def test_crowded_keys(spark, hot):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(3)]
    prints = {b ^ sum(1 << k for k in r.sample(range(64), r.randrange(6))) for b in base for _ in range(60)}
    parent = {p: p for p in prints}
    for _ in range(100):
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= 4:
                    parent[a] = parent[b] = min(parent[a], parent[b])
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    edges = links(spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long"), hot=hot).collect()
    found = {p: p for p in prints}
    for _ in range(100):
        for e in edges:
            a, b = e["a"] % 2**64, e["b"] % 2**64
            found[a] = found[b] = min(found[a], found[b])
    assert found == parent


def test_odd_texts(spark):
    r = random.Random(6)
    base = [f"W{r.randrange(500)}" for _ in range(400)]
    rows = [(40, None), (30, ""), (20, " \n"), (5, "One two"), (4, "one\ttwo"), (3, "one two three four five"), (2, "x" * 9000)]
    rows += [(100 + i, " ".join([*base[: 395 + r.randrange(5)], *(f"v{r.randrange(9)}" for _ in range(r.randrange(4)))])) for i in range(60)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fingerprint int")
    got = sorted((x["doc_id"], f"{x['fingerprint'] % 2**64:016x}", x["component_id"]) for x in near_duplicates(df).collect())
    assert got == plain(rows, [plain_print(t) for _, t in rows])
    assert near_duplicates(spark.createDataFrame([], df.schema)).collect() == []
    some = near_duplicates(spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "c d"), (None, "C D")], "doc_id long, text string")).collect()
    assert sorted(str(x["component_id"]) for x in some) == ["3", "3", "None", "None"]


def test_query(spark, sf):
    docs = [(x["doc_id"], x["text"]) for x in Q.table(spark, sf, "documents").collect()]
    got = sorted(tuple(x) for x in Q.queries()["op2_simhash_near_dedup"](spark, sf).collect())
    assert got == plain(docs, [plain_print(t) for _, t in docs])
