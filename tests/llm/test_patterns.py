import random

import numpy as np
import pytest
from brute_llm import benchmark
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from yearbook.llm import queries as Q
from yearbook.llm.patterns import CLASSES, WuManber, contamination


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), F.col("n_hit") > 0).collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=3, max_size=12).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=6, unique=True), st.binary(max_size=700).map(lambda b: bytes(97 + x % 2 for x in b)))
def test_wu_manber_finds_all(patterns, text):
    found = set()
    for (least, block), most in zip(CLASSES, (10**9, 32, 16, 8)):
        if some := [p for p in patterns if least <= len(p) < most]:
            at, p = WuManber(some, block).search(np.frombuffer(text + bytes(8), np.uint8), len(text))
            found |= {(a, some[k]) for a, k in zip(at.tolist(), p.tolist())}
    assert found == {(i, p) for p in patterns for i in range(len(text)) if text.startswith(p, i)}


def tables(spark):
    r = random.Random(8)
    some = lambda n: " ".join(r.choice(["a", "Bé", "cc9", "d-d", "日本", "word", "x" * 40]) for _ in range(n))
    items = [(3, some(30)), (10, some(10)), (4, "a"), (5, "Zeta zeta"), (6, ""), (7, None), (8, "!!"), (10, some(12)), (None, some(9) + " unique"), (11, "q w e r t y u i o p " * 3)]
    texts = [None, "", "...", "zeta ZETA zeta", "zeta", "A!", items[0][1], items[0][1].upper() + " tail", some(5000), f"{some(4)}\n{items[0][1]}", items[8][1], "q.w.e.r.t.y.u.i.o.p", "q w e r t y u i o", f"beta {items[1][1]} beta"]
    docs = [(i * 7 % 31, t) for i, t in enumerate(texts)]
    return docs, items, spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, items string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("item_bytes", [1 << 20, 200])
def test_odd_texts(spark, item_bytes):
    docs, items, d, i = tables(spark)
    out = contamination(d, i, item_bytes=item_bytes)
    assert got(out) == benchmark(docs, [("" if k is None else k, t) for k, t in items])


def test_empty_and_carried(spark):
    docs, items, d, i = tables(spark)
    assert got(contamination(d.limit(0), i)) == []
    assert {r["n_hit"] for r in contamination(d, i.limit(0)).collect()} == {0}
    out = contamination(d, i, carry=("text", "doc_id"))
    assert sorted((r["carried"]["text"] or "") for r in out.collect()) == sorted((t or "") for _, t in docs)


def test_query(spark, sf):
    rows = lambda name: [tuple(r)[:2] for r in Q.table(spark, sf, name).collect()]
    assert sorted(tuple(r) for r in Q.queries()["op9_benchmark_decontamination"](spark, sf).collect()) == benchmark(rows("documents"), rows("benchmark"))


def test_null_ids_and_repeated_rows(spark):
    docs, items, _, i = tables(spark)
    rows = [(None, docs[6][1]), (None, docs[6][1]), (4, docs[13][1]), (4, docs[13][1]), (4, None)]
    out = contamination(spark.createDataFrame(rows, "doc_id long, text string"), i.unionByName(i))
    found = [tuple(r) for r in out.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), F.col("n_hit") > 0).collect()]
    plain = benchmark([(-1 if d is None else d, t) for d, t in rows], [("" if k is None else k, t) for k, t in items])
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in found) == plain
