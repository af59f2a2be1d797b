import random

import brute_llm as brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from yearbook.llm.lines import LineIndex, PerfectHash, drop_shared_lines
from yearbook.llm.substring import remove_repeats
from yearbook.llm.suffix import common_prefixes, minima, remove_repeated_bytes, repeated_starts, suffix_array
from yearbook.llm import queries as Q


def corpus():
    """Odd texts: null, empty, white space only, copies, shared passages, periods, one very long."""
    r = random.Random(3)
    vocabulary = ["a", "Bé", "cc", "ddd", "e,", "ñandú", " x", "zz\x00z", "日本", "q" * 70]
    some = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared, other = some(60), some(200)
    texts = [None, "", " \t\n", "one", some(12), some(13), shared, shared, f"{some(5)}\n{shared} {some(9)}", f"{some(7)} {other}", f"{other}\r\n{some(3)}", "x " * 500, "ab " * 300, "ab " * 400 + shared, other[:700], f"{shared}  {shared}", some(5000), "y" * 3000, "\n".join(["The same line, in full"] * 3), " the same LINE, in full\t\nshort\nshort", "short\n\nthe same line, in full", "y" * 399, "y" * 400]
    texts += [f"{some(r.randrange(40))}\n{other[r.randrange(300):r.randrange(400, 900)]} {some(r.randrange(40))}" for _ in range(40)]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "chunk", 1) for d, t in rows], "doc_id long, text string, chunk string, shard int")


def got(df, *cols):
    return sorted(tuple(r) for r in df.selectExpr("doc_id", *cols).collect())


CASES = {
    "substring": (remove_repeats, brute.substring, ("n_words", "n_removed", "sha2(text, 256)")),
    "suffix": (remove_repeated_bytes, brute.suffix, ("n_bytes", "n_removed", "n_spans", "sha2(kept, 256)")),
    "lines": (drop_shared_lines, brute.lines, ("n_lines", "n_dropped", "sha2(text, 256)")),
}


@pytest.mark.parametrize("case", CASES)
def test_odd_texts(spark, case):
    ours, plain, cols = CASES[case]
    rows = corpus()
    assert got(ours(frame(spark, rows).repartition(5)), *cols) == plain(rows)


@pytest.mark.parametrize("case", CASES)
def test_empty_table_and_null_ids(spark, case):
    ours, _, cols = CASES[case]
    assert got(ours(frame(spark, [])), *cols) == []
    text = "a line that is long " * 40
    out = ours(frame(spark, [(None, text), (1, text)])).collect()
    assert sorted((r["doc_id"] is None) for r in out) == [False, True]


@pytest.mark.parametrize("case", CASES)
def test_tasks_with_several_shards(spark, case, monkeypatch):
    from yearbook.llm import exchange

    monkeypatch.setattr(exchange, "SHARD_BYTES", 4096)
    monkeypatch.setattr(exchange, "CHUNK_BYTES", 4096)
    monkeypatch.setattr(exchange, "MOST_TASKS", 8)
    ours, plain, cols = CASES[case]
    assert got(ours(frame(spark, corpus()).repartition(2)), *cols) == plain(corpus())


@pytest.mark.parametrize("query, case", [("op1_substring_dedup", "substring"), ("op10_line_dedup", "lines"), ("op4_suffix_array_dedup", "suffix")])
def test_queries_on_documents(spark, sf, query, case):
    rows = [(r["doc_id"], r["text"]) for r in Q.table(spark, sf, "documents").collect()]
    assert sorted(tuple(r) for r in Q.queries()[query](spark, sf).collect()) == CASES[case][1](rows)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300).map(lambda b: bytes(x % 4 for x in b)))
def test_two_stage_sorting_orders_suffixes(text):
    order = suffix_array(np.frombuffer(text, np.uint8), 600)
    assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text)))
    wanted = np.frombuffer(text, np.uint8) % 3 == 1
    order = suffix_array(np.frombuffer(text, np.uint8), 600, wanted)
    assert [text[i:] for i in order] == sorted(text[i:] for i in np.flatnonzero(wanted))


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=200).map(lambda b: bytes(x % 2 for x in b)), st.sampled_from([8, 9, 16, 20]))
def test_repeated_starts(text, length):
    starts = np.arange(len(text)) + length <= len(text)
    found = repeated_starts(np.frombuffer(text, np.uint8), starts, length)
    strings = [text[i : i + length] for i in range(len(text) - length + 1)]
    assert found[: len(strings)].tolist() == [strings.count(s) > 1 for s in strings]


def test_perfect_hash_is_minimal():
    r = np.random.default_rng(1)
    keys, prints = r.integers(0, 2**64, 20_000, dtype=np.uint64), r.integers(0, 2**32, 20_000, dtype=np.uint32)
    assert sorted(PerfectHash.of(keys, prints).index(keys, prints)) == list(range(len(keys)))


def test_lines_of_equal_keys_keep_their_own_places():
    keys = np.repeat(np.arange(50, dtype=np.uint64), 40)  # forty lines collide in each key
    prints, docs, ones = np.arange(2000, dtype=np.uint32), np.arange(2000) + 7, np.ones(2000, np.int64)
    twice = lambda x, y: np.concatenate([x, y])
    made = LineIndex.of(twice(keys, keys[::2]), twice(prints, prints[::2]), twice(docs, docs[::2] - 5), twice(ones, ones[::2]))
    index = LineIndex.from_bytes(made.to_bytes())
    counts, first = index.probe(keys, prints)
    assert counts.tolist() == [2, 1] * 1000 and first.tolist() == [d - 5 if i % 2 == 0 else d for i, d in enumerate(docs.tolist())]
    assert LineIndex.of(keys[:0], prints[:0], docs[:0], ones[:0]).probe(keys[:2], prints[:2])[0].tolist() == [0, 0]


def test_chunks_are_bounded_by_bytes_and_rows(spark, monkeypatch):
    from yearbook.llm import exchange

    monkeypatch.setattr(exchange, "CHUNK_BYTES", 1 << 16)
    rows = [(i, "x" * (200_000 if i % 50 == 7 else 40_000 if i % 3 == 0 else 3)) for i in range(400)]
    dealt = exchange.Chunks(spark.createDataFrame([*rows, (400, None)], "doc_id long, text string").repartition(3)).table.collect()
    held = {}
    for r in dealt:
        held.setdefault(r["chunk"], []).append(len(r["text"] or ""))
    assert sorted((r["doc_id"], r["text"]) for r in dealt if r["doc_id"] < 400) == rows and len(dealt) == 401
    assert all(sum(n + 16 for n in some) <= 1 << 16 or len(some) == 1 for some in held.values())
    # no chunk is smaller than it must be: two in a row would not fit one
    assert len(held) <= 2 * sum(len(t) + 16 for _, t in rows) // (1 << 16) + 3 + 8


def test_sizes_follow_the_bytes(spark):
    from yearbook.llm.exchange import MOST_CHUNK, MOST_SHARD, MOST_TASKS, Sizes

    for total in (10**8, 5 * 10**8, 3 * 10**10, 10**12, 10**14):
        s = Sizes(spark, total)
        assert s.chunk <= MOST_CHUNK and total / s.shards <= MOST_SHARD and s.tasks <= max(MOST_TASKS, 8) and s.buckets <= max(MOST_TASKS, 8)
        cells = max(1, total // s.chunk) * s.shards
        assert total / cells >= 100  # bytes of text to a cell


def test_minima():
    v = np.random.default_rng(2).integers(0, 99, 500).astype(np.uint64)
    assert minima(v, 7).tolist() == [min(v[i : i + 7]) for i in range(494)]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=120).map(lambda b: bytes(x % 2 for x in b)), st.sampled_from([1, 7, 8, 9, 30]))
def test_common_prefixes(text, most):
    order = suffix_array(np.frombuffer(text, np.uint8), most)
    a, b = order[:-1], order[1:]
    plain = [next((k for k in range(most) if text[i + k : i + k + 1] != text[j + k : j + k + 1] or max(i, j) + k >= len(text)), most) for i, j in zip(a, b)]
    assert common_prefixes(np.frombuffer(text, np.uint8), a, b, most).tolist() == plain


@pytest.mark.parametrize("case", CASES)
def test_texts_are_not_shuffled(spark, case):
    """The last stage reads the chunks from their buckets; only answers cross the network."""
    plan = CASES[case][0](frame(spark, corpus()))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "hashpartitioning(chunk" in exchanges[0] and "Bucketed: true" in plan
    assert "text" not in plan[plan.index("Exchange") :].split("\n", 2)[1]
