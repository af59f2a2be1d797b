import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from yearbook.llm import queries as Q
from yearbook.llm.ans import CHECKPOINT, LANES, Table, coded_tokens, read_tokens, write_tokens
from yearbook.llm.exchange import shared_dir
from yearbook.llm.packing import Packing, Search, dealt, pack
from yearbook.llm.tokens import Encoder, tokenizer

PATH = Q.tokenizer_path()
PARTS = ["it's", "don'T", "<|endoftext|>", "<|ENDOFTEXT|>", "a<b", "É", "é", "ÀÈ", "×a", "a÷", "…!!", "!!…", "\xa0x", "12ab3", "ß", "ÿŸ", "日本", "\x00", "İ", "\x85q", "ﬁ", "á", "́", "'S", "_x-", "Ça", "\x1cq", " ", "\n", "\t "]


def ids_of(text):
    return tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, part int")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_encoder_equals_the_library(text):
    ids, n = Encoder(PATH).encode([b"", text.encode(), b"a"])
    assert n.tolist() == [0, len(ids_of(text)), 1] and ids[:-1].tolist() == ids_of(text)


@pytest.mark.parametrize("n", [0, 1, LANES - 1, LANES, 5 * LANES + 3, 64 * LANES, 64 * LANES + 1, 200 * LANES + 1, 1300 * LANES + 9])
def test_ans_round_trip(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.geometric(0.01, n), 49_407).astype(np.uint32)
    table = Table(np.bincount(ids, minlength=3))
    states, points, stream = table.encode(ids)
    assert (table.decode(n, states, stream) == ids).all()
    assert (table.decode_block(n, states, points, stream) == ids).all() and len(points) == max(0, -(-n // LANES) - 1) // CHECKPOINT * (16 + 8 * LANES)
    step = 16 + 8 * LANES
    for i in range(0, len(points), step):
        row, place = np.frombuffer(points[i : i + 16], np.uint64).tolist()
        assert (table.decode(n, points[i + 16 : i + step], stream, row, place) == ids[row * LANES :]).all()


def rows():
    r = random.Random(5)
    return [(7, None), (3, ""), (9, "word " * 9000), (1, "x"), (None, "Hello"), (3, "again"), *((i, "".join(r.choice(PARTS) + " " for _ in range(r.randrange(60)))) for i in range(20, 90))]


def test_token_files(spark):
    key = lambda d: (d is not None, d or 0)
    got = sorted(coded_tokens(frame(spark, rows()), PATH).collect(), key=lambda r: r["start"])
    assert [key(r["doc_id"]) for r in got] == sorted(key(d) for d, _ in rows())
    start = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (start, len(r["ids"]) // 4)
        start += r["n_tokens"]
    assert sorted((key(r["doc_id"]), bytes(r["ids"])) for r in got) == sorted((key(d), np.array([*ids_of(t), 2], "<u4").tobytes()) for d, t in rows())


def test_damaged_block_raises(spark):
    path = shared_dir(spark)
    write_tokens(frame(spark, rows()), path, PATH)
    blocks = spark.read.parquet(f"{path}/blocks")
    blocks.withColumn("crc32", blocks.crc32 + 1).write.parquet(f"{path}-bad/blocks")
    spark.read.parquet(f"{path}/table").write.parquet(f"{path}-bad/table")
    with pytest.raises(Exception, match="is damaged"):
        read_tokens(spark, f"{path}-bad").collect()


def check_packing(got, expected, size):
    seen = {}
    for r in got:
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in seen.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(expected)
    return len(seen)


def expected_pieces(docs, size):
    for d, t in docs:
        ids = [*ids_of(t), 1]
        for piece, start in enumerate(range(0, len(ids), size)):
            yield d or -1, piece, start, len(ids[start : start + size]), crc(ids[start : start + size])


def test_packing(spark, sf):
    check_packing(pack(frame(spark, rows()).repartition(3), PATH, 64).collect(), expected_pieces(rows(), 64), 64)
    docs = [(r["doc_id"], r["text"]) for r in Q.table(spark, sf, "documents").collect()]
    expected = list(expected_pieces(docs, 4096))
    n = check_packing(Q.queries()["op5_best_fit_packing"](spark, sf).collect(), expected, 4096)
    assert n == -(-sum(x[3] for x in expected) // 4096)


def test_empty(spark):
    assert pack(frame(spark, []), PATH).collect() == []
    assert coded_tokens(frame(spark, []), PATH).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_local_search_keeps_pieces_and_never_adds_bins(pieces):
    first = dealt(pieces, 30)
    search = Search(first, 30)
    search.run()
    assert sorted(x for b in search.bins for x in b) == sorted(pieces) and all(sum(b) <= 30 for b in search.bins)
    assert search.least <= search.left == sum(map(bool, search.bins)) <= len(first)
    squares = lambda bins: sum(sum(b) ** 2 for b in bins)
    assert squares(search.bins) >= squares(first)


@pytest.mark.parametrize("bins, found", [
    ([[3], [5, 2]], (1, (3,), ())),
    ([[5], [4, 5]], (1, (5,), (4,))),
    ([[2, 3], [4, 5]], (1, (3, 2), (4,))),
    ([[7], [2, 3, 4]], (1, (7,), (2, 4))),
    ([[2, 2], [7, 2]], None),
])
def test_each_kind_of_exchange(bins, found):
    search = Search(bins, 10)
    search.leave(0)
    assert (search.move(0) or search.swap(0, 1) or search.swap(0, 2) or search.one_for_two(0)) == found


def test_local_search_empties_a_bin():
    # 6+4, 6+4 and 5+5 fill three bins of 10
    search = Search([[6], [6, 4], [5, 4], [5]], 10)
    search.run()
    assert search.left == 3


def plain_search(bins, size):
    """Every exchange tried in every order, until the squared fills no longer grow."""
    bins, again = [list(b) for b in bins], True
    while again:
        again = False
        for i, a in enumerate(bins):
            for j, b in enumerate(bins):
                sets = lambda x: [(), *((p,) for p in x), *((x[p], x[q]) for p in range(len(x)) for q in range(p))]
                for give in sets(a):
                    for take in sets(b):
                        if i == j or not give or len(give) + len(take) > 3:
                            continue
                        gain = sum(give) - sum(take)
                        if gain > 0 and sum(b) + gain <= size and gain > sum(a) - sum(b):
                            for x in give:
                                a.remove(x)
                            for x in take:
                                b.remove(x)
                            a += take
                            b += give
                            again = True
                            break
                    else:
                        continue
                    break
    return [b for b in bins if b]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=14))
def test_where_the_search_ends_no_exchange_helps(pieces):
    search = Search(dealt(pieces, 20), 20)
    search.run()
    found = [b for b in search.bins if b]
    assert search.left == search.least or sorted(map(sorted, plain_search(found, 20))) == sorted(map(sorted, found))


def test_packing_of_300000_pieces():
    r = np.random.default_rng(4)
    lengths = np.minimum(4096, r.lognormal(6, 1.1, 300_000).astype(np.int64) + 1)
    values, counts = np.unique(lengths, return_counts=True)
    packing = Packing(dict(zip(values.tolist(), counts.tolist())), 4096)
    order = np.argsort(lengths, kind="stable")
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths)) - np.repeat(np.cumsum(counts) - counts, counts)
    sequence, offset = packing.at(lengths, rank)
    order = np.lexsort((offset, sequence))
    sequence, offset, lengths = sequence[order], offset[order], lengths[order]
    new = np.append(True, np.diff(sequence) != 0)
    ends = offset + lengths
    assert (offset[new] == 0).all() and (offset[1:][~new[1:]] == ends[:-1][~new[1:]]).all() and ends.max() <= 4096
    assert new.sum() <= 1.001 * -(-lengths.sum() // 4096)
    assert packing.left < 0.9 * packing.dealt


@pytest.mark.parametrize("unit", [1, 2, 7, 100])
def test_grouped_packing_places_every_piece(unit):
    counts = {1: 9, 3: 4, 7: 5, 10: 3}
    packing = Packing(counts, 10, unit)
    lengths = np.repeat(list(counts), list(counts.values()))
    sequence, offset = packing.at(lengths, np.concatenate([np.arange(n) for n in counts.values()]))
    for s in set(sequence.tolist()):
        some = sorted(zip(offset[sequence == s].tolist(), lengths[sequence == s].tolist()))
        assert [o for o, _ in some] == np.cumsum([0, *(n for _, n in some)])[:-1].tolist() and sum(n for _, n in some) <= 10
