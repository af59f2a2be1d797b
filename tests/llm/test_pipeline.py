import corpus_pipeline as P
from brute_llm import benchmark, lines
from test_simhash import plain, plain_print
from test_tokens import check_packing, expected_pieces

from yearbook.llm import queries as Q
from yearbook.llm.exchange import written
from yearbook.llm.rulefit import learned, scored


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark, sf):
    docs = Q.table(spark, sf, "documents")
    columns = docs.columns
    stages = dict(P.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "best-fit packing"]

    kept = written(stages["quality classifier"](spark, docs, sf))
    model = learned(docs, Q.table(spark, sf, "labels"), "quality")
    good = {r["doc_id"] for r in scored(docs, model, carry=("doc_id",)).where("predicted = 1").collect()}
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == good and 0 < len(good) < docs.count()

    lined = written(stages["line dedup"](spark, kept, sf))
    assert lined.columns == columns and lined.dtypes == docs.dtypes
    assert [x[0] for x in sorted(rows(lined))] == sorted(good) and all(r["n_chars"] == len(r["text"]) for r in lined.collect())
    assert sorted((d, len(t.split("\n"))) for d, t in rows(lined) if t) == [(d, n - m) for d, n, m, _ in lines(rows(kept)) if n > m and dict(rows(lined))[d]]

    single = written(stages["simhash near-dedup"](spark, lined, sf))
    parts = plain(rows(lined), [plain_print(t) for _, t in rows(lined)])
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted({c for _, _, c in parts})

    clean = written(stages["benchmark decontamination"](spark, single, sf))
    hit = {x[0] for x in benchmark(rows(single), [tuple(r) for r in Q.table(spark, sf, "benchmark").collect()]) if x[-1]}
    assert clean.columns == columns and sorted(r["doc_id"] for r in clean.collect()) == sorted({r["doc_id"] for r in single.collect()} - hit) and hit

    packed = stages["best-fit packing"](spark, clean, sf).collect()
    check_packing(packed, expected_pieces(rows(clean), 4096), 4096)
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, P.run(spark, sf).collect())) == sorted(map(key, packed))


def test_equal_ids_and_nulls(spark):
    some = spark.createDataFrame([(1, "a b c d e", "x"), (1, "a b c d e", "y"), (None, "a b c d e", "z"), (None, None, "n"), (3, "", "e")], "doc_id long, text string, row string")
    got = P.one_of_each(some).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(1, "a b c d e"), (3, "")]
    assert P.line_dedup(spark, some, "").columns == ["doc_id", "text", "row"]
    assert P.one_of_each(some.limit(0)).collect() == []
