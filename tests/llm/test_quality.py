import random
import zlib

import numpy as np
import pytest
import brute_llm as brute
from brute_llm import base_rules
from pyspark.sql import functions as F

from yearbook.llm import queries as Q
from yearbook.llm.rulefit import FEATURES, Model, Rule, features, fit, learned, scored
from yearbook.llm.rules import RULES, cascade, quality_rules
from yearbook.llm.stats import Texts


def odd():
    r = random.Random(9)
    some = lambda n: " ".join(r.choice(["a", "Bé", "cc", "d|d", "ñu", "x!", "#y", "日本"]) for _ in range(n))
    return [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "a b c d e " * 3), (6, "line\nline\n\nline x\n \nline"), (7, some(4000)), (None, some(30)), (9, some(30)), (9, some(30)), (10, "z" * 5000), (11, "GO NOW " * 40)]


COLS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base(spark, sf):
    df = spark.createDataFrame([(d, t, True) for d, t in odd()], "doc_id long, text string, kept boolean")
    key = lambda r: (r[0] or 0, *r[1:])
    got = quality_rules(df).collect()
    assert sorted(key([r[c] for c in COLS]) for r in got) == sorted(key(r) for r in base_rules([(d or 0, t) for d, t in odd()]))
    assert all(r["kept"] == (not r["base_failed"] and r["rejected_by"] is None) for r in got)
    assert quality_rules(df.limit(0)).collect() == []
    docs = [(r["doc_id"], r["text"]) for r in Q.table(spark, sf, "documents").collect()]
    assert sorted(tuple(r[c] for c in COLS) for r in Q.queries()["op3_quality_rules"](spark, sf).collect()) == base_rules(docs)


def test_order_does_not_change_verdicts():
    texts = [(t or "").encode() for _, t in odd()]
    alone = np.any([np.asarray(rule(Texts(texts))) for rule in RULES.values()], axis=0)
    for order in (list(RULES), list(RULES)[::-1]):
        assert ((cascade(texts, order, RULES) >= 0) == alone).all()


def test_rules_keep_clean_documents(spark):
    docs, labels = (Q.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    got = quality_rules(docs).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("share")).collect()
    share = {r["quality"]: r["share"] for r in got}
    assert share[1] > 0.9 and share[0] < 0.2


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.queries()["op7_quality_classifier"](spark, sf).join(Q.table(spark, sf, "labels"), "doc_id").collect()
    aside = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == r["quality"] for r in aside]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_columns_equal_the_model(spark):
    r = np.random.default_rng(3)
    docs = odd()
    x = features([(t or "").encode() for _, t in docs])
    model = Model(0.3, [Rule(((0, True, 20.0), (3, False, 0.1))), Rule(((4, True, 0.5),))], [1.5, -2.0])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((row["doc_id"] or 0), round(row["score"], 9)) for row in scored(df, model, carry=("doc_id",)).collect())
    assert got == sorted(((d or 0), round(s, 9)) for (d, _), s in zip(docs, model.score(x).tolist()))
    assert scored(df.limit(0), model, carry=("doc_id", "text")).collect() == []
    y = r.integers(0, 2, 300).astype(float)
    z = r.random((300, len(FEATURES)))
    z[:, 2] += y
    assert np.mean((fit(z, y).score(z) > 0.5) == y) > 0.9


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 0), (2, 1, 0), (3, 0, 0), (99, 0, 1), (None, 1, 1), (4, None, 1)]])
def test_few_labels(spark, labels):
    df = spark.createDataFrame(odd(), "doc_id long, text string")
    model = learned(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "quality")
    assert scored(df, model).count() == len(odd())


def test_scores_equal_a_plain_reading_of_the_rules(spark, sf):
    docs, labels = (Q.table(spark, sf, t) for t in ("documents", "labels"))
    model = learned(docs, labels, "quality")
    rules = [r.conditions for r in model.rules]
    assert rules and len(rules) == len(model.weights)
    expected = {r["doc_id"]: brute.score(brute.features(r["text"]), model.base, rules, model.weights) for r in docs.collect()}
    got = Q.queries()["op7_quality_classifier"](spark, sf).collect()
    assert len(got) == len(expected)
    for r in got:
        assert abs(r["score"] - expected[r["doc_id"]]) < 1e-9 and r["predicted"] == int(r["score"] >= 0.3)


def test_features_equal_plain_ones():
    texts = [t for _, t in odd()] + ["É Ça \xd7 ÿ ÀB!?.,| #1 " * 9, "Same same SAME\nx\nx"]
    assert np.allclose(features([(t or "").encode() for t in texts]), [brute.features(t) for t in texts])


def test_clashing_columns(spark):
    # the documents' own columns have the names of statistics, of results and of the operator's inner columns
    rows = [(d, t, 5.0, 7, "x", 1) for d, t in odd()]
    df = spark.createDataFrame(rows, "doc_id long, text string, words double, score int, carried string, predicted int")
    model = Model(0.1, [Rule(((0, True, 20.0),))], [1.0])
    got = scored(df.drop("score", "predicted"), model, carry=("doc_id", "words", "carried")).collect()
    assert len(got) == len(rows) and {(r["words"], r["carried"]) for r in got} == {(5.0, "x")}
    assert quality_rules(df.withColumnRenamed("words", "n_words")).count() == len(rows)
    # with labels of their own, too
    labels = spark.createDataFrame([(d, d % 2) for d, _ in odd() if d], "doc_id long, quality int")
    assert scored(df, learned(df.withColumn("quality", F.lit(9)), labels, "quality")).count() == len(rows)
