from yearbook.plans import registry


def test_chunks_are_the_whole_texts(spark, sf):
    rows = registry.queries()["text_chunk_rows"](spark, sf).collect()
    whole = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["place"])):
        assert 0 < len(r["chunk"]) <= 1000
        whole[r["doc_id"]] = whole.get(r["doc_id"], "") + r["chunk"]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert whole == {d: t for d, t in docs.items() if t} and len(rows) > len(whole)
