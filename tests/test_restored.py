from palimpsest.plans import detection


def test_documents_are_searched_once(spark, tmp_path):
    """All that is read is the kept spans, never the table again."""
    docs = [(k, "en", "web" if k % 3 else None, f"write to user{k}@example.com or 10.0.0.{k}, café № {k}") for k in range(8)] + [(8, "en", "web", "nothing"), (9, "en", "web", None)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    back = detection.restored(spark, str(tmp_path))
    leaves = back._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert {leaves.apply(k).nodeName() for k in range(leaves.size())} == {"InMemoryRelation"}
    assert {(r.doc_id, r.whole) for r in back.collect()} == {(k, True) for k in range(8) if k % 3}
