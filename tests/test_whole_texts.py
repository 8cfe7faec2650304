from palimpsest.plans import detection


def test_tokens_and_invisible_characters_of_whole_texts(spark, tmp_path):
    d = str(tmp_path)
    texts = [(1, "a " * 500_010), (2, "x" * 60 + "​" + "y"), (3, "x" * 60 + "y")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    assert {r.doc_id: r.n_tokens for r in detection.simple_tokens(spark, d).collect()}[1] == 500_011
    got = {r.doc_id: r.clean_md5 for r in detection.QUERIES["invisible_texts"](spark, d).collect()}
    assert got[2] == got[3] != got[1]
